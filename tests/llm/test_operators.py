import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import components, decontaminate, langid, licenses, linededup, mixing, neardup, quality, secrets, tokenfile, warc
from weekloom.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, text_hash string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, None, None, 0, "x") for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None, None, None), (2, "", "en", "a", 1, ""), (None, "some text here", None, "a", 1, ""), (3, "the same words again and again", "en", "b", 1, ""), (3, "the same words again and again", "en", "b", 1, ""), (4, "wort " * 30000, "de", None, 1, ""), (5, " \n\t ", "de", "a", 1, ""), (6, "12 34 !!", "en", "a", 1, "")]
    return spark.createDataFrame(rows, SCHEMA)


def each(spark, docs):
    bench = spark.createDataFrame([(1, "same words again"), (None, "x"), (2, None)], "item_id long, text string")
    yield decontaminate.report(docs, bench)
    yield linededup.report(docs)
    yield warc.report(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), F.lit(1).alias("digest")))
    yield neardup.report(docs)
    yield langid.report(docs)
    yield quality.report(docs)
    yield secrets.report(docs)
    yield licenses.report(docs)
    yield tokenfile.report(docs)


def test_awkward_rows(spark, awkward):
    n = awkward.count()
    for k, out in enumerate(each(spark, awkward)):
        assert out.count() == n if k != 6 else out.count() >= 0, k
    assert mixing.report(awkward).count() >= 0


def test_empty_table(spark, awkward):
    for out in each(spark, awkward.limit(0)):
        assert out.count() == 0
    assert mixing.report(awkward.limit(0)).count() == 0


def test_decontamination_marks_words_both_ways(spark):
    rng = random.Random(1)
    word = lambda: "w" + str(rng.randrange(60))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 8, 10, 14, 25])))) for k in range(12)]
    texts = []
    for k in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if k % 2:
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            w[len(w) // 2 : len(w) // 2] = own[a : a + rng.randrange(1, 25)]
        texts.append((k, " ".join(w).upper() if k % 3 == 0 else " ".join(w)))
    want = {}
    for k, t in texts:
        w, hit, ids = t.translate(LOW).split(), set(), set()
        for item, x in items:
            x = x.split()
            size = min(10, len(x))
            own = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in own:
                    hit |= set(range(i, i + size))
                    ids.add(str(item))
        want[k] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.MAX_BROADCAST, 0):
        got = decontaminate.report(docs_of(spark, texts), bench, max_broadcast=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    texts, base = [], [[f"v{rng.randrange(900)}" for _ in range(rng.randrange(20, 120))] for _ in range(8)]
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(2, len(w) // 12))):
            w[rng.randrange(len(w))] = f"v{rng.randrange(900)}"
        texts.append((k, " ".join(w)))
    texts += [(200, ""), (201, None), (202, "One"), (203, "one")]
    for width in (2, 5):
        sets = {}
        for k, t in texts:
            w = (t or "").translate(LOW).split()
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        group = {k: k for k in sets}
        pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        for _ in sets:
            for a, b in pairs:
                group[a] = group[b] = min(group[a], group[b])
        got = neardup.report(docs_of(spark, texts), width=width).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), group[k]) for k in sets}


def test_large_group_with_texts_just_too_far(spark, monkeypatch):
    """A group about one text, of which many are just below the threshold, is compared by differences to its centre."""
    monkeypatch.setattr(neardup, "DIRECT", 0)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for k in range(120):
        own = list(base)
        for at in rng.choice(60, rng.integers(1, 9), replace=False):
            own[at] = f"x{rng.integers(40)}" if k % 2 else f"y{k}_{at}"
        texts.append(" ".join(own))
    sets = [frozenset(zip(x.split(), x.split()[1:])) for x in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert 20 < len(set(group)) < 120
    got = {r.doc_id: r.component_id for r in neardup.report(docs_of(spark, enumerate(texts)), width=2).collect()}
    assert got == dict(enumerate(group))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in components.components(links).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_token_file_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(["Hello,", "wörld!", "it's", "IT'S", "x.y", "<|endoftext|>", "A<|ENDOFTEXT|>", "Σας", " z", "12a", "...", "don't'll"]) for _ in range(rng.randrange(30)))) for k in range(80)] + [(90, None), (91, "")]
    rng.shuffle(texts)
    t = Tokenizer.from_file(tokenizer_path(tokenfile.TOKENIZER))
    want, start = {}, 0
    for k, x in sorted(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[k] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.report(docs_of(spark, texts)).collect()} == want


def test_codes_are_short_and_bounded():
    import numpy as np

    counts = np.array([1 << k for k in range(24)])
    lengths = tokenfile.code_lengths(counts, 12)
    assert lengths.max() == 12 and sum(2.0 ** -int(n) for n in lengths) <= 1
    ids = np.random.default_rng(1).integers(0, 24, 5000)
    bits, begins = tokenfile.pack_bits(ids, tokenfile.canonical(lengths), lengths)
    at = np.arange(0, len(ids), tokenfile.BLOCK)
    assert (tokenfile.unpack_bits(bits, begins[at], np.minimum(tokenfile.BLOCK, len(ids) - at), tokenfile.decode_table(lengths)) == ids).all()


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    words = {"en": "the house of many green letters and other things that water".split(), "de": "das haus der vielen grünen buchstaben und anderen dinge wasser".split()}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(12)), x) for k in range(120) for x in [("en", "de")[k % 2]]] + [(500, "123 !", None)]
    got = {r.doc_id: r for r in langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows if got[k].held_out and x) and got[500].lang_pred == "und"
    assert {k for k in got if got[k].held_out} == {k for k in got if zlib.crc32(str(k).encode()) % 4 == 2}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = {"a": 1, "b": 2, "ab": 3, "▁": 0, "▁a": 4}
    p = np.array([[0.2], [0.3], [0.1], [0.4]])
    alpha, _ = langid.forward(["ab"], langid.Model(("x",), pieces, p, np.zeros(1)))
    assert abs(alpha[0, 2, 0] - (0.2 * 0.3 + 0.1 + 0.4 * 0.3)) < 1e-12


def test_licence_spans(spark):
    text = "x y " + licenses.TEMPLATES[0][1] + " z MIT License, mit license and the General Public License"
    r = licenses.scan(docs_of(spark, [(1, text), (2, "nothing of the kind")])).orderBy("doc_id").collect()
    assert r[0].n_base == 3 and "mit-text" in r[0].labels.split(",") and r[0].score == 1.0 and r[0].base_labels == "gpl,mit"
    span = next(s for s in r[0].spans if s.label == "mit-text")
    assert (span.first, span["last"]) == (2, len(licenses.words_of(licenses.TEMPLATES[0][1].encode())) + 1) and r[1].labels == "" and r[1].score < 0.1


def test_matching_statistics_by_brute_force():
    rng = random.Random(5)
    templates = tuple((str(k), " ".join(rng.choice("abc") for _ in range(20))) for k in range(3))
    a = licenses.Automaton(templates)
    file = [rng.choice("abcd") for _ in range(200)]
    spaced = [f" {t} " for _, t in templates]
    for end, (n, _) in enumerate(a.statistics([a.ids.get(c.encode(), -1) for c in file])):
        best = next(m for m in range(end + 1, -1, -1) if m == 0 or any(f" {' '.join(file[end - m + 1 : end + 1])} " in t for t in spaced))
        assert n == best


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\n"]
    pages = spark.createDataFrame([(k, f"http://x/{k} y" if k else None, t) for k, t in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.report(pages).collect()}
    assert [got[k].payload_bytes for k in range(5)] == [len((t or "").encode()) for t in html] and (got[1].record_type, got[1].refers_to) == ("revisit", 0)
    assert got[0].record_type == "response" and got[0].refers_to is None


def test_secrets_and_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["the", "er", "on", "ing", "and"]) for _ in range(3))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    texts = [(k, " ".join(word() for _ in range(40)) + (" " + key() if k % 2 else " " + word() * 3)) for k in range(80)]
    found = secrets.report(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in found if r.is_secret} == {k for k, _ in texts if k % 2}


def test_mixing_meets_the_rates(spark):
    rows = [(k, "t", "big" if k % 10 else "small") for k in range(4000)]
    mixed = mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"big": 1.0, "small": 1.0})
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 300
