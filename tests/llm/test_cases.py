"""Operators beyond former limits, both ways of switches, awkward names and repeated ids, each against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import common, decontaminate, langid, licenses, linededup, mixing, neardup, quality, secrets, warc
from weekloom.llm.common import table, tokenizer_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string")


def test_hot_keys_meet_their_row(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(400)] + [(500, None)], "id long, key string")
    sums = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = {(r.id, r.key, r.low) for r in common.joined(rows, sums, ["key"], "n", 401, "id").collect()}
    low = {r.key: r.low for r in sums.collect()}
    assert got == {(r.id, r.key, low[r.key]) for r in rows.collect() if r.key}
    assert common.joined(rows, sums, ["key"], "n", 401, "id", "left").count() == 401


# ---------------------------------------------------------------- language ID


@pytest.fixture(scope="module")
def model():
    pieces = langid.vocabulary(tokenizer_path(langid.VOCABULARY))
    p = np.random.default_rng(1).random((max(pieces.values()), 2))
    return langid.Model(("a", "b"), pieces, p / p.sum(0), np.log([0.3, 0.7]))


def test_words_of_any_length_are_segmented_whole(model):
    counts = np.array([2.0, 3.0])
    for word in ("haus", "internationalization", "ünderstænding", "x", "zzéq"):
        alpha, _ = langid.forward([word], model)
        total, expected = langid.long_word(word, model, counts)
        assert np.allclose(np.log(alpha[0, len(word)]), total) and np.allclose(langid.expected_counts([word], counts[None], model), expected)
    word = "haus" * 40
    by_hand = {0: np.zeros(2)}
    for b in range(1, len(word) + 1):
        arcs = [(a, k) for a in range(b) if (k := model.pieces.get(word[a:b]))] + [(0, k) for k in [model.pieces.get("▁" + word[:b])] if k]
        arcs += [] if any(a == b - 1 for a, _ in arcs) else [(b - 1, 0)]
        by_hand[b] = np.logaddexp.reduce([by_hand[a] + (np.log(model.p[k - 1]) if k else np.log(langid.RARE)) for a, k in arcs])
    assert np.allclose(by_hand[len(word)], langid.long_word(word, model)[0])


def test_scores_do_not_depend_on_what_is_kept(model, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeinst") for _ in range(rng.choice([3, 6, 9, 50]))) for _ in range(20)) for _ in range(60)] + [None, "12", "½ ² ①"]
    whole = langid.Scorer(model)(texts)
    monkeypatch.setattr(langid, "CACHE", 40)
    few = langid.Scorer(model)(texts)
    assert whole[0] == few[0] and np.allclose(whole[1], few[1]) and whole[0][-3:] == ["und"] * 3
    assert langid.count_words("x²y Haus ½haus Straße") == Counter({"haus": 2, "x": 1, "y": 1, "straße": 1})


def test_held_out_documents_are_told(spark):
    docs = table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.report(docs).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)


# ---------------------------------------------------------------- near duplicates


def test_two_texts_under_one_id(spark):
    docs = docs_of(spark, [(5, "alpha beta gamma delta x y z"), (5, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten ten"), (None, "q q"), (7, None)])
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.report(docs, width=2).collect()}
    assert got == {(5, 6): (5, True), (5, 9): (2, False), (2, 10): (2, True), (None, 1): (None, True), (7, 0): (7, True)}
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in neardup.dedup(docs, width=2).collect()) == [("2", "one t"), ("5", "alpha"), ("7", ""), ("None", "q q")]


def test_large_component_with_an_outlier(spark, monkeypatch):
    """Many near copies of one text, and two texts that share buckets with them but are too far."""
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(80)] * 3
    far = [" ".join(base[:64] + [f"y{j}_{i}" for i in range(16)]) for j in range(2)]
    texts = [f"{t} {k}" for k, t in enumerate(texts)] + far
    sets = [frozenset(zip(x.split(), x.split()[1:])) for x in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    for limit in (neardup.MAX_BROADCAST, 0):
        monkeypatch.setattr(neardup, "MAX_BROADCAST", limit)
        assert {r.doc_id: r.component_id for r in neardup.report(docs_of(spark, enumerate(texts)), width=2).collect()} == dict(enumerate(group))


# ---------------------------------------------------------------- lines, quality, mixing, benchmark


def test_line_dedup_both_ways(spark):
    rng = random.Random(4)
    line = lambda: f"a line of the corpus that is long enough to count {rng.randrange(30)}"
    docs = docs_of(spark, [(k, "\n".join(line() for _ in range(rng.randrange(6)))) for k in range(60)] + [(3, line()), (None, line()), (90, None)])
    rows = [sorted(map(tuple, linededup.report(docs, max_broadcast=n).collect()), key=str) for n in (0, 100)]
    assert rows[0] == rows[1] and sum(r[2] for r in rows[0]) > 20


def test_line_dedup_joins_texts_alike_at_any_size(spark, capsys):
    docs = docs_of(spark, [(k, f"a line that is long enough and stands in all of the documents\nown {k}") for k in range(8)])
    for n in (0, 100):
        out = linededup.report(docs, max_broadcast=n)
        out.explain()
        assert "SortMergeJoin" in capsys.readouterr().out
        assert sorted(r.n_dropped for r in out.collect()) == [0] + [1] * 7


@pytest.mark.parametrize("bits", [64, 12, 2])
def test_repeated_windows_when_hashes_meet(spark, bits):
    rng = random.Random(bits)
    texts = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(250)))) for k in range(30)]
    want = {}
    for k, t in texts:
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        want[k] = len({i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)})
    assert {r.doc_id: r.n_repeat_words for r in quality.measures(docs_of(spark, texts), bits).collect()} == want


def test_good_documents_pass_the_rules(spark):
    told = quality.report(table(spark, "/root/testdata/sf0.01", "documents")).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in told.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_mixing_both_ways_and_clashing_names(spark):
    rows = [(k if k % 50 else None, f"t{k}", None if k % 5 == 0 else "big" if k % 3 else "small", 1, "x", "y") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __copy long, __rate string, row string")
    out = [sorted(map(tuple, mixing.mix(docs, max_broadcast=n).collect()), key=str) for n in (0, 10)]
    assert out[0] == out[1] and len(out[0]) > 100 and mixing.mix(docs).columns == ["doc_id", "text", "source", "__rate", "row", "__copy", "__order"]


def test_clean_keeps_columns_and_judges_texts(spark):
    rows = [(1, "a b c d e f g h i j k l", "x", 1), (1, "nothing of it", "x", 2), (None, "z a b c d e f g h i j", "y", 3), (4, None, "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __bad_id string, text_hash long")
    bench = spark.createDataFrame([(7, "A b c d e f g h i j")], "item_id long, text string")
    got = decontaminate.clean(docs, bench)
    assert sorted(r.text_hash for r in got.collect()) == [2, 4] and got.columns == docs.columns


# ---------------------------------------------------------------- WARC


def test_archives_are_members_and_digests_are_checked(spark, tmp_path):
    import gzip
    from pathlib import Path

    html = ["<p>a</p>", "<p>a</p>", None, "x" * ((1 << 24) + 5), "<p>a</p>", "<p>a</p>"]
    page = [0, 1, 2, 3, None, 0]
    pages = spark.createDataFrame(list(zip(page, ["http://x/ y"] * 6, html, ["d"] * 6)), "page_id long, url string, html string, digest string")
    path = f"{tmp_path}/w"
    warc.write(pages, path, file_bytes=600)
    files = [x for x in sorted(Path(path).glob("*.txt"))]
    read = [r for f in files for r in warc.parse(f.read_bytes(), f.name)]
    assert len(files) > 2 and Counter(r["type"] for r in read) == {"request": 6, "metadata": 6, "response": 4, "revisit": 2}
    one = next(r for r in read if r["type"] == "response" and r["payload"] == b"<p>a</p>")
    data = (Path(path) / one["file"]).read_bytes()
    assert next(warc.members(data[one["offset"] :]))[1].endswith(b"\r\n\r\n<p>a</p>\r\n\r\n") and b"".join(x for _, x in warc.members(data)) == gzip.decompress(data)
    got = Counter(map(tuple, warc.report(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == {(0, 8, "response", None): 2, (1, 8, "revisit", 0): 1, (2, 0, "response", None): 1, (3, (1 << 24) + 5, "response", None): 1, (None, 8, "revisit", 0): 1}
    bad = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<u:1>"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(bad)
    r = warc.assemble(warc.records(spark, f"{tmp_path}/bad")).first()
    assert r.response.digest == "WRONG" and r.response.payload_digest == warc.base32(__import__("hashlib").sha1(b"body").digest())


# ---------------------------------------------------------------- secrets, licences


def test_planted_findings_are_told_apart(spark):
    n = secrets.held_out_counts(table(spark, SF, "documents"))
    assert n["tp"] + n["fn"] > 300 and n["tp"] >= 0.97 * (n["tp"] + n["fp"]) and n["tp"] >= 0.97 * (n["tp"] + n["fn"])


def test_base_counts_of_licences(spark):
    rng = random.Random(6)
    pool = ["MIT", "License", "apache", "license", "General", "public", "x", "mit license", "general public license,", "é"]
    texts = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for k in range(60)] + [(99, None), (98, "")]
    got = {r.doc_id: r for r in licenses.report(docs_of(spark, texts)).collect()}
    for k, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at = [(i, label) for i in range(len(w)) for phrase, label in licenses.PHRASES if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


# ---------------------------------------------------------------- the pipeline


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    rng = random.Random(8)
    words = {"en": "the house of many green letters and other things that water before people number".split(), "de": "das haus der vielen grünen buchstaben und anderen dinge wasser vor leute zahl".split()}
    item = " ".join(rng.choice(words["en"]) for _ in range(12))
    rows = []
    for k in range(160):
        lang = ("en", "de")[k % 2]
        w = [rng.choice(words[lang]) for _ in range(60)]
        rows.append([k, " ".join(w), lang, "small" if k % 8 == 0 else "big"])
    rows += [[200 + k, " ".join(rows[k][1].split()[:-1] + ["other"]), rows[k][2], "big"] for k in range(10)]  # near copies
    rows += [[300 + k, rows[k + 20][1], rows[k + 20][2], "small"] for k in range(5)]  # copies
    rows += [[400, f"people {item} water", "en", "big"], [401, None, "en", "big"], [402, "12 34", "en", "big"], [403, "", None, None]]
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        kept.append(Counter(r.doc_id for r in docs.collect()))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    known = {r[0]: r for r in rows if re.search("[a-z]", r[1] or "")}
    assert kept[0] == dict.fromkeys(known, 1)
    sets = {k: {tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for k, r in known.items()}
    group = {k: k for k in known}
    for a in sorted(known):
        for b in sorted(known):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = {k: group[a] if g == group[b] else g for k, g in group.items()}
    single = {k for k in known if group[k] == k}
    assert kept[1] == dict.fromkeys(single, 1) and len(single) == len(known) - 15
    clean = single - {400}
    assert kept[2] == dict.fromkeys(clean, 1) and set(kept[3]) <= clean and sum(kept[3].values()) > 100
    # the mix, and its token file: whole, each document as often as drawn, copies apart from each other
    per = Counter(known[k][3] for k in clean)
    total = sum(n**0.5 for n in per.values())
    for k in clean:
        rate = round(len(clean) / total * per[known[k][3]] ** 0.5 / per[known[k][3]], 9)
        u = int(__import__("hashlib").md5(f"1|{k}|1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, upto = 0, np.exp(-rate), np.exp(-rate)
        while u >= upto:
            n += 1
            p *= rate / n
            upto += p
        assert kept[3][k] == n
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {k: [*t.encode(known[k][1], add_special_tokens=False).ids, 1] for k in clean}
    got = sorted(docs.collect(), key=lambda r: r.start)
    assert kept[4] == kept[3] and [r.start for r in got] == np.cumsum([0, *[len(ids[r.doc_id]) for r in got]])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id])) for r in got)
    order = [r.doc_id for r in got]
    assert order != sorted(order) and any(a != b for a, b in zip(order, order[1:])) and sum(a == b for a, b in zip(order, order[1:])) < 20
