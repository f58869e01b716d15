"""Suffix dedup, hard negatives and ball k-means against brute force."""

import hashlib
import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from weekloom.llm import centroids, negatives, suffixes


def _single(values):
    """Values of arrays of floats."""
    return None if values is None else [None if x is None else float(np.float32(x)) for x in values]


def _without_earlier(rows, n=50):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - n + 1 if i is not None else 0):
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1 if i is not None else 0):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(30)]
    rows = []
    for _ in range(120):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((r.randint(0, 140), " ".join(t[r.randrange(len(t)) :] + r.choice(base).split(" ") if r.random() < 0.3 else t)))
    odd = [(500, "a" * 3000), (501, "ab" * 500), (7, "a" * 70), (502, None), (503, ""), (None, rows[0][1]), (None, None), rows[3], (504, "x" * 49), (505, "x" * 50), (506, "x" * 50), (3, "\0" * 200), (600, "\0" * 120 + "\n")]
    return rows + odd


def test_suffix_dedup(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "keys": F.lit(1), "local": F.lit(2)}).repartition(3)
    want = _without_earlier(texts)
    assert sum(x[2] for x in want) > 10_000
    # one chunk; many small ones; runs that are too many for a task, whose windows Spark groups
    for options in ({}, {"chunk": 3000, "keys": 50}, {"chunk": 3000, "limit": 2000}):
        assert sorted(map(tuple, suffixes.report(docs, **options).collect()), key=str) == want
    assert suffixes.report(docs.limit(0)).count() == 0


def test_suffix_dedup_spans_and_other_lengths(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffixes.kept_bytes(docs, min_bytes=20).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == _without_earlier(texts, 20)
    assert all(sum(b - a for a, b in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed for r in got)
    with pytest.raises(ValueError):
        suffixes.kept_bytes(docs, min_bytes=8)


def test_a_passage_of_every_document_and_a_hot_key(spark):
    """One passage in all documents, each time between other words: its runs' keys are hot, with different text around them."""
    r = random.Random(5)
    passage = " ".join(str(r.randrange(10**6)) for _ in range(40))
    rows = [(i, " ".join([hex(r.randrange(1 << 60)), passage, hex(r.randrange(1 << 60))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _without_earlier(rows)
    for options in ({"chunk": 5000}, {"chunk": 5000, "limit": 1000}):
        assert sorted(map(tuple, suffixes.report(docs, **options).collect()), key=str) == want


def test_deep_shallow_is_the_order_of_the_suffixes():
    r = random.Random(9)
    for letters, size in (("ab", 400), ("abcdefgh", 3000), ("a", 200)):
        text = "".join(r.choice(letters) for _ in range(size)).encode() * 2
        data = np.frombuffer(text + bytes(80), np.uint8)
        starts = np.arange(len(text) - 60)
        for shallow in (0, 1, 3):
            order, group = suffixes.deep_shallow(data, starts, 50, shallow)
            cut = [text[a : a + 50] for a in starts[order].tolist()]
            assert cut == sorted(cut)
            assert [a == b for a, b in zip(cut, cut[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


def _mined(rows, every=100, scale=256):
    by = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = (label, [math.floor(scale * c) for c in v])
        by[i] = min(x, by.get(i, x))
    out = []
    for a, (label, v) in by.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m) for i, (m, w) in by.items() if i != a)
        for p, ps in [(i, -x) for x, i, m in ranked if m == label][:5]:
            fit = [(i, -x) for x, i, m in ranked if m != label and 80 * ps <= -100 * x <= 100 * ps][:5]
            out += [(a, p, k + 1, i, ps, x) for k, (i, x) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives(spark):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, r.randrange(10), [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for i in range(1200)]
    rows += [(5000 + i, 3, centres[0]) for i in range(300)]  # equal vectors: ties, and a cell that no cut divides
    rows += [(7000, None, centres[0]), (7001, 1, None), (7100, 1, [None] * 16), (7200, 2, [float("nan")] + [0.0] * 15), (7300, 4, [1.0, 2.0]), (7400, 4, []), (None, 4, centres[1])]
    rows += [(0, 1, centres[3]), (100, 9, centres[3]), (100, 9, centres[3]), (7500, 4, [-x for x in centres[0]]), (7600, 5, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"cell": F.lit("x"), "v": F.lit(1), "part": F.lit(0)}).repartition(3)
    single = [(i, label, _single(v)) for i, label, v in rows]
    for options in ({}, {"sample": 200, "cell": 100, "part": 60, "leaf": 16}, {"every": 20, "sample": 300, "cell": 200, "leaf": 32}):
        got = sorted(map(tuple, negatives.mined(df, **options).collect()))
        assert got == _mined(single, options.get("every", 100))
    assert negatives.mined(df.limit(0)).count() == 0
    assert negatives.mined(df.where("vec_id = 1")).count() == 0


def test_hard_negatives_beyond_what_doubles_hold(spark):
    rows = [(i, i % 3, [1000.0 * i, -1e4 - i]) for i in range(0, 3000, 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.mined(df, every=50).collect())) == _mined(rows, 50)


def _ball(rows, k=8, rounds=10):
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    cs = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in x]
        for j in range(len(cs)):
            own = [v for (_, v), b in zip(x, of, strict=True) if b == j]
            cs[j] = [sum(z) // len(own) for z in zip(*own, strict=True)] if own else cs[j]
    last = [near(v) for _, v in x]
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, j, d, sum(e for e, f in last if f == j), sum(e for e, _ in last), named[j]) for (i, _), (d, j) in zip(x, last, strict=True)], key=str)


def test_ball_kmeans(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 1.0, 2.0]) / (1 if i % 5 else 7) for _ in range(64)]) for i in range(150)]  # coarse values: ties
    rows += [(5, None), (6, [1.0] * 63), (7, [None] + [1.0] * 63), (8, [float("nan")] * 64), (None, [0.5] * 64), rows[3], rows[3], (300, [float("inf")] + [0.0] * 63), (301, [1e-3] * 64), (302, [-30000.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"ids": F.lit("x"), "cluster": F.lit(1), "label": F.lit(None)}).repartition(3)
    single = [(i, _single(v)) for i, v in rows]
    for block in (4096, 7):
        assert sorted(map(tuple, centroids.report(df, block=block).collect()), key=str) == _ball(single)
    assert centroids.report(df.limit(0)).count() == 0
    assert sorted(map(tuple, centroids.report(df.where("vec_id < 3")).collect()), key=str) == _ball([x for x in single if x[0] is not None and x[0] < 3])


def test_annuli_and_cores_change_nothing():
    r = np.random.default_rng(7)
    for _ in range(20):
        x, c = r.integers(-4, 5, (300, 3)), r.integers(-4, 5, (9, 3))
        plain, _ = centroids.assigned(x, c, None)
        every = np.stack([centroids.distances(x, k) for k in c])
        assert (plain == every.argmin(0)).all()
        again, best = centroids.assigned(x, c, r.integers(0, 9, 300))
        assert (again == plain).all() and (best == every.min(0)).all()
