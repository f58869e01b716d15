"""Buckets of near-duplicate search: large and small ones counted alike; copies left out with and without a broadcast."""

import random
from collections import Counter

from weekloom.llm import neardup


def test_rows_in_company(spark):
    r = random.Random(6)
    rows = [(i, 10, k) for i in range(3000) for k in {0 if i % 3 == 0 else 1_000_000 + i, r.randrange(500), 2_000_000 + i}]
    placed = spark.createDataFrame(rows, "rep long, n long, key long")
    sizes = Counter(k for *_, k in rows)
    # as few classes are left, 2 among one in EVERY make a bucket large
    got = neardup._in_company(placed, 3000).collect()
    assert sorted(map(tuple, got)) == sorted((i, n, k, sizes[k]) for i, n, k in rows if sizes[k] > 1) and sizes[0] >= 1000
    assert neardup._in_company(placed.limit(0), 0).count() == 0


def test_dedup_both_ways(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [r.choice(words) for _ in range(60)]
        rows += [(10 * i + j, " ".join(base if j else [*base[:-1], "end"])) for j in range(r.randint(1, 4))]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), (5000, None)], "doc_id long, text string").repartition(3)
    ways = [sorted(map(tuple, neardup.dedup(docs, max_broadcast=m).collect()), key=str) for m in (neardup.MAX_GONE, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 60 + 3
