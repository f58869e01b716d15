"""Words whose sums of powers are equal modulo 2**64 for any odd base: Thue-Morse words and their complements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import decontaminate, neardup, tokenfile
from weekloom.llm.common import tokenizer_path
from weekloom.llm.hashing import piece_hashes, shingle_sets, word_hashes

TOKENIZER = tokenizer_path(tokenfile.TOKENIZER)


def _words(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_ids_of_equal_sums(n):
    from tokenizers import Tokenizer

    a, b = _words(n)
    text = f"{a} {b} x {b} {a}"
    got, sizes = tokenfile.Encoder(TOKENIZER).encode([text.encode(), a.encode(), b.encode()])
    plain = Tokenizer.from_file(TOKENIZER)
    want = [[*plain.encode(t, add_special_tokens=False).ids, tokenfile.END_ID] for t in (text, a, b)]
    assert got.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_shingles_of_equal_sums(spark, n):
    a, b = _words(n)
    assert [len(x) for x in shingle_sets([f"{a} x {b} x".encode()], 2)] == [3]
    docs = spark.createDataFrame([(1, f"{a} x {b} x"), (2, f"{a} x {a} x"), (3, f"{b} x {b} x"), (4, f"{a.upper()} x {b} x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.report(docs, width=2).collect()}
    assert got == {1: (3, 1), 2: (2, 2), 3: (2, 3), 4: (3, 1)}


def test_hashes_are_of_pieces_alone():
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abABé") for _ in range(r.choice([1, 3, 8, 9, 16, 17, 40]))) for _ in range(30)) for _ in range(20)]
    words = [w for t in texts for w in t.split(" ")]
    got, counts = word_hashes([t.encode() for t in texts])
    assert counts.tolist() == [30] * 20
    low = [w.translate(str.maketrans("AB", "ab")) for w in words]
    assert len(set(got.tolist())) == len(set(low)) == len(set(zip(low, got.tolist(), strict=True)))
    assert piece_hashes(np.frombuffer(b"", np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_item_ids_of_any_type_both_ways(spark, kind):
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    item = [" ".join(r.choice(words) for _ in range(25)) for _ in range(6)]
    docs = [(i, " ".join([*(r.choice(words) for _ in range(20)), item[0] if i % 2 else "", *(r.choice(words) for _ in range(20)), item[i % 6] if i % 5 == 0 else ""])) for i in range(300)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    prefix = "x" if kind == "string" else ""
    bench = spark.createDataFrame([(f"{prefix}{i}", t) for i, t in enumerate(item)] + [(f"{prefix}7", item[0]), (None, item[1])], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    ways = [sorted(map(tuple, decontaminate.hits(docs, bench, max_broadcast=m).drop("text_hash").collect())) for m in (decontaminate.MAX_BROADCAST, 0)]
    assert ways[0] == ways[1]
    by = {x[0]: x for x in ways[0]}
    assert all((f"{prefix}7" in x[-1]) == (i % 2 == 1 or (i % 5 == 0 and i % 6 == 0)) for i, x in by.items())
