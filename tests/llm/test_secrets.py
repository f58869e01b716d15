import random

import pytest
from pyspark.sql import functions as F

from weekloom.llm import secrets

WORDS = "water letters house other green things people number through before sentence".split()


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("a"))


def grams(spark, texts):
    return {r.gram for r in secrets.dictionary(docs_of(spark, texts)).collect()}


def plain(texts):
    """The dictionary by its definition."""
    import re
    from collections import Counter

    n = Counter()
    for t in set(texts):
        for w in set(re.split("[^a-z]+", re.sub(secrets.CANDIDATE, " ", t).lower())):
            if 4 <= len(w) <= 15:
                n.update(w[i : i + 4] for i in range(len(w) - 3))
    return {g for g, k in n.items() if k * 26**4 >= sum(n.values())}


def test_copies_of_texts_change_no_entry(spark):
    texts = [" ".join(WORDS[k:] + WORDS[:2] + [f"rare{'abcdefghijk'[k] * 4}"]) for k in range(11)]
    assert grams(spark, texts) == grams(spark, texts * 25) == plain(texts) and "rare" in plain(texts)


@pytest.mark.parametrize("copies", [1, 60])
def test_keys_do_not_cover_themselves(spark, copies):
    rng = random.Random(11)
    key = "".join(rng.choice("qxzjvk") + ("7" if k % 9 == 8 else "") for k in range(36))
    texts = [f"{' '.join(rng.sample(WORDS, 6))} {k} token = {key}" for k in range(copies)]
    docs = docs_of(spark, texts)
    got = secrets.featured(secrets.candidates(docs), secrets.dictionary(docs)).select("coverage").distinct().collect()
    assert [r.coverage for r in got] == [0.0]


def test_rare_noise_words_are_no_entries(spark):
    """Random short words are rarer than the uniform share where words of a language outnumber them, though each stands 20 times."""
    texts = [" ".join([*(f"{w}{c}{d}" for w in WORDS for c in "abcdefghij" for d in "klmnopqrst"), "qxzj" if k % 100 == 0 else "", str(k)]) for k in range(2000)]
    got = grams(spark, texts)
    assert "qxzj" not in got and "wate" in got


def test_forest_and_plain_rule_differ_and_the_forest_is_right(spark):
    """Keys without a name, and digests, numbers and words under one: the rule of prefix, name and path is wrong, the forest isn't, even on kinds it never saw."""
    rng = random.Random(2)
    docs = docs_of(spark, [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(200)])
    got = secrets.held_out_counts(docs)
    n = sum(got[k] for k in ("tp", "fp", "fn", "tn"))
    assert n > 1000 and got["tp"] + got["tn"] >= 0.98 * n and got["rule"] <= 0.8 * n
    kinds = [k for k, x in enumerate(secrets.KINDS) if x[0] == 1 and x[-1] == "plain"] + [secrets.KINDS.index((0, "", secrets.DIGITS, 16, 19, "", "named"))]
    for found, forest, rule in secrets.left_out_kinds(docs, kinds).values():
        assert found > 200 and forest >= 0.9 * found and rule <= 0.3 * found
