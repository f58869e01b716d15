"""Benchmark decontamination by winnowing.

Words of a text become 64-bit hashes; a k-gram's hash is built from its k words. In each run of WINDOW consecutive
words the smallest 5-gram hash is that run's fingerprint, so that a shared run of WINDOW words always shares its
fingerprint. Fingerprints of the corpus meet those of the benchmark; what they hit is extended to the whole run of
words, which is compared word by word. Items shorter than a window are one window each, with one gram of that length.

The positions come from explode() and are probed inside one generated stage, kept small so that it is compiled; only
hits and one row per document leave it. The benchmark's windows are measured first: up to MAX_BROADCAST bytes they are broadcast, above that the
selected fingerprints are shuffled to find the documents that can hold a hit, and only these are extended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import NOT_WORD, ascii_lower, joined, split_words, written

WINDOW, GRAM = 10, 5
#: Bytes of a benchmark's windows, with their items' ids, that may be broadcast.
MAX_BROADCAST = 64_000_000


def _gram_hash(at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get("h", at + j) for j in range(size)])


def _fingerprint(at: Column, length: int, window: int, gram: int) -> Column:
    """Of the run of so many words that begins there. Shorter runs than a window are one gram."""
    if length < window:
        return _gram_hash(at, length)
    hashes = [F.get("g", at + j) for j in range(window - gram + 1)]
    return hashes[0] if len(hashes) == 1 else F.least(*hashes)


def _hashed(df: DataFrame, key: list[str], gram: int) -> DataFrame:
    """The words w of each text, their number n, hashes h, and the hashes g of the grams that begin at each."""
    return (
        df.select(*key, split_words(ascii_lower(F.col("text")), NOT_WORD).alias("w"))
        .select(*key, "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
        .select("*", F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, gram)])).alias("g"))
    )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, words, fp, items): each distinct window of the items, its number of words, fingerprint, and item ids."""
    at = _hashed(benchmark, ["item_id"], gram).where("n > 0").select(
        "item_id", "w", "h", "g", F.least("n", F.lit(window)).alias("k"), F.explode(F.expr(f"sequence(0, n - least(n, {window}))")).alias("i")
    )
    fp = reduce(lambda c, m: F.when(F.col("k") == m, _fingerprint(F.col("i"), m, window, gram)).otherwise(c), range(1, window), _fingerprint(F.col("i"), window, window, gram))
    return (
        at.select("k", F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " ").alias("words"), fp.alias("fp"), "item_id")
        .groupBy("k", "words", "fp")
        .agg(F.collect_set("item_id").alias("items"))
    )


def _places(docs: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """A row (i = -1) for each document, and one for each place and length with its fingerprint."""
    rows = _hashed(docs, ["doc_id", "text_hash"], gram).select("*", F.explode(F.expr("sequence(-1, n - 1)")).alias("i"))
    fits = lambda k: (F.col("i") >= 0) & (F.col("i") + k <= F.col("n"))
    if len(lengths) == 1:
        k = lengths[0]
        return rows.where((F.col("i") < 0) | fits(k)).select("doc_id", "text_hash", "w", "n", "i", F.lit(k).alias("k"), F.when(fits(k), _fingerprint(F.col("i"), k, window, gram)).alias("fp"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.when(fits(k), _fingerprint(F.col("i"), k, window, gram)).alias("fp")) for k in lengths])
    return rows.select("doc_id", "text_hash", "w", "n", "i", F.inline(each)).where((F.col("fp").isNotNull()) | ((F.col("i") < 0) & (F.col("k") == lengths[0])))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, text_hash, n_rows, n_words, n_hit, items): hit words and sorted ids of hitting items of each document.

    docs has doc_id and text, benchmark item_id and text; other columns are not touched. Null or empty texts have no
    words; texts of any length are read whole. Equal rows are counted in n_rows; rows of one doc_id with other texts are judged each on its own. A
    benchmark row without an item_id hits words but adds no id. With an empty benchmark nothing is hit; without
    documents there are no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    windows = written(benchmark_windows(benchmark, window, gram), "windows")
    lengths = sorted((r.k for r in windows.select("k").distinct().collect()), reverse=True) or [window]
    key = ["doc_id", "text_hash"]
    places = _places(docs, lengths, window, gram)
    fps = windows.select("k", "fp").distinct().withColumn("known", F.lit(True))
    words = F.when(F.col("i") >= 0, F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " "))
    size = windows.agg(F.sum(F.octet_length("words") + F.size("items") * 32 + 64)).first()[0] or 0
    if size <= max_broadcast:
        near = places.join(F.broadcast(fps), ["k", "fp"], "left").where("i < 0 or known")
        extended = near.select(*key, "n", "i", "k", words.alias("words")).join(F.broadcast(windows.drop("fp")), ["k", "words"], "left").where("i < 0 or items is not null")
    else:
        before = F.when(F.col("i") > 0, _fingerprint(F.col("i") - 1, window, window, gram))
        chosen = _places(docs, lengths, window, gram) if len(lengths) > 1 else _hashed(docs, key, gram).select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("i")).where(F.col("i") + lengths[0] <= F.col("n")).select(
            *key, F.lit(lengths[0]).alias("k"), "i", _fingerprint(F.col("i"), lengths[0], window, gram).alias("fp"), before.alias("before")
        ).where(F.col("before").isNull() | (F.col("fp") != F.col("before")))
        chosen = chosen.where("i >= 0").select(*key, "k", "fp")
        # counted with map-side sums; places of a passage that very many documents quote are dealt out by text
        counts = written(chosen.groupBy("k", "fp").agg(F.count("*").alias("met")).join(fps.drop("known"), ["k", "fp"]), "counts")
        total = counts.agg(F.sum("met")).first()[0] or 0
        able = written(joined(chosen, counts, ["k", "fp"], "met", total, "text_hash").select(*key).distinct(), "able")
        alike = docs.doc_id.eqNullSafe(able.doc_id) & (docs.text_hash == able.text_hash)
        counted = written(windows.join(counts, ["k", "fp"]).drop("fp"), "counted")
        places = _places(docs.join(able, alike, "left_semi"), lengths, window, gram).where("i >= 0").select(*key, "n", "i", "k", words.alias("words"))
        found = joined(places, counted, ["k", "words"], "met", total, "text_hash")
        items = windows.schema["items"].dataType
        each = docs.select(*key, F.size(split_words(ascii_lower(F.col("text")), NOT_WORD)).alias("n"), F.lit(-1).alias("i"), F.lit(0).alias("k"), F.lit(None).cast(items).alias("items"))
        extended = found.select(*key, "n", "i", "k", "items").unionByName(each)
    span = F.when(F.col("i") >= 0, F.struct("i", (F.col("i") + F.col("k")).alias("e")))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["i"], a["to"]))).alias("hit"), F.greatest(s["e"], a["to"]).alias("to")),
        lambda a: a["hit"],
    )
    return (
        extended.groupBy(*key)
        .agg(F.count_if(F.col("i") < 0).alias("n_rows"), F.max("n").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("items").alias("sets"))
        .select(*key, "n_rows", F.col("n_words").cast("long"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform(F.flatten("sets"), lambda x: x.cast("string")))).alias("items"))
    )


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return (
        hits(docs, benchmark, **options)
        .select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("copy"))
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, min_hit: int = 1, **options) -> DataFrame:
    """docs, all columns, without the rows in which at least min_hit words are in benchmark windows.

    Rows go by doc_id and text, so each row is judged by its own text. Names of other columns don't matter. Rows without
    text stay; an empty table or benchmark changes nothing.
    """
    bad = written(hits(docs, benchmark, **options).where(F.col("n_hit") >= min_hit).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_text")), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"]) == bad["__bad_text"]), "left_anti")
