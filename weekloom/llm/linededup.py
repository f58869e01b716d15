"""Line dedup: lines that stand in many documents go, except in the document with the largest id.

A line's key is hashed to 128 bits, once; only hashes, ids and positions are written and shuffled. Documents of each
hash are counted in two steps (distinct hash and document, then the hash), both with map-side sums. Lines over the
threshold meet their places by hash, those that very many documents hold by parts; positions to drop are gathered for
each document, and meet its text once. That join is a sort-merge join at any size: files of positions are so small that
Spark would broadcast them for a small input and move texts for a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import SPACE_CHARS, ascii_lower, joined, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Documents that lose lines (two numbers each) up to which these are broadcast, so that other texts aren't moved.
MAX_BROADCAST = 500_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n"))).where(F.length("col") >= min_chars).select("doc_id", "text_hash", "pos", line_key(F.col("col")).alias("key"))
    return lines.where(F.length("key") >= min_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text for each row; needs doc_id and text.

    A null text counts as one empty line and gives an empty text. Rows of one doc_id are one document when documents
    are counted; rows without an id are one document below all others. Repeated rows give repeated results. Texts and
    lines of any length are read whole. An empty table gives no rows. Names of other columns don't matter: only doc_id
    and text are read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    keyed = written(_keyed(docs, min_chars), "lines")
    each = keyed.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("lines"))
    common = each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"), F.sum("lines").alias("n")).where(F.col("n_docs") >= min_docs)
    common = written(common.select("h1", "h2", "last_id", "n"), "common")
    gone = (
        joined(keyed, common, ["h1", "h2"], "n", keyed.count(), "text_hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    gone = written(gone, "gone")
    positions = gone.hint("merge")
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    same = lambda own, id, hash: own.doc_id.eqNullSafe(F.col(id)) & (own.text_hash == F.col(hash))
    if gone.count() <= max_broadcast:
        # who loses lines is known everywhere, so that only their texts are moved
        known = F.broadcast(gone.select(F.col("id").alias("known_id"), F.col("hash").alias("known_hash"), F.lit(True).alias("known")))
        told = docs.join(known, same(docs, "known_id", "known_hash"), "left").select("doc_id", "text", "text_hash", "known")
        changed = told.where("known").drop("known")
        rest = told.where("known is null").select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
        whole = changed.join(positions, same(changed, "id", "hash")).select("doc_id", "text", "gone").unionByName(rest)
    else:
        whole = docs.join(positions, same(docs, "id", "hash"), "left")
    return whole.select("doc_id", "text", "gone", F.when(F.col("gone").isNotNull(), lines).alias("lines"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")).select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text")
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return kept_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
