"""Mixing sources to target weights by Poisson replication.

Each source gets a rate: rows it should have in the mix over rows it has. Each row draws a uniform number from a hash
of its id and a seed, inverts the Poisson distribution with its source's rate, and appears that often. The mix is
dealt out by a hash of row and copy, and sorted by it within partitions, which is a global shuffle that can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import written

#: Sources whose rates may be broadcast (a name, a rate and a short list each).
MAX_BROADCAST = 100_000
#: Parts among which the rows of each source are dealt out when rates are joined by shuffle.
PARTS = 64


def hash_uniform(*parts: Column | str) -> Column:
    """52 bits of an md5 of the parts, in [0, 1); a null part counts as '~'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, n, rate): rates that bring each source to its share of size x rows.

    weights: target weights by source; sources without one get 0. Without weights, the share is the source's rows to
    the power alpha, so that small sources gain. A null source is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        shares = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        shares = counts.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    shares = written(shares, "shares")
    total = shares.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    per_weight = size * (total.n or 0) / total.weight if total.weight else 0.0
    return shares.select("source", "n", F.round(F.lit(per_weight) * F.col("weight") / F.col("n"), 9).alias("rate"))


def _count(u: Column, rate: Column) -> Column:
    """Poisson count of u: walks p(k) up from 0, all in built-in functions. Rates above 500 are drawn by parts of 500 at most."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 60).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("total"), F.lit(0).alias("count"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["total"] + p).alias("total"), (a["count"] + F.when(u >= a["total"], 1).otherwise(0)).alias("count"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["count"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: int = 1, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs, all columns, each row as often as drawn, with __copy (from 1) and __order, dealt out and sorted by __order.

    Rates of the sources are counted first; up to max_broadcast sources they are broadcast, else joined by shuffle, a
    large source's rows by parts. Rows of one doc_id draw the same number, and so do those without one; they are told
    apart by the text, where there is one, only in how they are dealt out. Repeated rows are drawn each. Columns of docs
    named __copy or __order are replaced; other names don't matter. Texts aren't looked into. Empty tables give empty mixes.
    """
    rates = written(source_rates(docs, weights, alpha, size), "rates").select("source", "rate", F.greatest(F.lit(1), F.ceil(F.col("rate") / 500)).cast("int").alias("parts"))
    rows = docs.select(F.struct("*").alias("row"), F.col("source"), F.col("doc_id").cast("string").alias("id"))
    if rates.count() <= max_broadcast:
        met = rows.join(F.broadcast(rates), rows.source.eqNullSafe(rates.source))
    else:
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
        every = rates.select("source", "rate", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
        met = dealt.join(every, dealt.source.eqNullSafe(every.source) & (F.col("deal") == F.col("part")))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, j: a + _count(hash_uniform(F.lit(str(seed)), F.col("id"), j), F.col("rate") / F.col("parts")))
    copies = met.where("rate > 0").select("row", "id", F.explode(F.sequence(F.lit(0), drawn)).alias("copy")).where("copy > 0")
    order = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(F.col("id"), F.lit("~")), F.col("copy").cast("string")))
    apart = F.xxhash64("row.text") if "text" in docs.columns else F.lit(0)
    dealt = copies.withColumn("order", order).withColumn("apart", apart).repartition("order", "apart").sortWithinPartitions("order", "apart")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("__copy", "__order")], F.col("copy").alias("__copy"), F.col("order").alias("__order"))


def report(docs: DataFrame, **options) -> DataFrame:
    """The mix as doc_id, source, copy_no, order_key, text_chars and text."""
    return mix(docs.select("doc_id", "source", "text"), **options).select(
        "doc_id", "source", F.col("__copy").cast("long").alias("copy_no"), F.col("__order").alias("order_key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_chars"), "text"
    )
