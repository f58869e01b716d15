"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands between words: ASCII other than digits and lower-case letters (texts are lower-cased first).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the fast built-in, where both are the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separator: str) -> Column:
    """The non-empty pieces between separators; a null text has none."""
    return F.coalesce(F.array_remove(F.split(text, separator), ""), F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run on one machine, as in tests, a new local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weekloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weekloom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is hot; there are fewer hot keys than that.
HOT = 1000
#: Parts among which a hot key's rows are dealt out.
DEALT = 256


def joined(rows: DataFrame, sums: DataFrame, keys: list[str], count: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with sums, a written table of one row or a few for each key, by plain equality; hot keys are split.

    count names sums' column of how many of the total rows have the key. Keys with more than one in HOT of the rows, of
    which there are fewer than HOT, are broadcast as keys alone; their rows are dealt out by a hash of the column
    spread, and meet copies of sums' row. So no task gets more than its share of a key. Null keys meet nothing.
    """
    hot = sums.where(F.col(count) * HOT > total)
    names = [f"hot_{k}" for k in keys]
    known = F.broadcast(hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lit(True).alias("is_hot")).distinct())
    met = reduce(lambda c, x: c & x, [rows[k] == known[n] for k, n in zip(keys, names, strict=True)])
    dealt = rows.join(known, met, "left").withColumn("dealt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(spread), F.lit(DEALT))).otherwise(F.lit(0))).drop(*names, "is_hot")
    copies = F.when(F.col(count) * HOT > total, F.lit(DEALT - 1)).otherwise(0)
    every = sums.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long")))).drop(count)
    return dealt.join(every, [*keys, "dealt"], how).drop("dealt")


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a worker keeps from task to task under a key. Only one such object is kept: a task that asks for another, or for none, lets it go."""
    if key not in _KEPT:
        _KEPT.clear()
        if key is not None:
            _KEPT[key] = make()
    return _KEPT.get(key)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, without importing what describes them on the executors."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
