"""Incremental intake: new rows are added to a store; priority, late rows and revisions are worked out when the store is read."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekloom.operators.history import apply_revisions
from weekloom.params import Params

PRIORITY = {"official": 1, "scaled": 2, "interpolated": 3}
STORE = "series_id string, week_idx long, value double, change_pct double, source string, version long"


def latest(rows: DataFrame) -> DataFrame:
    """One row for each series and week: the better source, then the later version. Late rows count as any others."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("source")]
    own = Window.partitionBy("series_id", "week_idx").orderBy(rank, F.desc("version"))
    return rows.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What the intake below path has taken, one row for each series and week."""
    return latest(spark.read.schema(STORE).parquet(f"{path}/rows/batch=*"))


def revise(store: DataFrame, tolerance: float) -> DataFrame:
    """The store as it is read: official values that the next week's change contradicts by more than the tolerance are replaced by what it implies.

    The store itself keeps what was reported, so that the result doesn't depend on how rows came in batches.
    """
    none = F.lit(None).cast("array<double>")
    told = apply_revisions(store.withColumns({"groups": none, "groups_change_pct": none}), replace(Params(), revision=tolerance))
    return told.withColumn("value", F.col("value_revised")).select(*store.columns)


def run_intake(spark: SparkSession, source: DataFrame, path: str) -> StreamingQuery:
    """Starts the intake of a streaming DataFrame (STORE without version) below path; available data only.

    Each micro-batch writes its own rows alone, in a folder by its number, so that a batch that is run again overwrites
    itself and none costs more than its rows. No watermark: weeks may come any number of weeks late.
    """
    def add(batch: DataFrame, n: int) -> None:
        latest(batch.withColumn("version", F.lit(n).cast("long"))).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
