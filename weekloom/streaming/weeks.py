"""A weekly panel from a stream of raw events, in any order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekloom.functions.calendar import week_idx

SUMS = "series_id string, week_idx long, n long, total decimal(38,6), newest timestamp"
LATE = "series_id string, ts timestamp, value double"


def weekly(events: DataFrame) -> DataFrame:
    """(series_id, week_idx, n, total, newest) of events (series_id, ts, value): tumbling windows from Monday to Monday. Events without a time go; a null value counts as 0."""
    at = F.window("ts", "7 days", "7 days", "4 days")  # the epoch was a Thursday
    sums = events.where("ts is not null").groupBy("series_id", at.alias("w")).agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0)).cast("decimal(28,6)")).cast("decimal(38,6)").alias("total"), F.max("ts").alias("newest"))
    return sums.select("series_id", week_idx(F.col("w.start").cast("date")).alias("week_idx"), "n", "total", "newest")


class WeeklyPanel:
    """Sums by batch under path, and a side table of events whose week had ended more than lateness before the newest event of all earlier batches.

    Sums of weeks add up, so that the panel, with late events or without, doesn't depend on the order of arrival; which events
    are late does. A batch that is run again overwrites its own files. No window is held in memory between batches.
    """

    def __init__(self, spark: SparkSession, path: str, lateness: str = "INTERVAL 28 DAYS"):
        self.spark, self.path, self.lateness = spark, path, lateness

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.path}/{name}") if fs.exists(at) else self.spark.createDataFrame([], f"{schema}, batch int")

    def take(self, batch: DataFrame, n: int) -> None:
        newest = self._table("sums", SUMS).where(F.col("batch") < n).agg(F.max("newest")).first()[0]
        ended = F.timestamp_micros(F.unix_micros(F.date_trunc("week", "ts")) + 7 * 86_400_000_000)
        late = (ended + F.expr(self.lateness) < F.lit(newest)) if newest is not None else F.lit(False)
        told = batch.select("series_id", "ts", "value").where("ts is not null").withColumn("late", late)
        weekly(told.where("not late")).write.mode("overwrite").parquet(f"{self.path}/sums/batch={n}")
        told.where("late").drop("late").write.mode("overwrite").parquet(f"{self.path}/late/batch={n}")

    def run(self, source: DataFrame) -> StreamingQuery:
        return source.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def late(self) -> DataFrame:
        """Events of the side table."""
        return self._table("late", LATE).drop("batch")

    def panel(self, with_late: bool = True) -> DataFrame:
        """(series_id, week_idx, n, total) of what was taken."""
        sums = self._table("sums", SUMS).drop("batch")
        every = sums.unionByName(weekly(self.late())) if with_late else sums
        return every.groupBy("series_id", "week_idx").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
