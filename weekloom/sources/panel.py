"""Readers: panels, histories, case tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.calendar import calendar, iso_week, iso_year, monday, season_of, week_idx, wk

def with_calendar(df: DataFrame, date: Column) -> DataFrame:
    """Adds week_idx, iso_year, iso_week, wk52 and season of a date."""
    return df.withColumn("__d", date).withColumns({"week_idx": week_idx(F.col("__d")), "iso_year": iso_year(F.col("__d")), "iso_week": iso_week(F.col("__d"))}).withColumns({"wk52": wk(F.col("iso_week")), "season": season_of(F.col("iso_year"), F.col("iso_week"))}).drop("__d")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, week_idx, iso_year, iso_week, wk52, season, y): weekly order value in thousands by priority. Filled weeks only, y above 0."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("series_id"), F.date_trunc("week", "o_orderdate").cast("date").alias("monday"), "o_totalprice")
    weekly = orders.groupBy("series_id", "monday").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000, 3).alias("y"))
    return with_calendar(weekly, F.col("monday")).where("y > 0").select("series_id", "week_idx", "iso_year", "iso_week", "wk52", "season", "y")


def panel_calendar(panel: DataFrame) -> DataFrame:
    """The calendar of a panel's years and one more on each side, which neighbours and forecasts reach."""
    first, last = panel.agg(F.min("iso_year"), F.max("iso_year")).first()
    return calendar(panel.sparkSession, (first or 2000) - 1, (last or 2000) + 1)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(iso_year, iso_week, value) of a JSON file: {history: [...]} or a bare list. The newer name of the value counts unless it is missing; zeros and nulls go."""
    entry = "array<struct<year:int,iso_week:int,ari_per_100k:double,ari:double>>"
    raw = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<history:{entry}>")["history"], F.from_json("value", entry))
    e = raw.select(F.explode(rows).alias("e"))
    return e.select(F.col("e.year").alias("iso_year"), F.col("e.iso_week").alias("iso_week"), F.coalesce(F.col("e.ari_per_100k"), F.col("e.ari")).alias("value")).where("value <> 0")


def read_week_map(spark: SparkSession, path: str) -> DataFrame:
    """(iso_year, iso_week, value) of a JSON object from "YYYY-Www" to a number."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))
    return m.select(F.substring("key", 1, 4).cast("int").alias("iso_year"), F.substring("key", 7, 2).cast("int").alias("iso_week"), "value")


def as_series(rows: DataFrame, series_id: str) -> DataFrame:
    """A panel of one series from (iso_year, iso_week, value)."""
    return with_calendar(rows.where("value > 0").withColumn("series_id", F.lit(series_id)), monday(F.col("iso_year"), F.col("iso_week"))).select("series_id", "week_idx", "iso_year", "iso_week", "wk52", "season", F.col("value").alias("y"))
