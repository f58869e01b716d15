"""Accuracy over one series: python -m weekloom.jobs.accuracy FILE, a JSON object from "YYYY-Www" to a number.

Prints the mean upper median error in % of the blend and of the legacy model, for the tuning and the holdout seasons.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.jobs.folders import new_dir
from weekloom.operators import evaluate, models, profiles
from weekloom.params import Params
from weekloom.sources.panel import as_series, panel_calendar, read_week_map


def tables(spark: SparkSession, file: str, folder: str, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Panel of the file's series, the same with holiday effects, and calendar, each written below folder."""
    as_series(read_week_map(spark, file), "series").write.parquet(f"{folder}/panel")
    panel = spark.read.parquet(f"{folder}/panel")
    panel_calendar(panel).write.parquet(f"{folder}/calendar")
    cal = spark.read.parquet(f"{folder}/calendar")
    profiles.with_effects(panel, cal, p).write.parquet(f"{folder}/seen")
    return panel, spark.read.parquet(f"{folder}/seen"), cal


def scores(panel: DataFrame, seen: DataFrame, cal: DataFrame, folder: str, p: Params) -> DataFrame:
    """split, model, score and coverage of the blend, its two parts and the legacy model."""
    made = {"blend": models.point_forecast(panel, seen, cal, p), "analog": models.analog(panel, seen, cal, p), "holiday_profile": models.seasonal_profile_holiday(panel, seen, cal, p), "legacy": models.legacy(panel, p)}
    for name, rows in made.items():
        evaluate.residuals(panel, rows.withColumn("model", F.lit(name))).write.mode("append").parquet(f"{folder}/residuals")
    return evaluate.model_score(evaluate.backtest_summary(panel.sparkSession.read.parquet(f"{folder}/residuals"), p), p)


def main() -> None:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    p, folder = Params(), new_dir(spark, "accuracy")
    for r in scores(*tables(spark, sys.argv[1], folder, p), folder, p).orderBy("split", "model").collect():
        print(f"{r.split:8} {r.model:16} {r.score:6.2f}")


if __name__ == "__main__":
    main()
