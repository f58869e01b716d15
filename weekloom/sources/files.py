"""Readers of files that people make: what can't be used is kept with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weekloom.functions.calendar import monday, week_idx, weeks_in_iso_year

#: Columns of the case table, and what they are here.
CASE_COLUMNS = {"AGEGROUP_CODE": "group_code", "ISO_YEAR": "iso_year", "ISO_WEEK": "iso_week", "ARI_CASE": "cases", "ARI_POP_COV": "population", "ILI_CASE": "sub_cases", "ILI_POP_COV": "sub_population"}
OFFICIAL = "array<struct<year:int,week:int,ari:double,ili:double,ari_groups:array<double>,url:string>>"


def _week_reason(year: Column, week: Column) -> Column:
    y, w = year.try_cast("int"), week.try_cast("int")
    return F.when(y.isNull() | w.isNull(), "no week").when(~w.between(1, weeks_in_iso_year(y)), "no such week")


def read_case_table(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a case table in CSV. rows have the columns that columns names, by header, as text, and all others; rejects (line, reason) weren't used.

    Columns may stand in any order, with a byte-order mark before them; those that are missing are null. All files of a path
    have one header. Lines with too many or too few cells, and those without a week of the calendar, are rejects. Numbers
    that can't be read are left to history.case_rates(), which uses what stands before them.
    """
    columns = columns or CASE_COLUMNS
    header = [c.lstrip("﻿").strip() for c in spark.read.csv(path, header=True).columns]
    names = [columns.get(c, c) for c in header]
    schema = StructType([StructField(n, StringType()) for n in [*names, "__line"]])
    reader = spark.read.option("columnPruning", False)  # all cells are counted, whatever is read of them
    raw = reader.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="__line")
    raw = raw.select("*", *[F.lit(None).cast("string").alias(n) for n in columns.values() if n not in names])
    reason = F.when(F.col("__line").isNotNull(), "cells").otherwise(_week_reason(F.col("iso_year"), F.col("iso_week")))
    told = raw.withColumn("reason", reason)
    line = F.coalesce("__line", F.concat_ws(",", *[F.coalesce(n, F.lit("")) for n in names]))
    return told.where("reason is null").drop("__line", "reason"), told.where("reason is not null").select(line.alias("line"), "reason")


def read_official_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON files, each a list of official weeks. rows: file, week_idx, iso_year, iso_week, value, sub_value, groups, url. rejects: file, entry (JSON), reason."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value", F.from_json("value", OFFICIAL).alias("list"))
    e = raw.where("list is not null").select("file", F.explode("list").alias("e"))
    reason = F.when(F.col("e.ari").isNull(), "no value").otherwise(_week_reason(F.col("e.year"), F.col("e.week")))
    told = e.withColumn("reason", reason)
    at = week_idx(monday(F.col("e.year"), F.col("e.week")))
    rows = told.where("reason is null").select("file", at.alias("week_idx"), F.col("e.year").alias("iso_year"), F.col("e.week").alias("iso_week"), F.col("e.ari").alias("value"), F.col("e.ili").alias("sub_value"), F.col("e.ari_groups").alias("groups"), F.col("e.url").alias("url"))
    bad = told.where("reason is not null").select("file", F.to_json("e").alias("entry"), "reason")
    return rows, bad.unionByName(raw.where("list is null").select("file", F.col("value").alias("entry"), F.lit("no list").alias("reason")))
