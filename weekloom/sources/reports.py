"""Periodic reports: links, weeks, and validated values from their text, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.calendar import monday, week_idx, weeks_in_iso_year

#: Patterns of the reports' layout.
HEADER = r"(?iu)(\d{1,2})\s*\.?\s*t[ýy]den\s+(\d{4})"
NATIONAL = r"[ČC]esk[áa]\s+republika\s*-\s*the\s+Czech\s+Republic[ \t]+"
RATES = NATIONAL + r"(\d[\d \t,.]*)"
CHANGES = r"Zm[ěe]na\s*-\s*Change\s*\[%\][ \t]+([-−\d \t,.]+)"
REPORT_URL = r"(?i)/wp-content/uploads/(\d{4})/(\d{2})/(\d{1,2})_tyden\.pdf$"
COLUMNS = 6


def extract_links(pages: DataFrame, pattern: str, base: str) -> DataFrame:
    """(page_id, pos, url): links of each page that match the pattern, each once, at its first place. Fragments are cut off, links that don't begin with http get the base."""
    hrefs = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("pos", "href"))
    cut = F.substring_index("href", "#", 1)
    urls = hrefs.select("page_id", "pos", F.when(cut.startswith("http"), cut).otherwise(F.concat(F.lit(base), cut)).alias("url"))
    return urls.where(F.col("url").rlike(f"(?i){pattern}")).groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def url_week(url: Column) -> Column:
    """struct(year, week) of a report from its path, which has the year of the upload; null where nothing matches."""
    part = lambda k: F.regexp_extract(url, REPORT_URL, k).try_cast("int")
    y, m, w = part(1), part(2), part(3)
    year = F.when((m == 1) & (w >= 50), y - 1).when((m == 12) & (w <= 2), y + 1).otherwise(y)
    return F.when(url.rlike(REPORT_URL), F.struct(year.alias("year"), w.alias("week")))


def numbers(text: Column) -> Column:
    words = F.split(F.replace(F.replace(text, F.lit("−"), F.lit("-")), F.lit(","), F.lit(".")), r"\s+")
    return F.transform(F.filter(words, lambda x: x.rlike(r"^-?\d+(\.\d+)?$")), lambda x: x.cast("double"))


def _row_ok(v: Column) -> Column:
    groups = F.slice(v, 1, COLUMNS - 1)
    return (F.size(v) == COLUMNS) & F.get(v, F.lit(COLUMNS - 1)).between(F.array_min(groups) - 1, F.array_max(groups) + 1)


def parse_reports(texts: DataFrame) -> DataFrame:
    """All columns and report: struct(year, week, value, sub_value, groups, sub_groups, change_pct, groups_change_pct), or null if any check fails."""
    rates = F.regexp_extract_all("text", F.lit(RATES), F.lit(1))
    first = F.regexp_extract("text", rf"(?s)^(.*?{NATIONAL}\d[\d \t,.]*)", 1)
    tail = F.expr("substring(text, length(__first) + 1)")
    between = F.regexp_extract(tail, rf"(?s)^(.*?){NATIONAL}\d", 1)
    last = lambda v: F.get(v, F.lit(COLUMNS - 1))
    parsed = (
        texts.withColumn("__first", first)
        .withColumns({"__w": F.regexp_extract("text", HEADER, 1).try_cast("int"), "__y": F.regexp_extract("text", HEADER, 2).try_cast("int"), "__n": F.size(rates), "__a": numbers(F.coalesce(F.get(rates, F.lit(0)), F.lit(""))), "__b": numbers(F.coalesce(F.get(rates, F.lit(1)), F.lit(""))), "__c": numbers(F.regexp_extract(between, CHANGES, 1))})
    )
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    fine = (F.col("__n") >= 2) & F.col("__w").between(1, weeks_in_iso_year(F.col("__y"))) & _row_ok(a) & _row_ok(b) & (last(a) >= 3 * last(b))
    has = F.size(c) == COLUMNS
    report = F.struct(
        F.col("__y").alias("year"), F.col("__w").alias("week"), last(a).alias("value"), last(b).alias("sub_value"), F.slice(a, 1, COLUMNS - 1).alias("groups"), F.slice(b, 1, COLUMNS - 1).alias("sub_groups"),
        F.when(has, last(c)).alias("change_pct"), F.when(has, F.slice(c, 1, COLUMNS - 1)).alias("groups_change_pct"),
    )
    return parsed.withColumn("report", F.when(F.coalesce(fine, F.lit(False)), report)).select(*texts.columns, "report")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) of a folder of report texts, one file each; the file's place stands for the url."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("text"))


def checked_reports(texts: DataFrame) -> DataFrame:
    """parse_reports() of texts with their url; a report whose header is more than a week off the week in its url becomes null."""
    at = lambda w: week_idx(monday(w["year"], w["week"]))
    parsed = parse_reports(texts)
    off = F.abs(at(F.col("report")) - at(url_week(F.col("url")))) > 1
    return parsed.withColumn("report", F.when(~F.coalesce(off, F.lit(False)), F.col("report")))


def unread(links: DataFrame, history: DataFrame) -> DataFrame:
    """links (url) whose week isn't in history (iso_year, iso_week, source, value) as official; those without a week in the url stay. With a series_id on both sides, weeks are those of the series."""
    keys = [c for c in ("series_id",) if c in links.columns and c in history.columns]
    have = history.where((F.col("source") == "official") & F.col("value").isNotNull()).select(*keys, F.col("iso_year").alias("__y"), F.col("iso_week").alias("__w")).distinct()
    told = links.withColumn("__told", url_week(F.col("url"))).withColumns({"__y": F.col("__told.year"), "__w": F.col("__told.week")})
    return told.join(have, [*keys, "__y", "__w"], "left_anti").drop("__told", "__y", "__w")
