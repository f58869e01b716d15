"""ISO weeks, seasons and holidays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days from 0001-01-01 (day 1) to 1970-01-01.
EPOCH = 719163


def week_idx(date: Column) -> Column:
    """Linear number of the week of a date."""
    return F.floor((F.datediff(F.date_trunc("week", date).cast("date"), F.lit("1970-01-01").cast("date")) + EPOCH) / 7).cast("long")


def monday_of(idx: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (idx * 7 + 1 - EPOCH).cast("int"))


def monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week; 4 January is always in week 1."""
    return F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (7 * (week - 1)).cast("int"))


def iso_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date).cast("int")


def iso_week(date: Column) -> Column:
    return F.weekofyear(date).cast("int")


def weeks_in_iso_year(year: Column) -> Column:
    return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))


def season_of(year: Column, week: Column) -> Column:
    """Seasons run from week 27 to week 26."""
    return F.when(week >= 27, year).otherwise(year - 1).cast("int")


def wk(week: Column) -> Column:
    """Week 53 counts as 52."""
    return F.least(week, F.lit(52)).cast("int")


def week_dist(a: Column, b: Column) -> Column:
    d = F.abs(wk(a) - wk(b))
    return F.least(d, 52 - d)


def phase(week: Column) -> Column:
    return F.when(week.between(34, 48), "autumn").when((week >= 49) | (week <= 10), "winter").when(week.between(11, 26), "spring").otherwise("summer")


def week_label(year: Column, week: Column) -> Column:
    return F.format_string("%d-W%02d", year, week)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar by Gauss's rule: days from 22 March to the full moon and on to Sunday, with its two exceptions."""
    whole = lambda a, b: F.floor(a / b).cast("int")
    k = whole(year, 100)
    m = F.pmod(15 + k - whole(13 + 8 * k, 25) - whole(k, 4), F.lit(30))
    n = F.pmod(4 + k - whole(k, 4), F.lit(7))
    moon = (19 * (year % 19) + m) % 30
    on = (2 * (year % 4) + 4 * (year % 7) + 6 * moon + n) % 7
    early = (on == 6) & ((moon == 29) | ((moon == 28) & ((11 * m + 11) % 30 < 19)))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (moon + on - F.when(early, 7).otherwise(0)).cast("int"))


#: Holidays by date or days from Easter, whether only Monday to Friday count, type, label, precedence.
HOLIDAYS = (
    (12, 27, None, False, "xmas1", "Vánoce", 1),
    (1, 1, None, True, "xmas2", "Nový rok", 2),
    (12, 24, None, True, "minor", "Štědrý den", 3),
    (10, 28, None, True, "autumn", "28. října a podzimní prázdniny", 4),
    (None, None, -2, False, "goodfri", "Velký pátek", 5),
    (None, None, 1, False, "eastermon", "Velikonoční pondělí", 6),
    (5, 1, None, True, "minor", "1. května", 7),
    (5, 8, None, True, "minor", "8. května", 7),
    (9, 28, None, True, "minor", "28. září", 7),
    (11, 17, None, True, "minor", "17. listopadu", 7),
    (7, 5, None, True, "minor", "5. července", 7),
    (7, 6, None, True, "minor", "6. července", 7),
)
JULY = "5.–6. července"


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """A row for each ISO week of the years: week_idx, iso_year, iso_week, wk52, season, monday, htype, hlabel. Some 53 rows a year, small enough to broadcast."""
    years = spark.range(first_year - 1, last_year + 2).select(F.col("id").cast("int").alias("y"))
    listed = spark.createDataFrame(HOLIDAYS, "m int, d int, off int, weekday boolean, htype string, hlabel string, rank int")
    days = years.withColumn("all", F.lit(1)).join(F.broadcast(listed.withColumn("all", F.lit(1))), "all").select("y", "weekday", "htype", "hlabel", "rank", F.when(F.col("off").isNull(), F.make_date("y", "m", "d")).otherwise(F.date_add(easter(F.col("y")), F.coalesce("off", F.lit(0)))).alias("day"))
    counted = days.where(~F.col("weekday") | F.weekday("day").between(0, 4)).withColumn("week_idx", week_idx(F.col("day")))
    best = counted.groupBy("week_idx").agg(F.min(F.struct("y", "rank")).alias("best"))
    hits = counted.join(best, "week_idx").where((F.col("y") == F.col("best.y")) & (F.col("rank") == F.col("best.rank")))
    labels = hits.groupBy("week_idx").agg(F.first("htype").alias("htype"), F.transform(F.array_sort(F.collect_list(F.struct("day", "hlabel"))), lambda x: x["hlabel"]).alias("names"))
    named = labels.select("week_idx", "htype", F.when((F.size("names") == 2) & F.array_contains("names", "5. července"), JULY).otherwise(F.array_join("names", " a ")).alias("hlabel"))
    weeks = spark.range(1).select(F.explode(F.sequence(F.lit(f"{first_year}-01-04").cast("date"), F.lit(f"{last_year}-12-28").cast("date"), F.expr("interval 7 days"))).alias("day")).select(F.date_trunc("week", "day").cast("date").alias("monday"))
    base = weeks.select(week_idx(F.col("monday")).alias("week_idx"), iso_year(F.col("monday")).alias("iso_year"), iso_week(F.col("monday")).alias("iso_week"), "monday")
    return (
        base.withColumn("wk52", wk(F.col("iso_week"))).withColumn("season", season_of(F.col("iso_year"), F.col("iso_week"))).join(F.broadcast(named), "week_idx", "left")
        .select("week_idx", "iso_year", "iso_week", "wk52", "season", "monday", "htype", "hlabel")
    )
