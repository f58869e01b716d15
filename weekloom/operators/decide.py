"""Decision rules on the current state and forecast of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, monday_of
from weekloom.operators.history import by_week, band_of, trend_growth
from weekloom.params import Params


def planned_value(state: DataFrame, rows: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """(series_id, planned, planned_band): the larger of the last value and the upper quartile two weeks ahead; for a holiday week, the geometric mean of the plain weeks beside it."""
    f = rows.join(F.broadcast(cal.select("week_idx", "htype")), "week_idx", "left")
    w = Window.partitionBy("series_id", "origin_idx").orderBy("week_idx")
    plain = F.when(F.col("htype").isNull(), F.col("q75"))
    f = f.withColumns({"lo": F.last(plain, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "hi": F.first(plain, True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("horizon = 2")
    ahead = F.when(F.col("htype").isNull(), F.col("q75").cast("double")).otherwise(F.sqrt(F.coalesce("lo", "hi") * F.coalesce("hi", "lo")))
    v = F.greatest("y", ahead)
    return state.join(f.select("series_id", F.col("origin_idx").alias("week_idx"), ahead.alias("ahead")), ["series_id", "week_idx"], "left").select("series_id", "week_idx", "y", F.greatest("y", "ahead").alias("planned")).withColumn("planned_band", band_of(F.col("planned"), p))


def trend_class(panel: DataFrame, rows: DataFrame, cal: DataFrame) -> DataFrame:
    """(series_id, trend5, fast, rising, falling): growth of plain weeks in five classes; rising also if the mean forecast of the next 1 to 4 plain weeks is over 5 % above the last value."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("week_idx"))
    plain = panel.join(F.broadcast(cal.where("htype is not null").select("week_idx")), "week_idx", "left_anti").withColumn("n", F.row_number().over(newest)).where("n <= 4")
    clean = plain.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "y"))), lambda s: s["y"]).alias("clean"))
    last = panel.groupBy("series_id").agg(F.max_by("y", "week_idx").alias("y"))
    soon = rows.where("horizon <= 4").join(F.broadcast(cal.where("htype is not null").select("week_idx")), "week_idx", "left_anti").groupBy("series_id").agg(F.avg("median").alias("soon"))
    g, down = trend_growth(F.col("clean"))
    t = last.join(clean, "series_id", "left").join(soon, "series_id", "left").withColumns({"g": F.when(F.size("clean") == 4, g), "down": F.when(F.size("clean") == 4, down)})
    kind = F.when(F.col("g") >= 0.10, "rising fast").when(F.col("g") >= 0.03, "rising").when((F.col("g") <= -0.10) & F.col("down"), "falling fast").when((F.col("g") <= -0.03) & F.col("down"), "falling").otherwise("stable")
    return t.select("series_id", kind.alias("trend5"), F.coalesce(F.col("g") >= 0.10, F.lit(False)).alias("fast"), F.coalesce((F.col("g") >= 0.03) | (F.col("soon") > 1.05 * F.col("y")), F.lit(False)).alias("rising"), F.coalesce((F.col("g") <= -0.03) & F.col("down"), F.lit(False)).alias("falling"))


def planning_phase(panel: DataFrame, trend: DataFrame, p: Params, today_week: Column | None = None) -> DataFrame:
    """(series_id, plan_phase): summer, autumn, winter_pre, winter_post or spring, from the latest week of each series."""
    peak = panel.withColumns({"peak": F.max("y").over(Window.partitionBy("series_id", "season")), "peak_idx": F.max_by("week_idx", "y").over(Window.partitionBy("series_id", "season"))})
    last = peak.groupBy("series_id").agg(*[F.max_by(c, "week_idx").alias(c) for c in ("iso_week", "y", "peak", "peak_idx")], F.max("week_idx").alias("last_idx")).join(trend, "series_id")
    w = F.col("iso_week") if today_week is None else today_week
    over = (F.col("peak") >= p.thresholds[1]) & (F.col("last_idx") - F.col("peak_idx") >= 3) & (F.col("y") <= 0.85 * F.col("peak")) & F.col("falling")
    kind = F.when(w.between(33, 47), "autumn").when(w.between(22, 32), "summer").when(w.between(11, 16) & F.col("rising"), "winter_pre").when(w.between(11, 21), "spring").when(over, "winter_post").otherwise("winter_pre")
    return last.select("series_id", "iso_week", kind.alias("plan_phase"))


def early_signal(sub: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """(series_id, week_idx, signal): the sub-indicator is high, half as high again as the last plain week at least 2 weeks back, and not below the week before."""
    s = sub.join(F.broadcast(cal.select("week_idx", "htype")), "week_idx", "left")
    base = F.last(F.when(F.col("htype").isNull(), F.col("y")), True).over(by_week().rangeBetween(Window.unboundedPreceding, -2))
    before = F.lag("y").over(by_week())
    return s.select("series_id", "week_idx", F.coalesce((F.col("y") >= p.signal) & (F.col("y") >= 1.5 * base) & (F.col("y") >= before), F.lit(False)).alias("signal"))


def situation(facts: DataFrame, p: Params) -> DataFrame:
    """facts with situation. Conditions overlap in the rules; our order is S6, S10, S9/S9a, S12, S14, S11, S7/S8, S4/S4a, S3/S3a, S2, S8j, S5, S1b/S1.

    facts: series_id, planned_band, band (measured), y, plain_y (last plain value), plan_phase, iso_week, rising, fast,
    falling, signal, on_holiday, level, and p_yellow, p_amber, p_red, the highest chances within four weeks.
    """
    c = F.col
    pb, ph = c("planned_band"), c("plan_phase")
    autumn, pre, post = ph == "autumn", ph == "winter_pre", ph == "winter_post"
    measured_amber = c("band").isin("amber", "red")
    calm = (pb == "green") | ((pb == "yellow") & (ph == "summer"))
    s = (
        F.when(c("signal") & (c("y") < p.thresholds[2]) & ~ph.isin("spring", "winter_post"), "S6")
        .when((post & (pb == "red") & ~c("rising")) | (post & (pb == "amber") & c("falling")), "S10")
        .when((pb == "red") & (c("plain_y") >= p.thresholds[2]), "S9").when(pb == "red", "S9a")
        .when(c("on_holiday") & ~c("rising") & ~c("falling"), "S12")
        .when((ph == "summer") & (c("fast") | (c("rising") & (pb != "green"))), "S14")
        .when(c("falling") & ~autumn & ~pre, "S11")
        .when((pb == "amber") & pre & (c("rising") | (c("p_red") >= 0.30)), "S7").when((pb == "amber") & pre, "S8")
        .when((pb == "amber") & autumn & c("rising") & measured_amber, "S4").when((pb == "amber") & autumn & c("rising"), "S4a")
        .when((pb == "yellow") & (autumn | pre) & (c("rising") | (c("p_amber") >= 0.50)), F.when((c("band") == "green") & ~c("rising"), "S3a").otherwise("S3"))
        .when((pb == "green") & autumn & (c("rising") | (c("p_yellow") >= 0.30)), "S2")
        .when(pb.isin("amber", "yellow") & (post | (ph == "spring")), "S8j")
        .when(((pb == "amber") & autumn) | ((pb == "yellow") & (autumn | pre)), "S5")
        .when(calm & (c("level") >= 1), "S1b").otherwise("S1")
    )
    return facts.withColumn("situation", s)


def capacity_level(weeks: DataFrame, p: Params) -> DataFrame:
    """(series_id, week_idx, level) of (series_id, week_idx, planned_band, y, iso_week, plan_phase, signal, falling, on_holiday): up at once, down by one step at most and only on a confirmed fall in spring, after the peak or in summer to week 32, never in a holiday week; in autumn at least 1. A fold over each series' weeks in order."""
    wanted = F.when(F.col("planned_band") == "red", 3).when(F.col("planned_band") == "amber", 2).when(F.col("planned_band") == "yellow", 1).otherwise(0)
    wanted = F.when(F.col("signal") | (F.col("y") >= p.thresholds[2]), F.greatest(wanted, F.lit(3))).otherwise(wanted)
    floor = F.when(F.col("plan_phase") == "autumn", 1).otherwise(0)
    may_fall = F.col("falling") & ~F.col("on_holiday") & (F.col("plan_phase").isin("spring", "winter_post") | ((F.col("plan_phase") == "summer") & (F.col("iso_week") <= 32)))
    steps = weeks.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("week_idx", F.greatest(wanted, floor).alias("want"), may_fall.alias("down")))).alias("steps"))
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<struct<week_idx:bigint,level:int>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        level = F.when(s["want"] >= a["level"], s["want"]).when(s["down"], F.greatest(s["want"], a["level"] - 1)).otherwise(a["level"])
        return F.struct(level.alias("level"), F.concat(a["out"], F.array(F.struct(s["week_idx"].alias("week_idx"), level.alias("level")))).alias("out"))

    return steps.select("series_id", F.inline(F.aggregate("steps", start, step, lambda a: a["out"])))


def capacity_pct(planned: DataFrame, panel: DataFrame, share: DataFrame) -> DataFrame:
    """(series_id, low_pct, high_pct) of capacity: planned value over the summer median of the last 3 years, times share (series_id, share), at a respiratory part of 25 and 45 %, to 5 %, at least 100 %."""
    last = F.max("iso_year").over(Window.partitionBy("series_id"))
    summer = panel.withColumn("last", last).where(F.col("iso_week").between(27, 34) & (F.col("iso_year") > F.col("last") - 3)).groupBy("series_id").agg(F.median("y").alias("base"))
    m = F.col("planned") / F.col("base") * F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.col("share")))
    pct = lambda s: F.greatest(F.lit(100.0), F.bround(((1 - s) + s * m) * 100 / 5) * 5)
    return planned.join(summer, "series_id").join(share, "series_id").select("series_id", "base", pct(0.25).alias("low_pct"), pct(0.45).alias("high_pct"))
