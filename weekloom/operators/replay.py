"""Recommendations of past weeks, each from what was known then, and the levels and capacities that they hold up.

Two times run here: the week in which somebody looks (today_idx), and the latest week that was reported by then
(week_idx). A report comes with a delay of one or two weeks, so that each today has a vintage for each delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, monday_of
from weekloom.operators.history import band_of, by_week, trend_growth
from weekloom.params import Params

#: The weights of the groups from 15 to 24, 25 to 64 and 65 years in the adults' index.
ADULTS = (0.114, 0.636, 0.25)
#: Parts of respiratory patients in summer between which the capacity lies.
PARTS = (0.25, 0.45)


def known_weeks(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """panel's weeks with what the series said up to each: clean (last 4 plain values, newest first), plain_y, peak and peak_idx of the season so far, next_idx, htype."""
    m = panel.join(F.broadcast(cal.select("week_idx", "htype")), "week_idx", "left").withColumn("plain", F.col("htype").isNull())
    own = Window.partitionBy("series_id", "plain").orderBy("week_idx")
    so_far = by_week().rowsBetween(Window.unboundedPreceding, 0)
    lags = F.array("y", *[F.lag("y", k).over(own) for k in (1, 2, 3)])
    top = F.max(F.struct("y", -F.col("week_idx"))).over(Window.partitionBy("series_id", "season").orderBy("week_idx").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumns({"lags": F.when(F.col("plain"), lags), "top": top, "next_idx": F.lead("week_idx").over(by_week())})
    m = m.withColumn("clean", F.last("lags", ignorenulls=True).over(so_far))
    return m.select("series_id", "week_idx", "y", "htype", "next_idx", F.coalesce("clean", F.array().cast("array<double>")).alias("clean"), F.get("clean", F.lit(0)).alias("plain_y"), F.col("top.y").alias("peak"), (-F.col("top.col2")).alias("peak_idx"))


def vintages(panel: DataFrame, rows: DataFrame, cal: DataFrame, signal: DataFrame, p: Params, delays: tuple[int, ...] = (1, 2), longest: int = 4) -> DataFrame:
    """For each series, today_idx and delay the facts of a recommendation, from the latest week reported by then and the forecast from it.

    rows are forecasts of all weeks' origins; without one, the plan is the last value. A week without a report is
    stood in for by the one before, of up to longest - 1 weeks earlier; older ones say nothing any more.
    """
    w = known_weeks(panel, cal)
    upto = F.least(F.coalesce(F.col("next_idx"), F.col("week_idx") + 1) - 1, F.col("week_idx") + longest - 1)
    v = w.withColumn("known_idx", F.explode(F.sequence("week_idx", upto))).withColumn("delay", F.explode(F.array(*map(F.lit, delays)))).withColumn("today_idx", F.col("known_idx") + F.col("delay"))
    f = rows.select("series_id", F.col("origin_idx").alias("week_idx"), F.col("week_idx").alias("target"), "median", "q75", "p_1", "p_2", "p_3").join(F.broadcast(cal.select(F.col("week_idx").alias("target"), F.col("htype").alias("target_type"))), "target", "left")
    both = v.select("series_id", "week_idx", "today_idx", "delay").join(f, ["series_id", "week_idx"])
    plain, ahead = F.col("target_type").isNull(), F.col("target") - F.col("today_idx")
    soon = ahead.between(1, 4)
    said = both.groupBy("series_id", "today_idx", "delay").agg(
        F.avg(F.when(soon & plain, F.col("median"))).alias("soon"), F.max(F.when(ahead == 2, F.col("q75"))).alias("q75"), F.max(F.when(ahead == 2, F.col("target_type"))).alias("q75_type"),
        F.max_by("q75", F.when(plain & (ahead < 2), ahead)).alias("lo"), F.min_by("q75", F.when(plain & (ahead > 2), ahead)).alias("hi"),
        *[F.max(F.when(soon, F.col(f"p_{k}"))).alias(n) for k, n in enumerate(("p_yellow", "p_amber", "p_red"), 1)],
    )
    v = v.join(said, ["series_id", "today_idx", "delay"], "left").join(signal.select("series_id", "week_idx", "signal"), ["series_id", "week_idx"], "left")
    expected = F.when(F.col("q75_type").isNull(), F.col("q75").cast("double")).otherwise(F.sqrt(F.coalesce("lo", "hi") * F.coalesce("hi", "lo")))
    full = F.get("clean", F.lit(3)).isNotNull()
    g, down = trend_growth(F.col("clean"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    v = v.withColumns({"planned": F.greatest("y", expected), "g": F.when(full, g), "down": F.when(full, down), "iso_week": iso_week(monday_of(F.col("today_idx")))})
    v = v.withColumns({"planned_band": band_of(F.col("planned"), p), "band": band_of(F.col("y"), p), "fast": yes(F.col("g") >= 0.10), "falling": yes((F.col("g") <= -0.03) & F.col("down")), "rising": yes(F.col("g") >= 0.03) | yes(F.col("soon") > 1.05 * F.col("y")), "signal": yes(F.col("signal")), "on_holiday": F.col("htype").isNotNull()})
    over = (F.col("peak") >= p.thresholds[1]) & (F.col("week_idx") - F.col("peak_idx") >= 3) & (F.col("y") <= 0.85 * F.col("peak")) & F.col("falling")
    at = F.col("iso_week")
    phase = F.when(at.between(33, 47), "autumn").when(at.between(22, 32), "summer").when(at.between(11, 16) & F.col("rising"), "winter_pre").when(at.between(11, 21), "spring").when(over, "winter_post").otherwise("winter_pre")
    v = v.withColumn("plan_phase", phase).withColumn("crisis", (F.col("y") >= p.thresholds[2]) & (F.col("rising") | (F.col("plan_phase") == "winter_pre")))
    return v.select("series_id", "today_idx", "delay", "week_idx", "y", "planned", "planned_band", "band", "plain_y", "iso_week", "plan_phase", "fast", "rising", "falling", "signal", "on_holiday", "crisis", "p_yellow", "p_amber", "p_red")


def wanted_level(p: Params) -> Column:
    """0 to 3 by the planned band; 3 under the early signal or at epidemic level; in autumn 1 at least."""
    by_band = F.when(F.col("planned_band") == "red", 3).when(F.col("planned_band") == "amber", 2).when(F.col("planned_band") == "yellow", 1).otherwise(0)
    return F.greatest(by_band, F.when(F.col("signal") | (F.col("y") >= p.thresholds[2]), 3).otherwise(0), F.when(F.col("plan_phase") == "autumn", 1).otherwise(0))


def may_fall() -> Column:
    """A confirmed fall, in spring, after the peak or in summer to week 32, and not in a holiday week."""
    return F.col("falling") & ~F.col("on_holiday") & (F.col("plan_phase").isin("spring", "winter_post") | ((F.col("plan_phase") == "summer") & (F.col("iso_week") <= 32)))


def capacity_share(panel: DataFrame, groups: DataFrame, cal: DataFrame) -> DataFrame:
    """(series_id, week_idx, base, share) as known in each week: the summer median of the last 3 years, and the adults' part in growth.

    groups: (series_id, week_idx, groups), rates of five age groups. The part is the adults' index over its summer
    median, over the same of the total; of the last two plain weeks the larger one counts, between 0.5 and 1.5. Both are
    null before any summer.
    """
    index = sum((F.get("groups", F.lit(2 + k)) * x for k, x in enumerate(ADULTS)), F.lit(0.0))
    m = panel.join(groups, ["series_id", "week_idx"], "left").join(F.broadcast(cal.select("week_idx", "htype")), "week_idx", "left").withColumn("index", index)
    summer = m.where(F.col("iso_week").between(27, 34)).withColumn("iso_year", F.explode(F.sequence("iso_year", F.col("iso_year") + 2)))
    summers = summer.groupBy("series_id", "iso_year").agg(F.collect_list(F.struct("week_idx", "y", "index")).alias("summer"))
    m = m.join(summers, ["series_id", "iso_year"], "left").withColumn("summer", F.filter("summer", lambda s: s["week_idx"] <= F.col("week_idx")))

    def middle(name: str) -> Column:
        x = F.array_sort(F.filter(F.transform("summer", lambda s: s[name]), lambda v: v.isNotNull()))
        n = F.size(x)
        return F.when(n > 0, (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2)

    plain = F.col("htype").isNull()
    own = Window.partitionBy("series_id", "plain").orderBy("week_idx")
    m = m.withColumns({"base": middle("y"), "base_index": middle("index"), "plain": plain, "ratio": F.col("index") / F.col("y")})
    m = m.withColumn("two", F.when(F.col("plain"), F.greatest("ratio", F.lag("ratio").over(own))))
    two = F.last("two", ignorenulls=True).over(by_week().rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("two", two).select("series_id", "week_idx", "base", F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.col("two") * F.col("base") / F.col("base_index"))).alias("share"))


def capacity_replay(v: DataFrame, share: DataFrame, p: Params, hold: int = 8) -> DataFrame:
    """(series_id, today_idx, raw, held, level, crisis, low_pct, high_pct) for each week in which a recommendation was possible.

    raw is the higher of the delays' recommendations, held the highest raw of the hold weeks before. The level goes up at
    once; down by one step at most, and only where every delay's facts let it fall; else it stays, as long as one of the
    held recommendations reached it. Percentages likewise, but where they may fall they lose half of the difference. They
    are (1 - s) + s * planned / base * share in %, to 5, at least 100, and null without a base or share. A fold over each series' weeks.
    """
    m = F.col("planned") / F.col("base") * F.col("share")
    pct = {n: 100 * ((1 - s) + s * m) for n, s in zip(("low", "high"), PARTS, strict=True)}
    v = v.join(share, ["series_id", "week_idx"], "left").withColumns({"want": wanted_level(p), "down": may_fall(), **pct})
    t = v.groupBy("series_id", "today_idx").agg(F.max("want").alias("raw"), F.bool_and("down").alias("down"), F.bool_or("crisis").alias("crisis"), F.max("low").alias("low"), F.max("high").alias("high"))
    before = Window.partitionBy("series_id").orderBy("today_idx").rangeBetween(-hold, -1)
    t = t.withColumns({f"held_{c}": F.max(c).over(before) for c in ("raw", "low", "high")})
    steps = t.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("today_idx", "raw", "down", "crisis", "low", "high", "held_raw", "held_low", "held_high"))).alias("steps"))
    row = "array<struct<today_idx:bigint,raw:int,held:int,level:int,crisis:boolean,low:double,high:double>>"
    start = F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.array().cast(row).alias("out"))

    def next_of(old: Column, new: Column, held: Column, down: Column, fallen: Column) -> Column:
        kept = F.when(down, fallen).otherwise(F.greatest(new, F.least(old, held)))
        return F.when(old.isNull() | (new >= old), new).when(new.isNull(), old).otherwise(kept)

    def step(a: Column, s: Column) -> Column:
        level = next_of(a["level"], s["raw"], s["held_raw"], s["down"], F.greatest(s["raw"], a["level"] - 1))
        low, high = (next_of(a[c], s[c], s[f"held_{c}"], s["down"], (s[c] + a[c]) / 2) for c in ("low", "high"))
        out = F.struct(s["today_idx"].alias("today_idx"), s["raw"].alias("raw"), s["held_raw"].alias("held"), level.alias("level"), s["crisis"].alias("crisis"), low.alias("low"), high.alias("high"))
        return F.struct(level.alias("level"), low.alias("low"), high.alias("high"), F.concat(a["out"], F.array(out)).alias("out"))

    done = steps.select("series_id", F.inline(F.aggregate("steps", start, step, lambda a: a["out"])))
    whole = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(100.0), F.bround(F.round(F.col(c) / 5, 9)) * 5))
    return done.select("series_id", "today_idx", "raw", "held", "level", "crisis", whole("low").alias("low_pct"), whole("high").alias("high_pct"))
