"""Seasonal profiles and holiday effects, as they were known at each origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.history import by_week
from weekloom.params import Params

RECENT_TYPES = ("autumn", "xmas1", "xmas2", "eastermon")


def log_level(y: Column) -> Column:
    return F.ln(F.greatest(y, F.lit(1.0)))


def weekly_growth(panel: DataFrame) -> DataFrame:
    """Each week and its log growth to the next calendar week; weeks before a gap give no row."""
    nxt = F.when(F.lead("week_idx").over(by_week()) == F.col("week_idx") + 1, F.lead("y").over(by_week()))
    return panel.withColumn("growth", F.ln(nxt / F.col("y"))).where("growth is not null")


def _for_later_seasons(rows: DataFrame, panel: DataFrame, p: Params) -> DataFrame:
    """rows with each later season s0 of their series; rows of excluded seasons go."""
    last = panel.groupBy("series_id").agg(F.max("season").alias("last"))
    return rows.where(~F.col("season").isin(*p.excluded)).join(last, "series_id").where("season < last").withColumn("s0", F.explode(F.sequence(F.col("season") + 1, F.col("last")))).drop("last")


def growth_profile(panel: DataFrame, p: Params) -> DataFrame:
    """(series_id, s0, wk52, growth, n): median growth from each week over the seasons before s0, which is all that an origin in s0 may use."""
    rows = _for_later_seasons(weekly_growth(panel), panel, p)
    return rows.groupBy("series_id", "s0", "wk52").agg(F.median("growth").alias("growth"), F.count("*").alias("n")).where(F.col("n") >= p.min_n)


def level_climatology(panel: DataFrame, p: Params) -> DataFrame:
    """(series_id, s0, wk52, level, n): median log level of each week over the seasons before s0."""
    rows = _for_later_seasons(panel.withColumn("z", log_level(F.col("y"))), panel, p)
    return rows.groupBy("series_id", "s0", "wk52").agg(F.median("z").alias("level"), F.count("*").alias("n")).where(F.col("n") >= p.min_n)


def marked(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """The panel with z, the log of y, and the holiday type of each week. The calendar is broadcast: some 53 rows a year."""
    return panel.withColumn("z", F.ln("y")).join(F.broadcast(cal.select("week_idx", "htype")), "week_idx", "left")


def holiday_occurrences(panel: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """(series_id, week_idx, season, htype, diff, known_at): log distance of a holiday week from the line between its nearest plain neighbours within 3 weeks. It is known from the upper neighbour on."""
    plain = F.when(F.col("htype").isNull(), F.struct("week_idx", "z"))
    near = marked(panel, cal).withColumns({"lo": F.max(plain).over(by_week().rangeBetween(-3, -1)), "hi": F.min(plain).over(by_week().rangeBetween(1, 3))})
    line = F.col("lo.z") + (F.col("hi.z") - F.col("lo.z")) * (F.col("week_idx") - F.col("lo.week_idx")) / (F.col("hi.week_idx") - F.col("lo.week_idx"))
    return near.where(F.col("htype").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull() & ~F.col("season").isin(*p.excluded)).select("series_id", "week_idx", "season", "htype", (F.col("z") - line).alias("diff"), F.col("hi.week_idx").alias("known_at"))


def _middle(ordered: Column) -> Column:
    """Median of an ordered array, null of an empty one."""
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def holiday_effects(occurrences: DataFrame, p: Params) -> DataFrame:
    """(series_id, version, htype, effect): medians over what was known at each version, a week at which something became known. Some types use recent occurrences alone once there are two.

    A fold over each type's occurrences of a series in order keeps ordered lists and gives the medians after each; other
    versions carry them forward. So the work is linear in occurrences, of which a type has a few a year.
    """
    recent = F.col("season") >= p.recent_effects_from
    steps = occurrences.groupBy("series_id", "htype").agg(F.array_sort(F.collect_list(F.struct("known_at", "diff", recent.alias("recent")))).alias("steps"))
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("all"), empty.alias("new"), F.array().cast("array<struct<version:bigint,effect:double>>").alias("out"))
    own_recent = F.col("htype").isin(*RECENT_TYPES)

    def step(a: Column, s: Column) -> Column:
        every = F.array_sort(F.concat(a["all"], F.array(s["diff"])))
        new = F.when(s["recent"], F.array_sort(F.concat(a["new"], F.array(s["diff"])))).otherwise(a["new"])
        effect = F.when(own_recent & (F.size(new) >= 2), _middle(new)).when(F.size(every) >= 2, _middle(every))
        return F.struct(every.alias("all"), new.alias("new"), F.concat(a["out"], F.array(F.struct(s["known_at"].alias("version"), effect.alias("effect")))).alias("out"))

    each = steps.select("series_id", "htype", F.posexplode(F.aggregate("steps", start, step, lambda a: a["out"])))
    # of several occurrences that became known in one week, the last one has them all
    known = each.groupBy("series_id", "htype", F.col("col.version").alias("version")).agg(F.max_by(F.col("col.effect"), "pos").alias("own"), F.lit(True).alias("known"))
    versions = occurrences.groupBy("series_id").agg(F.collect_set("known_at").alias("versions"))
    every = steps.select("series_id", "htype").join(versions, "series_id").select("series_id", "htype", F.explode("versions").alias("version"))
    upto = Window.partitionBy("series_id", "htype").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("known"), F.struct("own")), ignorenulls=True).over(upto)
    filled = every.join(known, ["series_id", "htype", "version"], "left").withColumn("effect", carried["own"])
    return filled.where("effect is not null").select("series_id", "version", "htype", "effect")


def effect_maps(effects: DataFrame) -> DataFrame:
    """(series_id, version, effects): a map of at most six types."""
    return effects.groupBy("series_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("htype", "effect"))).alias("effects"))


def effect(htype: Column) -> Column:
    return F.coalesce(F.element_at("effects", F.coalesce(htype, F.lit("-"))), F.lit(0.0))


def with_effects(panel: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """marked() with version and effects: what was known of holidays in each week."""
    occ = holiday_occurrences(panel, cal, p)
    maps = effect_maps(holiday_effects(occ, p))
    at = occ.select("series_id", F.col("known_at").alias("week_idx"), F.col("known_at").alias("at")).distinct()
    seen = marked(panel, cal).join(at, ["series_id", "week_idx"], "left").withColumn("version", F.last("at", ignorenulls=True).over(by_week().rowsBetween(Window.unboundedPreceding, 0))).drop("at")
    return seen.join(maps, ["series_id", "version"], "left").withColumn("effects", F.coalesce("effects", F.create_map().cast("map<string,double>")))


def adjusted_series(panel: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """Each week's log level without the effect of its holiday, as known at the end of the series."""
    last = with_effects(panel, cal, p).groupBy("series_id").agg(F.max_by("effects", "week_idx").alias("effects"))
    return marked(panel, cal).join(last, "series_id").select("series_id", "week_idx", "z", "htype", (F.col("z") - effect(F.col("htype"))).alias("adjusted"))


def holiday_profile(panel: DataFrame, cal: DataFrame, versions: DataFrame, p: Params) -> DataFrame:
    """(series_id, s0, version, wk52, growth): median adjusted change to each week and its neighbours, over seasons before s0, for each (series_id, s0, version, effects) of versions.

    A week whose terms hold no holiday has one median for all versions of a season; the others have one for each
    different set of effects of the types that their terms hold, which versions share as long as these don't change.
    """
    m = marked(panel, cal)
    near = F.lag("week_idx").over(by_week()) == F.col("week_idx") - 1
    changes = m.withColumns({"change": F.when(near, F.col("z") - F.lag("z").over(by_week())), "before": F.when(near, F.lag("htype").over(by_week()))}).where("change is not null").where(~F.col("season").isin(*p.excluded))
    spread = changes.select("series_id", "season", F.explode(F.array(*[F.pmod(F.col("wk52") - 1 + d, F.lit(52)) + 1 for d in (-1, 0, 1)])).alias("wk52"), "change", "htype", "before")
    versions = versions.select("series_id", "s0", F.coalesce("version", F.lit(-1)).alias("version"), "effects")
    terms = spread.join(versions.select("series_id", "s0").distinct(), "series_id").where("season < s0")
    # what a week's median depends on: the effects of the types that its terms hold
    plain = F.col("htype").isNull() & F.col("before").isNull()
    key = ["series_id", "s0", "wk52"]
    weeks = terms.groupBy(*key).agg(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.array("htype", "before")))))).alias("types"), F.median(F.when(plain, F.col("change"))).alias("growth"))
    still = weeks.where("size(types) = 0").drop("types")
    moved = versions.join(weeks.where("size(types) > 0").select(*key, "types"), ["series_id", "s0"])
    moved = moved.select(*key, "version", "types", F.transform("types", lambda t: F.coalesce(F.element_at("effects", t), F.lit(0.0))).alias("at"))
    told = moved.select(*key, "types", "at").distinct().withColumn("effects", F.map_from_arrays("types", "at"))
    adjusted = terms.join(told, key).withColumn("change", F.col("change") - effect(F.col("htype")) + effect(F.col("before")))
    growth = adjusted.groupBy(*key, "at").agg(F.median("change").alias("growth"))
    return versions.select("series_id", "s0", "version").join(still, ["series_id", "s0"]).select(*key, "version", "growth").unionByName(moved.join(growth, [*key, "at"]).select(*key, "version", "growth")).select("series_id", "s0", "version", "wk52", "growth")
