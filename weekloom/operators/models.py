"""Forecast models: (panel, p) -> (series_id, origin_idx, horizon, lp) for all eligible origins at once; lp is a natural log.

No model sees a week after its origin: profiles of a season come from the seasons before it, holiday effects from the
version known at the origin. Origins are weeks that have a value, but for the production models (analog, holiday
profile and their blend), which also take origins_at(): weeks whose report is late are forecast from the last week that
has one. seen is what profiles.with_effects() gives; write it as a table first, since the models read it several times.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year, monday_of, season_of, wk
from weekloom.operators.history import by_week
from weekloom.operators.profiles import effect, growth_profile, holiday_profile, level_climatology, log_level
from weekloom.params import Params

OUT = ["series_id", "origin_idx", "horizon", "lp"]


def so_far(by: str = "horizon") -> WindowSpec:
    """The horizons of an origin up to each."""
    return Window.partitionBy("series_id", "origin_idx").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)


def rolling_origins(panel: DataFrame, p: Params) -> DataFrame:
    """Weeks from which forecasts are made: not in excluded seasons, with at least min_seasons seasons up to them."""
    seen = F.dense_rank().over(Window.partitionBy("series_id").orderBy("season"))
    return panel.withColumn("seen", seen).where((F.col("seen") >= p.min_seasons) & ~F.col("season").isin(*p.excluded)).select("series_id", F.col("week_idx").alias("origin_idx"), F.col("season").alias("s0"), "iso_year", "iso_week", "y")


def origins_at(panel: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(series_id, origin_idx, base_idx, s0) of wanted (series_id, origin_idx), weeks with or without a value.

    base_idx is the last week up to the origin that has a value and is in no excluded season; s0 is the origin's own
    season. Origins in excluded seasons, before min_seasons seasons and of series without a panel go.
    """
    rank = F.dense_rank().over(Window.partitionBy("series_id").orderBy("season"))
    known = panel.withColumn("seen", rank).where(~F.col("season").isin(*p.excluded)).select("series_id", "week_idx", F.struct("week_idx", "seen").alias("base"))
    asked = wanted.select("series_id", F.col("origin_idx").alias("week_idx"), F.lit(True).alias("asked")).distinct()
    at = known.join(asked, ["series_id", "week_idx"], "full").withColumn("base", F.last("base", ignorenulls=True).over(by_week())).where("asked")
    day = monday_of(F.col("week_idx"))
    at = at.withColumn("s0", season_of(iso_year(day), iso_week(day))).where((F.col("base.seen") >= p.min_seasons) & ~F.col("s0").isin(*p.excluded))
    return at.select("series_id", F.col("week_idx").alias("origin_idx"), F.col("base.week_idx").alias("base_idx"), "s0")


def _gap() -> Column:
    return F.col("origin_idx") - F.col("base_idx")


def _steps(origins: DataFrame, p: Params) -> DataFrame:
    """origins with each week after their base up to the last horizon: step, target_idx, and horizon, which is below 1 within a gap."""
    t = origins.withColumn("step", F.explode(F.sequence(F.lit(1), (_gap() + p.horizon).cast("int"))))
    return t.withColumns({"target_idx": F.col("base_idx") + F.col("step"), "horizon": (F.col("step") - _gap()).cast("int")})


def targets(origins: DataFrame, p: Params) -> DataFrame:
    """origins with each horizon: target_idx, and year and week of the target (t_year, t_week)."""
    t = origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(p.horizon)))).withColumn("target_idx", F.col("origin_idx") + F.col("horizon"))
    day = monday_of(F.col("target_idx"))
    return t.withColumns({"t_year": iso_year(day), "t_week": iso_week(day)})


def _step_week() -> Column:
    """wk52 of the week before the target."""
    return wk(iso_week(monday_of(F.col("target_idx") - 1)))


def _value_of(panel: DataFrame, year: str, week: str, name: str) -> DataFrame:
    return panel.select("series_id", F.col("iso_year").alias(year), F.col("iso_week").alias(week), F.col("y").alias(name))


def persistence(panel: DataFrame, p: Params) -> DataFrame:
    return targets(rolling_origins(panel, p), p).withColumn("lp", log_level(F.col("y"))).select(OUT)


def legacy(panel: DataFrame, p: Params) -> DataFrame:
    """Half the mean of the last 4 rows, half last year's same week at this year's level."""
    ma4 = panel.withColumn("ma4", F.avg("y").over(by_week().rowsBetween(-3, 0))).select("series_id", F.col("week_idx").alias("origin_idx"), "ma4")
    t = targets(rolling_origins(panel, p), p).join(ma4, ["series_id", "origin_idx"]).withColumns({"py": F.col("t_year") - 1, "oy": F.col("iso_year") - 1})
    t = t.join(_value_of(panel, "py", "t_week", "prev"), ["series_id", "py", "t_week"], "left").join(_value_of(panel, "oy", "iso_week", "base"), ["series_id", "oy", "iso_week"], "left")
    value = F.when(F.col("prev") > 0, 0.5 * F.col("ma4") + 0.5 * F.col("prev") * (F.col("y") / F.coalesce("base", "prev"))).otherwise(F.col("ma4") * 0.92)
    return t.withColumn("lp", log_level(value)).select(OUT)


def seasonal_naive(panel: DataFrame, p: Params) -> DataFrame:
    """The origin's level times last year's ratio; without one, the level."""
    t = targets(rolling_origins(panel, p), p).withColumns({"py": F.col("t_year") - 1, "pw": wk(F.col("t_week")), "oy": F.col("iso_year") - 1, "ow": wk(F.col("iso_week"))})
    t = t.join(_value_of(panel, "py", "pw", "prev"), ["series_id", "py", "pw"], "left").join(_value_of(panel, "oy", "ow", "base"), ["series_id", "oy", "ow"], "left")
    return t.withColumn("lp", log_level(F.col("y")) + F.coalesce(F.ln(F.col("prev") / F.col("base")), F.lit(0.0))).select(OUT)


def profile(panel: DataFrame, p: Params) -> DataFrame:
    """The origin's level plus the profile's growth week by week."""
    t = targets(rolling_origins(panel, p), p).withColumn("wk52", _step_week())
    t = t.join(growth_profile(panel, p).drop("n"), ["series_id", "s0", "wk52"], "left")
    return t.withColumn("lp", log_level(F.col("y")) + F.sum(F.coalesce("growth", F.lit(0.0))).over(so_far())).select(OUT)


def recent_anomaly_growth(panel: DataFrame, p: Params) -> DataFrame:
    """(series_id, origin_idx, anomaly): mean of growth over the profile's, over the last momentum_k weeks that have both."""
    o = rolling_origins(panel, p).select("series_id", "origin_idx", "s0")
    near = F.lag("week_idx").over(by_week()) == F.col("week_idx") - 1
    grown = panel.select("series_id", "week_idx", F.when(near, F.ln(F.col("y") / F.lag("y").over(by_week()))).alias("own"), F.when(near, F.lag("wk52").over(by_week())).alias("wk52")).where("own is not null")
    steps = o.withColumn("week_idx", F.explode(F.sequence(F.col("origin_idx") - p.momentum_k + 1, F.col("origin_idx"))))
    return steps.join(grown, ["series_id", "week_idx"]).join(growth_profile(panel, p), ["series_id", "s0", "wk52"]).groupBy("series_id", "origin_idx").agg(F.avg(F.col("own") - F.col("growth")).alias("anomaly"))


def profile_momentum(panel: DataFrame, p: Params) -> DataFrame:
    base = profile(panel, p).join(recent_anomaly_growth(panel, p), ["series_id", "origin_idx"], "left")
    damp = F.sum(F.pow(F.lit(p.momentum_phi), F.col("horizon"))).over(so_far())
    return base.withColumn("lp", F.col("lp") + F.coalesce("anomaly", F.lit(0.0)) * damp).select(OUT)


def clim_anomaly(panel: DataFrame, p: Params) -> DataFrame:
    """Climatology plus a fading anomaly; the profile where the origin's week has no climatology."""
    clim = level_climatology(panel, p).drop("n")
    o = rolling_origins(panel, p)
    own = panel.select("series_id", "week_idx", "wk52", log_level(F.col("y")).alias("z"))
    steps = o.select("series_id", "origin_idx", "s0", F.explode(F.array(F.col("origin_idx"), F.col("origin_idx") - 1)).alias("week_idx"))
    an = steps.join(own, ["series_id", "week_idx"]).join(clim, ["series_id", "s0", "wk52"]).withColumn("a", F.col("z") - F.col("level"))
    a0 = an.groupBy("series_id", "origin_idx").agg(F.max(F.when(F.col("week_idx") == F.col("origin_idx"), F.col("a"))).alias("now"), F.avg("a").alias("mean")).select("series_id", "origin_idx", (0.7 * F.col("now") + 0.3 * F.col("mean")).alias("a0"))
    t = targets(o, p).withColumn("wk52", wk(F.col("t_week"))).join(clim, ["series_id", "s0", "wk52"], "left").join(a0, ["series_id", "origin_idx"], "left")
    value = F.col("level") + F.col("a0") * F.pow(F.lit(p.anomaly_rho), F.col("horizon"))
    own_path = t.withColumn("own", F.coalesce(F.last(value, ignorenulls=True).over(so_far()), log_level(F.col("y"))))
    return own_path.join(profile(panel, p), ["series_id", "origin_idx", "horizon"]).withColumn("lp", F.when(F.col("a0").isNull(), F.col("lp")).otherwise(F.col("own"))).select(OUT)


def _known(panel: DataFrame, seen: DataFrame, p: Params, origins: DataFrame | None = None) -> DataFrame:
    """Origins (all weeks with a value, or those of origins_at) with z, holiday type, version (-1: none) and effects of their base."""
    if origins is None:
        origins = rolling_origins(panel, p).select("series_id", "origin_idx", F.col("origin_idx").alias("base_idx"), "s0")
    known = seen.select("series_id", F.col("week_idx").alias("base_idx"), "z", "htype", F.coalesce("version", F.lit(-1)).alias("version"), "effects")
    return origins.join(known, ["series_id", "base_idx"])


def _target_type(t: DataFrame, cal: DataFrame) -> DataFrame:
    return t.join(F.broadcast(cal.select(F.col("week_idx").alias("target_idx"), F.col("htype").alias("t_htype"))), "target_idx", "left")


def seasonal_profile_holiday(panel: DataFrame, seen: DataFrame, cal: DataFrame, p: Params, origins: DataFrame | None = None) -> DataFrame:
    """Adjusted level plus pooled growth of past seasons, plus profile_phi**h times the recent pace over the profile's, plus the target's holiday effect."""
    o = _known(panel, seen, p, origins)
    g = holiday_profile(panel, cal, o.select("series_id", "s0", "version", "effects").dropDuplicates(["series_id", "s0", "version"]), p)
    t = _steps(o, p).withColumn("wk52", wk(iso_week(monday_of(F.col("target_idx"))))).join(g, ["series_id", "s0", "version", "wk52"], "left")
    t = _target_type(t, cal)
    pace = F.lit(0.0)
    if p.profile_phi:
        m = seen.select("series_id", "week_idx", "wk52", F.col("z").alias("z_i"), F.col("htype").alias("type_i"), F.lag("week_idx").over(by_week()).alias("before_i"), F.lag("z").over(by_week()).alias("z_b"), F.lag("htype").over(by_week()).alias("type_b")).where("before_i = week_idx - 1")
        steps = o.withColumn("week_idx", F.explode(F.sequence(F.col("base_idx") - p.profile_n + 1, F.col("base_idx")))).drop("z", "htype").join(m, ["series_id", "week_idx"])
        steps = steps.withColumn("change", F.col("z_i") - effect(F.col("type_i")) - F.col("z_b") + effect(F.col("type_b")))
        # the profile is taken over as many weeks back from the base as there are changes
        per = steps.groupBy("series_id", "origin_idx").agg(F.greatest(F.lit(-p.profile_clip), F.least(F.lit(p.profile_clip), F.avg("change"))).alias("pace"), F.count("*").cast("int").alias("n"))
        weeks = o.join(per, ["series_id", "origin_idx"]).withColumn("back", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("wk52", wk(iso_week(monday_of(F.col("base_idx") - F.col("back")))))
        anom = weeks.join(g, ["series_id", "s0", "version", "wk52"], "left").groupBy("series_id", "origin_idx").agg((F.first("pace") - F.avg(F.coalesce("growth", F.lit(0.0)))).alias("anom"))
        t = t.join(anom, ["series_id", "origin_idx"], "left")
        pace = F.pow(F.lit(p.profile_phi), F.col("step")) * F.coalesce("anom", F.lit(0.0))
    path = F.sum(F.coalesce("growth", F.lit(0.0)) + pace).over(so_far("step"))
    return t.withColumn("lp", F.col("z") - effect(F.col("htype")) + path + effect(F.col("t_htype"))).where("horizon > 0").select(OUT)


def analog_align(panel: DataFrame, seen: DataFrame, cal: DataFrame, p: Params, late: int = 0) -> DataFrame:
    """(series_id, s0, s, week_idx, season, shift, d, t_now, t_then): each week with the week of season s that holds the same date, for the seasons s0 whose windows reach it. d, the log difference, is null where the past week is missing. late: the most seasons between an origin and its base."""
    m = seen.where(~F.col("season").isin(*p.excluded)).select("series_id", "week_idx", "season", "z", "htype")
    seasons = m.select("series_id", F.col("season").alias("s")).distinct()
    back = -(-p.long_weeks // 52) + late
    cur = m.withColumn("s0", F.explode(F.sequence(F.col("season"), F.col("season") + back))).join(seasons, "series_id").where("s < s0")
    july = lambda c: F.make_date(c, F.lit(7), F.lit(1))
    cur = cur.withColumn("shift", F.floor((3 - F.datediff(july(F.col("s0")), july(F.col("s")))) / 7).cast("long")).withColumn("past", F.col("week_idx") + F.col("shift"))
    then = m.select("series_id", F.col("week_idx").alias("past"), F.col("z").alias("z_then"), F.col("htype").alias("t_then"))
    return cur.join(then, ["series_id", "past"], "left").select("series_id", "s0", "s", "week_idx", "season", "shift", (F.col("z") - F.col("z_then")).alias("d"), F.col("htype").alias("t_now"), "t_then")


TYPES = ("xmas1", "xmas2", "autumn", "goodfri", "eastermon", "minor")


def analog_weights(panel: DataFrame, seen: DataFrame, cal: DataFrame, p: Params, origins: DataFrame | None = None, late: int = 0) -> DataFrame:
    """(series_id, origin_idx, base_idx, s0, s, shift, d2, o_now, o_long, w, effects, x0): the analogs of each origin.

    Effects enter a long window's mean linearly: raw differences and differences of holiday counts are summed by window
    frames once for each pair of seasons, and each origin applies its own effects to the sums.
    """
    pairs = analog_align(panel, seen, cal, p, late)
    frame = Window.partitionBy("series_id", "s0", "s").orderBy("week_idx").rangeBetween(-(p.long_weeks - 1), 0)
    counts = {f"c_{k}": F.sum(F.when(F.col("d").isNotNull(), (F.coalesce(F.col("t_now") == k, F.lit(False))).cast("int") - (F.coalesce(F.col("t_then") == k, F.lit(False))).cast("int"))).over(frame) for k in TYPES}
    long = pairs.withColumns({"n_long": F.count("d").over(frame), "sum_d": F.sum("d").over(frame)} | counts).where(f"s0 - season <= {late}")
    o = _known(panel, seen, p, origins).select("series_id", "origin_idx", "base_idx", "s0", "z", "htype", "effects")
    at = long.withColumnRenamed("week_idx", "base_idx").join(o, ["series_id", "base_idx", "s0"])
    taken = reduce(lambda a, k: a + F.col(f"c_{k}") * effect(F.lit(k)), TYPES, F.lit(0.0))
    at = at.withColumns({"o_long": (F.col("sum_d") - taken) / F.nullif(F.col("n_long"), F.lit(0)), "d_now": F.col("d") - effect(F.col("t_now")) + effect(F.col("t_then")), "x0": F.col("z") - effect(F.col("htype"))})
    own = pairs.where("d is not null").select("series_id", "s0", "s", "week_idx", F.col("d").alias("dj"), F.col("t_now").alias("tj"), F.col("t_then").alias("uj"))
    lags = at.select("series_id", "s0", "s", "origin_idx", "effects", F.posexplode(F.expr(f"transform(sequence(0, {p.shape_weeks - 1}), j -> base_idx - j)")).alias("j", "week_idx"))
    shape = lags.join(own, ["series_id", "s0", "s", "week_idx"]).withColumns({"w": F.pow(F.lit(p.decay), F.col("j")), "r": F.col("dj") - effect(F.col("tj")) + effect(F.col("uj"))})
    mean = F.sum(F.col("w") * F.col("r")) / F.sum("w")
    shape = shape.groupBy("series_id", "s0", "s", "origin_idx").agg(F.count("*").alias("n_win"), mean.alias("o_win"), (F.sum(F.col("w") * F.col("r") * F.col("r")) / F.sum("w") - mean * mean).alias("d2"))
    a = at.join(shape, ["series_id", "s0", "s", "origin_idx"], "left")
    future = at.select("series_id", "s0", "s", "origin_idx", F.explode(F.sequence(F.col("base_idx") + F.col("shift") + 1, F.col("origin_idx") + F.col("shift") + p.horizon)).alias("week_idx")).join(panel.where(~F.col("season").isin(*p.excluded)).select("series_id", "week_idx"), ["series_id", "week_idx"]).select("series_id", "s0", "s", "origin_idx").distinct()
    a = a.join(future, ["series_id", "s0", "s", "origin_idx"], "left_semi")
    proper = F.coalesce(F.col("n_win") >= max(p.min_pairs, (p.shape_weeks + 1) // 2), F.lit(False))
    a = a.withColumn("kind", F.when(proper, 1).when(F.col("n_long") >= p.min_long_pairs, 2)).where("kind is not null")
    of = Window.partitionBy("series_id", "origin_idx")
    a = a.withColumn("best", F.min("kind").over(of)).where("kind = best")
    a = a.withColumns({"d2": F.when(F.col("kind") == 1, F.greatest("d2", F.lit(0.0))).otherwise(0.0), "o_long": F.coalesce("o_long", "o_win")})
    a = a.withColumn("o_now", F.coalesce("d_now", F.when(F.col("kind") == 1, F.col("o_win")).otherwise(F.col("o_long"))))
    a = a.withColumn("n", F.row_number().over(of.orderBy("d2", "s"))).where(F.col("n") <= p.nearest)
    w = F.exp(-F.col("d2") / (2 * p.tau * p.tau)) if p.tau > 0 else F.lit(1.0)
    a = a.withColumn("w", w).withColumn("w", F.when(F.sum("w").over(of) > 0, F.col("w")).otherwise(1.0))
    return a.select("series_id", "origin_idx", "base_idx", "s0", "s", "shift", "d2", "o_now", "o_long", "w", "effects", "x0")


def analog(panel: DataFrame, seen: DataFrame, cal: DataFrame, p: Params, origins: DataFrame | None = None, late: int = 0) -> DataFrame:
    """Weighted mean of what each past season says; without any for a week the week before, without any at all the level; plus the target's holiday effect."""
    a = analog_weights(panel, seen, cal, p, origins, late)
    then = seen.where(~F.col("season").isin(*p.excluded)).select("series_id", F.col("week_idx").alias("past"), F.col("z").alias("z_then"), F.col("htype").alias("t_then"))
    each = _steps(a, p).withColumn("past", F.col("target_idx") + F.col("shift")).join(then, ["series_id", "past"])
    said = F.col("z_then") - effect(F.col("t_then")) + F.col("o_long") + (F.col("o_now") - F.col("o_long")) * F.pow(F.lit(p.analog_rho), F.col("step"))
    mean = each.groupBy("series_id", "origin_idx", "step").agg((F.sum(F.col("w") * said) / F.sum("w")).alias("v"))
    t = _target_type(_steps(_known(panel, seen, p, origins), p), cal).join(mean, ["series_id", "origin_idx", "step"], "left")
    level = F.col("z") - effect(F.col("htype"))
    return t.withColumn("lp", F.coalesce(F.last("v", ignorenulls=True).over(so_far("step")), level) + effect(F.col("t_htype"))).where("horizon > 0").select(OUT)


def point_forecast(panel: DataFrame, seen: DataFrame, cal: DataFrame, p: Params, origins: DataFrame | None = None, late: int = 0) -> DataFrame:
    """Blend of analog and profile, weighted by horizon. origins: what origins_at() gives, with late, the most seasons between an origin and its base; else all weeks with a value."""
    w = F.element_at(F.array(*[F.lit(x) for x in p.blend]), F.least(F.col("horizon"), F.lit(len(p.blend))))
    a, b = analog(panel, seen, cal, p, origins, late), seasonal_profile_holiday(panel, seen, cal, p, origins).withColumnRenamed("lp", "lp_b")
    return a.join(b, ["series_id", "origin_idx", "horizon"]).withColumn("lp", w * F.col("lp") + (1 - w) * F.col("lp_b")).select(OUT)


MODELS: dict[str, Callable] = {"persistence": persistence, "legacy": legacy, "seasonal_naive": seasonal_naive, "profile": profile, "profile_momentum": profile_momentum, "clim_anomaly": clim_anomaly}


def candidate_runs(panel: DataFrame, p: Params, predict: Callable) -> DataFrame:
    """A user's predict(weeks, values, horizon) -> logs, called for each origin with the data up to it: (series_id, origin_idx, horizon, lp, error). An origin at which it fails has one row, with what went wrong.

    Origins are dealt out in chunks of one season, so that no task holds more than one series' history and one season's origins.
    """
    import pandas as pd

    hist = panel.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("week_idx", "y"))).alias("h")).select("series_id", F.col("h.week_idx").alias("weeks"), F.col("h.y").alias("ys"))
    o = rolling_origins(panel, p).groupBy("series_id", "s0").agg(F.array_sort(F.collect_list("origin_idx")).alias("origins")).join(hist, "series_id").repartition("series_id", "s0")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for series, origins, weeks, values in zip(frame.series_id, frame.origins, frame.weeks, frame.ys, strict=True):
                weeks, values = list(weeks), list(values)
                out = []
                for at in origins:
                    upto = bisect_right(weeks, at)
                    try:
                        out += [(series, int(at), h, float(v), None) for h, v in enumerate(predict(weeks[:upto], values[:upto], p.horizon), 1)]
                    except Exception as e:  # a candidate may fail at an origin
                        out.append((series, int(at), 0, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=[*OUT, "error"])

    return o.select("series_id", "origins", "weeks", "ys").mapInPandas(run, "series_id string, origin_idx long, horizon int, lp double, error string")


def candidate(panel: DataFrame, p: Params, predict: Callable) -> DataFrame:
    """Forecasts of a user's model; origins at which it fails are left out, see candidate_failures()."""
    return candidate_runs(panel, p, predict).where("error is null").select(OUT)


def candidate_failures(panel: DataFrame, p: Params, predict: Callable) -> DataFrame:
    """(series_id, n_origins, n_failed, error): how many origins of each series a user's model was asked for, at how many it failed, and one of the errors."""
    runs = candidate_runs(panel, p, predict)
    return runs.groupBy("series_id").agg(F.count_distinct("origin_idx").alias("n_origins"), F.count("error").alias("n_failed"), F.min("error").alias("error"))
