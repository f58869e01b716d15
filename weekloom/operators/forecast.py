"""Forecast distributions from earlier errors of the same phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year, monday_of, week_dist, week_label
from weekloom.params import Params

KEYS = ["series_id", "t_idx", "horizon"]


def latest_origins(origins: DataFrame, first: int = 1, last: int = 1) -> DataFrame:
    """The newest origins of each series, from first to last counted back."""
    w = Window.partitionBy("series_id").orderBy(F.desc("origin_idx"))
    return origins.withColumn("n", F.row_number().over(w)).where(F.col("n").between(first, last)).drop("n")


def phase_pool(res: DataFrame, at: DataFrame, p: Params) -> DataFrame:
    """(series_id, t_idx, horizon, err, w): errors known at each wanted origin (origin + horizon <= t_idx) from origins of about its week, or all of them where those are too few. Errors of recent seasons weigh more."""
    wanted = at.select("series_id", F.col("origin_idx").alias("t_idx"), F.col("iso_week").alias("t_week"))
    known = res.join(wanted, "series_id").where("origin_idx + horizon <= t_idx").withColumn("near", week_dist(F.col("iso_week"), F.col("t_week")) <= p.phase_window)
    n = F.count_if("near").over(Window.partitionBy(*KEYS))
    return known.withColumn("n_near", n).where(F.col("near") | (F.col("n_near") < p.min_pool)).select(*KEYS, "err", F.when(F.col("s0") >= p.recent_from, p.recent_weight).otherwise(1.0).alias("w"))


def weighted_quantiles(pool: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Quantiles of weighted values: a value stands in the middle of its weight, between values it is linear, beyond the ends constant."""
    own = Window.partitionBy(*keys).orderBy(value, "w")
    total = F.sum("w").over(Window.partitionBy(*keys))
    at = pool.withColumn("pos", (F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w") / 2) / total)
    at = at.withColumns({"pos2": F.lead("pos").over(own), "v2": F.lead(value).over(own), "n": F.row_number().over(own)})
    v = F.col(value)

    def quantile(q: float) -> Column:
        inside = F.when((F.col("pos") < q) & (q <= F.col("pos2")), v + (F.col("v2") - v) * (q - F.col("pos")) / (F.col("pos2") - F.col("pos")))
        low = F.when((F.col("n") == 1) & (F.col("pos") >= q), v)
        high = F.when(F.col("pos2").isNull() & (F.col("pos") < q), v)
        return F.max(F.coalesce(inside, low, high))

    return at.groupBy(*keys).agg(*[quantile(q).alias(n) for n, q in qs.items()])


def widened(pool: DataFrame, p: Params) -> DataFrame:
    """Errors spread around their weighted median."""
    med = weighted_quantiles(pool, KEYS, "err", {"med": 0.5})
    return pool.join(med, KEYS).withColumn("err", F.col("med") + p.widen * (F.col("err") - F.col("med"))).drop("med")


def exceedance(pool: DataFrame, lp: DataFrame, p: Params) -> DataFrame:
    """p_1, p_2, p_3: weighted share of the pool with which the value reaches each threshold."""
    share = lambda t: F.bround(F.sum(F.when(F.col("lp") - F.col("err") >= F.ln(F.lit(t)), F.col("w")).otherwise(0.0)) / F.sum("w"), 3)
    return pool.join(lp, KEYS).groupBy(*KEYS).agg(*[share(t).alias(f"p_{k}") for k, t in enumerate(p.thresholds, 1)])


def make_forecast(points: DataFrame, res: DataFrame, at: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """Forecast rows of the wanted origins: quantiles, probabilities, label, Monday, holiday. The value's quantile q is the forecast less the error's quantile 1 - q."""
    lp = points.join(at.select("series_id", "origin_idx"), ["series_id", "origin_idx"], "left_semi").withColumnRenamed("origin_idx", "t_idx").select(*KEYS, "lp")
    pool = widened(phase_pool(res, at, p), p)
    names = {"q10": 0.9, "q25": 0.75, "median": 0.5, "q75": 0.25, "q90": 0.1}
    q = weighted_quantiles(pool, KEYS, "err", names)
    day = monday_of(F.col("week_idx"))
    rows = lp.join(q, KEYS).join(exceedance(pool, lp, p), KEYS).withColumn("week_idx", F.col("t_idx") + F.col("horizon")).join(F.broadcast(cal.select("week_idx", F.col("hlabel").alias("holiday"))), "week_idx", "left")
    whole = lambda c: F.bround(F.exp(c)).cast("long")
    return rows.select("series_id", F.col("t_idx").alias("origin_idx"), "horizon", "week_idx", week_label(iso_year(day), iso_week(day)).alias("week"), day.alias("monday"), *[whole(F.col("lp") - F.col(n)).alias(n) for n in names], whole(F.col("lp")).alias("point"), "p_1", "p_2", "p_3", "holiday")


def forecast_violations(rows: DataFrame, p: Params) -> DataFrame:
    """(series_id, origin_idx, problem): missing rows or weeks, unordered quantiles or probabilities."""
    ordered = (F.col("q10") <= F.col("q25")) & (F.col("q25") <= F.col("median")) & (F.col("median") <= F.col("q75")) & (F.col("q75") <= F.col("q90"))
    a = rows.groupBy("series_id", "origin_idx").agg(F.count("*").alias("n"), (F.max("week_idx") - F.min("week_idx") + 1).alias("span"), F.bool_and(ordered).alias("ok"), F.bool_and((F.col("p_1") >= F.col("p_2")) & (F.col("p_2") >= F.col("p_3"))).alias("mono"))
    bad = F.array_compact(F.array(F.when((F.col("n") != p.horizon) | (F.col("span") != F.col("n")), "rows"), F.when(~F.col("ok"), "quantiles"), F.when(~F.col("mono"), "probabilities")))
    return a.select("series_id", "origin_idx", F.explode(bad).alias("problem"))
