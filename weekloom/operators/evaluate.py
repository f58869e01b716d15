"""Backtests: residuals, error metrics, coverage, skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year, monday_of, phase, season_of
from weekloom.params import Params

QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
#: Width of the bins by which errors (logs) are counted before those at a rank are put in order.
BIN = 1 / 1024


def at_ranks(rows: DataFrame, keys: list[str], value: Column, ranks: list[Column]) -> DataFrame:
    """keys, n (the group's values) and at, a map from each rank to its value. Ranks are longs from 0, said by n; keys have no nulls, null values don't count.

    Exact for groups of any size: values are counted by bins, and only bins that hold a rank are put in order, equal
    values as one row. No task gets more than one bin of a group. rows are read twice: make them a table.
    """
    v = rows.select(*keys, value.alias("v")).where("v is not null").withColumn("bin", F.floor(F.col("v") / BIN))
    own, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = v.groupBy(*keys, "bin").agg(F.count("*").alias("c")).withColumns({"n": F.sum("c").over(own), "before": F.sum("c").over(upto) - F.col("c")})
    wanted = bins.withColumn("rank", F.explode(F.array_distinct(F.array(*ranks)))).where("rank >= before and rank < before + c").withColumn("rank_in", F.col("rank") - F.col("before")).drop("c", "before")
    inside = v.join(wanted.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "v").agg(F.count("*").alias("m"))
    inside = inside.withColumn("end", F.sum("m").over(Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.join(wanted, [*keys, "bin"]).where("rank_in >= end - m and rank_in < end")
    return hit.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))


def quantiles(rows: DataFrame, keys: list[str], value: Column, qs: dict[str, float]) -> DataFrame:
    """keys and exact quantiles, linear between the two nearest values; see at_ranks()."""
    place = {n: F.lit(q) * (F.col("n") - 1) for n, q in qs.items()}
    low, high = ({n: f(x).cast("long") for n, x in place.items()} for f in (F.floor, F.ceil))
    at = at_ranks(rows, keys, value, [*low.values(), *high.values()])
    value_at = lambda r: F.element_at("at", r)
    return at.select(*keys, *[(value_at(low[n]) + (value_at(high[n]) - value_at(low[n])) * (place[n] - low[n])).alias(n) for n in qs])


def residuals(panel: DataFrame, forecasts: DataFrame) -> DataFrame:
    """forecasts (model, series_id, origin_idx, horizon, lp) with err = lp - log of the actual value, chg and pchg against the origin; targets without a value go."""
    actual = panel.select("series_id", F.col("week_idx").alias("target_idx"), F.col("y").alias("act"))
    start = panel.select("series_id", F.col("week_idx").alias("origin_idx"), F.col("y").alias("y0"), F.col("season").alias("s0"), "iso_week")
    r = forecasts.withColumn("target_idx", F.col("origin_idx") + F.col("horizon")).join(actual, ["series_id", "target_idx"]).join(start, ["series_id", "origin_idx"])
    return r.withColumns({"err": F.col("lp") - F.ln("act"), "chg": F.ln(F.col("act") / F.col("y0")), "pchg": F.col("lp") - F.ln("y0")}).where("not isnan(err)").select("model", "series_id", "origin_idx", "s0", "iso_week", "horizon", "err", "chg", "pchg")


def split_of(p: Params) -> Column:
    return F.when(F.col("s0").between(*p.tune), "tune").when(F.col("s0").between(*p.holdout), "holdout")


def residual_quantiles(res: DataFrame) -> DataFrame:
    return quantiles(res, ["model", "horizon"], F.col("err"), QUANTILES)


def _splits(res: DataFrame, p: Params) -> DataFrame:
    """Each residual in its split and in all."""
    both = F.array_compact(F.array(F.lit("all"), split_of(p)))
    return res.where(F.col("horizon") <= p.eval_horizon).withColumn("split", F.explode(both)).withColumn("phase", phase(F.col("iso_week")))


def backtest_summary(res: DataFrame, p: Params) -> DataFrame:
    """Metrics by split, model and horizon, and by phase of these (phase null: all). mae_pct takes the upper of two middle errors.

    The middle errors are found by at_ranks(), all else by map-side sums: res should be a table. Quantiles for the
    coverage always come from the tune split.
    """
    q = residual_quantiles(res.where(F.col("s0").between(*p.tune) & (F.col("horizon") <= p.eval_horizon)))
    s = _splits(res, p).join(F.broadcast(q), ["model", "horizon"], "left")
    keys = ["split", "phase", "model", "horizon"]
    moved = F.abs("chg") > F.ln(F.lit(1.05))
    pct = lambda c: (F.exp(c) - 1) * 100
    both = s.withColumn("phase", F.explode(F.array(F.col("phase"), F.lit("*"))))
    sums = both.groupBy(*keys).agg(
        F.count("*").alias("n"), pct(F.avg(F.abs("err"))).alias("mean_pct"), pct(F.avg("err")).alias("bias_pct"),
        (F.avg(F.when(moved, ((F.col("pchg") > 0) == (F.col("chg") > 0)).cast("double"))) * 100).alias("dir"),
        (F.avg(F.col("err").between(F.col("q25"), F.col("q75")).cast("double")) * 100).alias("cov50"), (F.avg(F.col("err").between(F.col("q10"), F.col("q90")).cast("double")) * 100).alias("cov80"),
    )
    middle = at_ranks(both, keys, F.abs("err"), [F.expr("n div 2")])
    upper = middle.select(*keys, pct(F.element_at("at", F.expr("n div 2"))).alias("mae_pct"))
    return sums.join(upper, keys)


def model_score(summary: DataFrame, p: Params) -> DataFrame:
    """By split and model: mean of mae_pct over horizons (smaller is better), mean direction hit of horizons 1 to 4, mean coverage."""
    return summary.where("phase = '*'").groupBy("split", "model").agg(F.avg("mae_pct").alias("score"), F.avg(F.when(F.col("horizon") <= 4, F.col("dir"))).alias("dir1_4"), F.avg("cov50").alias("cov50"), F.avg("cov80").alias("cov80"))


def backtest_report(summary: DataFrame, p: Params, tuned: DataFrame | None = None) -> DataFrame:
    """One JSON text for each split and model: its score, metrics by horizon, by_h of each phase, and the quantiles of the tune split's errors by horizon (tuned: residual_quantiles() of these)."""
    metrics = ["n", *[F.round(c, 6).alias(c) for c in ("mae_pct", "mean_pct", "bias_pct", "dir", "cov50", "cov80")]]
    by = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string").alias("h"), value))))
    h = summary.groupBy("split", "model", "phase").agg(by(F.struct(*metrics)).alias("by_h"), F.round(F.avg("mae_pct"), 6).alias("score"))
    whole = h.where("phase = '*'").select("split", "model", "score", "by_h")
    phases = h.where("phase <> '*'").groupBy("split", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", F.struct("score", "by_h"))), lambda a, b: F.when(a["phase"] < b["phase"], -1).otherwise(1))).alias("phases"))
    told = whole.join(phases, ["split", "model"], "left")
    if tuned is not None:
        q = tuned.groupBy("model").agg(by(F.struct(*[F.round(n, 6).alias(n) for n in QUANTILES])).alias("tune_quantiles"))
        told = told.join(q, "model", "left")
    return told.select("split", "model", F.to_json(F.struct(*[c for c in told.columns if c not in ("split", "model")])).alias("report"))


def skill_summary(res: DataFrame, legacy: DataFrame, p: Params) -> DataFrame:
    """By series and horizon: upper median error in % of the model and of the legacy model over holdout seasons without the running one, with the numbers of origins and seasons."""
    def own(r: DataFrame, name: str) -> DataFrame:
        run = F.max("s0").over(Window.partitionBy("series_id"))
        r = r.withColumn("running", run).where((F.col("s0") >= p.holdout[0]) & (F.col("s0") != F.col("running")))
        w = Window.partitionBy("series_id", "horizon")
        r = r.withColumn("e", F.abs("err")).withColumns({"r": F.row_number().over(w.orderBy("e")), "n": F.count("*").over(w)})
        return r.groupBy("series_id", "horizon").agg(F.bround((F.exp(F.max(F.when(F.expr("r = n div 2 + 1"), F.col("e")))) - 1) * 100, 1).alias(name), F.count_distinct("origin_idx").alias(f"n_{name}"), F.count_distinct("s0").alias(f"seasons_{name}"))
    return own(res, "mdae_pct").join(own(legacy, "legacy_pct").select("series_id", "horizon", "legacy_pct"), ["series_id", "horizon"], "left").withColumnsRenamed({"n_mdae_pct": "n_origins", "seasons_mdae_pct": "n_seasons"})
