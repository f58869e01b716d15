"""Registered queries over the given tables: the panel is weekly order value by priority."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import calendar, monday, monday_of, phase, week_idx, week_label, weeks_in_iso_year
from weekloom.jobs.folders import new_dir as _dir
from weekloom.operators import decide, evaluate, forecast, history, kept, models, profiles, replay
from weekloom.params import ORDERS as P
from weekloom.sinks.store import ProductStore
from weekloom.sources import files, reports
from weekloom.sources.panel import orders_panel, read_history, read_week_map, with_calendar
from weekloom.streaming import ingest, watch
from weekloom.streaming.intake import ReportIntake, judged
from weekloom.streaming.weeks import WeeklyPanel


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = _dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CALENDARS: dict[tuple[str, int, int], str] = {}


def orders_calendar(spark, sf_dir):
    """The calendar of the panel's years and one more on each side, some hundred rows, written once for each application and span of years."""
    first, last = _panel(spark, sf_dir).agg(F.min("iso_year"), F.max("iso_year")).first()
    key = spark.sparkContext.applicationId, (first or 2000) - 1, (last or 2000) + 1
    if key not in _CALENDARS:
        path = _dir(spark, "calendar")
        calendar(spark, *key[1:]).coalesce(1).write.parquet(path)
        _CALENDARS[key] = path
    return spark.read.parquet(_CALENDARS[key])


def _seen(spark, sf_dir):
    """Panel, the same with the holiday effects known in each week, and the calendar, each a table."""
    panel, cal = _stored(_panel(spark, sf_dir), "panel"), orders_calendar(spark, sf_dir)
    return panel, _stored(profiles.with_effects(panel, cal, P), "seen"), cal


def _panel(spark, sf_dir):
    return orders_panel(spark, sf_dir)


def _secondary(spark, sf_dir):
    """The second source: weekly ordered quantity of all order lines by the order's priority, by ship week."""
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("series_id")), "l_orderkey")
    weekly = li.groupBy("series_id", F.date_trunc("week", "l_shipdate").cast("date").alias("monday")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("y"))
    return with_calendar(weekly, F.col("monday")).drop("monday")


def iso_calendar(spark, sf_dir):
    days = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    c = with_calendar(days, F.col("day"))
    return c.select(F.col("day").cast("string"), "week_idx", "iso_year", "iso_week", "wk52", "season", monday_of(F.col("week_idx")).cast("string").alias("monday"), monday_of(F.col("week_idx") + 1).cast("string").alias("next_monday"), weeks_in_iso_year(F.col("iso_year")).alias("n_weeks"), phase(F.col("iso_week")).alias("phase"), week_label(F.col("iso_year"), F.col("iso_week")).alias("week"))


def holiday_calendar(spark, sf_dir):
    used = _panel(spark, sf_dir).select("week_idx").distinct()
    return orders_calendar(spark, sf_dir).join(used, "week_idx", "left_semi").select("week_idx", "iso_year", "iso_week", "htype", "hlabel")


def load_history(spark, sf_dir):
    path = _dir(spark, "history")
    e = _panel(spark, sf_dir).select("series_id", F.struct(F.col("iso_year").alias("year"), "iso_week", F.col("y").alias("ari_per_100k")).alias("e"))
    e.groupBy("series_id").agg(F.collect_list("e").alias("history")).select(F.to_json(F.struct("history"))).repartition(5).write.text(path)
    return read_history(spark, path).groupBy("iso_year", "iso_week").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,3)")).cast("double").alias("value"))


def load_week_map(spark, sf_dir):
    path = _dir(spark, "map")
    m = _panel(spark, sf_dir).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct(week_label(F.col("iso_year"), F.col("iso_week")), "y"))).alias("m"))
    m.select(F.to_json("m")).repartition(5).write.text(path)
    return read_week_map(spark, path).groupBy("iso_year", "iso_week").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,3)")).cast("double").alias("value"))


def case_rates(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("group_code"), "o_orderdate"), "l_orderkey")
    rows = with_calendar(li, F.col("o_orderdate")).select("iso_year", "iso_week", "group_code", F.col("l_quantity").alias("cases"), F.col("l_extendedprice").alias("population"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("sub_cases"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("sub_population"))
    return _rounded(history.case_rates(rows, ["iso_year", "iso_week"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]), 4)


def _sources(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    official = panel.where("week_idx % 7 <> 3 and season >= 1996").select("series_id", "week_idx", F.round("y", 0).alias("value"), F.lit(None).cast("string").alias("note"))
    secondary = _secondary(spark, sf_dir).select("series_id", "week_idx", F.round(F.col("y") * P.ratio, 0).alias("value"))
    stored = panel.where("week_idx % 7 in (2, 3) and season >= 1997").select("series_id", "week_idx", F.round(F.col("y") + 1, 0).alias("value"), F.when(F.col("week_idx") % 14 < 7, F.lit("revised")).alias("note"))
    return official, secondary, stored


def merge_sources(spark, sf_dir):
    return history.merge_sources(*_sources(spark, sf_dir))


def source_counts(spark, sf_dir):
    return merge_sources(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


def calibration_ratio(spark, sf_dir):
    return _rounded(history.calibration_ratio(_panel(spark, sf_dir), _secondary(spark, sf_dir)))


def history_entries(spark, sf_dir):
    rows = _panel(spark, sf_dir).select("series_id", "week_idx", "iso_year", "iso_week", F.col("y").alias("value"), (F.col("y") / 7).alias("sub_value"), F.lit("official").alias("source"))
    return history.history_entries(rows).withColumn("monday", F.col("monday").cast("string"))


def fill_gaps(spark, sf_dir):
    h = _panel(spark, sf_dir).where("week_idx % 11 <> 5").select("series_id", "week_idx", F.col("y").alias("value"), F.lit("official").alias("source"))
    return _rounded(history.fill_single_gaps(h, orders_calendar(spark, sf_dir)), 4)


def plausibility_gate(spark, sf_dir):
    rows = _panel(spark, sf_dir).select("series_id", "week_idx", F.when(F.col("week_idx") % 9 == 4, F.col("y") * 5).otherwise(F.col("y")).alias("y"))
    return _rounded(history.plausibility_gate(rows, P))


def _report_rows(spark, sf_dir):
    """Weekly values of each priority as reports: five groups by order status and clerk parity are stood in for by fifths of the value."""
    p = _panel(spark, sf_dir)
    prev = F.lag("y").over(history.by_week())
    return p.withColumns({"value": F.bround("y"), "prev": F.when(F.lag("week_idx").over(history.by_week()) == F.col("week_idx") - 1, prev)}).withColumn("change_pct", F.bround((F.col("value") / (F.col("prev") * F.when(F.col("week_idx") % 5 == 0, 1.1).otherwise(1.0)) - 1) * 100, 2))


def parse_reports(spark, sf_dir):
    r = _report_rows(spark, sf_dir)
    n = F.col("value").cast("long")
    row = lambda v: F.concat_ws(" ", (v + 20).cast("string"), (v + 10).cast("string"), v.cast("string"), (v - 10).cast("string"), (v - 20).cast("string"), v.cast("string"))
    change = F.replace(F.format_string("%.2f", F.coalesce("change_pct", F.lit(0.0))), F.lit("."), F.lit(","))
    text = F.concat(
        F.format_string("%d týden %d - Week %d\nARI\nČeská republika - the Czech Republic ", "iso_week", "iso_year", "iso_week"), row(n), F.lit("\nZměna - Change [%] "), F.concat_ws(" ", *[change] * 6),
        F.lit("\nILI\nČeská republika - the Czech Republic "), F.when(F.col("week_idx") % 6 == 0, F.lit("496* 3")).otherwise(row(F.floor(n / 10))), F.lit("\n12"),
    )
    parsed = reports.parse_reports(r.select("series_id", "week_idx", text.alias("text")))
    return parsed.select("series_id", "week_idx", "report.year", "report.week", "report.value", "report.sub_value", F.element_at("report.groups", 1).alias("first_group"), "report.change_pct")


def apply_revisions(spark, sf_dir):
    r = _report_rows(spark, sf_dir).select("series_id", "week_idx", "value", "change_pct", F.array("value", F.col("value") + 5).alias("groups"), F.array("change_pct", "change_pct").alias("groups_change_pct"))
    return history.apply_revisions(r, P).select("series_id", "week_idx", "value", "value_revised", "revised", F.element_at("groups_revised", 2).alias("second_group"), "note")


def stream_ingest(spark, sf_dir):
    """Reports arrive as files, those of odd weeks first, then the others late; the final store is returned."""
    src, out = _dir(spark, "reports"), _dir(spark, "store")
    rows = _report_rows(spark, sf_dir).select("series_id", "week_idx", "value", "change_pct", F.when(F.col("week_idx") % 4 == 1, "scaled").otherwise("official").alias("source"))
    schema = ingest.STORE.rsplit(",", 1)[0]
    for k, part in enumerate((rows.where("week_idx % 2 = 1"), rows.where("week_idx % 2 = 0"), rows.where("week_idx % 4 = 1").withColumn("source", F.lit("official")).withColumn("value", F.col("value") + 1))):
        part.repartition("series_id").write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{src}/*")
    q = ingest.run_intake(spark, stream, out)
    q.awaitTermination()
    return ingest.revise(ingest.read_store(spark, out), P.revision).select("series_id", "week_idx", "value", "source")


def label_holidays(spark, sf_dir):
    return _panel(spark, sf_dir).select("series_id", "week_idx", "y").join(F.broadcast(orders_calendar(spark, sf_dir).select("week_idx", "htype", "hlabel")), "week_idx", "left")


def current_state(spark, sf_dir):
    sub = _secondary(spark, sf_dir).select("series_id", "week_idx", F.round("y", 1).alias("sub_value"))
    panel = _panel(spark, sf_dir).join(sub, ["series_id", "week_idx"], "left").withColumns({"source": F.lit("official"), "url": F.concat(F.lit("https://example.org/"), F.col("week_idx"))})
    return history.current_state(panel, orders_calendar(spark, sf_dir), P)


def history_document(spark, sf_dir):
    """One JSON document for each series, its weeks in order."""
    rows = _panel(spark, sf_dir).select("series_id", F.struct("week_idx", week_label(F.col("iso_year"), F.col("iso_week")).alias("week"), F.bround("y").cast("long").alias("value")).alias("e"))
    return rows.groupBy("series_id").agg(F.array_sort(F.collect_list("e")).alias("h")).select("series_id", F.size("h").alias("n"), F.to_json("h").alias("document"))


def changed_rows(spark, sf_dir):
    p = _panel(spark, sf_dir).select("series_id", "week_idx", F.bround("y").alias("value"))
    return history.changed_rows(p.withColumn("value", F.when(F.col("week_idx") % 50 == 0, F.col("value") + 1).otherwise(F.col("value"))), p.where("week_idx % 70 <> 1"))


def staleness(spark, sf_dir):
    p = _panel(spark, sf_dir)
    today = p.agg(F.max("week_idx")).first()[0] + 3
    return history.staleness(p.where("series_id <> '5-LOW' or season < 2000"), today)


def history_violations(spark, sf_dir):
    p = _panel(spark, sf_dir)
    rows = p.select("series_id", "week_idx", F.date_add(monday_of(F.col("week_idx")), F.when(F.col("week_idx") % 40 == 0, 1).otherwise(0)).alias("monday"), F.col("y").alias("value"), F.when(F.col("week_idx") % 60 == 0, "other").otherwise("official").alias("source"))
    return history.violations(rows.unionByName(rows.where("week_idx % 80 = 3")), P)


def season_peak(spark, sf_dir):
    return history.season_peak(_panel(spark, sf_dir))


def seasonal_change_stats(spark, sf_dir):
    return _rounded(history.seasonal_change_stats(_panel(spark, sf_dir)))


def extract_links(spark, sf_dir):
    return reports.extract_links(_t(spark, sf_dir, "pages"), r"^https?://", "https://example.org")


def url_week(spark, sf_dir):
    """Report paths written from the orders' dates, and what is read from them."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    url = F.format_string("https://example.org/wp-content/uploads/%04d/%02d/%02d_tyden.pdf", F.year("d"), F.month("d"), F.weekofyear("d"))
    return o.select("d", reports.url_week(url).alias("w")).select(F.col("d").cast("string"), "w.year", "w.week")


def new_reports(spark, sf_dir):
    """Of the texts' urls those whose week is not official yet."""
    official, _, _ = _sources(spark, sf_dir)
    weeks = _panel(spark, sf_dir).select("series_id", "week_idx", "iso_year", "iso_week")
    stored = official.join(weeks, ["series_id", "week_idx"]).withColumn("source", F.lit("official"))
    return reports.unread(_texts(spark, sf_dir).select("series_id", "url"), stored)


def weekly_growth(spark, sf_dir):
    return _rounded(profiles.weekly_growth(_panel(spark, sf_dir)).select("series_id", "week_idx", "growth"))


def growth_profile(spark, sf_dir):
    return _rounded(profiles.growth_profile(_panel(spark, sf_dir), P))


def level_climatology(spark, sf_dir):
    return _rounded(profiles.level_climatology(_panel(spark, sf_dir), P))


def holiday_occurrences(spark, sf_dir):
    return _rounded(profiles.holiday_occurrences(_panel(spark, sf_dir), orders_calendar(spark, sf_dir), P))


def holiday_effects(spark, sf_dir):
    return _rounded(profiles.holiday_effects(profiles.holiday_occurrences(_panel(spark, sf_dir), orders_calendar(spark, sf_dir), P), P))


def adjusted_series(spark, sf_dir):
    return _rounded(profiles.adjusted_series(_panel(spark, sf_dir), orders_calendar(spark, sf_dir), P))


def holiday_profile(spark, sf_dir):
    panel, seen, cal = _seen(spark, sf_dir)
    known = models._known(panel, seen, P).select("series_id", "s0", "version", "effects").dropDuplicates(["series_id", "s0", "version"])
    return _rounded(profiles.holiday_profile(panel, cal, known, P))


def rolling_origins(spark, sf_dir):
    return models.rolling_origins(_panel(spark, sf_dir), P)


def model_persistence(spark, sf_dir):
    return _rounded(models.persistence(_panel(spark, sf_dir), P))


def model_legacy(spark, sf_dir):
    return _rounded(models.legacy(_panel(spark, sf_dir), P))


def model_seasonal_naive(spark, sf_dir):
    return _rounded(models.seasonal_naive(_panel(spark, sf_dir), P))


def model_profile(spark, sf_dir):
    return _rounded(models.profile(_panel(spark, sf_dir), P))


def model_profile_momentum(spark, sf_dir):
    return _rounded(models.profile_momentum(_panel(spark, sf_dir), P))


def model_clim_anomaly(spark, sf_dir):
    return _rounded(models.clim_anomaly(_panel(spark, sf_dir), P))


def model_holiday_profile(spark, sf_dir):
    return _rounded(models.seasonal_profile_holiday(*_seen(spark, sf_dir), P))


def analog_align(spark, sf_dir):
    return _rounded(models.analog_align(*_seen(spark, sf_dir), P))


def analog_weights(spark, sf_dir):
    return _rounded(models.analog_weights(*_seen(spark, sf_dir), P).drop("effects", "base_idx"))


def model_analog(spark, sf_dir):
    return _rounded(models.analog(*_seen(spark, sf_dir), P))


def point_forecast(spark, sf_dir):
    return _rounded(models.point_forecast(*_seen(spark, sf_dir), P))


def late_forecast(spark, sf_dir):
    """Forecasts from the two weeks after each series' last report, as when reports are late."""
    panel, seen, cal = _seen(spark, sf_dir)
    wanted = panel.groupBy("series_id").agg(F.max("week_idx").alias("last")).select("series_id", F.explode(F.array(F.col("last") + 1, F.col("last") + 2)).alias("origin_idx"))
    return _rounded(models.point_forecast(panel, seen, cal, P, _stored(models.origins_at(panel, wanted, P), "origins"), 1))


def _simple_residuals(spark, sf_dir):
    """Residuals of every model in models.MODELS."""
    panel = _stored(_panel(spark, sf_dir), "panel")
    every = reduce(DataFrame.unionByName, [f(panel, P).withColumn("model", F.lit(n)) for n, f in models.MODELS.items()])
    return _stored(evaluate.residuals(panel, every), "residuals")


def backtest_residuals(spark, sf_dir):
    return _rounded(_simple_residuals(spark, sf_dir))


def residual_quantiles(spark, sf_dir):
    return _rounded(evaluate.residual_quantiles(_simple_residuals(spark, sf_dir)))


def backtest_summary(spark, sf_dir):
    return _rounded(evaluate.backtest_summary(_simple_residuals(spark, sf_dir), P), 4)


def interval_coverage(spark, sf_dir):
    return backtest_summary(spark, sf_dir).where("phase = '*'").select("split", "model", "horizon", "cov50", "cov80")


def model_score(spark, sf_dir):
    return _rounded(evaluate.model_score(evaluate.backtest_summary(_simple_residuals(spark, sf_dir), P), P), 4)


def backtest_report(spark, sf_dir):
    res = _simple_residuals(spark, sf_dir)
    tuned = evaluate.residual_quantiles(res.where(F.col("s0").between(*P.tune) & (F.col("horizon") <= P.eval_horizon)))
    return evaluate.backtest_report(evaluate.backtest_summary(res, P), P, tuned)


def backtest_candidate(spark, sf_dir):
    """A drift model as a user would plug it in."""
    def drift(weeks, values, horizon):
        import math

        a, b = math.log(values[-1]), math.log(values[max(0, len(values) - 9)])
        return [a + (a - b) / 8 * h * 0.5 for h in range(1, horizon + 1)]

    panel = _stored(_panel(spark, sf_dir), "panel")
    return _rounded(evaluate.residuals(panel, models.candidate(panel, P, drift).withColumn("model", F.lit("drift"))))


def _products(spark, sf_dir):
    """Panel, calendar, point forecasts of all origins and their residuals, each worked out once."""
    panel, seen, cal = _seen(spark, sf_dir)
    points = _stored(models.point_forecast(panel, seen, cal, P), "points")
    return panel, cal, points, _stored(evaluate.residuals(panel, points.withColumn("model", F.lit("blend"))), "residuals")


def phase_pool(spark, sf_dir):
    panel, _, _, res = _products(spark, sf_dir)
    return _rounded(forecast.phase_pool(res, forecast.latest_origins(models.rolling_origins(panel, P)), P))


def weighted_quantile(spark, sf_dir):
    panel, _, _, res = _products(spark, sf_dir)
    pool = forecast.phase_pool(res, forecast.latest_origins(models.rolling_origins(panel, P)), P)
    return _rounded(forecast.weighted_quantiles(pool, forecast.KEYS, "err", {"q10": 0.1, "q50": 0.5, "q90": 0.9}))


def widened_pool(spark, sf_dir):
    panel, _, _, res = _products(spark, sf_dir)
    return _rounded(forecast.widened(forecast.phase_pool(res, forecast.latest_origins(models.rolling_origins(panel, P)), P), P))


def exceedance_prob(spark, sf_dir):
    panel, _, points, res = _products(spark, sf_dir)
    at = forecast.latest_origins(models.rolling_origins(panel, P))
    lp = points.join(at.select("series_id", "origin_idx"), ["series_id", "origin_idx"], "left_semi").withColumnRenamed("origin_idx", "t_idx")
    return forecast.exceedance(forecast.widened(forecast.phase_pool(res, at, P), P), lp, P)


def make_forecast(spark, sf_dir):
    panel, cal, points, res = _products(spark, sf_dir)
    return forecast.make_forecast(points, res, forecast.latest_origins(models.rolling_origins(panel, P)), cal, P).withColumn("monday", F.col("monday").cast("string"))


def forecast_past(spark, sf_dir):
    panel, cal, points, res = _products(spark, sf_dir)
    return forecast.make_forecast(points, res, forecast.latest_origins(models.rolling_origins(panel, P), 2, 9), cal, P).withColumn("monday", F.col("monday").cast("string"))


def forecast_violations(spark, sf_dir):
    """Past forecasts of which some are spoilt: quantiles or probabilities the wrong way round, weeks missing."""
    o, h = F.col("origin_idx"), F.col("horizon")
    rows = forecast_past(spark, sf_dir).where(~((o % 4 == 1) & (h == 7)))
    swapped, chance = (o % 3 == 0) & (h == 4), (o % 5 == 2) & (h == 2)
    rows = rows.withColumns({"q10": F.when(swapped, F.col("q90") + 1).otherwise(F.col("q10")), "p_3": F.when(chance, F.col("p_1") + 0.1).otherwise(F.col("p_3"))})
    return forecast.forecast_violations(rows, P)


def skill_summary(spark, sf_dir):
    panel, _, _, res = _products(spark, sf_dir)
    return evaluate.skill_summary(res, evaluate.residuals(panel, models.legacy(panel, P).withColumn("model", F.lit("legacy"))), P)


def _facts(spark, sf_dir):
    panel, cal, points, res = _products(spark, sf_dir)
    rows = _stored(forecast.make_forecast(points, res, forecast.latest_origins(models.rolling_origins(panel, P)), cal, P), "forecast")
    state = _stored(history.current_state(panel, cal, P), "state")
    planned = decide.planned_value(state.select("series_id", "week_idx", "y"), rows, cal, P)
    trend = decide.trend_class(panel, rows, cal)
    chances = rows.where("horizon <= 4").groupBy("series_id").agg(*[F.max(f"p_{k}").alias(n) for k, n in enumerate(("p_yellow", "p_amber", "p_red"), 1)])
    signal = decide.early_signal(_secondary(spark, sf_dir).select("series_id", "week_idx", "y"), cal, P).groupBy("series_id").agg(F.max_by("signal", "week_idx").alias("signal"))
    plain = panel.join(F.broadcast(cal.where("htype is not null").select("week_idx")), "week_idx", "left_anti").groupBy("series_id").agg(F.max_by("y", "week_idx").alias("plain_y"))
    facts = planned.join(state.select("series_id", "band", F.col("holiday").isNotNull().alias("on_holiday")), "series_id").join(trend, "series_id").join(decide.planning_phase(panel, trend, P), "series_id").join(chances, "series_id", "left").join(signal, "series_id", "left").join(plain, "series_id")
    return panel, rows, facts


def planned_value(spark, sf_dir):
    return _facts(spark, sf_dir)[2].select("series_id", "week_idx", F.round("planned", 6).alias("planned"), "planned_band")


def trend_class(spark, sf_dir):
    return _facts(spark, sf_dir)[2].select("series_id", "trend5", "fast", "rising", "falling")


def planning_phase(spark, sf_dir):
    return _facts(spark, sf_dir)[2].select("series_id", "iso_week", "plan_phase")


def early_signal(spark, sf_dir):
    return decide.early_signal(_secondary(spark, sf_dir).select("series_id", "week_idx", "y"), orders_calendar(spark, sf_dir), P)


def _now(spark, sf_dir):
    """Panel, calendar, and facts of every week as they were known in it."""
    panel, cal, v = _vintages(spark, sf_dir, (0,))
    return panel, cal, _stored(v.where("today_idx = week_idx"), "facts")


def situation(spark, sf_dir):
    """The class of every week, with the level that was held then."""
    _, _, facts = _now(spark, sf_dir)
    return decide.situation(facts.join(decide.capacity_level(facts, P), ["series_id", "week_idx"]), P).select("series_id", "week_idx", "planned_band", "plan_phase", "level", "situation")


def capacity_level(spark, sf_dir):
    """The ratchet over all weeks of each series, planned on the forecast from each week."""
    return decide.capacity_level(_now(spark, sf_dir)[2], P)


def capacity_pct(spark, sf_dir):
    panel, cal, facts = _now(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("week_idx"))) == 1
    share = replay.capacity_share(panel, _groups(spark, sf_dir), cal)
    at = facts.withColumn("last", last).where("last").join(share, ["series_id", "week_idx"]).select("series_id", "planned", "share")
    return _rounded(decide.capacity_pct(at.drop("share"), panel, at.drop("planned")))


def _groups(spark, sf_dir):
    """Rates of five groups of customers, which stand for ages: their weekly order value, five times."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.date_trunc("week", "o_orderdate").cast("date").alias("monday"), (F.col("o_custkey") % 5).alias("g"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    sums = o.groupBy("series_id", "monday").agg(*[F.sum(F.when(F.col("g") == k, F.col("v")).otherwise(0)).alias(f"g{k}") for k in range(5)])
    return with_calendar(sums, F.col("monday")).select("series_id", "week_idx", F.array(*[F.round(F.col(f"g{k}").cast("double") / 200, 3) for k in range(5)]).alias("groups"))


def _vintages(spark, sf_dir, delays):
    """Facts of each week's recommendation, from forecasts of all origins."""
    panel, cal, points, res = _products(spark, sf_dir)
    rows = _stored(forecast.make_forecast(points, res, models.rolling_origins(panel, P), cal, P), "forecasts")
    signal = decide.early_signal(_secondary(spark, sf_dir).select("series_id", "week_idx", "y"), cal, P)
    return panel, cal, replay.vintages(panel, rows, cal, signal, P, delays)


def vintages(spark, sf_dir):
    return _rounded(_vintages(spark, sf_dir, (1, 2))[2])


def capacity_replay(spark, sf_dir):
    """Levels and capacities of all weeks, each from the forecasts known then, for reports one and two weeks late."""
    panel, cal, v = _vintages(spark, sf_dir, (1, 2))
    return replay.capacity_replay(v, replay.capacity_share(panel, _groups(spark, sf_dir), cal), P)


def _texts(spark, sf_dir):
    """A report text for each week of the panel, with its url: some values five times too high, some texts that can't be read, some under the url of three weeks later."""
    r = _report_rows(spark, sf_dir)
    n = (F.col("value") * F.when(F.col("week_idx") % 9 == 4, 5).otherwise(1)).cast("long")
    row = lambda v: F.concat_ws(" ", *[(v + k).cast("string") for k in (20, 10, 0, -10, -20, 0)])
    change = F.when(F.col("change_pct").isNotNull(), F.concat(F.lit("\nZměna - Change [%] "), F.concat_ws(" ", *[F.replace(F.format_string("%.2f", "change_pct"), F.lit("."), F.lit(","))] * 6)))
    text = F.concat(
        F.format_string("%d. týden %d\nČeská republika - the Czech Republic ", "iso_week", "iso_year"), row(n), F.coalesce(change, F.lit("")),
        F.lit("\nČeská republika - the Czech Republic "), F.when(F.col("week_idx") % 6 == 0, F.lit("496* 3")).otherwise(row(F.floor(n / 10))),
    )
    told = F.col("week_idx") + F.when(F.col("week_idx") % 13 == 5, 3).otherwise(0)
    put = F.date_add(monday_of(told), 9)
    url = F.format_string("https://example.org/%d/wp-content/uploads/%04d/%02d/%02d_tyden.pdf", "week_idx", F.year(put), F.month(put), F.weekofyear(monday_of(told)))
    return r.select("series_id", "week_idx", url.alias("url"), text.alias("text"))


def _estimates(spark, sf_dir):
    """What is stored before any report: estimates of some weeks."""
    return _panel(spark, sf_dir).where("week_idx % 4 = 1").select("series_id", "week_idx", F.bround(F.col("y") * 1.1).alias("value"), F.lit("scaled").alias("source"))


def report_intake(spark, sf_dir):
    """All texts in one intake, judged against a store with estimates and official weeks."""
    official = _panel(spark, sf_dir).where("week_idx % 7 = 3").select("series_id", "week_idx", F.bround("y").alias("value"), F.lit("official").alias("source"))
    stored = official.unionByName(_estimates(spark, sf_dir).where("week_idx % 7 <> 3"))
    texts = _texts(spark, sf_dir).drop("week_idx")
    none = spark.createDataFrame([], ReportIntake.PENDING)
    return judged(_stored(texts, "texts"), none, _stored(stored, "stored"), P).select("series_id", "week_idx", "value", "change_pct", "status")


def stream_reports(spark, sf_dir):
    """The texts as a stream of files, those of even weeks late; the history as it is read in the end."""
    src, intake = _dir(spark, "texts"), ReportIntake(spark, _dir(spark, "intake"), P)
    intake.seed(_estimates(spark, sf_dir))
    texts = _stored(_texts(spark, sf_dir), "all")
    for k, part in enumerate((texts.where("week_idx % 2 = 1"), texts.where("week_idx % 2 = 0"))):
        part.drop("week_idx").coalesce(1).write.parquet(f"{src}/{k}")  # a file for each intake
    stream = spark.readStream.schema("series_id string, url string, text string").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    intake.run(stream).awaitTermination()
    return intake.revised().select("series_id", "week_idx", "value", "source", "note")


@contextmanager
def _by_state(spark):
    """Streams by state need their own kind of store; the session's is put back."""
    before = spark.conf.get(watch.PROVIDER[0], None)
    spark.conf.set(*watch.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(watch.PROVIDER[0], before) if before else spark.conf.unset(watch.PROVIDER[0])


def _ended(spark, stream, schema, name):
    """All that a stream of available data gives, read back."""
    out = _dir(spark, name)
    with _by_state(spark):
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def stream_revisions(spark, sf_dir):
    """The log of a stream of reports, those of even weeks late and some again; the newest entry of each week that still holds."""
    src = _dir(spark, "reports")
    r = _report_rows(spark, sf_dir).select("series_id", "week_idx", "value", "change_pct", F.array("change_pct", "change_pct").alias("groups_change_pct"))
    parts = (r.where("week_idx % 2 = 1"), r.where("week_idx % 2 = 0"), r.where("week_idx % 4 = 1").withColumn("value", F.col("value") + 1))
    for k, part in enumerate(parts):
        part.withColumns({"groups": F.array("value", F.col("value") + 5), "version": F.col("week_idx") + k * 1_000_000}).repartition(2, "series_id").write.parquet(f"{src}/{k}")
    schema = "series_id string, week_idx long, value double, change_pct double, groups array<double>, groups_change_pct array<double>, version long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{src}/*")
    log = _ended(spark, watch.revision_log(stream, P.revision), watch.LOG, "log")
    newest = log.groupBy("series_id", "week_idx").agg(F.max_by(F.struct("old", "new", "groups", "note"), "version").alias("e")).where("e.new is not null")
    return newest.select("series_id", "week_idx", "e.old", "e.new", F.element_at("e.groups", 2).alias("second_group"), "e.note")


def stream_alerts(spark, sf_dir):
    """Alerts of series whose reports stop for seven weeks now and then; a clock's rows come each week."""
    src = _dir(spark, "arrivals")
    at = F.to_timestamp(F.date_add(monday_of(F.col("week_idx")), 8))
    panel = _panel(spark, sf_dir)
    weeks = panel.agg(F.min("week_idx").alias("a"), F.max("week_idx").alias("b")).select(F.lit("~").alias("series_id"), F.explode(F.sequence("a", F.col("b") + 6)).alias("week_idx"))
    rows = _stored(panel.where("week_idx % 40 > 6").select("series_id", "week_idx").unionByName(weeks).withColumn("at", at), "rows")
    first = rows.agg(F.min("week_idx")).first()[0] or 0
    for k in range(4):  # by quarters of ten years: files in the order of arrival
        rows.where((F.col("week_idx") >= first + 130 * k) & ((F.col("week_idx") < first + 130 * (k + 1)) | F.lit(k == 3))).coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema("series_id string, week_idx long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    return _ended(spark, watch.stale_alerts(stream), watch.ALERTS, "alerts").where("series_id <> '~'").select("series_id", "last_idx", F.col("at").cast("string").alias("at"), "kind")


def _made_files(spark, sf_dir):
    """A case table in CSV and official weeks in JSON, as people would make them: with lines of too many cells, weeks that don't exist, and weeks without a value."""
    case, json = _dir(spark, "cases"), _dir(spark, "official")
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("AGEGROUP_CODE"), "o_orderdate"), "l_orderkey")
    sums = lambda c, only: F.sum(F.when(only, F.col(c).cast("decimal(18,2)"))).cast("string")
    some, every = F.col("l_returnflag") == "R", F.lit(True)
    rows = with_calendar(li, F.col("o_orderdate")).groupBy("week_idx", "iso_year", "iso_week", "AGEGROUP_CODE").agg(
        sums("l_quantity", every).alias("ARI_CASE"), sums("l_extendedprice", every).alias("ARI_POP_COV"), sums("l_quantity", some).alias("ILI_CASE"), sums("l_extendedprice", some).alias("ILI_POP_COV")
    )
    week = F.when((F.col("week_idx") % 19 == 0) & (F.col("AGEGROUP_CODE") == "2-HIGH"), 99).otherwise(F.col("iso_week"))
    more = F.when((F.col("week_idx") % 17 == 0) & (F.col("AGEGROUP_CODE") == "1-URGENT"), ",7,7").otherwise("")
    line = F.concat(F.concat_ws(",", "iso_year", week, "ARI_POP_COV", "AGEGROUP_CODE", "ARI_CASE", F.coalesce("ILI_POP_COV", F.lit("")), F.coalesce("ILI_CASE", F.lit(""))), more)
    head = spark.createDataFrame([("\ufeffISO_YEAR,ISO_WEEK,ARI_POP_COV,AGEGROUP_CODE,ARI_CASE,ILI_POP_COV,ILI_CASE", 0)], "value string, n int")
    head.unionByName(rows.select(line.alias("value"), F.lit(1).alias("n"))).repartition(1).sortWithinPartitions("n").select("value").write.text(case)
    ari = F.when(F.col("week_idx") % 10 != 5, F.round(F.col("y") * 1.5, 1))
    entry = F.struct(F.col("iso_year").alias("year"), F.col("iso_week").alias("week"), ari.alias("ari"), F.round(F.col("y") / 9, 1).alias("ili"), F.array("y").alias("ari_groups"), F.lit("https://example.org").alias("url"))
    weeks = _panel(spark, sf_dir).where("week_idx % 3 > 0").select("series_id", entry.alias("e"))
    lists = weeks.groupBy("series_id").agg(F.to_json(F.collect_list("e"), {"ignoreNullFields": "false"}).alias("value")).select("value")
    lists.unionByName(spark.createDataFrame([("[{'year': ",)], "value string")).repartition(6).write.option("maxRecordsPerFile", 1).text(json)
    return files.read_case_table(spark, case), files.read_official_tables(spark, json)


def merge_files(spark, sf_dir):
    """One history from the two files: official weeks of the first series, the case table's rates brought to their scale where these are missing."""
    (cases, _), (official, _) = _made_files(spark, sf_dir)
    rates = history.case_rates(cases, ["iso_year", "iso_week"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    day = monday(F.col("iso_year").cast("int"), F.col("iso_week").cast("int"))
    other = history.scale_source(rates, P).select(F.lit("all").alias("series_id"), week_idx(day).alias("week_idx"), "value", "sub_value")
    mean = official.groupBy("week_idx").agg(F.avg("value").alias("value"), F.avg("sub_value").alias("sub_value")).select(F.lit("all").alias("series_id"), "*", F.lit(None).cast("string").alias("note"))
    none = spark.createDataFrame([], "series_id string, week_idx long, value double, sub_value double, note string")
    return _rounded(history.merge_sources(mean, other, none), 4)


def file_rejects(spark, sf_dir):
    (_, lines), (_, entries) = _made_files(spark, sf_dir)
    return lines.select(F.lit("cases").alias("kind"), "reason").unionByName(entries.select(F.lit("official").alias("kind"), "reason")).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def published_products(spark, sf_dir):
    """History, current state, forecast, past forecasts and skill in a store, published again after one season changed: since which version each partition is as it is."""
    panel, cal, points, res = _products(spark, sf_dir)
    origins = models.rolling_origins(panel, P)
    legacy = evaluate.residuals(panel, models.legacy(panel, P).withColumn("model", F.lit("legacy")))
    tables = {
        "history": panel, "current": history.current_state(panel, cal, P), "forecast": forecast.make_forecast(points, res, forecast.latest_origins(origins), cal, P),
        "forecast_past": forecast.make_forecast(points, res, forecast.latest_origins(origins, 2, 9), cal, P), "model": evaluate.skill_summary(res, legacy, P),
    }
    tables = {n: _stored(df, n) for n, df in tables.items()}
    by = {"history": "season"} | {n: "series_id" for n in tables if n != "history"}
    store = ProductStore(spark, _dir(spark, "products"))
    store.publish(tables, by)
    store.publish(tables | {"history": panel.withColumn("y", F.when(F.col("season") == 2000, F.col("y") + 1).otherwise(F.col("y")))}, by)
    return store.written()


def kept_forecasts(spark, sf_dir):
    """Forecasts kept from before each series' last three weeks and one week's revision, extended to all weeks."""
    panel, seen, cal = _seen(spark, sf_dir)
    last = Window.partitionBy("series_id").orderBy(F.desc("week_idx"))
    before = _stored(panel.withColumn("n", F.row_number().over(last)).where("n > 3").withColumn("y", F.when(F.col("n") == 12, F.col("y") * 1.1).otherwise(F.col("y"))).drop("n"), "before")
    first = spark.createDataFrame([], kept.KEPT)
    old = kept.extended(first, _stored(kept.stale_origins(first, before, P), "stale"), before, _stored(profiles.with_effects(before, cal, P), "seen"), cal, P)
    old = _stored(old, "kept")
    stale = _stored(kept.stale_origins(old, panel, P), "stale")
    return _rounded(kept.extended(old, stale, panel, seen, cal, P).drop("known"))


def stream_panel(spark, sf_dir):
    """Weekly sums of the events by type, from a stream whose files come newest first."""
    src, panel = _dir(spark, "events"), WeeklyPanel(spark, _dir(spark, "weeks"), "INTERVAL 7 DAYS")
    events = _t(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value").repartitionByRange(4, F.desc("ts"))
    events.write.parquet(f"{src}/0")
    stream = spark.readStream.schema("series_id string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    panel.run(stream).awaitTermination()
    return _rounded(panel.panel())


_NAMES = """iso_calendar holiday_calendar load_history load_week_map case_rates merge_sources source_counts calibration_ratio history_entries
fill_gaps plausibility_gate parse_reports apply_revisions stream_ingest label_holidays current_state history_document changed_rows staleness
history_violations season_peak seasonal_change_stats extract_links url_week new_reports weekly_growth growth_profile level_climatology
holiday_occurrences holiday_effects adjusted_series holiday_profile rolling_origins model_persistence model_legacy model_seasonal_naive
model_profile model_profile_momentum model_clim_anomaly model_holiday_profile analog_align analog_weights model_analog point_forecast late_forecast
backtest_residuals residual_quantiles backtest_summary interval_coverage model_score backtest_report backtest_candidate phase_pool
weighted_quantile widened_pool exceedance_prob make_forecast forecast_past forecast_violations skill_summary planned_value trend_class
planning_phase early_signal situation capacity_level capacity_pct vintages capacity_replay
report_intake stream_reports stream_revisions stream_alerts stream_panel
merge_files file_rejects published_products kept_forecasts""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
