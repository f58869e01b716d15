"""Building one history from sources of different scale and priority, and the state it is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year, monday_of, week_label
from weekloom.params import Params

def by_week() -> WindowSpec:
    """The weeks of each series in order."""
    return Window.partitionBy("series_id").orderBy("week_idx")


def band_of(v: Column, p: Params) -> Column:
    a, b, c = p.thresholds
    return F.when(v >= c, "red").when(v >= b, "amber").when(v >= a, "yellow").otherwise("green")


def case_rates(cases: DataFrame, keys: list[str], groups: list[str], least: float = 1e5) -> DataFrame:
    """Rates per 100000 of two indicators over the given groups. cases has group_code, cases, population, sub_cases, sub_population, as text or numbers.

    A population that is empty or not above 0 leaves its indicator's row out; empty cases count 0. A number that can't
    be read leaves out what is left of its row. Weeks with a population below least go; sub_rate is null without one.
    """
    num = lambda c: F.col(c).try_cast("double")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    good = lambda cs, pop: ~empty(pop) & (num(pop) > 0) & (empty(cs) | num(cs).isNotNull())
    main = good("cases", "population")
    broken = (~empty("population") & num("population").isNull()) | ((num("population") > 0) & ~empty("cases") & num("cases").isNull())
    sub = good("sub_cases", "sub_population") & ~F.coalesce(broken, F.lit(False))
    total = lambda ok, c: F.coalesce(F.sum(F.when(ok, F.coalesce(num(c), F.lit(0.0)))), F.lit(0.0))
    sums = cases.where(F.col("group_code").isin(groups)).groupBy(*keys).agg(total(main, "cases").alias("a"), total(main, "population").alias("b"), total(sub, "sub_cases").alias("c"), total(sub, "sub_population").alias("d"))
    return sums.where(F.col("b") >= least).select(*keys, (F.col("a") / F.col("b") * 1e5).alias("rate"), F.when(F.col("d") > 0, F.col("c") / F.col("d") * 1e5).alias("sub_rate"))


def scale_source(rates: DataFrame, p: Params) -> DataFrame:
    """Rates brought to the official scale; a sub rate of 0 is missing."""
    return rates.withColumn("value", F.col("rate") * p.ratio).withColumn("sub_value", F.when(F.col("sub_rate") > 0, F.col("sub_rate") * p.sub_ratio))


def calibration_ratio(official: DataFrame, secondary: DataFrame) -> DataFrame:
    """Median, spread and number of official / secondary over shared weeks: for each series, by season of it, and by quarter (of 13 weeks; the last has 14 in long years)."""
    shared = official.join(secondary.select("series_id", "week_idx", F.col("y").alias("other")), ["series_id", "week_idx"]).where("other > 0").withColumn("r", F.col("y") / F.col("other"))
    shared = shared.withColumn("quarter", F.least(F.lit(4), F.ceil(F.col("iso_week") / 13)).cast("int"))
    return shared.groupingSets([["series_id"], ["series_id", "season"], ["series_id", "quarter"]], "series_id", "season", "quarter").agg(F.median("r").alias("ratio"), F.stddev("r").alias("spread"), F.count("*").alias("n"))


def history_entries(rows: DataFrame) -> DataFrame:
    """week, monday and rounded values of (series_id, week_idx, iso_year, iso_week, value, sub_value, source)."""
    return rows.select("series_id", "week_idx", week_label(F.col("iso_year"), F.col("iso_week")).alias("week"), "iso_year", "iso_week", monday_of(F.col("week_idx")).alias("monday"), F.bround("value").cast("int").alias("value"), F.bround("sub_value", 1).alias("sub_value"), "source")


def is_official() -> Column:
    return (F.col("source") == "official") & F.col("value").isNotNull()


def merge_sources(official: DataFrame, secondary: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each week from (series_id, week_idx, value, note): scaled secondary before the first official week, official rows, stored official rows where the new row isn't official or the stored one has a note, and scaled secondary for weeks still missing.

    A series without any official week has all its secondary rows. Other columns of the three are kept.
    """
    first = official.groupBy("series_id").agg(F.min("week_idx").alias("first_idx"))
    old = stored.where("value is not null").withColumns({"source": F.lit("official"), "rank": F.when(F.col("note").isNotNull(), 1).otherwise(3)})
    new = official.withColumns({"source": F.lit("official"), "rank": F.lit(2)})
    other = secondary.join(first, "series_id", "left").withColumns({"source": F.lit("scaled"), "rank": F.lit(4), "note": F.when(F.col("week_idx") >= F.col("first_idx"), F.lit("official report missing"))}).drop("first_idx")
    every = new.unionByName(old, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    own = Window.partitionBy("series_id", "week_idx").orderBy("rank")
    return every.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n", "rank")


def fill_single_gaps(history: DataFrame, cal: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """history and, for each single missing week between two known ones, their geometric mean as a whole number, with a note; not for holiday weeks nor those in skip (series_id, week_idx)."""
    nxt = history.select("series_id", "week_idx", "value", F.lead("week_idx").over(by_week()).alias("to"), F.lead("value").over(by_week()).alias("b")).where("to = week_idx + 2")
    made = nxt.select("series_id", (F.col("week_idx") + 1).alias("week_idx"), F.bround(F.sqrt(F.col("value") * F.col("b"))).alias("value"), F.lit("no report, from the weeks beside it").alias("note"))
    made = made.join(F.broadcast(cal.where("htype is not null").select("week_idx")), "week_idx", "left_anti")
    if skip is not None:
        made = made.join(skip, ["series_id", "week_idx"], "left_anti")
    return history.unionByName(made.withColumn("source", F.lit("interpolated")), allowMissingColumns=True)


def plausibility_gate(rows: DataFrame, p: Params) -> DataFrame:
    """rows (series_id, week_idx, y) with accepted. A week is compared with the week before if that was stored; a rejected week is a gap, so that the next is accepted unchecked: in a run of implausible steps, every other week goes."""
    prev = F.when(F.lag("week_idx").over(by_week()) == F.col("week_idx") - 1, F.lag("y").over(by_week()))
    bad = F.coalesce(~(F.col("y") / prev).between(*p.gate), F.lit(False))
    run = rows.withColumn("bad", bad).withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(by_week()))
    at = F.row_number().over(Window.partitionBy("series_id", "run").orderBy("week_idx"))
    # a run's first row is the plausible one before it; rejected are the 2nd, 4th, ... of the run
    return run.withColumn("at", at).withColumn("first_bad", F.min("bad").over(Window.partitionBy("series_id", "run"))).withColumn("accepted", ~(F.col("bad") & (((F.col("at") % 2 == 0) & ~F.col("first_bad")) | ((F.col("at") % 2 == 1) & F.col("first_bad"))))).drop("bad", "run", "at", "first_bad")


def apply_revisions(reports: DataFrame, p: Params) -> DataFrame:
    """Reports (series_id, week_idx, value, change_pct, groups, groups_change_pct), each revised by the next week's: value_revised, groups_revised, revised, note.

    With a column source, only official rows are revised. The note names the week whose report revised, and the value before.
    """
    nxt = lambda c: F.when(F.lead("week_idx").over(by_week()) == F.col("week_idx") + 1, F.lead(c).over(by_week()))
    r = reports.withColumns({"nv": nxt("value"), "nc": nxt("change_pct"), "ng": nxt("groups"), "ngc": nxt("groups_change_pct")})
    implied = F.col("nv") / (1 + F.col("nc") / 100)
    off = F.coalesce(F.abs(implied / F.col("value") - 1) > p.revision, F.lit(False)) & (is_official() if "source" in reports.columns else F.lit(True))
    by = monday_of(F.col("week_idx") + 1)
    note = F.when(off, F.concat(F.lit("revised by the report of "), week_label(iso_year(by), iso_week(by)), F.lit(", before "), F.bround("value").cast("long").cast("string")))
    groups = F.when(off & (F.size("ng") == F.size("ngc")), F.zip_with("ng", "ngc", lambda g, c: F.bround(g / (1 + c / 100)))).otherwise(F.col("groups"))
    return r.withColumns({"revised": off, "value_revised": F.when(off, F.bround(implied)).otherwise(F.col("value")), "groups_revised": groups, "note": note}).drop("nv", "nc", "ng", "ngc")


def trend_growth(clean: Column) -> tuple[Column, Column]:
    """Weekly log growth from two-week sums of the last 4 clean values (newest first), and whether a fall is confirmed."""
    x = [F.get(clean, F.lit(k)) for k in range(4)]
    return 0.5 * F.ln((x[0] + x[1]) / (x[2] + x[3])), (F.ln(x[0] / x[1]) <= 0.02) & (F.ln(x[1] / x[2]) <= 0.02)


def current_state(panel: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """For each series its latest week: value, band, changes in %, trend, holiday, and the panel's sub_value, source and url, if it has them. Changes and trend go by rows, not weeks."""
    more = [c for c in ("sub_value", "source", "url") if c in panel.columns]
    newest = Window.partitionBy("series_id").orderBy(F.desc("week_idx"))
    last = panel.select("series_id", "week_idx", "y", *more).withColumn("n", F.row_number().over(newest)).where("n <= 8").join(F.broadcast(cal.select("week_idx", "htype", "hlabel")), "week_idx", "left")
    at = lambda k, c="y": F.max(F.when(F.col("n") == k, F.col(c)))
    rows = last.groupBy("series_id").agg(
        at(1, "week_idx").alias("week_idx"), at(1).alias("y"), at(2).alias("y1"), at(3).alias("y2"), at(1, "hlabel").alias("holiday"), *[at(1, c).alias(c) for c in more],
        F.transform(F.array_sort(F.collect_list(F.when(F.col("htype").isNull(), F.struct("n", "y")))), lambda s: s["y"]).alias("clean"),
    )
    g, falling = trend_growth(F.col("clean"))
    trend = F.when(F.size("clean") < 4, "stable").when(g >= 0.03, "rising").when((g <= -0.03) & falling, "falling").otherwise("stable")
    pct = lambda c: F.bround((F.col("y") / F.col(c) - 1) * 100, 1)
    return rows.select("series_id", "week_idx", "y", band_of(F.col("y"), p).alias("band"), pct("y1").alias("change_1w_pct"), pct("y2").alias("change_2w_pct"), trend.alias("trend"), "holiday", *more)


def changed_rows(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of only one of two stores, with where they are; no rows: nothing to write."""
    return new.exceptAll(old).withColumn("side", F.lit("new")).unionByName(old.exceptAll(new).withColumn("side", F.lit("old")))


def staleness(panel: DataFrame, today_idx: int, weeks: int = 4) -> DataFrame:
    return panel.groupBy("series_id").agg(F.max("week_idx").alias("last_idx")).withColumn("weeks_behind", F.lit(today_idx) - F.col("last_idx")).withColumn("alert", F.col("weeks_behind") >= weeks)


def violations(history: DataFrame, p: Params) -> DataFrame:
    """(series_id, week_idx, problem) of (series_id, week_idx, monday, value, source): duplicates, unknown sources, wrong Mondays, implausible values and jumps between neighbouring official weeks."""
    jump = (F.lag("week_idx").over(by_week()) == F.col("week_idx") - 1) & (F.col("source") == "official") & (F.lag("source").over(by_week()) == "official") & ~(F.col("value") / F.lag("value").over(by_week())).between(*p.gate)
    n = F.count("*").over(Window.partitionBy("series_id", "week_idx"))
    history = history.withColumns({"n": n, "jump": F.coalesce(jump, F.lit(False))})
    problems = F.array_compact(F.array(
        F.when(F.col("n") > 1, "duplicate"), F.when(~F.col("source").isin("official", "scaled", "interpolated"), "source"), F.when(F.col("monday") != monday_of(F.col("week_idx")), "monday"),
        F.when(~F.col("value").between(*p.plausible), "value"), F.when(F.col("jump"), "jump"),
    ))
    return history.select("series_id", "week_idx", F.explode(problems).alias("problem"))


def season_peak(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series_id", "season").agg(F.max("y").alias("peak"), F.max_by("week_idx", F.struct("y", -F.col("week_idx"))).alias("peak_idx"))


def seasonal_change_stats(panel: DataFrame) -> DataFrame:
    """By ISO week: median change in % against the week before, share of seasons rising, number."""
    prev = F.when(F.lag("week_idx").over(by_week()) == F.col("week_idx") - 1, F.lag("y").over(by_week()))
    ch = panel.withColumn("chg", F.col("y") / prev - 1).where("chg is not null")
    return ch.groupBy("series_id", "wk52").agg((F.median("chg") * 100).alias("median_pct"), F.avg((F.col("chg") > 0).cast("double")).alias("share_rising"), F.count("*").alias("n"))
