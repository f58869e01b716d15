"""Replayed recommendations: against cut panels, and against plain loops over random series."""

import random
from dataclasses import replace
from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from weekloom.functions import calendar as C
from weekloom.operators import decide, replay
from weekloom.params import Params

P = replace(Params(), thresholds=(100.0, 150.0, 220.0))
PANEL = "series_id string, week_idx long, iso_year int, iso_week int, wk52 int, season int, y double"
FORECAST = "series_id string, origin_idx long, horizon int, week_idx long, median long, q75 long, p_1 double, p_2 double, p_3 double"


def _row(s, i, y):
    yr, w, _ = date.fromordinal(i * 7 + 1).isocalendar()
    return s, i, yr, w, min(w, 52), yr if w >= 27 else yr - 1, y


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Three series of random walks with gaps, and random forecasts from each week."""
    rng, at, panel, rows = random.Random(12), tmp_path_factory.mktemp("replay"), [], []
    first = date.fromisocalendar(2015, 30, 1).toordinal() // 7
    for s in "abc":
        y = 120.0
        for i in range(first, first + 170):
            y = min(400.0, max(40.0, y * rng.choice([0.75, 0.85, 0.9, 0.97, 1.0, 1.05, 1.15, 1.3])))
            if rng.random() < 0.1:
                continue
            panel.append(_row(s, i, round(y, 3)))
            if rng.random() < 0.9:
                for h in range(1, 11):
                    m = max(1, round(y * rng.uniform(0.7, 1.4)))
                    p3 = round(rng.random() / 2, 3)
                    rows.append((s, i, h, i + h, m, m + rng.randint(0, 60), min(1.0, p3 + 0.4), p3 + 0.1, p3))
    C.calendar(spark, 2014, 2020).write.parquet(f"{at}/cal")
    spark.createDataFrame(panel, PANEL).write.parquet(f"{at}/panel")
    spark.createDataFrame(rows, FORECAST).write.parquet(f"{at}/rows")
    signal = spark.createDataFrame([(r[0], r[1], rng.random() < 0.05) for r in panel], "series_id string, week_idx long, signal boolean")
    signal.write.parquet(f"{at}/signal")
    return [spark.read.parquet(f"{at}/{x}") for x in ("panel", "rows", "cal", "signal")]


def test_facts_of_a_week_are_those_of_the_panel_cut_there(spark, data):
    panel, rows, cal, signal = data
    got = {(r.series_id, r.today_idx): r for r in replay.vintages(panel, rows, cal, signal, P, (0,)).collect() if r.today_idx == r.week_idx}
    weeks = sorted({r.week_idx for r in panel.where("series_id = 'a'").collect()})
    for cut in weeks[20::23]:
        upto = panel.where(F.col("week_idx") <= cut)
        last = {r.series_id: r.week_idx for r in upto.groupBy("series_id").agg(F.max("week_idx").alias("week_idx")).collect()}
        own = rows.join(upto.groupBy("series_id").agg(F.max("week_idx").alias("origin_idx")), ["series_id", "origin_idx"])
        state = upto.join(upto.groupBy("series_id").agg(F.max("week_idx").alias("week_idx")), ["series_id", "week_idx"]).select("series_id", "week_idx", "y")
        trend = decide.trend_class(upto, own, cal)
        plain = {r.series_id: r for r in decide.planned_value(state, own, cal, P).join(trend, "series_id").join(decide.planning_phase(upto, trend, P), "series_id").collect()}
        for s, i in last.items():
            a, b = got[s, i], plain[s]
            assert (a.planned_band, a.fast, a.rising, a.falling, a.plan_phase) == (b.planned_band, b.fast, b.rising, b.falling, b.plan_phase)
            assert abs(a.planned - b.planned) < 1e-9


def test_delays_see_what_was_reported_by_then(data):
    panel, rows, cal, signal = data
    weeks = {(r.series_id, r.week_idx) for r in panel.collect()}
    v = replay.vintages(panel, rows, cal, signal, P).collect()
    assert len({(r.series_id, r.today_idx, r.delay) for r in v}) == len(v) > 500
    for r in v:
        behind = r.today_idx - r.delay
        assert r.week_idx == max(i for s, i in weeks if s == r.series_id and i <= behind) > behind - 4
        assert r.crisis == (r.y >= 220 and (r.rising or r.plan_phase == "winter_pre"))


def _fold(rows, hold=8):
    """The rules in order, for the rows (one for each today and delay) of a series."""
    days, out, level, low, high = {}, [], None, None, None
    for r in rows:
        days.setdefault(r["today"], []).append(r)
    raw = {t: (max(x["want"] for x in d), *(max((x[c] for x in d if x[c] is not None), default=None) for c in ("low", "high"))) for t, d in days.items()}
    for t in sorted(days):
        held = [max((raw[u][k] for u in range(t - hold, t) if u in raw and raw[u][k] is not None), default=None) for k in range(3)]
        down, now = all(x["down"] for x in days[t]), raw[t]

        def after(old, new, kept, fallen):
            if old is None or (new is not None and new >= old):
                return new
            if new is None:
                return old
            if down:
                return fallen(old, new)
            return max(new, old if kept is None else min(old, kept))

        level = after(level, now[0], held[0], lambda o, n: max(n, o - 1))
        low, high = (after(o, n, k, lambda a, b: (a + b) / 2) for o, n, k in zip((low, high), now[1:], held[1:], strict=True))
        whole = lambda x: None if x is None else max(100.0, 5.0 * round(round(x / 5, 9)))
        out.append((t, now[0], held[0], level, any(x["crisis"] for x in days[t]), whole(low), whole(high)))
    return out


def test_levels_and_capacities_follow_the_rules_in_order(spark, data):
    panel, rows, cal, signal = data
    rng = random.Random(4)
    groups = spark.createDataFrame([(r.series_id, r.week_idx, [rng.uniform(20, 400) for _ in range(5)]) for r in panel.collect() if rng.random() < 0.95], "series_id string, week_idx long, groups array<double>")
    v, share = replay.vintages(panel, rows, cal, signal, P), replay.capacity_share(panel, groups, cal)
    got = replay.capacity_replay(v, share, P).collect()
    facts = v.withColumns({"want": replay.wanted_level(P), "down": replay.may_fall()}).join(share, ["series_id", "week_idx"], "left").collect()
    m = lambda r: None if r.base is None or r.share is None else r.planned / r.base * r.share
    pct = lambda r, s: None if m(r) is None else 100 * ((1 - s) + s * m(r))
    for s in "abc":
        own = [{"today": r.today_idx, "want": r.want, "down": r.down, "crisis": r.crisis, "low": pct(r, 0.25), "high": pct(r, 0.45)} for r in facts if r.series_id == s]
        assert sorted(tuple(r)[1:] for r in got if r.series_id == s) == _fold(own)
    by = {(r.series_id, r.today_idx): r for r in got}
    steps = [(by[s, t - 1].level, r.level) for (s, t), r in by.items() if (s, t - 1) in by]
    assert any(b < a for a, b in steps) and {r.level for r in got} == {0, 1, 2, 3} and any(r.low_pct and r.low_pct > 100 for r in got)


def test_share_is_the_larger_of_the_last_two_plain_weeks(spark, data):
    panel, _, cal, _ = data
    rng = random.Random(6)
    g = {(r.series_id, r.week_idx): [rng.uniform(20, 400) for _ in range(5)] for r in panel.collect()}
    groups = spark.createDataFrame([(*k, v) for k, v in g.items()], "series_id string, week_idx long, groups array<double>")
    hol = {r.week_idx for r in cal.where("htype is not null").collect()}
    got = {(r.series_id, r.week_idx): r for r in replay.capacity_share(panel, groups, cal).collect()}
    index = lambda x: 0.114 * x[2] + 0.636 * x[3] + 0.25 * x[4]
    for s in "abc":
        own = sorted((r.week_idx, r.iso_year, r.iso_week, r.y) for r in panel.collect() if r.series_id == s)
        for i, year, _, _ in own:
            summer = [(y, index(g[s, j])) for j, yr, w, y in own if 27 <= w <= 34 and year - 3 < yr and j <= i]
            r = got[s, i]
            if not summer:
                assert r.base is None and r.share is None
                continue
            two = [index(g[s, j]) / y for j, _, _, y in own if j <= i and j not in hol][-2:]
            base, base_index = median(y for y, _ in summer), median(x for _, x in summer)
            assert abs(r.base - base) < 1e-9 and abs(r.share - min(1.5, max(0.5, max(two) * base / base_index))) < 1e-9


_FACTS = dict(planned_band="green", band="green", y=50.0, plain_y=50.0, plan_phase="winter_pre", iso_week=2, rising=False, fast=False, falling=False, signal=False, on_holiday=False, level=0, p_yellow=0.0, p_amber=0.0, p_red=0.0)
_SITUATIONS = {
    "S1": {"plan_phase": "summer", "planned_band": "yellow"},
    "S1b": {"plan_phase": "spring", "level": 1},
    "S2": {"plan_phase": "autumn", "p_yellow": 0.3},
    "S3": {"plan_phase": "autumn", "planned_band": "yellow", "band": "yellow", "p_amber": 0.5},
    "S3a": {"planned_band": "yellow", "p_amber": 0.6},
    "S4": {"plan_phase": "autumn", "planned_band": "amber", "band": "amber", "rising": True},
    "S4a": {"plan_phase": "autumn", "planned_band": "amber", "band": "yellow", "rising": True},
    "S5": {"plan_phase": "autumn", "planned_band": "amber", "band": "amber"},
    "S6": {"signal": True, "planned_band": "red", "plain_y": 300.0},
    "S7": {"planned_band": "amber", "p_red": 0.3},
    "S8": {"planned_band": "amber", "p_red": 0.29},
    "S8j": {"plan_phase": "spring", "planned_band": "yellow"},
    "S9": {"planned_band": "red", "plain_y": 220.0, "on_holiday": True},
    "S9a": {"planned_band": "red", "plain_y": 219.0, "on_holiday": True},
    "S10": {"plan_phase": "winter_post", "planned_band": "amber", "falling": True},
    "S11": {"plan_phase": "spring", "planned_band": "yellow", "falling": True},
    "S12": {"on_holiday": True, "planned_band": "amber"},
    "S14": {"plan_phase": "summer", "planned_band": "yellow", "rising": True},
}


def test_every_situation(spark):
    more = {"S10": {"plan_phase": "winter_post", "planned_band": "red", "plain_y": 300.0}, "S14": {"plan_phase": "summer", "fast": True}, "S5": {"planned_band": "yellow"}, "S3": {"plan_phase": "winter_pre", "planned_band": "yellow", "rising": True}, "S2": {"plan_phase": "autumn", "rising": True}, "S7": {"planned_band": "amber", "rising": True}}
    cases = [(n, _FACTS | x) for y in (_SITUATIONS, more) for n, x in y.items()]
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = "want string, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in _FACTS.items())
    got = decide.situation(spark.createDataFrame([(n, *f.values()) for n, f in cases], schema), P).collect()
    assert [(r.want, r.situation) for r in got] == [(n, n) for n, _ in cases] and len(_SITUATIONS) == 18
