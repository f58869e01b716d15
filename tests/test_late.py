"""Forecasts from weeks whose report is late."""

import math
import random
from dataclasses import replace
from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from weekloom.functions import calendar as C
from weekloom.operators import models, profiles
from weekloom.params import Params

P = Params(excluded=(2012,))
PANEL = "series_id string, week_idx long, iso_year int, iso_week int, wk52 int, season int, y double"


def _idx(y, w):
    return date.fromisocalendar(y, w, 1).toordinal() // 7


def _year_week(i):
    return date.fromordinal(i * 7 + 1).isocalendar()[:2]


def _season(i):
    y, w = _year_week(i)
    return y if w >= 27 else y - 1


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Weeks 15 to 33 of 2017 are missing, and some others."""
    rng, rows, at = random.Random(31), [], tmp_path_factory.mktemp("late")
    for i in range(_idx(2009, 30), _idx(2018, 20)):
        y, w = _year_week(i)
        if (2017, 15) <= (y, w) <= (2017, 33) or rng.random() < 0.05:
            continue
        rows.append(("s", i, y, w, min(w, 52), _season(i), (500 + 350 * math.cos((w - 4) / 52 * 2 * math.pi)) * math.exp(rng.gauss(0, 0.15))))
    spark.createDataFrame(rows, PANEL).write.parquet(f"{at}/panel")
    C.calendar(spark, 2008, 2019).write.parquet(f"{at}/cal")
    panel, cal = spark.read.parquet(f"{at}/panel"), spark.read.parquet(f"{at}/cal")
    profiles.with_effects(panel, cal, P).write.parquet(f"{at}/seen")
    return panel, spark.read.parquet(f"{at}/seen"), cal, {r[1]: r[6] for r in rows}


def _wanted(spark, weeks):
    return spark.createDataFrame([("s", i) for i in weeks], "series_id string, origin_idx long")


def _rows(df):
    return {(r.origin_idx, r.horizon): r.lp for r in df.collect()}


@pytest.mark.parametrize("phi", [0.0, 0.5])
def test_a_late_week_continues_the_forecast_of_its_base(spark, data, phi):
    panel, seen, cal, y = data
    p = replace(P, profile_phi=phi)
    base = max(i for i in y if i < _idx(2017, 15))
    weeks = [base, base + 1, base + 4]
    at = models.origins_at(panel, _wanted(spark, weeks), p)
    longer = replace(p, horizon=14)
    for f in (models.seasonal_profile_holiday, models.analog):
        got = _rows(f(panel, seen, cal, p, at))
        want = _rows(f(panel, seen, cal, longer).where(F.col("origin_idx") == base))
        assert got.keys() == {(o, h) for o in weeks for h in range(1, 11)}
        assert all(abs(v - want[base, o - base + h]) < 1e-9 for (o, h), v in got.items())


def test_weeks_with_a_value_are_their_own_base(spark, data):
    panel, seen, cal, y = data
    weeks = sorted(i for i in y if _season(i) == 2015)[::9]
    got = _rows(models.point_forecast(panel, seen, cal, P, models.origins_at(panel, _wanted(spark, weeks), P)))
    want = _rows(models.point_forecast(panel, seen, cal, P).where(F.col("origin_idx").isin(weeks)))
    assert got.keys() == want.keys() and len(got) == 10 * len(weeks) and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def _plain(y, origin, p):
    """Profile and analog models without holidays, by their definitions."""
    z = {i: math.log(v) for i, v in y.items() if i <= origin}
    base, s0 = max(i for i in z if _season(i) not in p.excluded), _season(origin)
    changes = {}
    for i in z:
        if i - 1 in z and _season(i) < s0 and _season(i) not in p.excluded:
            changes.setdefault(min(_year_week(i)[1], 52), []).append(z[i] - z[i - 1])
    steps, level, prof = origin - base + p.horizon, z[base], []
    for h in range(1, steps + 1):
        w = min(_year_week(base + h)[1], 52)
        near = [x for d in (-1, 0, 1) for x in changes.get((w - 1 + d) % 52 + 1, [])]
        level += median(near) if near else 0.0
        prof.append(level)
    z = {i: v for i, v in z.items() if _season(i) not in p.excluded}
    found = []
    for s in sorted({_season(i) for i in z} - {x for x in map(_season, z) if x >= s0}):
        sh = (3 - (date(s0, 7, 1) - date(s, 7, 1)).days) // 7
        pair = lambda i, sh=sh: z[i] - z[i + sh] if i in z and i + sh in z else None
        long = [d for j in range(p.long_weeks) if (d := pair(base - j)) is not None]
        win = [(p.decay**j, d) for j in range(p.shape_weeks) if (d := pair(base - j)) is not None]
        if len(win) < p.min_pairs or not any(base + sh + h in z for h in range(1, steps + 1)):
            continue
        total = sum(w for w, _ in win)
        mean = sum(w * d for w, d in win) / total
        d2 = sum(w * (d - mean) ** 2 for w, d in win) / total
        now = pair(base)
        found.append((math.exp(-d2 / (2 * p.tau**2)), sh, mean if now is None else now, sum(long) / len(long)))
    assert found
    an, last = [], z[base]
    for h in range(1, steps + 1):
        said = [(w, z[base + h + sh] + o + (now - o) * p.analog_rho**h) for w, sh, now, o in found if base + h + sh in z]
        last = sum(w * v for w, v in said) / sum(w for w, _ in said) if said else last
        an.append(last)
    return prof[-p.horizon :], an[-p.horizon :]


def test_a_gap_over_the_turn_of_seasons(spark, data):
    panel, _, cal, y = data
    plain = cal.withColumn("htype", F.lit(None).cast("string"))
    seen = profiles.with_effects(panel, plain, P).cache()
    weeks = [_idx(2017, w) for w in (24, 27, 30)]
    at = models.origins_at(panel, _wanted(spark, weeks), P)
    for k, f in enumerate((lambda: models.seasonal_profile_holiday(panel, seen, plain, P, at), lambda: models.analog(panel, seen, plain, P, at, 1))):
        got = _rows(f())
        assert len(got) == 30
        for o in weeks:
            want = _plain(y, o, P)[k]
            assert all(abs(got[o, h] - v) < 1e-9 for h, v in enumerate(want, 1))


def test_origins_that_have_no_base(spark, data):
    panel, *_ = data
    got = models.origins_at(panel, _wanted(spark, [_idx(2009, 29), _idx(2010, 40), _idx(2012, 40)]), P).collect()
    assert got == [] and models.origins_at(panel, spark.createDataFrame([("t", _idx(2017, 40))], "series_id string, origin_idx long"), P).collect() == []
