import math
import random
from datetime import date
from statistics import median

import pytest

import __spark_entry__ as entry
from weekloom.operators import models
from weekloom.params import Params

SF = "/root/testdata/sf0.001"
BACKTESTS = ("backtest_residuals", "residual_quantiles", "backtest_summary", "interval_coverage", "model_score", "backtest_report")


@pytest.mark.parametrize("name", BACKTESTS)
def test_every_model_is_backtested(spark, name):
    got = {r.model for r in entry.queries()[name](spark, SF).select("model").distinct().collect()}
    assert got == set(models.MODELS)


def test_models_of_the_sql_have_its_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    want = {(m, s, o, h): (err, chg, pchg) for m, s, o, _, _, h, err, chg, pchg in con.execute(entry.oracle_sql()["backtest_residuals"]).fetchall()}
    kept = {m for m, *_ in want}
    got = {(r.model, r.series_id, r.origin_idx, r.horizon): (r.err, r.chg, r.pchg) for r in entry.queries()["backtest_residuals"](spark, SF).collect() if r.model in kept}
    assert got.keys() == want.keys() and all(abs(a - b) < 2e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def _plain(rows, p):
    """Both models week by week: {(origin, horizon): (momentum, climatology)}."""
    y = {w: v for w, *_, v in rows}
    wk52, season = (lambda w: min(date.fromordinal(w * 7 + 1).isocalendar()[1], 52)), {w: s for w, s, _ in rows}
    seasons, log, out = sorted(set(season.values())), (lambda v: math.log(max(v, 1.0))), {}
    for o in y:
        s0 = season[o]
        if s0 in p.excluded or seasons.index(s0) + 1 < p.min_seasons:
            continue
        grown, level = {}, {}
        for w in (w for w in y if season[w] < s0 and season[w] not in p.excluded):
            level.setdefault(wk52(w), []).append(log(y[w]))
            if w + 1 in y:
                grown.setdefault(wk52(w), []).append(math.log(y[w + 1] / y[w]))
        g, c = ({k: median(x) for k, x in d.items() if len(x) >= p.min_n} for d in (grown, level))
        own = [math.log(y[w] / y[w - 1]) - g[wk52(w - 1)] for w in (o, o - 1) if w in y and w - 1 in y and wk52(w - 1) in g]
        a = sum(own) / len(own) if own else 0.0
        an = [log(y[w]) - c[wk52(w)] for w in (o, o - 1) if w in y and wk52(w) in c]
        base, lift, last = log(y[o]), 0.0, log(y[o])
        for h in range(1, p.horizon + 1):
            base += g.get(wk52(o + h - 1), 0.0)
            lift += a * p.momentum_phi**h
            if wk52(o) in c:
                a0 = 0.7 * an[0] + 0.3 * sum(an) / len(an)
                last = c[wk52(o + h)] + a0 * p.anomaly_rho**h if wk52(o + h) in c else last
            out[o, h] = (base + lift, last if wk52(o) in c else base)
    return out


def test_momentum_and_climatology_are_the_plain_rules(spark):
    rng, rows, full = random.Random(8), [], []
    for w in range(date(2010, 7, 5).toordinal() // 7, date(2018, 3, 5).toordinal() // 7):
        y, k, _ = date.fromordinal(w * 7 + 1).isocalendar()
        if rng.random() < 0.12 or (k in (9, 10, 33) and y % 3):
            continue
        v = (400 + 300 * math.cos((k - 5) / 52 * 2 * math.pi)) * math.exp(rng.gauss(0, 0.2))
        rows.append((w, y if k >= 27 else y - 1, v))
        full.append(("s", w, y, k, min(k, 52), rows[-1][1], v))
    p = Params(excluded=(2012,))
    want = _plain(rows, p)
    panel = spark.createDataFrame(full, "series_id string, week_idx long, iso_year int, iso_week int, wk52 int, season int, y double").cache()
    for k, model in enumerate((models.profile_momentum, models.clim_anomaly)):
        got = {(r.origin_idx, r.horizon): r.lp for r in model(panel, p).collect()}
        assert got.keys() == want.keys() and all(abs(v - want[key][k]) < 1e-9 for key, v in got.items())
