"""Kept forecasts, holiday effects by fold, readers of files, candidates, reports of backtests."""

import json
import math
import random
from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from weekloom.functions import calendar as C
from weekloom.operators import evaluate, history, kept, models, profiles
from weekloom.params import Params
from weekloom.sources import files

P = Params(excluded=(2012,), recent_effects_from=2013)
PANEL = "series_id string, week_idx long, iso_year int, iso_week int, wk52 int, season int, y double"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng, rows, at = random.Random(3), [], tmp_path_factory.mktemp("kept")
    for s in "ab":
        for i in range(date.fromisocalendar(2009, 30, 1).toordinal() // 7, date.fromisocalendar(2015, 45, 1).toordinal() // 7):
            y, w, _ = date.fromordinal(i * 7 + 1).isocalendar()
            if rng.random() > 0.03:
                rows.append((s, i, y, w, min(w, 52), y if w >= 27 else y - 1, round((500 + 350 * math.cos((w - 4) / 52 * 2 * math.pi)) * math.exp(rng.gauss(0, 0.15)), 3)))
    spark.createDataFrame(rows, PANEL).write.parquet(f"{at}/panel")
    C.calendar(spark, 2008, 2017).write.parquet(f"{at}/cal")
    return spark.read.parquet(f"{at}/panel"), spark.read.parquet(f"{at}/cal"), at


def _written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def test_a_new_week_adds_one_origin_a_series(spark, data):
    panel, cal, at = data
    last = {r.series_id: r.last for r in panel.groupBy("series_id").agg(F.max("week_idx").alias("last")).collect()}
    at_last = F.col("week_idx") == F.when(F.col("series_id") == "a", last["a"]).otherwise(last["b"])
    before = _written(panel.where(~at_last), at / "before")
    none = spark.createDataFrame([], kept.KEPT)
    old = kept.extended(none, _written(kept.stale_origins(none, before, P), at / "s0"), before, _written(profiles.with_effects(before, cal, P), at / "e0"), cal, P)
    old = _written(old, at / "k0")
    stale = _written(kept.stale_origins(old, panel, P), at / "s1")
    assert {(r.series_id, r.origin_idx) for r in stale.collect()} == set(last.items())
    seen = _written(profiles.with_effects(panel, cal, P), at / "e1")
    got = {(r.series_id, r.origin_idx, r.horizon): r.lp for r in kept.extended(old, stale, panel, seen, cal, P).collect()}
    want = {(r.series_id, r.origin_idx, r.horizon): r.lp for r in models.point_forecast(panel, seen, cal, P).collect()}
    assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    # a revised week of one series redoes its origins from there on, and no other
    weeks = sorted(k[1] for k in got if k[0] == "a" and k[2] == 1)
    revised = panel.withColumn("y", F.when((F.col("series_id") == "a") & (F.col("week_idx") == weeks[-7]), F.col("y") + 1).otherwise(F.col("y")))
    full = _written(kept.extended(old, stale, panel, seen, cal, P), at / "k1")
    assert {(r.series_id, r.origin_idx) for r in kept.stale_origins(full, revised, P).collect()} == {("a", i) for i in weeks[-7:]}


def test_effects_by_fold(spark):
    rng = random.Random(5)
    kinds = ["autumn", "xmas1", "minor", "goodfri"]
    occ = sorted({(s, t, i): (s, i, 2010 + i // 52, rng.choice(kinds), round(rng.gauss(0, 0.2), 4), t) for s in "abc" for i in range(0, 400, 3) for t in [i + rng.randint(1, 4)]}.values())
    got = profiles.holiday_effects(spark.createDataFrame(occ, "series_id string, week_idx long, season int, htype string, diff double, known_at long"), P).collect()
    want = {}
    for s in "abc":
        for v in {o[5] for o in occ if o[0] == s}:
            for k in kinds:
                own = [o for o in occ if o[0] == s and o[3] == k and o[5] <= v]
                new = [o[4] for o in own if o[2] >= 2013]
                if k in profiles.RECENT_TYPES and len(new) >= 2:
                    want[s, v, k] = median(new)
                elif len(own) >= 2:
                    want[s, v, k] = median(o[4] for o in own)
    assert len(got) == len(want) and all(abs(r.effect - want[r.series_id, r.version, r.htype]) < 1e-12 for r in got)


def test_case_table_keeps_what_it_rejects(spark, tmp_path):
    lines = ["﻿ISO_WEEK,AGEGROUP_CODE,ISO_YEAR,ARI_CASE,ARI_POP_COV,NOTE", "1,0TO4,2024,10,60000,x", "53,0TO4,2024,10,60000,x", "1,65TO,2024,7,60000,y,extra", "x,65TO,2024,7,60000,y", "2,65TO,2024,n/a,200000,", "3,65TO"]
    (tmp_path / "cases.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows, rejects = files.read_case_table(spark, f"file://{tmp_path}/cases.csv")
    assert sorted((r.iso_year, r.iso_week, r.group_code, r.cases, r.population, r.sub_cases, r.NOTE) for r in rows.collect()) == [("2024", "1", "0TO4", "10", "60000", None, "x"), ("2024", "2", "65TO", "n/a", "200000", None, None)]
    assert sorted((r.reason, r.line) for r in rejects.collect()) == [("cells", "1,65TO,2024,7,60000,y,extra"), ("cells", "3,65TO"), ("no such week", "53,0TO4,2024,10,60000,x"), ("no week", "x,65TO,2024,7,60000,y")]
    assert rejects.groupBy("reason").count().count() == 3
    rates = history.case_rates(rows, ["iso_year", "iso_week"], ["0TO4", "65TO"], least=1.0).collect()
    assert [(r.iso_week, round(r.rate, 4), r.sub_rate) for r in rates] == [("1", round(10 / 0.6, 4), None)]


def test_official_tables_keep_what_they_reject(spark, tmp_path):
    a = [{"year": 2024, "week": 5, "ari": 801, "ili": 12.5, "ari_groups": [1, 2], "url": "u"}, {"year": 2024, "week": 60, "ari": 1}, {"year": 2024, "week": 6, "ari": None}, {"week": 7, "ari": 2}]
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text("[{'year': ")
    rows, rejects = files.read_official_tables(spark, f"file://{tmp_path}")
    assert [(r.file, r.week_idx, r.value, r.sub_value, r.groups, r.url) for r in rows.collect()] == [("a.json", date.fromisocalendar(2024, 5, 1).toordinal() // 7, 801.0, 12.5, [1.0, 2.0], "u")]
    assert sorted((r.file, r.reason) for r in rejects.collect()) == [("a.json", "no such week"), ("a.json", "no value"), ("a.json", "no week"), ("b.json", "no list")]


def test_a_candidate_that_fails_is_counted(spark, data):
    panel, _, _ = data

    def odd(weeks, values, horizon):
        if weeks[-1] % 2:
            raise ValueError("odd week")
        return [math.log(values[-1])] * horizon

    origins = [r.origin_idx for r in models.rolling_origins(panel, P).where("series_id = 'a'").collect()]
    got = {r.series_id: r for r in models.candidate_failures(panel, P, odd).collect()}
    assert got["a"].n_origins == len(origins) and got["a"].n_failed == sum(i % 2 for i in origins) and got["a"].error == "ValueError: odd week"
    assert models.candidate(panel, P, odd).where("series_id = 'a'").count() == P.horizon * sum(i % 2 == 0 for i in origins)


def test_report_has_phases_and_quantiles(spark, data, tmp_path):
    panel, _, _ = data
    p = Params(excluded=(2012,), tune=(2011, 2013), holdout=(2014, 2015))
    made = [f(panel, p).withColumn("model", F.lit(n)) for n, f in models.MODELS.items() if n in ("persistence", "legacy")]
    res = _written(evaluate.residuals(panel, made[0].unionByName(made[1])), tmp_path / "res")
    summary = _written(evaluate.backtest_summary(res, p), tmp_path / "sum")
    tuned = evaluate.residual_quantiles(res.where(F.col("s0").between(*p.tune) & (F.col("horizon") <= p.eval_horizon)))
    got = {(r.split, r.model): json.loads(r.report) for r in evaluate.backtest_report(summary, p, tuned).collect()}
    rows = {(r.split, r.model, r.phase, r.horizon): r for r in summary.collect()}
    assert set(got) == {(k[0], k[1]) for k in rows}
    for (split, model), report in got.items():
        assert set(report["phases"]) == {k[2] for k in rows if k[:2] == (split, model)} - {"*"} and set(report["tune_quantiles"]) == {str(h) for h in range(1, 9)}
        for (s, m, phase, h), r in rows.items():
            if (s, m) == (split, model):
                own = report if phase == "*" else report["phases"][phase]
                assert own["by_h"][str(h)]["n"] == r.n and abs(own["by_h"][str(h)]["mae_pct"] - r.mae_pct) < 1e-5
        whole = [r.mae_pct for k, r in rows.items() if k[:3] == (split, model, "*")]
        assert abs(report["score"] - sum(whole) / len(whole)) < 1e-5
