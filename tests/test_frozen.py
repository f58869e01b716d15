"""The national series up to 2026-W39, whose file $WEEKLOOM_SERIES names; without it these tests are skipped."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from weekloom.jobs import accuracy
from weekloom.operators import evaluate, forecast, models, profiles
from weekloom.params import Params

FILE = os.environ.get("WEEKLOOM_SERIES", "")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no series")
P = Params()


def _idx(w):
    return date.fromisocalendar(2026, w, 1).toordinal() // 7


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("frozen"))
    panel, seen, cal = accuracy.tables(spark, FILE, at, P)
    scores = {(r.split, r.model): r.score for r in accuracy.scores(panel, seen, cal, at, P).collect()}
    models.point_forecast(panel, seen, cal, P).write.parquet(f"{at}/points")
    points, res = spark.read.parquet(f"{at}/points"), spark.read.parquet(f"{at}/residuals").where("model = 'blend'")
    origins = models.rolling_origins(panel, P)
    rows = {(r.origin_idx, r.horizon): r for r in forecast.make_forecast(points, res, forecast.latest_origins(origins, 1, 2), cal, P).collect()}
    return panel, seen, cal, scores, rows, res.select("origin_idx").distinct().count()


def test_scores_are_the_published_ones(made):
    _, _, _, scores, _, origins = made
    assert origins == 565
    for key, value in {("tune", "blend"): 6.4, ("holdout", "blend"): 7.7, ("tune", "legacy"): 21.3, ("holdout", "legacy"): 18.0}.items():
        assert abs(scores[key] - value) < 0.06, (key, scores[key])


def test_autumn_of_2026(made):
    panel, seen, cal, _, rows, _ = made
    last = panel.where(F.col("week_idx") == _idx(39)).first().y
    assert rows[_idx(38), 1].q10 <= last <= rows[_idx(38), 1].q90
    m = {w: rows[_idx(39), w - 39].median for w in range(40, 50)}
    assert min(m[41], m[42], m[43]) > last and m[40] < m[41] and m[44] < min(m[43], m[45]) and m[44] / m[43] < 0.85
    h = {w: rows[_idx(39), w - 39].holiday for w in (40, 41, 44, 47)}
    assert h[40] and h[44] and h[47] and not h[41]
    for f in (models.analog, models.seasonal_profile_holiday):
        lp = {r.horizon: r.lp for r in f(panel, seen, cal, P).where(F.col("origin_idx") == _idx(39)).collect()}
        assert lp[5] - lp[4] < -0.1985  # a ratio below 0.82
    effects = seen.where(F.col("week_idx") == _idx(39)).first().effects
    assert abs(m[44] / m[43] - 2.718281828 ** effects["autumn"]) < 0.06
