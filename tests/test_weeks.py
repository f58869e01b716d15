import math
import random
from datetime import date

from pyspark.sql import functions as F

from weekloom.functions import calendar as C
from weekloom.operators import forecast, history, models, profiles
from weekloom.params import Params
from weekloom.sources import reports

#: Easter Sundays as printed in almanacs.
EASTERS = {1954: (4, 18), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2049: (4, 18)}
BASE = """25 týden 2026 - Week 25
Relativní nemocnost na 100000 obyvatel - Morbidity per 100000
ARI
0 - 5 let/ 6 - 14 15 - 24 25 - 64 65+ let/ Celkem /
Česká republika - the Czech Republic 2194 1099 672 496 330 738
Změna - Change [%] -2,71 -3,26 4,35 0,61 -2,08 -0,81
ILI
Česká republika - the Czech Republic 15 9 7 6 5 7
"""


def test_calendar_and_holidays(spark):
    rows = {(r.iso_year, r.iso_week): r for r in C.calendar(spark, 2009, 2028).collect()}
    want = {}
    for y in range(2009, 2029):  # which type a week has, from the days themselves; the first that applies counts
        e = next(r.e for r in spark.range(1).select(C.easter(F.lit(y)).alias("e")).collect()) if y in EASTERS else None
        for m, d, only_weekdays, kind in ((12, 27, False, "xmas1"), (1, 1, True, "xmas2"), (12, 24, True, "minor"), (10, 28, True, "autumn")):
            day = date(y, m, d)
            if not only_weekdays or day.weekday() < 5:
                want.setdefault(day.isocalendar()[:2], []).append(kind)
        if e:
            assert (e.month, e.day) == EASTERS[y] and rows[e.isocalendar()[:2]].htype == "goodfri" and rows[date.fromordinal(e.toordinal() + 1).isocalendar()[:2]].htype == "eastermon"
    assert all(rows[k].htype in kinds for k, kinds in want.items() if k in rows)
    assert all(rows[y, w].htype is None for y in (2010, 2017, 2026) for w in (3, 8, 24, 31, 34, 36))
    assert rows[2026, 53].week_idx + 1 == rows[2027, 1].week_idx == rows[2026, 52].week_idx + 2
    for (y, w), r in rows.items():
        assert r.monday == date.fromisocalendar(y, w, 1) and r.week_idx == r.monday.toordinal() // 7 and r.wk52 == min(w, 52) and r.season == (y if w >= 27 else y - 1)


def test_reports(spark):
    second = BASE.index("Česká", BASE.index("ILI"))
    texts = {
        "base": BASE, "none": "no table", "star": BASE.replace("496 330", "496* 330"), "dash": BASE.replace("672 496", "– 496"), "thousands": BASE.replace(" 738", " 1 078", 1), "total": BASE.replace(" 330 738", " 330 7380"),
        "week": BASE.replace("25 týden 2026", "53 týden 2027"), "one": BASE[: BASE.index("Česká")] + BASE[second:], "next": BASE.replace("5 7\n", "5 7\n12\n"), "null": None,
    }
    got = {r.name: r.report for r in reports.parse_reports(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert (got["base"].year, got["base"].week, got["base"].value, got["base"].sub_value, got["base"].change_pct) == (2026, 25, 738, 7, -0.81)
    assert got["base"].groups == [2194, 1099, 672, 496, 330] and got["next"] == got["base"]
    assert all(got[k] is None for k in texts if k not in ("base", "next"))


def test_reports_come_with_variants(spark):
    texts = {
        "plain letters": BASE.replace("Česká republika", "Ceska  republika").replace("Změna - Change", "Zmena -  Change"), "upper": BASE.replace("25 týden", "25 . TÝDEN"), "dotted": BASE.replace("25 týden", "25. tyden"),
        "no blanks": BASE.replace("republika - the", "republika-the"),
    }
    parsed = reports.parse_reports(spark.createDataFrame([*texts.items(), ("base", BASE)], "name string, text string")).collect()
    assert len({str(r.report) for r in parsed}) == 1 and parsed[0].report.change_pct == -0.81


def test_header_and_url_agree(spark):
    at = "https://example.org/wp-content/uploads/2026/{}_tyden.pdf"
    urls = {at.format("06/25"): True, at.format("06/26"): True, at.format("06/22"): False, "https://example.org/x.pdf": True, "https://example.org/other/2026/06/22_tyden.pdf": True}
    got = {r.url: r.report is not None for r in reports.checked_reports(spark.createDataFrame([(u, BASE) for u in urls], "url string, text string")).collect()}
    assert got == urls
    have = spark.createDataFrame([(2026, 25, "official", 738.0), (2026, 26, "scaled", 700.0)], "iso_year int, iso_week int, source string, value double")
    assert {r.url for r in reports.unread(spark.createDataFrame([(u,) for u in urls], "url string"), have).collect()} == set(urls) - {at.format("06/25")}


def test_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text(BASE, encoding="utf-8")
    assert reports.parse_reports(reports.read_reports(spark, f"{tmp_path}/r")).first().report.value == 738


def test_gaps_and_sources(spark):
    cal = spark.createDataFrame([(7, "minor")], "week_idx long, htype string")
    rows = spark.createDataFrame([("a", 1, 900.0), ("a", 3, 1000.0), ("a", 6, 5.0), ("a", 8, 5.0)], "series_id string, week_idx long, value double").withColumn("source", F.lit("official"))
    made = [r for r in history.fill_single_gaps(rows, cal).collect() if r.source == "interpolated"]
    assert [(r.week_idx, r.value) for r in made] == [(2, 949.0)] and made[0].note
    row = "series_id string, week_idx long, value double, note string"
    merged = history.merge_sources(spark.createDataFrame([("a", 5, 9.0, None)], row).withColumn("sub_value", F.lit(1.5)), spark.createDataFrame([("a", 4, 1.0), ("a", 6, 2.0), ("b", 4, 3.0)], "series_id string, week_idx long, value double"), spark.createDataFrame([], row))
    assert {(r.series_id, r.week_idx, r.value, r.source, r.note, r.sub_value) for r in merged.collect()} == {("a", 4, 1.0, "scaled", None, None), ("a", 5, 9.0, "official", None, 1.5), ("a", 6, 2.0, "scaled", "official report missing", None), ("b", 4, 3.0, "scaled", None, None)}
    scaled = spark.createDataFrame([("a", 1, 100.0, 2.0, "scaled"), ("a", 2, 100.0, 100.0, "official")], "series_id string, week_idx long, value double, change_pct double, source string").withColumns({"groups": F.array(F.lit(1.0)), "groups_change_pct": F.array(F.lit(1.0))})
    assert [r.revised for r in history.apply_revisions(scaled, Params()).collect()] == [False, False]
    official = history.apply_revisions(scaled.withColumn("source", F.lit("official")), Params()).orderBy("week_idx").first()
    assert official.revised and official.value_revised == 50 and official.note.endswith(", before 100")


def test_url_week(spark):
    rows = [(f"https://example.org/wp-content/uploads/{x}_tyden.pdf",) for x in ("2026/01/52", "2025/12/01", "2026/09/39")] + [("https://example.org/other.pdf",)]
    got = spark.createDataFrame(rows, "u string").select(reports.url_week(F.col("u")).alias("w")).collect()
    assert [tuple(r.w) if r.w else None for r in got] == [(2025, 52), (2026, 1), (2026, 39), None]


#: Numbers of published reports, which must come out as published.
def test_revision(spark):
    week = [2211.0, 1311.0, 1321.0, 665.0, 402.0], [0.14, -9.83, 20.2, 14.85, 14.86]
    rows = [("a", 1, 851.0, None, [2079.0, 1468.0, 1013.0, 554.0, 324.0], None), ("a", 2, 955.0, 7.3, *week), ("b", 1, 744.0, None, [1.0], None), ("b", 2, 738.0, -0.81, [1.0], [0.0])]
    got = history.apply_revisions(spark.createDataFrame(rows, "series_id string, week_idx long, value double, change_pct double, groups array<double>, groups_change_pct array<double>"), Params()).where("week_idx = 1").orderBy("series_id").collect()
    assert got[0].value_revised == 890 and got[0].groups_revised == [2208, 1454, 1099, 579, 350] and got[1].value_revised == 744


def test_gate_is_the_sequential_rule(spark):
    rng, rows, want = random.Random(3), [], {}
    for s in range(60):
        prev = None
        for w in (w for w in range(40) if rng.random() < 0.85):
            y = math.exp(rng.gauss(0, 0.9))
            ok = prev is None or prev[0] != w - 1 or 0.4 <= y / prev[1] <= 2.5
            rows.append((str(s), w, y))
            want[str(s), w] = ok
            prev = (w, y) if ok else None
    got = history.plausibility_gate(spark.createDataFrame(rows, "series_id string, week_idx long, y double"), Params()).collect()
    assert {(r.series_id, r.week_idx): r.accepted for r in got} == want


def test_case_rates(spark):
    rows = [("0TO4", "2024", "1", "10", "60000", "1", "60000"), ("65TO", "2024", "1", "", "60000", "", ""), ("ALL", "2024", "1", "99", "99", "9", "9"), ("0TO4", "2024", "2", "5", "90000", "", ""), ("0TO4", "2024", "3", "5", "200000", "", "0"), ("15TO64", "2024", "3", "7", "0", "1", "")]
    df = spark.createDataFrame(rows, "group_code string, iso_year string, iso_week string, cases string, population string, sub_cases string, sub_population string")
    got = {r.iso_week: r for r in history.case_rates(df, ["iso_year", "iso_week"], ["0TO4", "5TO14", "15TO64", "65TO"]).collect()}
    assert set(got) == {"1", "3"} and abs(got["1"].rate - 10 / 120000 * 1e5) < 1e-9 and abs(got["1"].sub_rate - 1 / 60000 * 1e5) < 1e-9 and got["3"].sub_rate is None


def test_weighted_quantiles(spark):
    rng = random.Random(1)
    pool = [("a", round(rng.gauss(0, 1), 3), rng.choice([1.0, 3.0])) for _ in range(80)]
    qs = {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q0": 0.0}
    got = forecast.weighted_quantiles(spark.createDataFrame(pool, "k string, err double, w double"), ["k"], "err", qs).first()
    xs, total, acc, pts = sorted((e, w) for _, e, w in pool), sum(w for *_, w in pool), 0.0, []
    for e, w in xs:
        pts.append(((acc + w / 2) / total, e))
        acc += w
    import numpy as np

    for n, q in qs.items():
        assert abs(got[n] - np.interp(q, *zip(*pts))) < 1e-9


def _made_up(spark, last=(2026, 39)):
    """A series of our own: a yearly wave with a drifting peak, a slow trend, and noise."""
    rng, rows = random.Random(20), []
    for y in range(2010, 2027):
        for w in range(1, date(y, 12, 28).isocalendar()[1] + 1):
            v = 700 + 12 * (y - 2010) + 450 * math.sin((w + 8 + y % 5) / 52.18 * 2 * math.pi) ** 3 + rng.uniform(-25, 25)
            if (y, w) <= last:
                rows.append(("s", date.fromisocalendar(y, w, 1).toordinal() // 7, y, w, min(w, 52), y if w >= 27 else y - 1, v))
    return spark.createDataFrame(rows, "series_id string, week_idx long, iso_year int, iso_week int, wk52 int, season int, y double")


def test_no_model_looks_ahead(spark, tmp_path):
    p, cal = Params(), C.calendar(spark, 2009, 2028)
    cal.write.parquet(f"{tmp_path}/cal")
    cal = spark.read.parquet(f"{tmp_path}/cal")
    cut = date.fromisocalendar(2026, 20, 1).toordinal() // 7
    out = []
    for k, panel in enumerate((_made_up(spark), _made_up(spark, (2026, 20)))):
        profiles.with_effects(panel, cal, p).write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        out.append({(r.origin_idx, r.horizon): r.lp for r in models.point_forecast(panel, seen, cal, p).where(F.col("origin_idx") <= cut).collect()})
    assert out[0].keys() == out[1].keys() and len(out[0]) > 4000 and all(abs(v - out[1][k]) < 1e-9 for k, v in out[0].items()) and all(math.isfinite(v) for v in out[0].values())


def test_weeks_to_skip_are_not_filled(spark):
    rows = [("a", i, 100.0 * i, "official") for i in (1, 3, 5, 8, 10)]
    h = spark.createDataFrame(rows, "series_id string, week_idx long, value double, source string")
    cal = spark.createDataFrame([(9, "minor")], "week_idx long, htype string")
    skip = spark.createDataFrame([("a", 4), ("b", 2)], "series_id string, week_idx long")
    filled = lambda **k: {r.week_idx: r.value for r in history.fill_single_gaps(h, cal, **k).where("source = 'interpolated'").collect()}
    # two missing weeks and a holiday stay missing
    assert filled() == {2: round((100 * 300) ** 0.5), 4: round((300 * 500) ** 0.5)} and filled(skip=skip) == {2: round((100 * 300) ** 0.5)}
