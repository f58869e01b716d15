"""Streams: report texts into the store, the log of revisions, alerts."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weekloom.operators import history
from weekloom.params import Params
from weekloom.streaming import watch
from weekloom.streaming.intake import ReportIntake, gate_against_store

P = Params()
FIRST = date.fromisocalendar(2020, 40, 1).toordinal() // 7


@pytest.fixture(scope="module", autouse=True)
def by_state(spark):
    spark.conf.set(*watch.PROVIDER)
    yield
    spark.conf.unset(watch.PROVIDER[0])


def _year_week(idx):
    return date.fromordinal(idx * 7 + 1).isocalendar()[:2]


def _url(idx):
    """Where the report of a week is put, in the week after."""
    day = date.fromordinal((idx + 1) * 7 + 3)
    return f"https://example.org/wp-content/uploads/{day.year}/{day.month:02d}/{_year_week(idx)[1]}_tyden.pdf"


def _text(idx, v, change=None, broken=False):
    y, w = _year_week(idx)
    row = lambda x: " ".join(str(k) for k in (x + 20, x + 10, x, x - 10, x - 20, x))
    middle = "" if change is None else "\nZměna - Change [%] " + " ".join([f"{change:.2f}".replace(".", ",")] * 6)
    return f"{w}. týden {y}\nČeská republika - the Czech Republic {row(v)}{middle}\nČeská republika - the Czech Republic {'496* 3' if broken else row(max(21, v // 10))}\n"


def _plain(runs, estimates):
    """Every intake offers all texts so far, oldest first; what is official stays as it is."""
    store = {k: (v, "scaled") for k, v in estimates.items()}
    offered, refused = {}, {}
    for run in runs:
        for s, idx, v, bad, shift in run:
            if bad or abs(shift) > 1:
                if store.get((s, idx), (0, ""))[1] != "official":
                    refused[s, idx, v] = "unreadable" if bad else "other week"
                continue
            offered.setdefault((s, idx + shift), {})[_url(idx)] = v
        for (s, idx), by_url in sorted(offered.items(), key=lambda x: x[0]):
            for _, v in sorted(by_url.items()):
                if store.get((s, idx), (0, ""))[1] == "official":
                    continue
                prev = store.get((s, idx - 1))
                if prev is None or 0.4 <= v / prev[0] <= 2.5:
                    store[s, idx] = (v, "official")
    return store, refused


def test_intake_is_the_sequential_rule(spark, tmp_path):
    rng = random.Random(8)
    weeks = [(s, FIRST + k) for s in "abcd" for k in range(40)]
    estimates = {k: float(rng.randint(80, 400)) for k in weeks if rng.random() < 0.4}
    texts = [(s, idx, rng.choice([80, 100, 150, 240, 400, 700]), rng.random() < 0.08, 0) for s, idx in weeks if rng.random() < 0.9]
    # urls a week off are fine, three weeks off aren't
    texts = [(s, i, v, b, rng.choice([0] * 8 + [3]) if not b else 0) for s, i, v, b, _ in texts]
    rng.shuffle(texts)
    runs = [texts[:50], texts[50:51], texts[51:]]
    intake = ReportIntake(spark, f"file://{tmp_path}/intake", P)
    intake.seed(spark.createDataFrame([(*k, v, "scaled") for k, v in estimates.items()], "series_id string, week_idx long, value double, source string"))
    rows = lambda run: spark.createDataFrame([(s, _url(i), _text(i + d, v, None, b)) for s, i, v, b, d in run], "series_id string, url string, text string")
    for n, run in enumerate(runs):
        intake.take(rows(run), n)
        versions = intake.store.versions()
        intake.take(rows(run), n)  # done again: nothing changes
        assert intake.store.versions() == versions
    store, refused = _plain(runs, estimates)
    got = {(r.series_id, r.week_idx): (r.value, r.source) for r in intake.table("history").collect()}
    assert got == store
    assert {(r.series_id, r.reason) for r in intake.table("rejects").collect()} == {(k[0], v) for k, v in refused.items()}
    assert sum(v[1] == "official" for v in got.values()) > 60 and intake.table("pending").count() > 5


def test_stream_of_texts_and_revisions(spark, tmp_path):
    """Two files, the later weeks first; week 2 says that week 1 was other than reported."""
    values = {0: (200, None), 1: (240, 20.0), 2: (300, 10.0), 3: (310, 3.3)}
    for n, some in enumerate(((2, 3), (0, 1))):
        spark.createDataFrame([("a", _url(FIRST + k), _text(FIRST + k, *values[k])) for k in some], "series_id string, url string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    intake = ReportIntake(spark, f"file://{tmp_path}/intake", P)
    source = spark.readStream.schema("series_id string, url string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    intake.run(source).awaitTermination()
    got = {r.week_idx - FIRST: r for r in intake.revised().collect()}
    assert {k: r.value for k, r in got.items()} == {0: 200, 1: 273, 2: 300, 3: 310} and got[1].note.endswith("before 240")
    assert got[1].groups == [round(x / 1.1) for x in (320, 310, 300, 290, 280)]


def test_a_stored_estimate_stands_in_for_a_rejected_week(spark):
    stored = spark.createDataFrame([("a", 1, 100.0, "official"), ("a", 2, 110.0, "scaled"), ("b", 1, 100.0, "official")], "series_id string, week_idx long, value double, source string")
    new = spark.createDataFrame([(s, i, f"u{i}", v) for s in "ab" for i, v in ((1, 90.0), (2, 900.0), (3, 900.0), (4, 950.0))], "series_id string, week_idx long, url string, value double")
    got = {(r.series_id, r.week_idx): r.status for r in gate_against_store(new, stored, P).collect()}
    # a: week 3 is held against the estimate of week 2; b: week 2 is a gap then
    assert got == {("a", 1): "known", ("a", 2): "implausible", ("a", 3): "implausible", ("a", 4): "accepted", ("b", 1): "known", ("b", 2): "implausible", ("b", 3): "accepted", ("b", 4): "accepted"}


REPORTS = "series_id string, week_idx long, version long, value double, change_pct double, groups array<double>, groups_change_pct array<double>"


def _run(stream, path, out):
    q = stream.writeStream.format("parquet").option("path", f"{path}/{out}").option("checkpointLocation", f"{path}/{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return path / out


def test_revision_log_does_not_depend_on_batches(spark, tmp_path):
    rng, rows = random.Random(2), []
    for version in range(90):
        idx, v = FIRST + rng.randrange(12), float(rng.randint(100, 300))
        pct = round(rng.uniform(-30, 30), 2) if rng.random() < 0.9 else None
        rows.append((rng.choice("ab"), idx, version, v, pct, [v, v + 5], [pct, pct] if pct is not None and rng.random() < 0.8 else None))
    logs = []
    for name, cuts in (("one", [90]), ("three", [7, 40, 90]), ("five", [1, 2, 30, 31, 90])):
        at = 0
        for k, cut in enumerate(cuts):
            spark.createDataFrame(rows[at:cut], REPORTS).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
            at = cut
        source = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/{name}/*")
        logs.append(spark.read.parquet(str(_run(watch.revision_log(source, P.revision), tmp_path, f"log-{name}"))).collect())
    keys = [sorted((tuple(r) for r in log), key=str) for log in logs]
    assert keys[0] == keys[1] == keys[2] and len(keys[0]) > 20 and any(r.new is None for r in logs[0])
    # the newest entries are what the batch says of the last report of each week
    last = {(r[0], r[1]): r for r in rows}
    batch = history.apply_revisions(spark.createDataFrame(list(last.values()), REPORTS), P).where("revised").collect()
    newest = {}
    for r in sorted(logs[0], key=lambda r: r.version):
        newest[r.series_id, r.week_idx] = r
    got = {k: (r.old, r.new, r.groups, r.note) for k, r in newest.items() if r.new is not None}
    assert got == {(r.series_id, r.week_idx): (r.value, r.value_revised, r.groups_revised, r.note) for r in batch}


def test_alerts_come_without_rows_and_are_withdrawn(spark, tmp_path):
    """Time goes on with the rows of a clock; each file is one step of it."""
    came = lambda idx: datetime.fromordinal((idx + 1) * 7 + 2)
    weeks = {"a": [0, 1, 2, 12, 13], "b": list(range(14)), "c": [0]}
    rows = sorted([(s, FIRST + k, came(FIRST + k)) for s, w in weeks.items() for k in w] + [("~", FIRST + k, came(FIRST + k)) for k in range(20)], key=lambda r: r[2])
    due = lambda k: datetime.fromordinal((FIRST + k + 4) * 7 + 1)
    want = {("a", 2, due(2), "alert"), ("a", 12, came(FIRST + 12), "withdrawn"), ("a", 13, due(13), "alert"), ("b", 13, due(13), "alert"), ("c", 0, due(0), "alert")}
    for name, steps in (("each", 20), ("few", 3), ("one", 1)):
        size = -(-len(rows) // steps)
        for k in range(0, len(rows), size):
            spark.createDataFrame(rows[k : k + size], "series_id string, week_idx long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/{name}/{k:03d}")
        source = spark.readStream.schema("series_id string, week_idx long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
        got = spark.read.schema(watch.ALERTS).parquet(str(_run(watch.stale_alerts(source), tmp_path, f"alerts-{name}"))).collect()
        assert {(r.series_id, r.last_idx - FIRST, r.at, r.kind) for r in got if r.series_id != "~"} == want and len({tuple(r) for r in got}) == len(got)
