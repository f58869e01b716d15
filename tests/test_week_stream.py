"""The weekly panel of a stream equals the batch panel in any order of arrival."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weekloom.streaming.weeks import WeeklyPanel, weekly

EVENTS = "series_id string, ts timestamp, value double"


def test_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(9)
    start = datetime(2023, 12, 25)
    rows = [(rng.choice("ab"), start + timedelta(minutes=rng.randrange(60 * 24 * 120)), rng.choice([None, 1.5, 2.25, -3.0])) for _ in range(600)]
    rows += [("a", datetime(2024, 1, 1), 1.0), ("a", datetime(2023, 12, 31, 23, 59, 59), 2.0), ("a", None, 5.0)]  # a Monday's first moment, and the last one before
    want = sorted(tuple(r) for r in weekly(spark.createDataFrame(rows, EVENTS)).select("series_id", "week_idx", "n", F.col("total").cast("double")).collect())
    plain = {}
    for s, ts, v in rows:
        if ts is not None:
            k = s, ts.toordinal() - ts.weekday()
            n, t = plain.get(k, (0, 0.0))
            plain[k] = n + 1, t + (v or 0)
    assert want == sorted((s, d // 7, n, t) for (s, d), (n, t) in plain.items())
    late = []
    for name in ("sorted", "reversed", "mixed"):
        order = sorted(rows, key=lambda r: r[1] or start, reverse=name == "reversed")
        if name == "mixed":
            rng.shuffle(order)
        for k in range(4):
            spark.createDataFrame(order[k * 160 : (k + 1) * 160], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{k}")
        p = WeeklyPanel(spark, f"file://{tmp_path}/{name}/out")
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
        p.run(source).awaitTermination()
        assert sorted(map(tuple, p.panel().collect())) == want
        late.append(p.late().count())
        assert sum(r.n for r in p.panel(False).collect()) == len(rows) - 1 - late[-1]
        p.take(spark.createDataFrame(order[480:], EVENTS), 3)  # the last batch again
        assert sorted(map(tuple, p.panel().collect())) == want
    assert late[0] == 0 and late[1] > 100 and late[2] > 50
