import random

import numpy as np
from pyspark.sql import functions as F

from weekloom.operators import evaluate
from weekloom.streaming import ingest


def test_quantiles_and_upper_medians_are_exact(spark):
    rng = random.Random(5)
    groups = {"one": [0.25], "two": [-1.0, 3.0], "same": [0.1] * 500, "ties": [round(rng.gauss(0, 0.002), 4) for _ in range(700)], "wide": [rng.gauss(0, 50) for _ in range(701)], "none": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    got = {r.k: r for r in evaluate.quantiles(rows, ["k"], F.col("v"), evaluate.QUANTILES).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for k, r in got.items():
        assert np.allclose([r[n] for n in evaluate.QUANTILES], np.quantile(groups[k], list(evaluate.QUANTILES.values())), atol=1e-12)
    upper = evaluate.at_ranks(rows, ["k"], F.abs("v"), [F.expr("n div 2")]).select("k", "n", F.element_at("at", F.expr("n div 2")).alias("v")).collect()
    assert {r.k: (r.n, r.v) for r in upper} == {k: (len(v), sorted(map(abs, v))[len(v) // 2]) for k, v in groups.items() if k != "none"}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = [("a", 1, 5.0, None, "scaled"), ("a", 2, 6.0, None, "official")], [("a", 1, 7.0, None, "official"), ("a", 2, 9.0, None, "scaled")], [("a", 2, 8.0, None, "official"), ("b", 1, 1.0, None, "interpolated")]
    schema = ingest.STORE.rsplit(",", 1)[0]
    for again in (1, 2):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{again}-{k}")
            ingest.run_intake(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/store").awaitTermination()
        got = {(r.series_id, r.week_idx): (r.value, r.source) for r in ingest.read_store(spark, f"{tmp_path}/store").collect()}
        assert got == {("a", 1): (7.0, "official"), ("a", 2): (8.0, "official"), ("b", 1): (1.0, "interpolated")}
