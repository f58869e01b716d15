"""The product store: what is written when, and what readers see."""

import glob

import pytest
from pyspark.sql import functions as F

from weekloom.sinks.store import ProductStore


def _files(path):
    return sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def history(spark):
    return spark.createDataFrame([(s, 2000 + k, float(k), [1.0 * k] if k % 2 else None) for s in "ab" for k in range(4)] + [("c", None, 1.0, None)], "series_id string, season int, y double, groups array<double>")


def test_only_changed_partitions_are_written(spark, history, tmp_path):
    store = ProductStore(spark, f"file://{tmp_path}/s")
    assert store.versions() == [] and store.publish({"history": history}, {"history": "season"}) == 1
    first = _files(tmp_path)
    # the same rows in another order: no file, no version
    assert store.publish({"history": history.orderBy(F.desc("y")).repartition(3)}, {"history": "season"}) is None and _files(tmp_path) == first
    later = history.where("season <> 2003 or season is null").withColumn("y", F.when((F.col("season") == 2001) & (F.col("series_id") == "a"), 9.0).otherwise(F.col("y")))
    assert store.publish({"history": later}, {"history": "season"}) == 2
    assert {r.part: (r.rows, r.version) for r in store.written().collect()} == {"2000": (2, 1), "2001": (2, 2), "2002": (2, 1), None: (1, 1)}
    assert set(first) < set(_files(tmp_path))
    assert _rows(store.read("history")) == _rows(later) and _rows(store.read("history", 1)) == _rows(history)
    assert _rows(store.read("history", parts=[2001, None])) == _rows(later.where("season = 2001 or season is null"))


def test_a_failed_write_leaves_the_old_version(spark, history, tmp_path, monkeypatch):
    store = ProductStore(spark, f"file://{tmp_path}/s")
    store.publish({"history": history}, {"history": "season"})
    bad = history.withColumn("y", F.when(F.col("season") == 2002, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("y") + 1))
    with pytest.raises(Exception, match="lost"):
        store.publish({"history": bad}, {"history": "season"})
    assert store.versions() == [1] and _rows(store.read("history")) == _rows(history)
    # and one that fails between the rows and the manifest
    monkeypatch.setattr(ProductStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        store.publish({"history": history.withColumn("y", F.col("y") + 1)}, {"history": "season"})
    assert store.versions() == [1] and _rows(store.read("history")) == _rows(history)


def test_tables_are_published_at_once_and_old_folders_dropped(spark, history, tmp_path):
    store = ProductStore(spark, f"file://{tmp_path}/s")
    current = history.groupBy("series_id").agg(F.max("season").alias("season"))
    store.publish({"history": history, "current": current}, {"history": "season", "current": "series_id"})
    assert store.publish({"current": current.withColumn("season", F.col("season") + 1)}, {"current": "series_id"}) == 2
    assert _rows(store.read("history")) == _rows(history) and store.read("current").agg(F.max("season")).first()[0] == 2004
    assert store.publish({"history": history.limit(0)}, {"history": "season"}) == 3 and store.read("history").count() == 0 and store.read("history").columns == history.columns
    # the newest has no history, and current has new partitions but for the one without a season
    assert store.vacuum() > 5 and store.versions() == [3]
    assert _rows(store.read("current")) == _rows(current.withColumn("season", F.col("season") + 1))
    with pytest.raises(FileExistsError):
        store._publish({}, 3)
