"""Centroid clustering by ball k-means, in whole numbers, so that results are exact.

Vectors are packed into blocks of rows; a round reads the blocks with their last clusters and writes them with new ones,
and with counts and sums of each cluster, which Spark adds up. In a block, a cluster's members are a ball around its
centroid: of the other centroids only those nearer than twice its radius are neighbours. Members nearer than half the
way to the first neighbour are its stable core and stay; those in the annulus between half the way to one neighbour and
to the next are compared with the neighbours up to there only. Half the way itself belongs to the annulus, as there a
smaller number wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import vectors
from weekloom.llm.common import new_path, written

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Vectors in a block.
BLOCK = 4096
#: Squares' sum up to which distances fit in a long.
MOST = float(1 << 60)
BLOCK_SCHEMA = "ids array<long>, width int, vectors binary, clusters binary, counts array<long>, sums array<long>"
_FIELDS = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()), ("clusters", pa.binary()), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, exactly."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def assigned(x: np.ndarray, centroids: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the nearest centroid of each row, the smaller number of equal ones; last: where rows were before, if known."""
    cluster = np.zeros(len(x), np.int64) if last is None else last.astype(np.int64)
    out, best = cluster.copy(), np.zeros(len(x), np.int64)
    for i in np.unique(cluster).tolist():
        members = np.flatnonzero(cluster == i)
        own = distances(x[members], centroids[i])
        between = distances(centroids, centroids[i])
        neighbours = [j for j in np.argsort(between, kind="stable").tolist() if j != i and between[j] <= 4 * own.max()]
        annulus = np.searchsorted(between[neighbours], 4 * own, "right")  # so many neighbours may be nearer, or as near
        number = np.full(len(members), i)
        for t, j in enumerate(neighbours):
            at = np.flatnonzero(annulus > t)
            d = distances(x[members[at]], centroids[j])
            nearer = (d < own[at]) | ((d == own[at]) & (j < number[at]))
            own[at[nearer]], number[at[nearer]] = d[nearer], j
        out[members], best[members] = number, own
    return out, best


def _block_batches(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                width, rows = vectors.packed(vectors.matrix(some.column("v"), len(some.column("v")[0])))
                yield pa.RecordBatch.from_pylist([{"ids": some.column("vec_id").to_pylist(), "width": width, "vectors": b"".join(rows)}], _FIELDS)

    return run


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray | None]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            x = np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(-1, dims)
            yield row, x, None if row["clusters"] is None else np.frombuffer(row["clusters"], "<u2")


def _round_batches(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, last in _rows(batches, centroids.shape[1]):
            cluster, _ = assigned(x, centroids, last)
            sums = np.zeros(centroids.shape, np.int64)
            np.add.at(sums, cluster, x)
            yield pa.RecordBatch.from_pylist([row | {"clusters": cluster.astype("<u2").tobytes(), "counts": np.bincount(cluster, minlength=len(centroids)).tolist(), "sums": sums.ravel().tolist()}], _FIELDS)

    return run


def _last_batches(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, last in _rows(batches, centroids.shape[1]):
            cluster, best = assigned(x, centroids, last)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def _drop(spark, path: str) -> None:
    """A round's table goes once the next one's is complete, so that two at most lie on disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) for each vector, the final centroids).

    Vectors with dims components, none null or non-finite, are kept, as floor(scale * x); those whose squares then add
    up to more than MOST, far from any embedding, can't be told in a long and go. Centroids start as the kept vectors with the smallest
    SHA-256 of 'seed:vec_id', equal ones by their components; with fewer vectors there are fewer centroids. Rows without
    a vec_id are clustered but never start one; repeated rows count each time. An empty table gives no rows. Only vec_id
    and embedding are read, whatever other columns there are. At most 65,536 clusters.
    """
    spark = embeddings.sparkSession
    rows = vectors.kept(embeddings.where(F.size("embedding") == dims).select("vec_id", "embedding"), scale, MOST)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select("v", hashed.alias("h")).orderBy("h", "v").limit(clusters).collect()
    if not first:
        # nothing to start from: all rows without an id, or none
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = np.array([r["v"] for r in first], np.int64)
    path = new_path(spark, "blocks")
    rows.select("vec_id", "v").mapInArrow(_block_batches(block), BLOCK_SCHEMA).write.parquet(path)
    for _ in range(rounds):
        after = new_path(spark, "round")
        spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_round_batches(centroids), BLOCK_SCHEMA).write.parquet(after)
        _drop(spark, path)
        path = after
        told = spark.read.schema(BLOCK_SCHEMA).parquet(path)
        counts = dict(told.select(F.posexplode("counts").alias("c", "n")).groupBy("c").agg(F.sum("n")).collect())
        sums = dict(told.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect())
        new = [[int(sums[i * dims + j]) // counts[i] for j in range(dims)] if counts[i] else centroids[i].tolist() for i in range(len(centroids))]
        new = np.array(new, np.int64)
        if (new == centroids).all():  # all further rounds give the same
            break
        centroids = new
    last = written(spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_last_batches(centroids), "vec_id long, cluster int, distance long"), "clustered")
    _drop(spark, path)
    return last, centroids.tolist()


def report(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that clustered() keeps. An inertia that no long holds is null."""
    rows, centroids = clustered(embeddings, **options)
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string")
    # a row for each cluster
    each = written(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")), "inertia")
    all_of = each.agg(F.expr("try_cast(sum(s) as long)").alias("inertia"))
    told = each.join(F.broadcast(names), "cluster").join(F.broadcast(all_of)).select("cluster", F.expr("try_cast(s as long)").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
