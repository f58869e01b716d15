"""Vectors of doubles as whole numbers, in narrow binary form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(x: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles."""
    return F.transform(x.cast("array<double>"), lambda c: F.floor(c * scale).cast("double"))


def finite(x: Column, most: float) -> Column:
    """Whether x is not null, no component is null or not finite, and the squares' sum, of doubles, is no more than most."""
    square = F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda a, c: a + c * c)
    return F.coalesce((square <= most) & ~F.isnan(square), F.lit(False))


def kept(table: DataFrame, scale: int, most: float) -> DataFrame:
    """(vec_id, label, v): v holds whole numbers; vectors with null or non-finite components, or with a sum of squares over most once they are whole, go."""
    v = table.where(finite(F.col("embedding"), 1e300)).select(F.col("vec_id").cast("long").alias("vec_id"), *[F.col("label").cast("long").alias("label")] * ("label" in table.columns), whole(F.col("embedding"), scale).alias("v"))
    return v.where(finite(F.col("v"), most)).withColumn("v", F.col("v").cast("array<long>"))


def packed(x: np.ndarray) -> tuple[int, list[bytes]]:
    """(bytes for a component, rows) in the narrowest width that holds x."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    data = x.astype(f"<i{width}").tobytes()
    step = width * x.shape[1]
    return width, [data[i * step : (i + 1) * step] for i in range(len(x))]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists as rows of dims whole numbers; what a shorter vector lacks is 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return flat.astype(np.int64).reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out
