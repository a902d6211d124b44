"""Vectors of whole numbers, for operators that compare them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this bound, either way, are set to it; sums of products then stay exact.
LARGEST = 1 << 24


def finite(vector: Column) -> Column:
    """Whether the vector is there, and every component is there and finite."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as array<int>."""

    def one(x: Column) -> Column:
        scaled = F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-2.0**30)), F.lit(2.0**30)))
        return F.least(F.greatest(scaled, F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")

    return F.transform(vector, one)


def whole_vectors(df: DataFrame, scale: int) -> DataFrame:
    """Rows of ``df`` with finite vectors: vec_id, label, and ``v``, the vector in whole numbers."""
    return df.filter(finite(F.col("embedding"))).select(
        "vec_id", "label", whole(F.col("embedding"), scale).alias("v")
    )


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; shorter vectors are filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            return np.zeros((0, width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out
