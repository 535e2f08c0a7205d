"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components stay below this, so that squares and products of two vectors of up to
#: 128 components add up within 64 bits.
LARGEST = 1 << 27


def finite(vector: str | Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    inner = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(inner, F.lit(False))


def whole(vector: str | Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, x as double. A component of ``LARGEST`` or
    more ends the job with a message: sums of products would leave 64 bits."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def component(x: Column) -> Column:
        value = F.floor(F.lit(scale) * x.cast("double"))
        refused = F.raise_error(F.lit(f"a vector component times {scale} is {LARGEST} or more"))
        return F.when(F.abs(value) < LARGEST, value).otherwise(refused.cast("long")).cast("int")

    return F.transform(vector, component)


def matrix(column: pa.Array, width: int, dtype: type = np.int64) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = rows.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))
