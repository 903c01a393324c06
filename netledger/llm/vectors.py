"""Vectors as whole numbers, for the operators that compute on them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A component x counts as floor(SCALE * x).
SCALE = 256.0
#: Whole numbers below these bounds are exact as doubles, and as longs.
DOUBLE, LONG = 2.0**53, 2.0**63


def sound(vector: Column) -> Column:
    """Whether a vector is not null and holds only finite components, also when scaled."""
    scaled = F.transform(vector, lambda v: v.cast("double") * SCALE)
    return F.coalesce(~F.exists(scaled, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def extent(vectors: DataFrame, name: str) -> tuple[int, float, int]:
    """Length of the longest vector, a bound of the magnitude of all scaled components, and number of rows."""
    most = F.array_max(F.transform(name, lambda v: F.abs(v.cast("double") * SCALE)))
    row = vectors.agg(F.max(F.size(name)).alias("width"), F.max(most).alias("most"), F.count(F.lit(1)).alias("n")).first()
    return row["width"] or 0, (row["most"] or 0.0) + 1, row["n"]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of sound vectors, one per row, filled up with zeros to ``width``; whole numbers as doubles."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def whole(x: np.ndarray, longs: bool) -> np.ndarray:
    """Whole numbers held as doubles, as longs or, where longs are too short, as Python's integers."""
    return x.astype(np.int64) if longs else np.frompyfunc(int, 1, 1)(x)


def as_long(x: np.ndarray) -> np.ndarray:
    """Longs; what is beyond their range becomes its end."""
    return x if x.dtype == np.int64 else np.array([max(-(2**63), min(2**63 - 1, v)) for v in x.ravel()], np.int64).reshape(x.shape)
