"""Vectors of integers: components ``floor(scale * x)``, x as a double, and exact products of them.

Integers lie within ``LIMIT``, so that squared distances of vectors of 64 components fit a long; larger ones are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are, and are finite."""
    inf = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def integers(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` for each component, as longs; beyond ``LIMIT`` an error."""

    def whole(x: Column) -> Column:
        y = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x * F.lit(float(scale))) <= LIMIT, y).otherwise(F.raise_error(F.lit(f"a component times {scale} lies beyond {LIMIT}: exact sums don't fit a long")).cast("long"))

    return F.transform(vector.cast("array<double>"), whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of lists as rows of ``dim`` integers; shorter lists end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(column) * dim:
        return values.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as longs."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 52:  # every partial sum is a double without a rest
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)
