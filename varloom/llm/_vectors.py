"""Columns of vectors: which rows can take part, and their exchange with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(v: Column) -> Column:
    """Whether a vector (array<double>) is there and holds neither null nor non-finite components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def length_of(rows: DataFrame, column: str) -> int:
    """The commonest length of the vectors (the smaller of equally common ones); 0 for no rows.  Rows of other lengths take no part."""
    got = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return got["d"] if got else 0


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list a row of a two-dimensional array."""
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def no_list(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, pa.list_(kind))
