"""Vectors as columns: which take part, and how batches of them become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def lengths(df: DataFrame, column: str = "embedding") -> list[int]:
    """The lengths that occur; vectors of different ones can't be compared. Each takes a pass of its own."""
    return sorted(r.n for r in df.select(F.size(column).alias("n")).distinct().collect())


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as rows, in double precision."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
