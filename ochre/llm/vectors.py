"""Columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the greater of equally frequent ones; 0 where there is none."""
    sizes = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).limit(1).collect()
    return top[0]["size"] if top else 0


def usable(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of ``d`` finite entries, and their values as a matrix of doubles; null, shorter, longer ones and those with a null or non-finite entry are left out."""
    lengths = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    place = np.flatnonzero(lengths == d)
    starts = column.offsets.to_numpy()[:-1][place].astype(np.int64)
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)  # null entries become NaN
    rows = values[starts[:, None] + np.arange(d)]
    finite = np.isfinite(rows).all(axis=1)
    return place[finite], rows[finite]


def floored(rows: np.ndarray, scale: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have all of floor(scale * entry) below ``most`` in size, and these numbers, whole, as doubles."""
    with np.errstate(over="ignore"):
        whole = np.floor(rows * scale)
    fits = (np.abs(whole) < most).all(axis=1)
    return fits, whole[fits]
