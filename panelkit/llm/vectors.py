"""Which vectors count, and how Arrow hands them over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(name: str = "embedding") -> Column:
    """Not null, no null, NaN or infinite component, and not all zero."""
    v = F.col(name)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_rows(df: DataFrame, bound: int, seed: int, id_col: str) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, picked by a hash of ``id_col``."""
    parts = 1 << 30
    share = int(parts * min(1.0, bound / max(df.count(), 1)))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(parts)) < share)
