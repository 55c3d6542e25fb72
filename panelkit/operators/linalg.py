"""Driver-side algebra on coefficient-sized matrices (k x k, T x T) and
distributed Gram helpers that keep the data work on the executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, cols: Sequence[str], weight: Column | None = None) -> np.ndarray:
    """sum_i w_i x_i x_i' over a DataFrame; result is len(cols) square.

    One path for any width: every task multiplies its Arrow batches, the upper
    triangles are added up by cell, and only those sums reach the driver."""
    k = len(cols)
    w = weight if weight is not None else F.lit(1.0)
    a, b = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) if k else np.zeros((len(batch), 0))
            total += (x * batch.column(0).to_numpy(zero_copy_only=False)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "v"])

    rows = df.select(w.cast("double").alias("_gw"), *[F.col(c).cast("double") for c in cols])
    sums = rows.mapInArrow(partial, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    G = np.zeros((k, k))
    for r in sums:
        G[r["a"], r["b"]] = G[r["b"], r["a"]] = r["v"]
    return G


def rowmatrix_gram(df: DataFrame, array_col: str, ncols: int | None = None) -> np.ndarray:
    """Gram of an array<double> column via MLlib RowMatrix (tree aggregation of
    per-partition dense accumulators; rows are never paired or shuffled)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    vec = df.select(array_to_vector(F.col(array_col)).alias("v"))
    vec = MLUtils.convertVectorColumnsFromML(vec, "v")
    # passing the width avoids an extra job that would compute it from the first row
    return RowMatrix(vec, 0, ncols or 0).computeGramianMatrix().toArray()


def ordered_pivots(G: np.ndarray, scale: np.ndarray | None = None, tol: float = 1e-9) -> list[int]:
    """The columns of a symmetric PSD matrix that don't follow from admitted ones before.

    Cholesky's factor is built column by column, in the given order: a column costs one
    product with the rows already found, so that all of them take k^3 steps."""
    k = G.shape[0]
    scale = np.diag(G) if scale is None else scale
    L, keep = np.zeros((k, k)), []
    for j in range(k):
        m = len(keep)
        left = G[j, j] - L[j, :m] @ L[j, :m]
        if left > tol * scale[j] and left > 0:
            L[j:, m] = (G[j:, j] - L[j:, :m] @ L[j, :m]) / np.sqrt(left)
            keep.append(j)
    return keep


def add_up(df: DataFrame, part, size: int) -> np.ndarray:
    """``size`` numbers added up over all tasks; ``part`` makes a task's from its Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    got = df.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def pivoted_solve(G: np.ndarray, rhs: np.ndarray, scale: np.ndarray | None = None, tol: float = 1e-9):
    """Solve G b = rhs for symmetric PSD G, dropping collinear columns.

    Columns are admitted in order; one whose residual diagonal after eliminating
    the admitted ones is below ``tol`` times its ``scale`` is reported as omitted.
    ``scale`` is the column's variance before any effects were absorbed (default:
    the diagonal), so that a column the effects absorb isn't taken for one of tiny
    variance.  Returns (b with NaN for omitted, keep mask, G_kept^-1)."""
    k = G.shape[0]
    keep = ordered_pivots(G, scale, tol)
    mask = np.zeros(k, dtype=bool)
    mask[keep] = True
    b = np.full(rhs.shape, np.nan, dtype=float)
    inv = np.linalg.inv(G[np.ix_(keep, keep)]) if keep else np.zeros((0, 0))
    if keep:
        b[keep] = inv @ rhs[keep]
    return b, mask, inv
