"""Period effects of any number, solved step by step in Spark.

Least squares with unit and period effects needs, for every column, the period effects g of
``M g = b``: b[t] is the period's sum of the unit-demeaned column, and ``M g`` at t is
``d_t g_t - sum_i w_it (sum_s w_is g_s) / W_i``.  M is never laid out.  Conjugate gradients,
scaled by d, apply it as two grouped sums over the cells (by unit, then by period), for all
columns at once.  The state (t, d and x, r, p of each column) is a table with a row a period,
written every step to the shared folder, so that a lost executor costs one step; the step
before it is deleted.  Only a few numbers a column reach the driver.

M doesn't tell the levels of unconnected parts of the panel; the right sides lie in its range, so
that the steps converge to one of its solutions, all of which give the same residuals."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import checkpoint_dir
from panelkit.sources.io import remove_folder


class Steps:
    """A table rewritten step by step below the checkpoint folder; the step before goes once the next is whole."""

    def __init__(self, spark):
        self.spark, self.n = spark, 0
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{self.n}")
        if self.n:
            remove_folder(self.spark, f"{self.root}/{self.n - 1}")
        self.n += 1
        return self.spark.read.parquet(f"{self.root}/{self.n - 1}")

    def drop(self) -> None:
        remove_folder(self.spark, self.root)


def _numbers(df: DataFrame, exprs) -> np.ndarray:
    row = df.agg(*[F.sum(e).alias(f"_{i}") for i, e in enumerate(exprs)]).first()
    return np.array([0.0 if v is None else v for v in row], dtype=float)


def solve_periods(cells: DataFrame, sums: DataFrame, least: np.ndarray, tol: float = 1e-12, max_steps: int = 2000) -> tuple[DataFrame, Steps, int]:
    """Period effects of every column, as a table (_t, _g0.._gk), the folder it lies in and the steps taken.

    ``cells``: (_u, _t, _wc, _wsum), one row each; ``sums``: (_t, d, b0..bk).  A column is done when the squared
    residual, scaled by d, is at most ``tol`` squared of what it was or ``least``, the rounding of its sums.
    Without convergence in ``max_steps`` (very long chains of units that share few periods) it is an error."""
    k = len(least)
    steps = Steps(cells.sparkSession)
    state = steps.write(sums.select("_t", "d", *[c for j in range(k) for c in (
        F.lit(0.0).alias(f"x{j}"), F.col(f"b{j}").alias(f"r{j}"), (F.col(f"b{j}") / F.col("d")).alias(f"p{j}"))]))
    size = [F.col(f"r{j}") * F.col(f"r{j}") / F.col("d") for j in range(k)]
    now = _numbers(state, size)
    stop = np.maximum(tol * tol * now, least)
    taken = 0
    while (todo := np.flatnonzero(now > stop)).size:
        if taken == max_steps:
            steps.drop()
            raise ValueError(f"period effects not found in {max_steps} steps; units share too few periods")
        taken += 1
        means = (cells.join(state.select("_t", *[f"p{j}" for j in todo]), "_t").groupBy("_u")
                 .agg(*[(F.sum(F.col("_wc") * F.col(f"p{j}")) / F.first("_wsum")).alias(f"m{j}") for j in todo]))
        back = cells.join(means, "_u").groupBy("_t").agg(*[F.sum(F.col("_wc") * F.col(f"m{j}")).alias(f"m{j}") for j in todo])
        state = steps.write(state.join(back, "_t").select(*state.columns, *[(F.col("d") * F.col(f"p{j}") - F.col(f"m{j}")).alias(f"q{j}") for j in todo]))
        of = lambda c, j: F.col(f"{c}{j}")
        got = _numbers(state, [e for j in todo for e in (of("p", j) * of("q", j), of("r", j) * of("r", j) / F.col("d"), of("r", j) * of("q", j) / F.col("d"), of("q", j) * of("q", j) / F.col("d"))]).reshape(-1, 4)
        now, moved = now.copy(), {}
        for j, (pq, rr, rq, qq) in zip(todo, got):
            alpha = rr / pq if pq > 0 else 0.0  # 0: nothing but rounding is left of p
            now[j] = max(0.0, rr - 2 * alpha * rq + alpha * alpha * qq) if pq > 0 else 0.0
            turn, rest = F.lit(float(now[j] / rr) if rr > 0 else 0.0), of("r", j) - F.lit(float(alpha)) * of("q", j)
            moved[j] = [(F.col(f"x{j}") + F.lit(float(alpha)) * of("p", j)).alias(f"x{j}"), rest.alias(f"r{j}"), (rest / F.col("d") + turn * of("p", j)).alias(f"p{j}")]
        state = state.select("_t", "d", *[c for j in range(k) for c in moved.get(j, [f"x{j}", f"r{j}", f"p{j}"])])
    return steps.write(state.select("_t", *[F.col(f"x{j}").alias(f"_g{j}") for j in range(k)])), steps, taken


def unconnected_parts(cells: DataFrame) -> int:
    """Parts of the panel that no unit connects (1: all periods hang together).

    Every part of periods takes the least label that a unit leads it to; labels are random, so that
    their number falls by a share each round even where units form long chains."""
    steps = Steps(cells.sparkSession)
    label = steps.write(cells.select("_t").distinct().select("_t", F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("of")).alias("l")))
    while True:
        near = cells.join(label, "_t").groupBy("_u").agg(F.min("l").alias("m"))
        least = cells.join(near, "_u").groupBy("_t").agg(F.min("m").alias("m"))
        found = steps.write(label.join(least, "_t"))
        if found.where("m < l").isEmpty():
            n = found.select("l").distinct().count()
            steps.drop()
            return n
        to = found.groupBy("l").agg(F.min("m").alias("to"))
        label = steps.write(found.select("_t", "l").join(to, "l").select("_t", F.col("to").alias("l")))


def absorbed_periods(unit_df: DataFrame, nv: int, chunk: int) -> tuple[DataFrame, dict]:
    """The table of period effects, and n, T, sum of weights, weighted variances and missing rank, as the direct solver gives them."""
    w = F.col("_w")
    total = unit_df.agg(F.count(F.lit(1)), F.sum("_w")).first()
    n, sw = int(total[0]), float(total[1] or 0.0)
    moments = np.zeros((nv, 3))
    for lo in range(0, nv, chunk):
        at = range(lo, min(nv, lo + chunk))
        got = _numbers(unit_df, [e for j in at for e in (w * F.col(f"_v{j}"), w * F.col(f"_v{j}") * F.col(f"_v{j}"), w * F.col(f"_d{j}") * F.col(f"_d{j}"))])
        moments[lo:lo + len(at)] = got.reshape(-1, 3)
    wv, wvv, wdd = moments.T
    raw = wvv - wv ** 2 / sw if sw > 0 else np.zeros(nv)
    raw = np.where(raw > 1e-14 * wvv, raw, np.inf)
    cells = (unit_df.groupBy("_u", "_t").agg(F.sum("_w").alias("_wc"), F.first("_wsum").alias("_wsum"))
             .persist(StorageLevel.MEMORY_AND_DISK))
    sums = unit_df.groupBy("_t").agg(F.sum("_w").alias("d"), *[F.sum(w * F.col(f"_d{j}")).alias(f"b{j}") for j in range(nv)])
    try:
        effects, steps, taken = solve_periods(cells, sums, np.maximum(1e-24 * wdd, 1e-28 * wvv))
        deficit = max(0, unconnected_parts(cells) - 1)
    finally:
        cells.unpersist()
    return effects, {"T": effects.count(), "n": n, "sum_w": sw, "raw": raw, "fe_rank_deficit": deficit, "steps": taken, "_folder": steps}
