"""Comparing the members of a group pair by pair without gathering it in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, keys: list[str], id_col: str, size: int) -> DataFrame:
    """Deal each group of ``keys`` into blocks of about ``size`` rows and copy a row to every pair of blocks with its own.

    Adds ``lo``, ``hi`` (the pair) and ``side`` (the row's block): rows of one
    (keys, lo, hi) meet in one task, at most about ``2 * size`` of them.  A group
    of ``size`` rows or fewer isn't copied."""
    blocks = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    rows = df.join(blocks, keys).withColumn("side", F.pmod(F.xxhash64(F.lit(7), id_col), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("*", F.least("side", "_o").alias("lo"), F.greatest("side", "_o").alias("hi")).drop("_n", "_o")


def pairs_here(side: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Square mask of the pairs that this task compares: above the diagonal of one block, or across two."""
    if lo == hi:
        return np.triu(np.ones((len(side), len(side)), bool), 1)
    return (side == lo)[:, None] & (side == hi)[None, :]


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of a square link mask (either triangle)."""
    links = links | links.T
    left, a, b = np.ones(len(links), bool), [], []
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            v = front.pop()
            new = np.flatnonzero(links[v] & left)
            left[new] = False
            a += [v] * len(new)
            b += new.tolist()
            front += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)
