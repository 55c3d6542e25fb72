"""Connected components of a link table, by alternating star contractions.

Every step is a grouped minimum and a join; nothing but two sums reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut


ROWS = 200_000  # links of a partition that is written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the smallest vertex it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go in the next step


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands itself and its smaller neighbours to the smallest of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (u, v: long) that isn't itself the smallest."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # a round's files follow the links there are, not the session's partitions: few links, few files
    parts = -(-edges.count() // ROWS) or 1
    before = None
    while True:
        edges = cut(_small_star(_large_star(edges)).coalesce(parts))
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        now = edges.agg(F.count("*"), F.sum(mark)).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
