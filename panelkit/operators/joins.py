"""Joins used by panel construction and the estimators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.panel import over_unit
from panelkit.session import checkpoint_dir


def attach_unit_attrs(df: DataFrame, attrs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join of one-row-per-unit attributes.  Catalyst picks broadcast
    vs sort-merge from statistics; the unit table grows with the data, so no hint."""
    return df.join(attrs, list(keys), "left")


def join_outer(a: DataFrame, b: DataFrame, keys: Sequence[str], merge_col: str = "merge_code") -> DataFrame:
    """Full outer join keeping both sides' unmatched rows; shared non-key columns
    take the master (left) value when present (Stata ``merge`` default);
    merge_code 1 = master only, 2 = using only, 3 = both."""
    keys = list(keys)
    j = a.withColumn("_in_a", F.lit(True)).alias("a").join(b.withColumn("_in_b", F.lit(True)).alias("b"), keys, "full_outer")
    code = F.when(F.col("_in_b").isNull(), 1).when(F.col("_in_a").isNull(), 2).otherwise(3).cast("int")
    return j.select(*_merged(a, b, keys), code.alias(merge_col))


def _merged(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    """Keys, the master's columns and the using side's others, of sides aliased ``a`` and ``b``."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    cols = [F.col(k) for k in keys]
    for c in a.columns:
        if c not in keys:
            cols.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in shared else F.col(f"a.{c}"))
    return cols + [F.col(f"b.{c}") for c in b.columns if c not in keys and c not in shared]


def heavy_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], least: int = 100_000) -> DataFrame:
    """Keys (none null) that hold more than a quarter of a partition's share of either
    side, and more than ``least`` rows: keys, rows of each side (0: none), and ``_sa``,
    ``_sb``, the blocks that each side is dealt into.

    At most eight times as many keys as there are shuffle partitions can be heavy."""
    keys = list(keys)
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = [side.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for side, n in ((a, "_na"), (b, "_nb"))]
    counts = known[0].join(known[1], keys, "full_outer").select(
        *keys, F.coalesce("_na", F.lit(0)).alias("_na"), F.coalesce("_nb", F.lit(0)).alias("_nb"))
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = counts.agg(F.sum("_na"), F.sum("_nb")).first()
        bound = [max(least, (n or 0) // (4 * parts)) for n in totals]
        heavy = counts.where((F.col("_na") > bound[0]) | (F.col("_nb") > bound[1]))
        blocks = [F.greatest(F.lit(1), F.ceil(F.col(n) / x)).cast("int").alias(s) for n, x, s in (("_na", bound[0], "_sa"), ("_nb", bound[1], "_sb"))]
        checkpoint_dir(a.sparkSession)
        return heavy.select(*keys, "_na", "_nb", *blocks).checkpoint(eager=True)
    finally:
        counts.unpersist()


def join_outer_skewed(a: DataFrame, b: DataFrame, keys: Sequence[str], merge_col: str = "merge_code",
                      least: int = 100_000) -> DataFrame:
    """J2 where a key may hold a large share of either side's rows: the rows of ``join_outer``.

    Adaptive execution doesn't split a full outer join.  Here rows with a null key match
    nothing and pass by without a shuffle, as do rows of a heavy key that the other side
    lacks.  A heavy key of both sides is an inner join: each side is dealt into blocks by a
    hash of the row (the same if a task runs again; rows that repeat whole share a block)
    and every pair of blocks meets on its own.  The other
    keys take the plain join.  Costs a count of the keys of both sides beforehand."""
    keys = list(keys)
    heavy = heavy_keys(a, b, keys, least)  # a bounded number of rows, so broadcast
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    ranks = F.broadcast(heavy)
    light = [side.where(known).join(F.broadcast(heavy.select(*keys)), keys, "left_anti") for side in (a, b)]
    hot_a = a.withColumn("_h", F.xxhash64(*a.columns)).join(ranks, keys)
    hot_b = b.withColumn("_h", F.xxhash64(*b.columns)).join(ranks, keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("_h", F.lit(n)), F.col(n)).cast("int")
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    dealt_a = hot_a.where(both).withColumn("_i", mine("_sa")).withColumn("_j", every("_sb")).select(*a.columns, "_i", "_j")
    dealt_b = hot_b.where(both).withColumn("_j", mine("_sb")).withColumn("_i", every("_sa")).select(*b.columns, "_i", "_j")
    met = dealt_a.alias("a").join(dealt_b.alias("b").hint("shuffle_merge"), [*keys, "_i", "_j"]).select(
        *_merged(a, b, keys), F.lit(3).cast("int").alias(merge_col))
    alone_a = a.where(~known).unionByName(hot_a.where("_nb = 0").select(*a.columns))
    alone_b = b.where(~known).unionByName(hot_b.where("_na = 0").select(*b.columns))
    out = join_outer(*light, keys, merge_col).unionByName(met)
    types = dict(out.dtypes)
    for side, code in ((alone_a, 1), (alone_b, 2)):
        cols = [F.col(c).cast(types[c]) if c in side.columns else F.lit(None).cast(types[c]).alias(c) for c in out.columns if c != merge_col]
        out = out.unionByName(side.select(*cols, F.lit(code).cast("int").alias(merge_col)))
    return out


def keep_units(df: DataFrame, u: str, pred: Column) -> DataFrame:
    """Rows of units satisfying a unit-level existential predicate (window form:
    the same exchange as every other unit-level step, no second scan)."""
    return (df.withColumn("_keep", F.max(pred.cast("int")).over(over_unit(u)))
              .filter(F.col("_keep") == 1).drop("_keep"))


def bounded_values(df: DataFrame, column: str, bound: int) -> list:
    """The distinct values of a column that the caller needs on the driver; more than ``bound`` are refused, and no more than that are collected."""
    values = [r[0] for r in df.select(column).distinct().limit(bound + 1).collect()]
    if len(values) > bound:
        raise ValueError(f"more than {bound} distinct values of {column}")
    return values


def cohort_pairs(df: DataFrame, g: str) -> DataFrame:
    """Every ordered (treated cohort, control cohort) pair plus each cohort vs
    the never-treated, labelled like the decomposition's comparison types.

    Cohorts, of any number, meet by bucket: each treated one goes to all buckets, each
    control (a null among them) to the one of its hash."""
    buckets = 32
    cohorts = df.select(F.col(g).cast("int").alias("c")).distinct()
    treated = cohorts.where("c is not null").select(F.col("c").alias("treated"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"))
    control = cohorts.select(F.col("c").alias("control"), F.pmod(F.xxhash64("c"), F.lit(buckets)).cast("int").alias("b"))
    pairs = treated.join(control, "b").where("control is null or control <> treated")
    kind = (F.when(F.col("control").isNull(), "Treated vs Untreated").when(F.col("treated") < F.col("control"), "Earlier vs Later Treated")
            .otherwise("Later vs Earlier Treated"))
    return pairs.select(F.col("treated").cast("int"), "control", kind.alias("type"))


def long_diff(df: DataFrame, u: str, t: str, y: str, base: Column, out: str = "dy") -> DataFrame:
    """y_t - y_base for every row of units observed at their base period
    (conditional max over the unit window instead of a self-join)."""
    yb = F.max(F.when(F.col(t) == base, F.col(y))).over(over_unit(u))
    return df.withColumn("_yb", yb).filter(F.col("_yb").isNotNull()) \
             .withColumn(out, F.col(y) - F.col("_yb")).drop("_yb")
