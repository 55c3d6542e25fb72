"""P1-P18 (keys, projections, predicates) and T1-T17 (event-time panel construction).

All unit-level quantities are whole-partition window aggregates over the
unit key, so a chain of them costs one hash exchange on the unit and later
windows reuse that partitioning.  A unit holds at most one row per period,
so no window partition grows with the data volume, only with the number of
periods.

NULL rules (SURVEY 1.4) are spelled out in every predicate: Spark
comparisons with NULL are NULL, which ``filter`` drops, so "missing counts
as +infinity" comparisons of the Stata code and R's ``any(na.rm=TRUE)``
are written with explicit ``coalesce``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import checkpoint_dir


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over_unit(u: str | Sequence[str]) -> Window:
    """Whole-partition frame over the unit key (one exchange, reused)."""
    keys = [u] if isinstance(u, str) else list(u)
    return Window.partitionBy(*keys)


# --- P1/P2 dense ids ----------------------------------------------------------------

def dense_id(df: DataFrame, keys: str | Sequence[str], out: str = "unit_id",
             num_partitions: int | None = None) -> DataFrame:
    """Consecutive 1..N id in key order (R ``as.integer(factor(x))``, Stata ``egen group``).

    Distinct keys are range-partitioned and sorted; each row's id is its
    partition's offset plus its position in the partition.  Only the
    per-partition counts (one row per partition) reach the driver, and the
    id table is joined back on the keys, so no step moves all keys to one
    task.  The key table is checkpointed so both passes see the same
    partition boundaries even when executors are lost.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.select(*keys).distinct()
    ranged = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()) \
                   .withColumn("_mono", F.monotonically_increasing_id()).checkpoint()
    counts = sorted((r["_pid"], r["n"], r["m"]) for r in ranged.groupBy("_pid")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("_mono").alias("m")).collect())
    offsets, acc = [], 0
    for pid, c, first in counts:  # a partition's rows are numbered from its first one
        offsets.append((pid, acc - first))
        acc += c
    off = spark.createDataFrame(offsets, "_pid int, _off long")
    # number of partitions is bounded by configuration, not by data: broadcast is safe
    ids = (ranged.join(F.broadcast(off), "_pid")
                 .select(*keys, (F.col("_off") + F.col("_mono") + 1).cast("long").alias(out)))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(ids[k])
        cond = c if cond is None else cond & c
    return df.join(ids, cond, "left").select(*[df[c] for c in df.columns], ids[out])


# --- P3-P10 conditional columns and filters -------------------------------------------

def when_else(cond: Column, value, otherwise=None) -> Column:
    """``ifelse(cond, value, NA)`` / Stata ``g x = e if c``: NULL cond -> otherwise."""
    return F.when(cond, value).otherwise(otherwise)


def case_when(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """First matching branch wins; a NULL predicate falls through (dplyr ``case_when``)."""
    expr = None
    for cond, val in branches:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d)


def override_chain(assignments: Sequence[tuple[Column, object]]) -> Column:
    """P5: a sequence of ``replace x = v if c`` where the LAST true assignment wins.

    Written as one CASE in reverse order, so it is a single projection."""
    return case_when(list(reversed(list(assignments))))


def keep_any_nonnull(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where at least one of ``cols`` is not missing."""
    return df.na.drop(how="all", subset=list(cols))


def drop_all_missing_units(df: DataFrame, u, y: str) -> DataFrame:
    """Drop units whose outcome is missing in every period (egen max ... by; drop if >= .)."""
    return (df.withColumn("_any_y", F.max(F.col(y).isNotNull().cast("int")).over(over_unit(u)))
              .filter(F.col("_any_y") == 1).drop("_any_y"))


def two_tail_filter(df: DataFrame, t: str, lo: int, hi: int, keep: str = "tails") -> DataFrame:
    """``t < lo | t > hi`` (keep='tails') or ``lo <= t <= hi`` (keep='middle')."""
    cond = (F.col(t) < lo) | (F.col(t) > hi)
    return df.filter(cond if keep == "tails" else ~cond)


def replace_where(df: DataFrame, prefix: str, cond: Column, value) -> DataFrame:
    """P10: the same recode over every column whose name starts with ``prefix``."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumns({c: F.when(cond, F.lit(value)).otherwise(F.col(c)) for c in cols})


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a missing weight, control or regressor before a fit."""
    return df.na.drop(how="any", subset=list(cols))


# --- P12-P16 indicators ---------------------------------------------------------------

def flag(cond: Column) -> Column:
    """Boolean -> 0/1 integer; NULL stays NULL."""
    return cond.cast("int")


def dummy_name(k: int, prefix: str = "tau") -> str:
    return f"{prefix}m{-k}" if k < 0 else f"{prefix}{k}"


def event_dummies(df: DataFrame, tau: str, lo: int, hi: int, prefix: str = "tau",
                  skip: Sequence[int] = ()) -> DataFrame:
    """One 0/1 column per event time in [lo, hi]; NULL tau gives 0 (Stata ``tau == k``)."""
    return df.withColumns({dummy_name(k, prefix): F.coalesce(F.col(tau) == k, F.lit(False)).cast("int")
                           for k in range(lo, hi + 1) if k not in skip})


def tail_dummies(df: DataFrame, tau: str, lo: int, hi: int, prefix: str = "tau") -> DataFrame:
    """Beyond-window indicators L (tau < lo) and R (lo/hi exclusive), missing-safe."""
    return df.withColumns({
        f"{prefix}L": F.coalesce(F.col(tau) < lo, F.lit(False)).cast("int"),
        f"{prefix}R": F.coalesce(F.col(tau) > hi, F.lit(False)).cast("int"),
    })


def bin_tau(tau, lo: int, hi: int, never=None) -> Column:
    """Clamp event time to [lo, hi]; never-adopters (and NULL tau) stay NULL."""
    t = _c(tau)
    clamped = F.when(t < lo, F.lit(lo)).when(t > hi, F.lit(hi)).otherwise(t)
    if never is not None:
        clamped = F.when(_c(never), F.lit(None)).otherwise(clamped)
    return clamped.cast("int")


# --- T1-T17 event-time panel -----------------------------------------------------------

def first_treated(df: DataFrame, u, t: str, flag_col: str, out: str = "first",
                  require: Column | None = None) -> DataFrame:
    """First period with flag = 1 per unit (NULL flag never counts)."""
    cond = F.col(flag_col) == 1
    if require is not None:
        cond = cond & require
    return df.withColumn(out, F.min(F.when(cond, F.col(t))).over(over_unit(u)))


def obs_span(df: DataFrame, u, t: str, lo: str = "first_obs", hi: str = "last_obs",
             require: Column | None = None) -> DataFrame:
    """First / last observed period per unit (optionally only rows meeting ``require``)."""
    tt = F.col(t) if require is None else F.when(require, F.col(t))
    w = over_unit(u)
    return df.withColumns({lo: F.min(tt).over(w), hi: F.max(tt).over(w)})


def event_time(first: str, span_min: str, t: str, require: Column | None = None) -> Column:
    """T - first, only when adoption is after the first observed period
    (always-treated -> NULL), optionally only on rows with an observed outcome."""
    cond = F.col(first) > F.col(span_min)
    if require is not None:
        cond = cond & require
    return F.when(cond, F.col(t) - F.col(first)).cast("int")


def never_adopt(first: str, last: str | None = None) -> Column:
    """No adoption, or (with ``last``) adoption after the last observation."""
    c = F.col(first).isNull()
    if last is not None:
        c = c | F.coalesce(F.col(last) < F.col(first), F.lit(False))
    return c


def any_nonnull(cols: Sequence[str]) -> Column:
    c = None
    for x in cols:
        c = F.col(x).isNotNull() if c is None else (c | F.col(x).isNotNull())
    return c


def reclassify_no_post(df: DataFrame, u, t: str, first: str, tau: str, never: str,
                       outcomes: Sequence[str]) -> DataFrame:
    """Adopters with no observed outcome at or after adoption become never-adopters
    and lose their event time (R/Stata both apply this rule)."""
    post_obs = F.max(F.when((F.col(t) >= F.col(first)) & any_nonnull(outcomes), 1)).over(over_unit(u))
    bad = F.col(first).isNotNull() & post_obs.isNull()
    return (df.withColumn("_nopost", bad)
              .withColumn(never, F.col(never) | F.col("_nopost"))
              .withColumn(tau, F.when(F.col("_nopost"), F.lit(None)).otherwise(F.col(tau)).cast("int"))
              .drop("_nopost"))


def check_no_post(df: DataFrame, u, t: str, first: str, outcomes: Sequence[str]) -> DataFrame:
    """Per adopter unit, whether it has any observed outcome from adoption on (report only)."""
    return (df.filter(F.col(first).isNotNull())
              .groupBy(u).agg(F.max(F.when((F.col(t) >= F.col(first)) & any_nonnull(outcomes), 1))
                              .alias("has_post")))


def eligible_flag(u, tau: str, never: str, pre: int = 3, post: int = 3,
                  min_n: int | None = 2, count_of: str | None = None) -> Column:
    """Adopters need an observation at tau <= -pre and one at tau >= post
    (and more than min_n - 1 rows); never-adopters need more than min_n - 1 rows.
    ``count_of`` counts non-missing values of that column instead of rows."""
    w = over_unit(u)
    n = F.count(F.col(count_of) if count_of else F.lit(1)).over(w)
    has_pre = F.coalesce(F.max((F.col(tau) <= -pre).cast("int")).over(w), F.lit(0)) == 1
    has_post = F.coalesce(F.max((F.col(tau) >= post).cast("int")).over(w), F.lit(0)) == 1
    enough = F.lit(True) if min_n is None else (n >= min_n)
    return F.when(F.col(never), enough).otherwise(has_pre & has_post & enough)


def eligible_sample(df: DataFrame, u, tau: str, never: str, y: str | None = None,
                    pre: int = 3, post: int = 3, min_n: int | None = 2) -> DataFrame:
    """The estimation sample for one outcome: drop missing y first (R order), then the unit rule."""
    if y is not None:
        df = df.filter(F.col(y).isNotNull())
    return (df.withColumn("_use", eligible_flag(u, tau, never, pre, post, min_n))
              .filter(F.col("_use")).drop("_use"))


def min_rows(df: DataFrame, keys: Sequence[str], n: int = 2) -> DataFrame:
    """Drop key groups with fewer than ``n`` rows (Stata ``_n`` then max = count)."""
    return (df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
              .filter(F.col("_n") >= n).drop("_n"))


def ever(u, flag_col: str) -> Column:
    """Unit ever has flag = 1 (egen max by unit); NULL if all flags missing."""
    return F.max(F.col(flag_col)).over(over_unit(u))


def cohort(never: str, first: str) -> Column:
    """Adoption cohort, NULL for never-adopters (no 0 / Inf sentinels)."""
    return F.when(~F.col(never), F.col(first)).cast("int")


def post(never: str, t: str, first: str) -> Column:
    """Static post indicator, 0 for never-adopters."""
    return F.coalesce((~F.col(never)) & (F.col(t) >= F.col(first)), F.lit(False)).cast("int")


def onestep_terms(df: DataFrame, tau: str, never: str, post_col: str, lo: int, hi: int,
                  prefix: str) -> DataFrame:
    """In-range flag, range-restricted policy, trend and trend-break columns."""
    in_range = (F.coalesce((F.col(tau) >= lo) & (F.col(tau) <= hi), F.lit(False))) | F.col(never)
    policy = ((F.col(post_col) == 1) & in_range).cast("int")
    tau_range = F.when(in_range & ~F.col(never), F.col(tau)).otherwise(F.lit(0))
    return df.withColumns({
        f"{prefix}_in_range": in_range,
        f"{prefix}_policy": policy,
        f"{prefix}_tau_range": tau_range.cast("int"),
        f"{prefix}_trend_break": F.when(policy == 1, F.col(tau)).otherwise(F.lit(0)).cast("int"),
    })


def trend_break_terms(df: DataFrame, tau: str, never: str, prefix: str = "",
                      offset: int = 0, never_tau: int | None = None) -> DataFrame:
    """Post, trend, post x trend.

    offset=0 is the R form (post x tau); offset=1 the Stata form (counts from 1 in
    year 0).  ``never_tau=0`` codes never-adopters' tau as 0 first (one-step form)."""
    t = F.col(tau)
    if never_tau is not None:
        t = F.when(F.col(never), F.lit(never_tau)).otherwise(t)
    post_ = F.coalesce((~F.col(never)) & (t >= 0), F.lit(False)).cast("int")
    trend = F.when((~F.col(never)) & t.isNotNull(), t).otherwise(F.lit(0)).cast("int")
    pt = (post_ * F.coalesce(t, F.lit(0)) + post_ * F.lit(offset)).cast("int")
    return df.withColumns({f"{prefix}post": post_, f"{prefix}trend": trend, f"{prefix}post_trend": pt})


def prepare_panel(df: DataFrame, u: str, t: str, flag_col: str, outcomes: Sequence[str],
                  prefix: str = "", first_from: str | None = None, never_if_late: bool = False,
                  reclassify: bool = True, require_obs: bool = False) -> DataFrame:
    """Stage-01 composite (T1, T2, T3/T4, T5/T6, T7, T13) with one exchange on the unit.

    first_from: column with a precomputed adoption year coalesced ahead of the
    derived one (P6).  require_obs: event time only on rows with any observed outcome.
    """
    p = prefix
    first = f"{p}first"
    df = first_treated(df, u, t, flag_col, out=first)
    if first_from is not None:
        df = df.withColumn(first, F.coalesce(F.col(first_from), F.col(first)))
    df = obs_span(df, u, t, lo=f"{p}first_obs", hi=f"{p}last_obs")
    req = any_nonnull(outcomes) if require_obs else None
    df = df.withColumn(f"{p}tau", event_time(first, f"{p}first_obs", t, req))
    df = df.withColumn(f"{p}never", never_adopt(first, f"{p}last_obs" if never_if_late else None))
    if never_if_late:
        df = df.withColumn(f"{p}tau", F.when(F.col(f"{p}never"), F.lit(None)).otherwise(F.col(f"{p}tau")).cast("int"))
    if reclassify:
        df = reclassify_no_post(df, u, t, first, f"{p}tau", f"{p}never", outcomes)
    return df.withColumns({f"{p}cohort": cohort(f"{p}never", first),
                           f"{p}post": post(f"{p}never", t, first)})
