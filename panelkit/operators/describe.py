"""Descriptive tables over a panel.

Exact quantiles work on value counts: equal values of a group meet in a partial
aggregate, so a frequent value is one row, and running counts over the distinct
values come from a range-partitioned sort with per-partition offsets.  Only the
few values at the wanted order statistics are kept; no group is collected into
one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.panel import over_unit
from panelkit.session import checkpoint_dir

BROADCAST_ROWS_MAX = 200_000  # broadcast a side only when its counted size is below this


def _bounded_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                  small_rows: int | None = None) -> DataFrame:
    """Join with a broadcast only behind a size check; otherwise a shuffle join."""
    n = small.count() if small_rows is None else small_rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS_MAX else small, list(on), how)


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: position, n_rows, n_nonnull (one aggregate over the data)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', {i + 1}, _c{i}" for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, position, n_nonnull)", "_n AS n_rows") \
              .select("column_name", F.col("position").cast("int").alias("position"), "n_rows", "n_nonnull")


# --- exact quantiles -------------------------------------------------------------------

def value_ranks(df: DataFrame, groups: Sequence[str], x: str) -> DataFrame:
    """Distinct values of x by group with the 1-based positions ``_from`` .. ``_to`` that
    they take in the group's sorted rows, and the group size n."""
    groups = list(groups)
    spark = df.sparkSession
    checkpoint_dir(spark)
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(x).isNotNull()).groupBy(*groups, x).agg(F.count(F.lit(1)).alias("_c"))
    # partition ids must not change between the sums and the rows: written once
    ranked = counts.repartitionByRange(nparts, *groups, x).withColumn("_pid", F.spark_partition_id()).checkpoint()
    parts = ranked.groupBy("_pid", *groups).agg(F.sum("_c").alias("_ps"))  # a row for each partition a group reaches
    wg = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    parts = parts.withColumn("_off", F.sum("_ps").over(wg.orderBy("_pid")) - F.col("_ps")).withColumn("n", F.sum("_ps").over(wg)).drop("_ps")
    joined = _bounded_join(ranked, parts, ["_pid", *groups])
    to = F.col("_off") + F.sum("_c").over(Window.partitionBy("_pid", *groups).orderBy(x))
    return joined.withColumn("_to", to).select(*groups, x, (F.col("_to") - F.col("_c") + 1).alias("_from"), "_to", "n")


def quantile_positions(n: Column, p: float, method: str) -> tuple[Column, Column, Column]:
    """(lo, hi, frac): value = x[lo] + frac * (x[hi] - x[lo]).

    method 'type7' (R default, = Spark percentile, DuckDB quantile_cont);
    'stata' (order statistic, average of two when n*p is whole)."""
    if method == "type7":
        h = (n - 1) * F.lit(p) + 1
        lo = F.floor(h)
        return lo, F.ceil(h), h - lo
    np_ = n * F.lit(p)
    whole = np_ == F.floor(np_)
    lo = F.when(whole, np_).otherwise(F.ceil(np_))
    hi = F.when(whole, F.least(np_ + 1, n)).otherwise(F.ceil(np_))
    return lo.cast("long"), hi.cast("long"), F.when(whole, F.lit(0.5)).otherwise(F.lit(0.0))


def exact_quantiles(df: DataFrame, groups: Sequence[str], x: str, probs: Mapping[str, float],
                    method: str = "type7") -> DataFrame:
    """One row per group with one column per named probability."""
    groups = list(groups)
    ranks = value_ranks(df, groups, x)
    at = lambda p: (F.col("_from") <= p) & (F.col("_to") >= p)
    cols = {name: quantile_positions(F.col("n"), p, method) for name, p in probs.items()}
    wanted = F.lit(False)
    for lo, hi, _ in cols.values():
        wanted = wanted | at(lo) | at(hi)
    picked, aggs = ranks.filter(wanted), []
    for name, (lo, hi, fr) in cols.items():
        xlo, xhi = F.max(F.when(at(lo), F.col(x))), F.max(F.when(at(hi), F.col(x)))
        aggs.append((xlo + F.max(fr) * (xhi - xlo)).alias(name))
    if groups:
        return picked.groupBy(*groups).agg(*aggs)
    return picked.agg(*aggs)


# --- A1-A5 summary statistics ----------------------------------------------------------

def summary_stats(long: DataFrame, groups: Sequence[str], x: str = "value",
                  p_lo: float = 0.10, p_hi: float = 0.90, method: str = "type7") -> DataFrame:
    """A1/A2: mean, sd, N, P10, P90 ignoring missing values, per group of a long table."""
    groups = list(groups)
    base = long.filter(F.col(x).isNotNull())
    stats = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(F.lit(1)).alias("n")]
    probs = {"p10": p_lo, "p90": p_hi}
    if groups:
        moments = base.groupBy(*groups).agg(*stats)
        return moments.join(exact_quantiles(base, groups, x, probs, method), groups, "left")
    # global: two one-row results, combined as scalars on the driver (no join needed)
    m = base.agg(*stats).first()
    q = exact_quantiles(base, [], x, probs, method).first()
    return long.sparkSession.createDataFrame(
        [(m["mean"], m["sd"], m["n"], q["p10"] if q else None, q["p90"] if q else None)],
        "mean double, sd double, n long, p10 double, p90 double")


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    """Wide to long (pivot_longer)."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), name, value)


def summary_table(df: DataFrame, cols: Sequence[str], periods: Mapping[str, Column],
                  digits: int = 1) -> DataFrame:
    """A2: stats for variables x periods, rounded like the published table.

    Every row is read once and stands in each period whose condition it meets."""
    labels = F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in periods.items()]), lambda c: c.isNotNull())
    long = to_long(df.withColumn("period", F.explode(labels)), ["period"], cols)
    s = summary_stats(long, ["variable", "period"])
    return s.select("variable", "period", *[F.round(c, digits).alias(c) for c in ("mean", "sd")], "n",
                    *[F.round(c, digits).alias(c) for c in ("p10", "p90")])


def collapse(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """A3/A4: Stata ``collapse (mean) (sd) (count) (p10) (p90)``, one row (per ``by``),
    Stata percentile definition; mean and sd rounded to 0.01 as in the do-file."""
    by = list(by)
    long = to_long(df.select(*by, *cols), by, cols)
    s = summary_stats(long, [*by, "variable"], method="stata")
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return s.select(*by, "variable", r(F.col("mean")).alias("mean"), r(F.col("sd")).alias("sd"),
                    "n", "p10", "p90")


def collapse_wide(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """The collapse report as published: one row (per ``by``), columns ``<variable>_<statistic>``.

    The variables are arguments, so the columns need no look at the data."""
    by = list(by)
    long = collapse(df, cols, by, digits)
    stats = ("mean", "sd", "n", "p10", "p90")
    wide = [F.max(F.when(F.col("variable") == v, F.col(s))).alias(f"{v}_{s}") for v in cols for s in stats]
    return long.groupBy(*by).agg(*wide) if by else long.agg(*wide)


# --- A6-A15 ------------------------------------------------------------------------------

def prevalence(df: DataFrame, u: str, t: str, flags: Mapping[str, str], units_name: str = "n_units") -> DataFrame:
    """Per period, distinct units and distinct units with each flag = 1 (NULL ignored).

    One row a (period, unit) first, so that counting needs no copy of the rows for each flag."""
    cells = df.groupBy(t, u).agg(*[F.max(F.coalesce((F.col(f) == 1).cast("int"), F.lit(0))).alias(f"_f{i}") for i, f in enumerate(flags.values())])
    return cells.groupBy(t).agg(F.count(u).alias(units_name),
                                *[F.sum(F.when(F.col(u).isNotNull(), F.col(f"_f{i}")).otherwise(0)).alias(name) for i, name in enumerate(flags)])


def cohort_sizes(df: DataFrame, u: str, g: str) -> DataFrame:
    """Distinct (unit, cohort) then units per cohort (never-adopters excluded)."""
    return df.filter(F.col(g).isNotNull()).select(u, g).distinct().groupBy(g) \
             .agg(F.count(F.lit(1)).alias("n_units"))


def running_total(df: DataFrame, order_col: str, val: str, out: str = "running") -> DataFrame:
    """Running sum of ``val`` in ``order_col`` order (NULLs last) without a
    single-partition window: range-partitioned sort, a window per sorted
    partition, plus the totals of all earlier partitions (one small table)."""
    spark = df.sparkSession
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order_col).asc_nulls_last()
    ranged = (df.repartitionByRange(nparts, key).sortWithinPartitions(key)
                .withColumn("_pid", F.spark_partition_id()))
    checkpoint_dir(spark)
    ranged = ranged.checkpoint()  # partition ids must not change between the sums and the rows
    parts = ranged.groupBy("_pid").agg(F.sum(val).alias("_ps"))
    parts = parts.withColumn("_off", F.coalesce(F.sum("_ps").over(
        Window.partitionBy(F.lit(1)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum(val).over(Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    # one row per partition of the data: bounded by configuration
    return ranged.withColumn("_w", within).join(F.broadcast(parts.select("_pid", "_off")), "_pid") \
                 .withColumn(out, F.col("_off") + F.col("_w")).drop("_pid", "_w", "_off")


def spark_row(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def tabulate(df: DataFrame, col: str, where: Column | None = None, missing: bool = False) -> DataFrame:
    """Stata ``tab``: freq, percent, cumulative percent and a Total row.
    The cumulative sum over the frequency table uses ``running_total``, so a
    high-cardinality column never lands in one task."""
    d = df if where is None else df.filter(where)
    if not missing:
        d = d.filter(F.col(col).isNotNull())
    withcum = running_total(d.groupBy(col).agg(F.count(F.lit(1)).alias("freq")), col, "freq", "_run")
    total_n = withcum.agg(F.max("_run")).first()[0] or 0     # one scalar through the driver
    body = withcum.select(F.col(col).cast("string").alias("value"), "freq",
                          (F.col("freq") * 100.0 / F.lit(total_n)).alias("percent"),
                          (F.col("_run") * 100.0 / F.lit(total_n)).alias("cum_percent"))
    total = spark_row(df, [("Total", total_n or None, 100.0, None)], "value string, freq long, percent double, cum_percent double")
    return body.unionByName(total)


def trend(df: DataFrame, t: str, cols: Sequence[str]) -> DataFrame:
    """A10 + O5: mean of each outcome per period, long form (t, variable, mean)."""
    wide = df.groupBy(t).agg(*[F.avg(c).alias(c) for c in cols])
    return wide.unpivot([t], list(cols), "variable", "mean")


def weighted_mean_by(df: DataFrame, by: Sequence[str], x: str, w: str) -> DataFrame:
    """N, weight sum and weighted mean of x per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight_sum"),
                               (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("avg_estimate"))


def balance_report(df: DataFrame, u: str, t: str) -> DataFrame:
    """Rows, units, min / max / median periods per unit (two-level aggregate;
    the median over units uses the exact sort-based quantile)."""
    per_unit = df.groupBy(u).agg(F.count(F.lit(1)).alias("n_periods"))
    top = per_unit.agg(F.sum("n_periods").alias("n_rows"), F.count(F.lit(1)).alias("n_units"),
                       F.min("n_periods").alias("min_periods"), F.max("n_periods").alias("max_periods")).first()
    med = exact_quantiles(per_unit, [], "n_periods", {"median_periods": 0.5}).first()
    # two one-row results combined as scalars on the driver
    return df.sparkSession.createDataFrame(
        [(top["n_rows"], top["n_units"], top["min_periods"], top["max_periods"], med["median_periods"] if med else None)],
        "n_rows long, n_units long, min_periods long, max_periods long, median_periods double")


def any_flag(cond: Column) -> Column:
    """any() over a group with NULL -> FALSE (R ``any(..., na.rm = TRUE)``)."""
    return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1


def n_units(df: DataFrame, u: str, never: str | None = None) -> DataFrame:
    """Distinct units, and adopters / never-adopters among them (two-level aggregate)."""
    d = df.filter(F.col(u).isNotNull())
    if never is None:
        return d.select(u).distinct().agg(F.count(F.lit(1)).alias("n_units"))
    yes = F.col(never).cast("int")
    units = d.groupBy(u).agg(F.max(1 - yes).alias("a"), F.max(yes).alias("n"))
    return units.agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_adopters"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("n_never"))


def tau_grid(df: DataFrame, tau: str, lo: int, hi: int) -> DataFrame:
    """One row per event time inside [lo, hi] (``collapse ... by(tau)`` + drop)."""
    return df.select(tau).filter((F.col(tau) >= lo) & (F.col(tau) <= hi)).distinct()


def adoption_listing(df: DataFrame, u: str, g: str) -> DataFrame:
    """O2: distinct (unit, cohort) of adopters, ordered by cohort then unit."""
    return df.filter(F.col(g).isNotNull()).select(u, g).distinct().orderBy(g, u)


def one_per_unit(df: DataFrame, u: str, cols: Sequence[str]) -> DataFrame:
    """One row per unit of unit-constant columns (``!duplicated``)."""
    return df.select(u, *cols).dropDuplicates([u])


def lag_outcome(df: DataFrame, u: str, t: str, y: str, out: str = "y_lag") -> DataFrame:
    """Previous observed period's value within the unit (varying base)."""
    w = Window.partitionBy(u).orderBy(t)
    return df.withColumn(out, F.lag(y).over(w)).withColumn(f"{out}_t", F.lag(t).over(w))


def row_in_unit(df: DataFrame, u: str, t: str, out: str = "row_n") -> DataFrame:
    """Row number within unit, ordered by period."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(u).orderBy(t)))


def unit_max(col: str, u) -> Column:
    """Unit-level max broadcast back to rows (egen max(), by())."""
    return F.max(F.col(col)).over(over_unit(u))


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """O3: union by name, missing columns filled with NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
