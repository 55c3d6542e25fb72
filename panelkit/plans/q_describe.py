"""Queries for A1-A15, W1-W4, O1-O8 (descriptives), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import describe as D
from panelkit.operators import panel as P
from panelkit.plans.registry import register, rnd, with_ctes
from panelkit.sources.fixtures import SQL_P1, SQL_P2, SQL_P3, customer_year, supplier_quarter, user_day

# Stata order-statistic percentile of column x at fraction p:
# (percentile_disc(p) + percentile_disc(1 - p) on the descending order) / 2
def _stata_pct(x: str, p: float) -> str:
    return (f"(quantile_disc({x}, {p}) + (-quantile_disc(-{x}, {round(1 - p, 10)})) ) / 2.0")


@register("summary_stats", with_ctes(SQL_P2) + """
SELECT round(avg(y_val), 6) + 0.0 AS mean, round(stddev_samp(y_val), 6) + 0.0 AS sd, count(y_val) AS n,
       round(quantile_cont(y_val, 0.1), 6) + 0.0 AS p10, round(quantile_cont(y_val, 0.9), 6) + 0.0 AS p90
FROM p2""")
def q_summary_stats(spark, sf_dir):
    long = D.to_long(customer_year(spark, sf_dir).select("y_val"), [], ["y_val"])
    s = D.summary_stats(long, [])
    return s.select(rnd("mean").alias("mean"), rnd("sd").alias("sd"), "n", rnd("p10").alias("p10"), rnd("p90").alias("p90"))


_SUMTAB_PARTS = []
for _var in ("y_cnt", "y_val"):
    for _label, _cond in (("Full", "true"), ("1995-1996", "t <= 1996"), ("2000-2001", "t >= 2000")):
        _SUMTAB_PARTS.append(
            f"SELECT '{_var}' AS variable, '{_label}' AS period, round(avg({_var}), 1) AS mean, "
            f"round(stddev_samp({_var}), 1) AS sd, count({_var}) AS n, round(quantile_cont({_var}, 0.1), 1) AS p10, "
            f"round(quantile_cont({_var}, 0.9), 1) AS p90 FROM p2 WHERE {_cond} AND {_var} IS NOT NULL")


@register("summary_table", with_ctes(SQL_P2) + "\n" + "\nUNION ALL\n".join(_SUMTAB_PARTS))
def q_summary_table(spark, sf_dir):
    p = customer_year(spark, sf_dir)
    periods = {"Full": F.lit(True), "1995-1996": F.col("t") <= 1996, "2000-2001": F.col("t") >= 2000}
    return D.summary_table(p, ["y_cnt", "y_val"], periods, digits=1)


def _collapse_sql(by: str | None) -> str:
    parts = []
    for v in ("y_cnt", "y_val"):
        sel = (f"SELECT {by + ', ' if by else ''}'{v}' AS variable, round(avg({v}), 2) AS mean, "
               f"round(stddev_samp({v}), 2) AS sd, count({v}) AS n, "
               f"round({_stata_pct(v, 0.1)}, 6) + 0.0 AS p10, round({_stata_pct(v, 0.9)}, 6) + 0.0 AS p90 "
               f"FROM src WHERE {v} IS NOT NULL" + (f" GROUP BY {by}" if by else ""))
        parts.append(sel)
    return "\nUNION ALL\n".join(parts)


@register("collapse_all", with_ctes(SQL_P2, "src AS (SELECT * FROM p2)") + "\n" + _collapse_sql(None))
def q_collapse_all(spark, sf_dir):
    c = D.collapse(customer_year(spark, sf_dir), ["y_cnt", "y_val"])
    return c.withColumns({"p10": rnd("p10"), "p90": rnd("p90")})


@register("collapse_by_flag", with_ctes(
    SQL_P2, "src AS (SELECT *, CAST(t >= 2000 AS INTEGER) AS ld FROM p2 WHERE t <= 1996 OR t >= 2000)")
    + "\n" + _collapse_sql("ld"))
def q_collapse_by_flag(spark, sf_dir):
    p = P.two_tail_filter(customer_year(spark, sf_dir), "t", 1997, 1999).withColumn("ld", (F.col("t") >= 2000).cast("int"))
    c = D.collapse(p, ["y_cnt", "y_val"], by=["ld"])
    return c.withColumns({"p10": rnd("p10"), "p90": rnd("p90")})


def _collapse_wide_sql(by):
    names = [f"max(CASE WHEN variable = '{v}' THEN {x} END) AS {v}_{x}" for v in ("y_cnt", "y_val") for x in ("mean", "sd", "n", "p10", "p90")]
    return f"SELECT {by}, {', '.join(names)} FROM ({_collapse_sql(by)}) GROUP BY {by}"


@register("collapse_wide", with_ctes(
    SQL_P2, "src AS (SELECT *, CAST(t >= 2000 AS INTEGER) AS ld FROM p2 WHERE t <= 1996 OR t >= 2000)")
    + "\n" + _collapse_wide_sql("ld"))
def q_collapse_wide(spark, sf_dir):
    """A4 in the published layout: a row per period group, a column per variable and statistic."""
    p = P.two_tail_filter(customer_year(spark, sf_dir), "t", 1997, 1999).withColumn("ld", (F.col("t") >= 2000).cast("int"))
    c = D.collapse_wide(p, ["y_cnt", "y_val"], by=["ld"])
    return c.withColumns({x: rnd(x) for x in c.columns if x.endswith(("p10", "p90"))})


@register("percentile_stata", with_ctes(SQL_P2) + f"""
SELECT t, round({_stata_pct('y_val', 0.1)}, 6) + 0.0 AS p10_stata, round(quantile_cont(y_val, 0.1), 6) + 0.0 AS p10_type7,
       round({_stata_pct('y_cnt', 0.5)}, 6) + 0.0 AS p50_stata, round(quantile_cont(y_cnt, 0.5), 6) + 0.0 AS p50_type7
FROM p2 GROUP BY t""")
def q_percentile_stata(spark, sf_dir):
    p = customer_year(spark, sf_dir)
    a = D.exact_quantiles(p, ["t"], "y_val", {"p10_stata": 0.1}, method="stata")
    b = D.exact_quantiles(p, ["t"], "y_val", {"p10_type7": 0.1})
    c = D.exact_quantiles(p, ["t"], "y_cnt", {"p50_stata": 0.5}, method="stata")
    d = D.exact_quantiles(p, ["t"], "y_cnt", {"p50_type7": 0.5})
    out = a.join(b, "t").join(c, "t").join(d, "t")
    return out.select("t", *[rnd(x).alias(x) for x in ("p10_stata", "p10_type7", "p50_stata", "p50_type7")])


@register("prevalence", with_ctes(SQL_P1) + """
SELECT t, count(DISTINCT unit) AS n_units, count(DISTINCT CASE WHEN policy = 1 THEN unit END) AS n_policy,
       count(DISTINCT CASE WHEN policy2 = 1 THEN unit END) AS n_policy2
FROM p1 GROUP BY t""")
def q_prevalence(spark, sf_dir):
    return D.prevalence(supplier_quarter(spark, sf_dir), "unit", "t", {"n_policy": "policy", "n_policy2": "policy2"})


@register("cohort_sizes", with_ctes(SQL_P3) + """
SELECT g, count(*) AS n_units FROM (SELECT DISTINCT unit, g FROM p3 WHERE g IS NOT NULL) GROUP BY g""")
def q_cohort_sizes(spark, sf_dir):
    return D.cohort_sizes(user_day(spark, sf_dir), "unit", "g")


_TAB_SQL = """,
f AS (SELECT CAST(t AS VARCHAR) AS value, t AS k, count(*) AS freq FROM src GROUP BY t)
SELECT value, freq, round(freq * 100.0 / sum(freq) OVER (), 6) + 0.0 AS percent,
       round(sum(freq) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0 / sum(freq) OVER (), 6) + 0.0 AS cum_percent
FROM f
UNION ALL SELECT 'Total', CAST(sum(freq) AS BIGINT), 100.0, NULL FROM f"""


def _tab(df, col, where=None):
    t = D.tabulate(df, col, where)
    return t.select("value", "freq", rnd("percent").alias("percent"), rnd("cum_percent").alias("cum_percent"))


@register("tabulate", with_ctes(SQL_P2, "src AS (SELECT * FROM p2)") + _TAB_SQL)
def q_tabulate(spark, sf_dir):
    return _tab(customer_year(spark, sf_dir), "t")


@register("tabulate_where", with_ctes(SQL_P2, "src AS (SELECT * FROM p2 WHERE g = 1998 AND t >= g)") + _TAB_SQL)
def q_tabulate_where(spark, sf_dir):
    return _tab(customer_year(spark, sf_dir), "t", (F.col("g") == 1998) & (F.col("t") >= F.col("g")))


@register("cum_pct", with_ctes(SQL_P3, "src AS (SELECT g AS t FROM (SELECT DISTINCT unit, g FROM p3) WHERE g IS NOT NULL)") + _TAB_SQL)
def q_cum_pct(spark, sf_dir):
    """Running cumulative percent of units by adoption day."""
    return _tab(user_day(spark, sf_dir).select("unit", "g").distinct(), "g")


@register("trend_long", with_ctes(SQL_P2) + """
SELECT t, variable, round(mean, 6) + 0.0 AS mean FROM (
  SELECT t, 'y_cnt' AS variable, avg(y_cnt) AS mean FROM p2g GROUP BY t UNION ALL
  SELECT t, 'y_val', avg(y_val) FROM p2g GROUP BY t)""")
def q_trend_long(spark, sf_dir):
    tr = D.trend(customer_year(spark, sf_dir, grid=True), "t", ["y_cnt", "y_val"])
    return tr.withColumn("mean", rnd("mean"))


@register("tau_grid", with_ctes(SQL_P1) + """
SELECT DISTINCT CAST(t - g AS INTEGER) AS tau FROM p1 WHERE t - g BETWEEN -10 AND 5""")
def q_tau_grid(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir).withColumn("tau", (F.col("t") - F.col("g")).cast("int"))
    return D.tau_grid(p, "tau", -10, 5)


@register("balance_report", with_ctes(SQL_P2) + """,
u AS (SELECT unit, count(*) AS n_periods FROM p2 GROUP BY unit)
SELECT CAST(sum(n_periods) AS BIGINT) AS n_rows, count(*) AS n_units, min(n_periods) AS min_periods, max(n_periods) AS max_periods,
       round(quantile_cont(n_periods, 0.5), 6) + 0.0 AS median_periods FROM u""")
def q_balance_report(spark, sf_dir):
    b = D.balance_report(customer_year(spark, sf_dir), "unit", "t")
    return b.withColumn("median_periods", rnd("median_periods"))


@register("any_flags", with_ctes(SQL_P2) + """
SELECT unit, coalesce(max(CASE WHEN y_cnt >= 3 THEN 1 ELSE 0 END), 0) = 1 AS any_busy,
       coalesce(max(CASE WHEN t >= 2000 AND y_val > 300000 THEN 1 ELSE 0 END), 0) = 1 AS any_big_late
FROM p2g GROUP BY unit""")
def q_any_flags(spark, sf_dir):
    p = customer_year(spark, sf_dir, grid=True)
    return p.groupBy("unit").agg(D.any_flag(F.col("y_cnt") >= 3).alias("any_busy"),
                                 D.any_flag((F.col("t") >= 2000) & (F.col("y_val") > 300000)).alias("any_big_late"))


@register("n_units", with_ctes(SQL_P3) + """
SELECT count(DISTINCT unit) AS n_units, count(DISTINCT CASE WHEN g IS NOT NULL THEN unit END) AS n_adopters,
       count(DISTINCT CASE WHEN g IS NULL THEN unit END) AS n_never FROM p3""")
def q_n_units(spark, sf_dir):
    p = user_day(spark, sf_dir).withColumn("never", F.col("g").isNull())
    return D.n_units(p, "unit", "never")


@register("adoption_listing", with_ctes(SQL_P2) + """
SELECT DISTINCT unit, g FROM p2 WHERE g IS NOT NULL""")
def q_adoption_listing(spark, sf_dir):
    return D.adoption_listing(customer_year(spark, sf_dir), "unit", "g")


@register("one_per_unit", with_ctes(SQL_P2) + """
SELECT DISTINCT unit, g, w FROM p2""")
def q_one_per_unit(spark, sf_dir):
    return D.one_per_unit(customer_year(spark, sf_dir), "unit", ["g", "w"])


@register("lag_outcome", with_ctes(SQL_P2) + """
SELECT unit, t, lag(y_cnt) OVER (PARTITION BY unit ORDER BY t) AS y_lag, lag(t) OVER (PARTITION BY unit ORDER BY t) AS y_lag_t,
       CAST(row_number() OVER (PARTITION BY unit ORDER BY t) AS INTEGER) AS row_n
FROM p2""")
def q_lag_outcome(spark, sf_dir):
    p = customer_year(spark, sf_dir).select("unit", "t", "y_cnt")
    p = D.row_in_unit(D.lag_outcome(p, "unit", "t", "y_cnt"), "unit", "t")
    return p.select("unit", "t", "y_lag", "y_lag_t", "row_n")


@register("weighted_mean_by", with_ctes(SQL_P1) + """
SELECT g, count(*) AS n, round(sum(w), 6) + 0.0 AS weight_sum, round(sum(w * y_qty) / sum(w), 6) + 0.0 AS avg_estimate
FROM p1 GROUP BY g""")
def q_weighted_mean_by(spark, sf_dir):
    m = D.weighted_mean_by(supplier_quarter(spark, sf_dir), ["g"], "y_qty", "w")
    return m.select("g", "n", rnd("weight_sum").alias("weight_sum"), rnd("avg_estimate").alias("avg_estimate"))


@register("unit_extremes", with_ctes(SQL_P2) + """
SELECT unit, t, max(y_cnt) OVER (PARTITION BY unit) AS max_cnt, min(y_val) OVER (PARTITION BY unit) AS min_val,
       count(y_cnt) OVER (PARTITION BY unit) AS n_cnt FROM p2g""")
def q_unit_extremes(spark, sf_dir):
    p = customer_year(spark, sf_dir, grid=True)
    w = P.over_unit("unit")
    return p.select("unit", "t", D.unit_max("y_cnt", "unit").alias("max_cnt"),
                    F.min("y_val").over(w).alias("min_val"), F.count("y_cnt").over(w).alias("n_cnt"))


@register("bind_rows", with_ctes(SQL_P1, SQL_P2) + """
SELECT 'p1' AS source, t, round(avg(y_cnt), 6) + 0.0 AS mean_cnt, NULL::DOUBLE AS mean_val FROM p1 GROUP BY t
UNION ALL
SELECT 'p2', t, round(avg(y_cnt), 6) + 0.0, round(avg(y_val), 6) + 0.0 FROM p2 GROUP BY t""")
def q_bind_rows(spark, sf_dir):
    a = supplier_quarter(spark, sf_dir).groupBy("t").agg(rnd(F.avg("y_cnt")).alias("mean_cnt")) \
        .withColumn("source", F.lit("p1"))
    b = customer_year(spark, sf_dir).groupBy("t").agg(rnd(F.avg("y_cnt")).alias("mean_cnt"),
                                                      rnd(F.avg("y_val")).alias("mean_val")).withColumn("source", F.lit("p2"))
    return D.bind_rows(a, b).select("source", "t", "mean_cnt", "mean_val")


@register("distinct_units", with_ctes(SQL_P3) + """
SELECT DISTINCT unit, g FROM p3""")
def q_distinct(spark, sf_dir):
    """Distinct (unit, cohort)."""
    return user_day(spark, sf_dir).select("unit", "g").distinct()


@register("sorted_report", with_ctes(SQL_P1) + """
SELECT g, t, count(*) AS n FROM p1 WHERE g IS NOT NULL GROUP BY g, t""")
def q_sorted_report(spark, sf_dir):
    """O1: report rows sorted by cohort, then period."""
    p = supplier_quarter(spark, sf_dir).filter(F.col("g").isNotNull())
    return p.groupBy("g", "t").agg(F.count(F.lit(1)).alias("n")).orderBy("g", "t")
