"""Queries for P1-P18 (keys, recodes, filters, indicators), T1-T17 (event-time
panel) and J1-J6 (joins), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import panel as P
from panelkit.operators.joins import attach_unit_attrs, cohort_pairs, join_outer, join_outer_skewed, keep_units, long_diff
from panelkit.plans.registry import register, rnd, with_ctes
from panelkit.sources.fixtures import SQL_P1, SQL_P2, SQL_P3, customer_year, supplier_quarter, user_day
from panelkit.sources.io import read_table

# P1 with event time of the first policy (g is after the first quarter for every adopter)
SQL_P1T = """
p1t AS (
  SELECT *, CAST(CASE WHEN g > min(t) OVER (PARTITION BY unit) THEN t - g END AS INTEGER) AS tau,
         g IS NULL AS never
  FROM p1)"""


def _p1t(spark, sf_dir):
    p = P.obs_span(supplier_quarter(spark, sf_dir), "unit", "t")
    return (p.withColumn("tau", P.event_time("g", "first_obs", "t"))
             .withColumn("never", P.never_adopt("g")).drop("first_obs", "last_obs"))


# ---------------------------------------------------------------- P1 / P2 dense ids

@register("dense_id", with_ctes(SQL_P2) + """
SELECT unit, t, CAST(dense_rank() OVER (ORDER BY unit) AS BIGINT) AS unit_id FROM p2""")
def q_dense_id(spark, sf_dir):
    return P.dense_id(customer_year(spark, sf_dir).select("unit", "t"), "unit")


@register("dense_id_composite", with_ctes(SQL_P2) + """
SELECT g, unit, t, CAST(dense_rank() OVER (ORDER BY g ASC NULLS FIRST, unit) AS BIGINT) AS key_id FROM p2g""")
def q_dense_id_composite(spark, sf_dir):
    return P.dense_id(customer_year(spark, sf_dir, grid=True).select("g", "unit", "t"), ["g", "unit"], out="key_id")


# ---------------------------------------------------------------- P3-P6, F1-F2, F12

@register("recode_case", with_ctes(SQL_P2) + """
SELECT unit, t,
  CAST(CASE WHEN g IS NULL THEN NULL WHEN t - g < -2 THEN -2 WHEN t - g > 2 THEN 2 ELSE t - g END AS INTEGER) AS tau_bin,
  CASE WHEN g IS NULL THEN 'never' WHEN t >= g THEN 'post' ELSE 'pre' END AS phase,
  CASE WHEN y_cnt >= 2 THEN y_val END AS y_busy
FROM p2""")
def q_recode_case(spark, sf_dir):
    p = customer_year(spark, sf_dir)
    tau = F.col("t") - F.col("g")
    return p.select("unit", "t",
                    P.case_when([(F.col("g").isNull(), None), (tau < -2, -2), (tau > 2, 2)], tau).cast("int").alias("tau_bin"),
                    P.case_when([(F.col("g").isNull(), "never"), (F.col("t") >= F.col("g"), "post")], "pre").alias("phase"),
                    P.when_else(F.col("y_cnt") >= 2, F.col("y_val")).alias("y_busy"))


@register("recode_override", with_ctes(SQL_P1) + """
SELECT unit, t, CAST(CASE WHEN unit % 7 = 0 THEN 1985 WHEN unit % 5 = 0 THEN 1993
                          WHEN unit % 3 = 0 THEN 1995 END AS INTEGER) AS programme_start
FROM p1""")
def q_recode_override(spark, sf_dir):
    """P5: replace 1995 if a; replace 1993 if b; replace 1985 if c (last wins)."""
    u = F.col("unit")
    start = P.override_chain([(u % 3 == 0, 1995), (u % 5 == 0, 1993), (u % 7 == 0, 1985)])
    return supplier_quarter(spark, sf_dir).select("unit", "t", start.cast("int").alias("programme_start"))


@register("coalesce_adoption", with_ctes(SQL_P2) + """
SELECT unit, t, CAST(coalesce(g, min(CASE WHEN y_cnt >= 2 THEN t END) OVER (PARTITION BY unit)) AS INTEGER) AS adopt
FROM p2""")
def q_coalesce_adoption(spark, sf_dir):
    p = customer_year(spark, sf_dir).withColumn("busy", (F.col("y_cnt") >= 2).cast("int"))
    p = P.first_treated(p, "unit", "t", "busy", out="first_busy")
    return p.select("unit", "t", F.coalesce("g", "first_busy").cast("int").alias("adopt"))


@register("round_stats", with_ctes(SQL_P2) + """
SELECT t, round(avg(y_val), 1) + 0.0 AS mean_1dp, round(avg(y_val), 2) + 0.0 AS mean_2dp,
       count(*) FILTER (WHERE y_val IS NULL) AS n_missing, round(sqrt(avg(y_cnt)), 6) + 0.0 AS sqrt_mean_cnt,
       round(max(abs(y_val - 100000.0)), 2) + 0.0 AS max_abs_dev
FROM p2g GROUP BY t""")
def q_round_stats(spark, sf_dir):
    p = customer_year(spark, sf_dir, grid=True)
    return p.groupBy("t").agg(
        (F.round(F.avg("y_val"), 1) + 0.0).alias("mean_1dp"), (F.round(F.avg("y_val"), 2) + 0.0).alias("mean_2dp"),
        F.count(F.when(F.col("y_val").isNull(), 1)).alias("n_missing"),
        rnd(F.sqrt(F.avg("y_cnt"))).alias("sqrt_mean_cnt"),
        (F.round(F.max(F.abs(F.col("y_val") - 100000.0)), 2) + 0.0).alias("max_abs_dev"))


# ---------------------------------------------------------------- P7-P10, P18

@register("any_nonnull_filter", with_ctes(SQL_P2) + """
SELECT unit, t, y_cnt FROM p2g WHERE y_cnt IS NOT NULL OR y_val IS NOT NULL""")
def q_any_nonnull(spark, sf_dir):
    return P.keep_any_nonnull(customer_year(spark, sf_dir, grid=True), ["y_cnt", "y_val"]).select("unit", "t", "y_cnt")


@register("drop_all_missing", with_ctes(SQL_P2) + """,
late AS (SELECT unit, t, CASE WHEN t >= 2000 THEN y_cnt END AS y_late FROM p2g)
SELECT unit, t, y_late FROM late
WHERE unit IN (SELECT unit FROM late GROUP BY unit HAVING count(y_late) > 0)""")
def q_drop_all_missing(spark, sf_dir):
    p = customer_year(spark, sf_dir, grid=True).select(
        "unit", "t", F.when(F.col("t") >= 2000, F.col("y_cnt")).alias("y_late"))
    return P.drop_all_missing_units(p, "unit", "y_late")


@register("two_tail_filter", with_ctes(SQL_P2) + """
SELECT unit, t, y_cnt FROM p2 WHERE t < 1997 OR t > 2000""")
def q_two_tail(spark, sf_dir):
    return P.two_tail_filter(customer_year(spark, sf_dir), "t", 1997, 2000).select("unit", "t", "y_cnt")


@register("wildcard_recode", with_ctes(SQL_P2) + """
SELECT unit, t, CASE WHEN t = 2001 THEN 0.0 ELSE y_cnt END AS y_cnt,
       CASE WHEN t = 2001 THEN 0.0 ELSE y_val END AS y_val FROM p2g""")
def q_wildcard(spark, sf_dir):
    p = customer_year(spark, sf_dir, grid=True).select("unit", "t", "y_cnt", "y_val")
    return P.replace_where(p, "y_", F.col("t") == 2001, 0.0)


@register("complete_cases", with_ctes(SQL_P2) + """
SELECT unit, t, y_cnt, y_val, w FROM p2g WHERE y_cnt IS NOT NULL AND y_val IS NOT NULL AND w IS NOT NULL""")
def q_complete_cases(spark, sf_dir):
    return P.complete_cases(customer_year(spark, sf_dir, grid=True).select("unit", "t", "y_cnt", "y_val", "w"),
                            ["y_cnt", "y_val", "w"])


# ---------------------------------------------------------------- P12-P16

@register("event_dummies", with_ctes(SQL_P1, SQL_P1T) + """
SELECT unit, t, tau,
  CAST(coalesce(tau = -3, false) AS INTEGER) AS taum3, CAST(coalesce(tau = -2, false) AS INTEGER) AS taum2,
  CAST(coalesce(tau = -1, false) AS INTEGER) AS taum1, CAST(coalesce(tau = 0, false) AS INTEGER) AS tau0,
  CAST(coalesce(tau = 1, false) AS INTEGER) AS tau1, CAST(coalesce(tau = 2, false) AS INTEGER) AS tau2,
  CAST(coalesce(tau = 3, false) AS INTEGER) AS tau3
FROM p1t""")
def q_event_dummies(spark, sf_dir):
    return P.event_dummies(_p1t(spark, sf_dir).select("unit", "t", "tau"), "tau", -3, 3)


@register("tail_dummies", with_ctes(SQL_P1, SQL_P1T) + """
SELECT unit, t, CAST(coalesce(tau < -3, false) AS INTEGER) AS tauL,
       CAST(coalesce(tau > 3, false) AS INTEGER) AS tauR FROM p1t""")
def q_tail_dummies(spark, sf_dir):
    return P.tail_dummies(_p1t(spark, sf_dir).select("unit", "t", "tau"), "tau", -3, 3).drop("tau")


@register("bin_tau", with_ctes(SQL_P1, SQL_P1T) + """
SELECT unit, t, CAST(CASE WHEN never THEN NULL WHEN tau < -7 THEN -7 WHEN tau > 9 THEN 9 ELSE tau END AS INTEGER) AS tau_binned
FROM p1t""")
def q_bin_tau(spark, sf_dir):
    return _p1t(spark, sf_dir).select("unit", "t", P.bin_tau("tau", -7, 9, "never").alias("tau_binned"))


@register("interactions", with_ctes(SQL_P1, SQL_P1T) + """
SELECT unit, t, CAST(policy * coalesce(tau, 0) AS INTEGER) AS post_x_tau,
       CAST(policy * policy2 AS INTEGER) AS both_policies, round(y_cnt * w, 6) + 0.0 AS cnt_x_w,
       CAST(NOT never AS INTEGER) AS adopter
FROM p1t""")
def q_interactions(spark, sf_dir):
    p = _p1t(spark, sf_dir)
    return p.select("unit", "t", (F.col("policy") * F.coalesce("tau", F.lit(0))).cast("int").alias("post_x_tau"),
                    (F.col("policy") * F.col("policy2")).cast("int").alias("both_policies"),
                    rnd(F.col("y_cnt") * F.col("w")).alias("cnt_x_w"), P.flag(~F.col("never")).alias("adopter"))


# ---------------------------------------------------------------- T1-T6

@register("first_treated", with_ctes(SQL_P3) + """
SELECT unit, t, CAST(min(CASE WHEN y_cnt >= 3 THEN t END) OVER (PARTITION BY unit) AS INTEGER) AS first_busy,
       g AS first_purchase FROM p3""")
def q_first_treated(spark, sf_dir):
    p = user_day(spark, sf_dir).withColumn("busy", (F.col("y_cnt") >= 3).cast("int"))
    p = P.first_treated(p, "unit", "t", "busy", out="first_busy")
    return p.select("unit", "t", F.col("first_busy").cast("int").alias("first_busy"), F.col("g").alias("first_purchase"))


@register("obs_span", with_ctes(SQL_P2) + """
SELECT unit, t, min(t) OVER (PARTITION BY unit) AS first_obs, max(t) OVER (PARTITION BY unit) AS last_obs,
       min(CASE WHEN y_val > 200000 THEN t END) OVER (PARTITION BY unit) AS first_big
FROM p2""")
def q_obs_span(spark, sf_dir):
    p = P.obs_span(customer_year(spark, sf_dir), "unit", "t")
    p = P.obs_span(p, "unit", "t", lo="first_big", hi="_last_big", require=F.col("y_val") > 200000)
    return p.select("unit", "t", "first_obs", "last_obs", "first_big")


_SQL_P2G_SPAN = """
p2s AS (
  SELECT *, min(CASE WHEN y_cnt IS NOT NULL THEN t END) OVER (PARTITION BY unit) AS first_obs,
            max(CASE WHEN y_cnt IS NOT NULL THEN t END) OVER (PARTITION BY unit) AS last_obs
  FROM p2g)"""


def _p2g_span(spark, sf_dir):
    p = customer_year(spark, sf_dir, grid=True)
    return P.obs_span(p, "unit", "t", require=F.col("y_cnt").isNotNull())


@register("event_time", with_ctes(SQL_P2, _SQL_P2G_SPAN) + """
SELECT unit, t, CAST(CASE WHEN g > first_obs THEN t - g END AS INTEGER) AS tau_all,
       CAST(CASE WHEN g > first_obs AND y_cnt IS NOT NULL THEN t - g END AS INTEGER) AS tau_obs
FROM p2s""")
def q_event_time(spark, sf_dir):
    p = _p2g_span(spark, sf_dir)
    return p.select("unit", "t", P.event_time("g", "first_obs", "t").alias("tau_all"),
                    P.event_time("g", "first_obs", "t", require=F.col("y_cnt").isNotNull()).alias("tau_obs"))


@register("never_adopt", with_ctes(SQL_P2) + """
SELECT unit, t, g IS NULL AS never FROM p2""")
def q_never_adopt(spark, sf_dir):
    return customer_year(spark, sf_dir).select("unit", "t", P.never_adopt("g").alias("never"))


@register("never_adopt_late", with_ctes(SQL_P2, _SQL_P2G_SPAN) + """
SELECT unit, t, (g IS NULL OR coalesce(last_obs < g, false)) AS never FROM p2s""")
def q_never_adopt_late(spark, sf_dir):
    return _p2g_span(spark, sf_dir).select("unit", "t", P.never_adopt("g", "last_obs").alias("never"))


# ---------------------------------------------------------------- T7-T12

_SQL_P2_RECLASS = """
p2r0 AS (
  SELECT *, CAST(CASE WHEN g > first_obs THEN t - g END AS INTEGER) AS tau0,
         max(CASE WHEN t >= g AND (y_cnt IS NOT NULL OR y_val IS NOT NULL) THEN 1 END) OVER (PARTITION BY unit) AS has_post
  FROM p2s),
p2r AS (
  SELECT unit, t, y_cnt, y_val, w, g,
         (g IS NULL) OR (g IS NOT NULL AND has_post IS NULL) AS never,
         CAST(CASE WHEN g IS NOT NULL AND has_post IS NULL THEN NULL ELSE tau0 END AS INTEGER) AS tau
  FROM p2r0)"""


def _p2_reclass(spark, sf_dir):
    p = _p2g_span(spark, sf_dir)
    p = p.withColumn("tau", P.event_time("g", "first_obs", "t")).withColumn("never", P.never_adopt("g"))
    return P.reclassify_no_post(p, "unit", "t", "g", "tau", "never", ["y_cnt", "y_val"])


@register("reclassify_no_post", with_ctes(SQL_P2, _SQL_P2G_SPAN, _SQL_P2_RECLASS) + """
SELECT unit, t, tau, never FROM p2r""")
def q_reclassify(spark, sf_dir):
    return _p2_reclass(spark, sf_dir).select("unit", "t", "tau", "never")


_SQL_ELIG = """
el AS (
  SELECT *, count(*) OVER (PARTITION BY unit) AS n_obs,
         coalesce(max(CASE WHEN tau <= -3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) AS has_pre,
         coalesce(max(CASE WHEN tau >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) AS has_post3
  FROM p2r WHERE y_cnt IS NOT NULL)"""


@register("eligible_sample", with_ctes(SQL_P2, _SQL_P2G_SPAN, _SQL_P2_RECLASS, _SQL_ELIG) + """
SELECT unit, t, tau, never FROM el
WHERE CASE WHEN never THEN n_obs > 1 ELSE has_pre = 1 AND has_post3 = 1 AND n_obs > 1 END""")
def q_eligible(spark, sf_dir):
    p = P.eligible_sample(_p2_reclass(spark, sf_dir), "unit", "tau", "never", y="y_cnt")
    return p.select("unit", "t", "tau", "never")


@register("eligible_two_policies", with_ctes(SQL_P1) + """,
e AS (
  SELECT *, CAST(t - g AS INTEGER) AS tau1, CAST(t - g2 AS INTEGER) AS tau2, count(*) OVER (PARTITION BY unit) AS n
  FROM p1),
f AS (
  SELECT *, coalesce(max(CASE WHEN tau1 <= -3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) = 1
              AND coalesce(max(CASE WHEN tau1 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) = 1 AS ok1,
            coalesce(max(CASE WHEN tau2 <= -3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) = 1
              AND coalesce(max(CASE WHEN tau2 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) = 1 AS ok2
  FROM e)
SELECT unit, t, tau1, tau2 FROM f
WHERE (CASE WHEN g IS NULL THEN n > 1 ELSE ok1 AND n > 1 END)
  AND (CASE WHEN g2 IS NULL THEN n > 1 ELSE ok2 AND n > 1 END)""")
def q_eligible_two(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir).withColumns({
        "tau1": (F.col("t") - F.col("g")).cast("int"), "tau2": (F.col("t") - F.col("g2")).cast("int"),
        "never1": F.col("g").isNull(), "never2": F.col("g2").isNull()})
    keep = P.eligible_flag("unit", "tau1", "never1") & P.eligible_flag("unit", "tau2", "never2")
    return p.filter(F.col("y_qty").isNotNull()).withColumn("_k", keep).filter("_k").select("unit", "t", "tau1", "tau2")


@register("eligible_water", with_ctes(SQL_P2, _SQL_P2G_SPAN, _SQL_P2_RECLASS) + """,
u AS (
  SELECT *, coalesce(max(CASE WHEN tau <= -3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) AS has_pre,
            coalesce(max(CASE WHEN tau >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY unit), 0) AS has_post3
  FROM p2r),
k AS (SELECT * FROM u WHERE (has_pre = 1 AND has_post3 = 1) OR never),
k2 AS (SELECT * FROM k WHERE y_cnt IS NOT NULL OR y_val IS NOT NULL),
k3 AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM k2)
SELECT unit, t, tau FROM k3 WHERE n >= 2""")
def q_eligible_water(spark, sf_dir):
    p = _p2_reclass(spark, sf_dir)
    p = p.withColumn("_use", P.eligible_flag("unit", "tau", "never", min_n=None)).filter("_use")
    p = P.keep_any_nonnull(p, ["y_cnt", "y_val"])
    return P.min_rows(p, ["unit"], 2).select("unit", "t", "tau")


@register("ever_treated", with_ctes(SQL_P1) + """
SELECT DISTINCT unit, max(policy2) OVER (PARTITION BY unit) AS ever2, max(policy) OVER (PARTITION BY unit) AS ever1 FROM p1""")
def q_ever(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir)
    return p.select("unit", P.ever("unit", "policy2").alias("ever2"), P.ever("unit", "policy").alias("ever1")).distinct()


# ---------------------------------------------------------------- T13-T17

@register("cohort_post", with_ctes(SQL_P1, SQL_P1T) + """
SELECT unit, t, CAST(CASE WHEN NOT never THEN g END AS INTEGER) AS cohort,
       CAST(coalesce(NOT never AND t >= g, false) AS INTEGER) AS post FROM p1t""")
def q_cohort_post(spark, sf_dir):
    p = _p1t(spark, sf_dir)
    return p.select("unit", "t", P.cohort("never", "g").alias("cohort"), P.post("never", "t", "g").alias("post"))


@register("onestep_terms", with_ctes(SQL_P1, SQL_P1T) + """,
r AS (SELECT *, coalesce(tau >= -7 AND tau <= 9, false) OR never AS in_range FROM p1t)
SELECT unit, t, in_range AS c_in_range,
       CAST(policy = 1 AND in_range AS INTEGER) AS c_policy,
       CAST(CASE WHEN in_range AND NOT never THEN tau ELSE 0 END AS INTEGER) AS c_tau_range,
       CAST(CASE WHEN policy = 1 AND in_range THEN tau ELSE 0 END AS INTEGER) AS c_trend_break
FROM r""")
def q_onestep_terms(spark, sf_dir):
    p = P.onestep_terms(_p1t(spark, sf_dir), "tau", "never", "policy", -7, 9, "c")
    return p.select("unit", "t", "c_in_range", "c_policy", "c_tau_range", "c_trend_break")


_TB_SQL = """
SELECT unit, t, CAST(coalesce(NOT never AND {tau} >= 0, false) AS INTEGER) AS post,
       CAST(CASE WHEN NOT never AND {tau} IS NOT NULL THEN {tau} ELSE 0 END AS INTEGER) AS trend,
       CAST(coalesce(NOT never AND {tau} >= 0, false) AS INTEGER) * coalesce({tau}, 0)
         + CAST(coalesce(NOT never AND {tau} >= 0, false) AS INTEGER) * {off} AS post_trend
FROM p1t"""


@register("trend_break_terms", with_ctes(SQL_P1, SQL_P1T) + _TB_SQL.format(tau="tau", off=0))
def q_trend_break(spark, sf_dir):
    return P.trend_break_terms(_p1t(spark, sf_dir), "tau", "never").select("unit", "t", "post", "trend", "post_trend")


@register("trend_break_offset", with_ctes(SQL_P1, SQL_P1T) + _TB_SQL.format(tau="tau", off=1))
def q_trend_break_offset(spark, sf_dir):
    return P.trend_break_terms(_p1t(spark, sf_dir), "tau", "never", offset=1).select("unit", "t", "post", "trend", "post_trend")


@register("never_tau_zero", with_ctes(SQL_P1, SQL_P1T) + _TB_SQL.format(
    tau="CASE WHEN never THEN 0 ELSE tau END", off=1))
def q_never_tau_zero(spark, sf_dir):
    return P.trend_break_terms(_p1t(spark, sf_dir), "tau", "never", offset=1, never_tau=0) \
            .select("unit", "t", "post", "trend", "post_trend")


# ---------------------------------------------------------------- J1-J6

@register("left_attach", with_ctes(SQL_P2) + """,
a AS (SELECT unit, min(t) AS first_obs, max(t) AS last_obs, count(*) AS n_obs FROM p2 GROUP BY unit)
SELECT g.unit, g.t, g.y_cnt, a.first_obs, a.last_obs, a.n_obs FROM p2g g LEFT JOIN a ON a.unit = g.unit""")
def q_left_attach(spark, sf_dir):
    attrs = customer_year(spark, sf_dir).groupBy("unit").agg(
        F.min("t").alias("first_obs"), F.max("t").alias("last_obs"), F.count(F.lit(1)).alias("n_obs"))
    grid = customer_year(spark, sf_dir, grid=True).select("unit", "t", "y_cnt")
    return attach_unit_attrs(grid, attrs, ["unit"])


_SQL_LINES = """
ln AS (
  SELECT o_custkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS y_cnt,
         CAST(sum(l_quantity) AS DOUBLE) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("o_custkey").alias("unit"), F.year("l_shipdate").cast("int").alias("t")).agg(
        F.count(F.lit(1)).cast("double").alias("y_cnt"), F.sum("l_quantity").cast("double").alias("qty"))


@register("outer_keep_both", with_ctes(SQL_P2, _SQL_LINES) + """
SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.t, b.t) AS t,
       coalesce(a.y_cnt, b.y_cnt) AS y_cnt, a.y_val, b.qty,
       CAST(CASE WHEN b.unit IS NULL THEN 1 WHEN a.unit IS NULL THEN 2 ELSE 3 END AS INTEGER) AS merge_code
FROM (SELECT unit, t, y_cnt, y_val FROM p2) a FULL OUTER JOIN ln b ON a.unit = b.unit AND a.t = b.t""")
def q_outer(spark, sf_dir):
    a = customer_year(spark, sf_dir).select("unit", "t", "y_cnt", "y_val")
    return join_outer(a, _lines(spark, sf_dir), ["unit", "t"]).select("unit", "t", "y_cnt", "y_val", "qty", "merge_code")


@register("outer_hot_key", """
WITH a AS (SELECT CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS k,
                  l_orderkey AS ord, l_linenumber AS line, l_suppkey AS supp FROM lineitem),
b AS (SELECT CASE WHEN s_suppkey <= 2 THEN 0 WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey END AS k, s_suppkey AS supp, s_nationkey AS nation
      FROM supplier)
SELECT coalesce(a.k, b.k) AS k, ord, line, coalesce(a.supp, b.supp) AS supp, nation,
       CAST(CASE WHEN b.supp IS NULL THEN 1 WHEN a.supp IS NULL THEN 2 ELSE 3 END AS INTEGER) AS merge_code
FROM a FULL OUTER JOIN b ON a.k = b.k""")
def q_outer_hot_key(spark, sf_dir):
    """J2 many-to-many with about half of all rows under one key, and null keys."""
    line, supp = F.col("l_linenumber"), F.col("s_suppkey")
    a = read_table(spark, sf_dir, "lineitem").select(
        F.when(line <= 3, 0).when(line == 7, None).otherwise(F.col("l_suppkey")).alias("k"),
        F.col("l_orderkey").alias("ord"), line.alias("line"), F.col("l_suppkey").alias("supp"))
    b = read_table(spark, sf_dir, "supplier").select(
        F.when(supp <= 2, 0).when(supp % 7 == 0, None).otherwise(supp).alias("k"), supp.alias("supp"), F.col("s_nationkey").alias("nation"))
    return join_outer_skewed(a, b, ["k"], least=1000)


@register("keep_units", with_ctes(SQL_P2) + """
SELECT unit, t, y_cnt FROM p2 WHERE unit IN (SELECT unit FROM p2 WHERE y_cnt >= 3)""")
def q_keep_units(spark, sf_dir):
    p = customer_year(spark, sf_dir).select("unit", "t", "y_cnt")
    return keep_units(p, "unit", F.col("y_cnt") >= 3)


@register("cohort_pairs", with_ctes(SQL_P1) + """,
c AS (SELECT DISTINCT g FROM p1),
tr AS (SELECT g FROM c WHERE g IS NOT NULL)
SELECT a.g AS treated, b.g AS control,
       CASE WHEN b.g IS NULL THEN 'Treated vs Untreated' WHEN a.g < b.g THEN 'Earlier vs Later Treated'
            ELSE 'Later vs Earlier Treated' END AS type
FROM tr a JOIN c b ON a.g IS DISTINCT FROM b.g""")
def q_cohort_pairs(spark, sf_dir):
    return cohort_pairs(supplier_quarter(spark, sf_dir), "g")


@register("long_diff", with_ctes(SQL_P1) + """,
b AS (SELECT unit, y_qty AS y_base FROM p1 WHERE t = g - 1)
SELECT p1.unit, p1.t, round(p1.y_qty - b.y_base, 6) + 0.0 AS dy FROM p1 JOIN b ON b.unit = p1.unit""")
def q_long_diff(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir)
    return long_diff(p, "unit", "t", "y_qty", F.col("g") - 1).select("unit", "t", rnd("dy").alias("dy"))


@register("check_no_post", with_ctes(SQL_P2) + """,
h AS (SELECT unit, max(CASE WHEN t >= g AND (y_cnt IS NOT NULL OR y_val IS NOT NULL) THEN 1 END) AS has_post
      FROM p2g WHERE g IS NOT NULL GROUP BY unit)
SELECT CAST(has_post AS VARCHAR) AS value, count(*) AS freq FROM h GROUP BY has_post""")
def q_check_no_post(spark, sf_dir):
    """Report (tabulate, missing included) whether each adopter has any observed
    outcome from adoption on, without applying the rule."""
    h = P.check_no_post(customer_year(spark, sf_dir, grid=True), "unit", "t", "g", ["y_cnt", "y_val"])
    return h.groupBy(F.col("has_post").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("freq"))


# ---------------------------------------------------------------- stage-01 composite

@register("prepared_panel", with_ctes(SQL_P2) + """,
f AS (SELECT *, CASE WHEN unit % 6 = 1 THEN 1998 END AS g_list FROM p2g),
a AS (SELECT *, coalesce(g_list, min(CASE WHEN g IS NOT NULL AND t >= g THEN t END) OVER (PARTITION BY unit)) AS first_,
             min(CASE WHEN y_cnt IS NOT NULL OR y_val IS NOT NULL THEN t END) OVER (PARTITION BY unit) AS x,
             min(t) OVER (PARTITION BY unit) AS first_obs, max(t) OVER (PARTITION BY unit) AS last_obs FROM f),
b AS (SELECT *, CASE WHEN first_ > first_obs AND (y_cnt IS NOT NULL OR y_val IS NOT NULL) THEN t - first_ END AS tau0,
             first_ IS NULL OR coalesce(last_obs < first_, false) AS never0,
             max(CASE WHEN t >= first_ AND (y_cnt IS NOT NULL OR y_val IS NOT NULL) THEN 1 END) OVER (PARTITION BY unit) AS post_obs FROM a),
c AS (SELECT *, first_ IS NOT NULL AND post_obs IS NULL AS nopost FROM b),
d AS (SELECT *, never0 OR nopost AS never, CASE WHEN NOT never0 AND NOT nopost THEN tau0 END AS tau FROM c)
SELECT unit, t, CAST(first_ AS INTEGER) AS first, CAST(tau AS INTEGER) AS tau, never,
       CAST(CASE WHEN NOT never THEN first_ END AS INTEGER) AS cohort, CAST(NOT never AND t >= first_ AS INTEGER) AS post FROM d""")
def q_prepared_panel(spark, sf_dir):
    """The whole preparation of a panel with listed adoptions: listed adoption years ahead of derived ones, late
    adopters as never-adopters, event time on observed rows, no-post units reclassified."""
    p = customer_year(spark, sf_dir, grid=True).withColumns({
        "flag": F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int"),
        "g_list": F.when(F.col("unit") % 6 == 1, F.lit(1998)).cast("int")})
    p = P.prepare_panel(p, "unit", "t", "flag", ["y_cnt", "y_val"], first_from="g_list", never_if_late=True, require_obs=True)
    return p.select("unit", "t", F.col("first").cast("int").alias("first"), "tau", "never", F.col("cohort").cast("int").alias("cohort"),
                    F.coalesce("post", F.lit(0)).cast("int").alias("post"))
