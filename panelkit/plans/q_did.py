"""Queries for D1-D5 (decomposition), E1-E14 (group-time ATT, Sun-Abraham, comparison)."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from panelkit.operators import bacon as B
from panelkit.plans.registry import register, rnd, with_ctes
from panelkit.sources.fixtures import SQL_P1, SQL_P2, SQL_P3, customer_year, supplier_quarter, user_day


def _bacon_sql(src: str) -> str:
    """Oracle for the decomposition over a CTE ``base(unit, t, y, g)`` (g = first treated period)."""
    return src + """,
span AS (SELECT min(t) AS lo, max(t) AS hi, max(t) - min(t) + 1 AS tt, count(DISTINCT unit) AS n FROM base),
cm AS (SELECT g, t, avg(y) AS ybar FROM base GROUP BY g, t),
cs AS (SELECT g, count(DISTINCT unit) * 1.0 / (SELECT n FROM span) AS sh,
              CASE WHEN g IS NULL THEN 0.0 ELSE ((SELECT hi FROM span) - g + 1) * 1.0 / (SELECT tt FROM span) END AS dd
       FROM base GROUP BY g),
tim AS (SELECT * FROM cs WHERE g IS NOT NULL AND g <> (SELECT lo FROM span)),
alw AS (SELECT * FROM cs WHERE g = (SELECT lo FROM span)),
unt AS (SELECT * FROM cs WHERE g IS NULL),
pairs AS (
  SELECT e.g AS treated, CAST(NULL AS INTEGER) AS control, 'Treated vs Untreated' AS type,
         (SELECT lo FROM span) AS w_lo, (SELECT hi FROM span) AS w_hi, e.g AS post_from,
         pow(e.sh + u.sh, 2) * (e.sh / (e.sh + u.sh)) * (1 - e.sh / (e.sh + u.sh)) * e.dd * (1 - e.dd) AS rw
  FROM tim e JOIN unt u ON true
  UNION ALL
  SELECT e.g, a.g, 'Later vs Always Treated', (SELECT lo FROM span), (SELECT hi FROM span), e.g,
         pow(a.sh + e.sh, 2) * (a.sh / (a.sh + e.sh)) * (1 - a.sh / (a.sh + e.sh)) * e.dd * (1 - e.dd)
  FROM tim e JOIN alw a ON true
  UNION ALL
  SELECT e.g, l.g, 'Earlier vs Later Treated', (SELECT lo FROM span), l.g - 1, e.g,
         pow((e.sh + l.sh) * (1 - l.dd), 2) * (e.sh / (e.sh + l.sh)) * (1 - e.sh / (e.sh + l.sh))
           * ((e.dd - l.dd) / (1 - l.dd)) * ((1 - e.dd) / (1 - l.dd))
  FROM tim e JOIN tim l ON e.g < l.g
  UNION ALL
  SELECT l.g, e.g, 'Later vs Earlier Treated', e.g, (SELECT hi FROM span), l.g,
         pow((e.sh + l.sh) * e.dd, 2) * (e.sh / (e.sh + l.sh)) * (1 - e.sh / (e.sh + l.sh))
           * (l.dd / e.dd) * ((e.dd - l.dd) / e.dd)
  FROM tim e JOIN tim l ON e.g < l.g),
pw AS (SELECT *, rw / sum(rw) OVER () AS weight FROM pairs),
est AS (
  SELECT p.treated, p.control, p.type, p.weight,
         avg(CASE WHEN a.t >= p.post_from THEN a.ybar - b.ybar END)
           - avg(CASE WHEN a.t < p.post_from THEN a.ybar - b.ybar END) AS estimate
  FROM pw p JOIN cm a ON a.g = p.treated
            JOIN cm b ON b.g IS NOT DISTINCT FROM p.control AND b.t = a.t
  WHERE a.t BETWEEN p.w_lo AND p.w_hi
  GROUP BY p.treated, p.control, p.type, p.weight)"""


_P1_BASE = with_ctes(SQL_P1) + """,
base AS (SELECT unit, t, y_qty AS y, min(CASE WHEN policy = 1 THEN t END) OVER (PARTITION BY unit) AS g FROM p1)"""
_P3_BASE = with_ctes(SQL_P3) + """,
base AS (SELECT unit, t, y_cnt AS y, min(CASE WHEN flag = 1 THEN t END) OVER (PARTITION BY unit) AS g FROM p3g)"""


def _pairs_out(pairs):
    return pairs.select("treated", "control", "type", rnd("estimate").alias("estimate"), rnd("weight").alias("weight"))


def _p1_pairs(spark, sf_dir):
    return B.bacon(supplier_quarter(spark, sf_dir), "y_qty", "policy", "unit", "t")


@register("bacon_pairs", _bacon_sql(_P1_BASE) + """
SELECT treated, control, type, round(estimate, 6) + 0.0 AS estimate, round(weight, 6) + 0.0 AS weight FROM est""")
def q_bacon_pairs(spark, sf_dir):
    """All 2x2 comparisons on P1 (three timing cohorts + never treated)."""
    return _pairs_out(_p1_pairs(spark, sf_dir))


@register("bacon_pairs_always", _bacon_sql(_P3_BASE) + """
SELECT treated, control, type, round(estimate, 6) + 0.0 AS estimate, round(weight, 6) + 0.0 AS weight FROM est""")
def q_bacon_pairs_always(spark, sf_dir):
    """D1 with always-treated units and no never-treated (P3 grid, first-purchase adoption)."""
    p = user_day(spark, sf_dir, grid=True)
    return _pairs_out(B.bacon(p, "y_cnt", "flag", "unit", "t"))


@register("bacon_total", _bacon_sql(_P1_BASE) + """
SELECT round(sum(estimate * weight), 6) + 0.0 AS total, count(*) AS n_pairs, round(sum(weight), 6) + 0.0 AS weight_sum FROM est""")
def q_bacon_total(spark, sf_dir):
    """D3: decomposition total (equals the static TWFE coefficient) and pair count."""
    t = B.bacon_total(_p1_pairs(spark, sf_dir))
    return t.select(rnd("total").alias("total"), "n_pairs", rnd("weight_sum").alias("weight_sum"))


@register("bacon_by_type", _bacon_sql(_P3_BASE) + """
SELECT type, count(*) AS n, round(sum(weight), 6) + 0.0 AS weight_sum,
       round(sum(weight * estimate) / sum(weight), 6) + 0.0 AS avg_estimate FROM est GROUP BY type""")
def q_bacon_by_type(spark, sf_dir):
    """Summary by comparison type."""
    p = user_day(spark, sf_dir, grid=True)
    s = B.bacon_by_type(B.bacon(p, "y_cnt", "flag", "unit", "t"))
    return s.select("type", "n", rnd("weight_sum").alias("weight_sum"), rnd("avg_estimate").alias("avg_estimate"))


@register("bacon_timing_weight", _bacon_sql(_P3_BASE) + """
SELECT round(coalesce(sum(CASE WHEN regexp_matches(type, '(?i)later|earlier') THEN weight END), 0), 6) + 0.0 AS timing_weight,
       round(coalesce(sum(CASE WHEN type IN ('Later vs Earlier Treated', 'Later vs Always Treated') THEN weight END), 0), 6) + 0.0
         AS forbidden_weight FROM est""")
def q_bacon_timing_weight(spark, sf_dir):
    """Weight on Later/Earlier comparisons (reference definition) and on forbidden ones."""
    p = user_day(spark, sf_dir, grid=True)
    w = B.timing_weight(B.bacon(p, "y_cnt", "flag", "unit", "t"))
    return w.select(rnd("timing_weight").alias("timing_weight"), rnd("forbidden_weight").alias("forbidden_weight"))


@register("balanced_subset", with_ctes(SQL_P2) + """
SELECT unit, t, y_cnt FROM p2
WHERE unit IN (SELECT unit FROM p2 GROUP BY unit
               HAVING count(*) = (SELECT max(t) - min(t) + 1 FROM p2))""")
def q_balanced_subset(spark, sf_dir):
    """Units observed in every period (fallback sample of the decomposition)."""
    return B.balanced_subset(customer_year(spark, sf_dir), "unit", "t", "y_cnt").select("unit", "t", "y_cnt")


# ---------------------------------------------------------------- E1-E8 group-time ATT

from pyspark.sql import Window  # noqa: E402

from panelkit.operators.attgt import aggte, aggte_cov, att_gt, uniform_band  # noqa: E402


def _att_sql(src: str, control: str) -> str:
    """Oracle CTEs for ATT(g,t) over ``base(unit, t, y, G, w)``; defines ``roles``, ``cell``, ``nu``."""
    ctrl = ("G IS NULL" if control == "never" else
            "G IS NULL OR (G > greatest(t, CASE WHEN t >= k THEN k - 1 ELSE t - 1 END) AND G <> k)")
    return src + f""",
per AS (SELECT count(DISTINCT t) AS tt, min(t) AS lo, max(t) AS hi FROM base),
bal AS (SELECT b.*, max(CASE WHEN t = (SELECT lo FROM per) THEN w END) OVER (PARTITION BY unit) AS w1,
               count(*) OVER (PARTITION BY unit) AS nn FROM base b WHERE y IS NOT NULL),
pan AS (SELECT unit, t, y, CASE WHEN G > (SELECT hi FROM per) THEN NULL ELSE G END AS G, w1 AS w
        FROM bal WHERE nn = (SELECT tt FROM per) AND w1 > 0),
pan2 AS (SELECT * FROM pan WHERE G IS NULL OR G > (SELECT lo FROM per)),
nu AS (SELECT count(*) AS n, avg(w) AS mw FROM pan2 WHERE t = (SELECT lo FROM per)),
coh AS (SELECT DISTINCT G AS k FROM pan2 WHERE G IS NOT NULL),
lagged AS (SELECT *, lag(y) OVER (PARTITION BY unit ORDER BY t) AS y_prev FROM pan2),
cellrows AS (
  SELECT l.unit, l.t, c.k, l.G, l.w / (SELECT mw FROM nu) AS w,
         l.y - CASE WHEN l.t >= c.k THEN b.y ELSE l.y_prev END AS dy
  FROM lagged l JOIN coh c ON true LEFT JOIN pan2 b ON b.unit = l.unit AND b.t = c.k - 1
  WHERE l.t > (SELECT lo FROM per)),
roles AS (
  SELECT *, CASE WHEN G = k THEN 'tr' WHEN {ctrl} THEN 'co' END AS role FROM cellrows),
agg AS (
  SELECT k, t, role, count(*) AS c, sum(w) AS s0, sum(w * dy) AS s1, sum(w * w) AS a0,
         sum(w * w * dy) AS a1, sum(w * w * dy * dy) AS a2
  FROM roles WHERE role IS NOT NULL AND dy IS NOT NULL GROUP BY k, t, role),
cell AS (
  SELECT tr.k AS g, tr.t, tr.s1 / tr.s0 - co.s1 / co.s0 AS att,
         sqrt(greatest(tr.a2 - 2 * (tr.s1 / tr.s0) * tr.a1 + pow(tr.s1 / tr.s0, 2) * tr.a0, 0) / pow(tr.s0, 2)
            + greatest(co.a2 - 2 * (co.s1 / co.s0) * co.a1 + pow(co.s1 / co.s0, 2) * co.a0, 0) / pow(co.s0, 2)) AS se,
         tr.c AS n_treated, co.c AS n_control, tr.s1 / tr.s0 AS m_tr, tr.s0 AS s0_tr, co.s1 / co.s0 AS m_co, co.s0 AS s0_co
  FROM agg tr JOIN agg co ON tr.k = co.k AND tr.t = co.t AND tr.role = 'tr' AND co.role = 'co')"""


_CELL_OUT = """
SELECT g, t, round(att, 6) + 0.0 AS att, round(se, 6) + 0.0 AS se, n_treated, n_control FROM cell"""

_P1_ATT = with_ctes(SQL_P1) + """,
base AS (SELECT unit, t, y_qty AS y, g AS G, w FROM p1)"""
_P1_ATT_WQ = with_ctes(SQL_P1) + """,
base AS (SELECT unit, t, y_qty AS y, g AS G, sum(y_qty) OVER (PARTITION BY unit) AS w FROM p1)"""
_P3_ATT = with_ctes(SQL_P3) + """,
base AS (SELECT unit, t, y_cnt AS y, g AS G, 1.0 AS w FROM p3g)"""


def _cells_out(res):
    c = res.cell_frame().filter(F.col("att").isNotNull())
    return c.select("g", "t", rnd("att").alias("att"), rnd("se").alias("se"), "n_treated", "n_control")


def _p1_wq(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir)
    return p.withColumn("wq", F.sum("y_qty").over(Window.partitionBy("unit")))


@register("att_gt_never", _att_sql(_P1_ATT, "never") + _CELL_OUT)
def q_att_gt_never(spark, sf_dir):
    """ATT(g,t), never-treated controls, unit weights, analytic se."""
    return _cells_out(att_gt(supplier_quarter(spark, sf_dir), "y_qty", "unit", "t", "g", "w"))


@register("att_gt_notyet", _att_sql(_P1_ATT, "notyet") + _CELL_OUT)
def q_att_gt_notyet(spark, sf_dir):
    """Not-yet-treated controls (the cohort itself never controls its own pre-periods)."""
    return _cells_out(att_gt(supplier_quarter(spark, sf_dir), "y_qty", "unit", "t", "g", "w", control="notyet"))


@register("att_gt_fallback", _att_sql(_P3_ATT, "notyet") + _CELL_OUT)
def q_att_gt_fallback(spark, sf_dir):
    """Never-treated requested on P3 (no never-treated user): falls back to not-yet."""
    res = att_gt(user_day(spark, sf_dir, grid=True), "y_cnt", "unit", "t", "g", control="never", fallback=True)
    return _cells_out(res)


@register("att_gt_se", _att_sql(_P1_ATT_WQ, "never") + _CELL_OUT)
def q_att_gt_se(spark, sf_dir):
    """Cell se with unit weights that vary across units (unit total quantity)."""
    return _cells_out(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"))


_SIMPLE_SQL = """,
pgt AS (SELECT G, sum(w / (SELECT mw FROM nu)) / (SELECT n FROM nu) AS pg FROM pan2
        WHERE t = (SELECT lo FROM per) AND G IS NOT NULL GROUP BY G),
keep AS (SELECT cell.*, pgt.pg FROM cell JOIN pgt ON pgt.G = cell.g WHERE cell.t >= cell.g AND cell.att IS NOT NULL),
tot AS (SELECT sum(pg) AS pp, sum(att * pg) AS aw FROM keep),
om AS (SELECT keep.*, pg / (SELECT pp FROM tot) AS om FROM keep),
ps AS (
  SELECT r.unit, sum(o.om * (SELECT n FROM nu) * CASE WHEN r.role = 'tr' THEN r.w * (r.dy - o.m_tr) / o.s0_tr
                                                   ELSE -r.w * (r.dy - o.m_co) / o.s0_co END) AS psi
  FROM roles r JOIN om o ON o.g = r.k AND o.t = r.t WHERE r.role IS NOT NULL AND r.dy IS NOT NULL GROUP BY r.unit),
wg AS (SELECT g AS G, sum(att) / (SELECT pp FROM tot) AS a,
              count(*) * (SELECT aw FROM tot) / pow((SELECT pp FROM tot), 2) AS b FROM keep GROUP BY g),
un AS (SELECT unit, G, w / (SELECT mw FROM nu) AS w FROM pan2 WHERE t = (SELECT lo FROM per)),
ifs AS (SELECT un.unit, coalesce(ps.psi, 0) + un.w * (coalesce(wg.a, 0) - coalesce(wg.b, 0)) AS inf
        FROM un LEFT JOIN ps ON ps.unit = un.unit LEFT JOIN wg ON wg.G = un.G)
SELECT 'simple' AS target, round((SELECT aw / pp FROM tot), 6) + 0.0 AS att,
       round(sqrt(sum(inf * inf)) / (SELECT n FROM nu), 6) + 0.0 AS se FROM ifs"""


@register("aggte_simple", _att_sql(_P1_ATT_WQ, "never") + _SIMPLE_SQL)
def q_aggte_simple(spark, sf_dir):
    """Simple aggregation (cohort-share weights over post cells) with the
    influence-function se including the weight-estimation term."""
    a = aggte(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"), "simple")
    return a.select("target", rnd("att").alias("att"), rnd("se").alias("se"))


_DYN_SQL = """,
pgt AS (SELECT G, sum(w / (SELECT mw FROM nu)) / (SELECT n FROM nu) AS pg FROM pan2
        WHERE t = (SELECT lo FROM per) AND G IS NOT NULL GROUP BY G),
keep AS (SELECT cell.*, pgt.pg, CAST(cell.t - cell.g AS INTEGER) AS e FROM cell JOIN pgt ON pgt.G = cell.g
         WHERE cell.att IS NOT NULL AND cell.t - cell.g BETWEEN -7 AND 9),
tot AS (SELECT e, sum(pg) AS pp, sum(att * pg) AS aw FROM keep GROUP BY e),
om AS (SELECT keep.*, keep.pg / tot.pp AS om, tot.pp, tot.aw FROM keep JOIN tot ON tot.e = keep.e),
ps AS (
  SELECT r.unit, o.e, sum(o.om * (SELECT n FROM nu) * CASE WHEN r.role = 'tr' THEN r.w * (r.dy - o.m_tr) / o.s0_tr
                                                       ELSE -r.w * (r.dy - o.m_co) / o.s0_co END) AS psi
  FROM roles r JOIN om o ON o.g = r.k AND o.t = r.t WHERE r.role IS NOT NULL AND r.dy IS NOT NULL
  GROUP BY r.unit, o.e),
wg AS (SELECT e, g AS G, sum(att) / max(pp) AS a, count(*) * max(aw) / pow(max(pp), 2) AS b FROM om GROUP BY e, g),
un AS (SELECT unit, G, w / (SELECT mw FROM nu) AS w FROM pan2 WHERE t = (SELECT lo FROM per)),
ue AS (SELECT un.unit, un.G, un.w, tot.e FROM un JOIN tot ON true),
ifs AS (SELECT ue.unit, ue.e, coalesce(ps.psi, 0) + ue.w * (coalesce(wg.a, 0) - coalesce(wg.b, 0)) AS inf
        FROM ue LEFT JOIN ps ON ps.unit = ue.unit AND ps.e = ue.e LEFT JOIN wg ON wg.e = ue.e AND wg.G = ue.G),
se_e AS (SELECT e, sqrt(sum(inf * inf)) / (SELECT n FROM nu) AS se FROM ifs GROUP BY e),
ov AS (SELECT unit, sum(inf) / (SELECT count(*) FROM tot WHERE e >= 0) AS x FROM ifs WHERE e >= 0 GROUP BY unit)
SELECT 'e' || CAST(tot.e AS VARCHAR) AS target, tot.e AS e, round(tot.aw / tot.pp, 6) + 0.0 AS att,
       round(se_e.se, 6) + 0.0 AS se
FROM tot JOIN se_e ON se_e.e = tot.e
UNION ALL
SELECT 'overall', CAST(NULL AS INTEGER), round((SELECT avg(aw / pp) FROM tot WHERE e >= 0), 6) + 0.0,
       round(sqrt(sum(x * x)) / (SELECT n FROM nu), 6) + 0.0 FROM ov"""


@register("aggte_dynamic", _att_sql(_P1_ATT_WQ, "never") + _DYN_SQL)
def q_aggte_dynamic(spark, sf_dir):
    """Event-time aggregation for e in [-7, 9] and the overall mean over e >= 0,
    each with its influence-function se."""
    a = aggte(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"), "dynamic", -7, 9)
    return a.select("target", "e", rnd("att").alias("att"), rnd("se").alias("se"))


@register("att_boot_se", _att_sql(_P1_ATT_WQ, "never") + _SIMPLE_SQL[: _SIMPLE_SQL.index("SELECT 'simple'")].rstrip() + """,
reps AS (
  SELECT b, sum((ascii(substr(md5('20240101|' || CAST(b AS VARCHAR) || '|' || CAST(unit AS VARCHAR)), 1, 1)) % 2 * 2 - 1) * inf) / (SELECT n FROM nu) AS theta
  FROM ifs, (SELECT unnest(range(999)) AS b) GROUP BY b)
SELECT 'simple' AS target, CAST(NULL AS INTEGER) AS e, round((SELECT aw / pp FROM tot), 6) + 0.0 AS att,
       round((SELECT sqrt(sum(inf * inf)) FROM ifs) / (SELECT n FROM nu), 6) + 0.0 AS se,
       round((quantile_cont(theta, 0.75) - quantile_cont(theta, 0.25)) / 1.3489795003921634, 6) + 0.0 AS boot_se FROM reps""")
def q_att_boot(spark, sf_dir):
    """Multiplier-bootstrap se (seeded hashed Rademacher draws) next to the analytic se."""
    res = att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq")
    a = aggte(res, "simple", boot_draws=999, seed=20240101)
    return a.withColumns({c: rnd(c) for c in ("att", "se", "boot_se")})


_DYN_CTES = _DYN_SQL[: _DYN_SQL.index("SELECT 'e' || CAST(tot.e")].rstrip()


@register("att_uniform_band", _att_sql(_P1_ATT_WQ, "never") + _DYN_CTES + """,
signs AS (
  SELECT un.unit, b, ascii(substr(md5('20240101|' || CAST(b AS VARCHAR) || '|' || CAST(unit AS VARCHAR)), 1, 1)) % 2 * 2 - 1 AS v
  FROM un, (SELECT unnest(range(999)) AS b)),
reps AS (SELECT ifs.e, b, sum(v * inf) / (SELECT n FROM nu) AS theta FROM ifs JOIN signs ON signs.unit = ifs.unit GROUP BY ifs.e, b),
spread AS (SELECT e, (quantile_cont(theta, 0.75) - quantile_cont(theta, 0.25)) / 1.3489795003921634 AS se FROM reps GROUP BY e),
top AS (SELECT b, max(abs(theta / se)) AS m FROM reps JOIN spread ON spread.e = reps.e WHERE se > 0 GROUP BY b),
crit AS (SELECT m AS c FROM (SELECT m, row_number() OVER (ORDER BY m) AS r FROM top) WHERE r = 950)
SELECT 'e' || CAST(tot.e AS VARCHAR) AS target, tot.e AS e, round(aw / pp, 6) + 0.0 AS att, round(se, 6) + 0.0 AS boot_se, round(c, 6) + 0.0 AS crit,
       round(aw / pp - c * se, 6) + 0.0 AS band_low, round(aw / pp + c * se, 6) + 0.0 AS band_high
FROM tot JOIN spread ON spread.e = tot.e, crit""")
def q_att_band(spark, sf_dir):
    """Simultaneous 95% bands of the event-time effects from 999 multiplier draws (sup-t)."""
    a = uniform_band(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"), "dynamic", -7, 9, 999, 20240101)
    return a.withColumns({c: rnd(c) for c in ("att", "boot_se", "crit", "band_low", "band_high")})


# ---------------------------------------------------------------- E9-E14, F3, F7-F14

from panelkit.functions import scalar as S  # noqa: E402
from panelkit.operators.compare import comparison_table, compare_series, pretrend_rows, pretrend_stat, pretrend_test, pretrend_wald  # noqa: E402
from panelkit.operators.feols import feols, feols_multi  # noqa: E402
from panelkit.operators.regression import event_study, event_study_fit  # noqa: E402
from panelkit.operators.sunab import sunab  # noqa: E402


from panelkit.plans.q_regression import _P1R, _binned, _rounded  # noqa: E402
from panelkit.plans.sqlgen import chi2_p_sql, normal_p_sql, sweep_ctes, t_pvalues, wald_ctes  # noqa: E402

# the saturated regression of Sun-Abraham on laid-out indicators: cohorts and quarters of P1 with their weighted shares
_SA = {f"{g}:{t - g}": (g, t) for g in (8, 14, 20) for t in range(32) if t != g - 1}


def _sunab_ctes(groups: dict[str, list[str]]) -> str:
    """``groups``: name -> cells that are averaged by their share of the weighted observations."""
    share = lambda c: f"(SELECT coalesce(sum(w), 0) FROM use WHERE g = {_SA[c][0]} AND t = {_SA[c][1]})"
    # cells of quarters that the data lack weigh nothing and are left out by the fit
    wts = {name: {c: f"{share(c)} / (SELECT sum(w) FROM use WHERE " + " OR ".join(f"g = {_SA[x][0]} AND t = {_SA[x][1]}" for x in cells) + ")" for c in cells}
           for name, cells in groups.items()}
    return ("WITH RECURSIVE " + ",\n".join(_P1R) + ",\nuse AS (SELECT * FROM p1r)," +
            sweep_ctes("sa", "use", "y_qty", {c: f"coalesce(g = {g} AND t = {t}, false)::INTEGER" for c, (g, t) in _SA.items()}, "w", lincoms=wts, partial=True))


_SA_ATT = {"att": [c for c, (g, t) in _SA.items() if t >= g]}
_SA_ES = {f"e{e}": [c for c, (g, t) in _SA.items() if t - g == e] for e in sorted({t - g for g, t in _SA.values()})}
def _raw(sql: str) -> str:
    """The aggregate without its rounding, for SQL that goes on with it."""
    for name in ("att", "se"):
        sql = re.sub(rf"round\((.*), 6\) \+ 0\.0 AS {name}", rf"\1 AS {name}", sql)
    return re.sub(r"round\((.*), 6\) \+ 0\.0(,| FROM)", r"\1\2", sql)


_DYN_ROWS = lambda src: "(" + _att_sql(src, "never") + _raw(_DYN_SQL) + ")"


@register("sunab_coefs", with_ctes(SQL_P1) + """,
ref AS (SELECT unit, y_qty AS yb, g FROM p1),
d AS (SELECT p.unit, p.t, c.g AS k, p.g AS G, p.y_qty - r.y_qty AS dy
      FROM p1 p JOIN (SELECT DISTINCT g FROM p1 WHERE g IS NOT NULL) c ON true
      JOIN p1 r ON r.unit = p.unit AND r.t = c.g - 1
      WHERE p.t <> c.g - 1)
SELECT k AS g, CAST(t - k AS INTEGER) AS e,
       round(avg(CASE WHEN G = k THEN dy END) - avg(CASE WHEN G IS NULL THEN dy END), 6) + 0.0 AS estimate
FROM d GROUP BY k, t""")
def q_sunab_coefs(spark, sf_dir):
    """Saturated cohort x relative-period coefficients (ref -1).  On a balanced,
    unweighted panel they equal never-treated long differences to base g-1 (oracle form)."""
    sa = sunab(supplier_quarter(spark, sf_dir), "y_qty", "g", "unit", "t")
    rows = [(g, e, b) for g, e, b, s in sa.coefs()]
    return spark.createDataFrame(rows, "g int, e int, estimate double").select("g", "e", rnd("estimate").alias("estimate"))


@register("sunab_att", _sunab_ctes(_SA_ATT) + f"""
SELECT round(estimate, 6) + 0.0 AS att, round(se, 6) + 0.0 AS se, round({normal_p_sql('sa_out.t_stat')}, 6) + 0.0 AS p_value
FROM sa_out WHERE term = 'att'""")
def q_sunab_att(spark, sf_dir):
    """Sun-Abraham ATT (weighted by cell observation shares) with its se."""
    sa = sunab(supplier_quarter(spark, sf_dir), "y_qty", "g", "unit", "t", w="w")
    est, se = sa.att()
    from panelkit.functions.dist import p_normal
    return _rounded(spark.createDataFrame([(est, se, p_normal(est / se))], "att double, se double, p_value double"), "att", "se", "p_value")


@register("sunab_es", _sunab_ctes(_SA_ES) + """
SELECT CAST(substr(term, 2) AS INTEGER) AS e, round(estimate, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se
FROM sa_out WHERE term LIKE 'e%' AND estimate IS NOT NULL""")
def q_sunab_es(spark, sf_dir):
    """Sun-Abraham event-study aggregation by relative period."""
    sa = sunab(supplier_quarter(spark, sf_dir), "y_qty", "g", "unit", "t", w="w")
    return _rounded(spark.createDataFrame(sa.event_study(), "e int, estimate double, se double"), "estimate", "se")


@register("pretrend_test", _att_sql(_P1_ATT, "never") + """
SELECT round(sum(pow(att / se, 2)), 6) + 0.0 AS chi2, count(*) AS df FROM cell WHERE t < g""")
def q_pretrend_test(spark, sf_dir):
    """Joint pre-period statistic over the pre-treatment ATT(g,t) cells."""
    cells = att_gt(supplier_quarter(spark, sf_dir), "y_qty", "unit", "t", "g", "w").cell_frame() \
        .filter(F.col("att").isNotNull()).withColumn("tau", F.col("t") - F.col("g"))
    s = pretrend_stat(cells, "tau", "att", "se")
    return s.select(rnd("chi2").alias("chi2"), "df")


@register("pretrend_dynamic", f"""
WITH s AS (SELECT sum(pow(att / se, 2)) AS chi2, count(*) AS df, count(*) FILTER (abs(att / se) > 1.96) AS n_significant
           FROM {_DYN_ROWS(_P1_ATT_WQ)} WHERE e < 0),
v AS (SELECT *, {chi2_p_sql('s.chi2', 's.df')} AS p FROM s)
SELECT round(chi2, 6) + 0.0 AS chi2, df, round(p, 6) + 0.0 AS p_value,
       CASE WHEN p < 0.05 THEN 'joint test rejects at 5%' ELSE 'not rejected' END AS verdict, n_significant FROM v""")
def q_pretrend_dynamic(spark, sf_dir):
    """E12 on the event-time series, with chi-square p-value and verdict."""
    a = aggte(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"), "dynamic", -7, 9)
    r = pretrend_test(a.filter(F.col("e").isNotNull()), "e", "att", "se")
    return r.withColumns({"chi2": rnd("chi2"), "p_value": rnd("p_value")})


def _wald_sql() -> str:
    es = sweep_ctes("es", "p1r", "y_qty", _binned(-7, 9, -1), "w")
    att = "(" + _att_sql(_P1_ATT_WQ, "never") + _DYN_CTES
    parts = [",\n".join(_P1R), es, f"""
esx AS (SELECT psi.unit, o.pos AS j, psi.psi * sqrt((ng / (ng - 1.0)) * ((n.n - 1.0) / (n.n - kk))) AS x
  FROM es_psi psi JOIN es_out o ON o.pos = psi.pos, es_n n, es_k WHERE CAST(o.term AS INTEGER) < 0),
esb AS (SELECT pos AS j, estimate AS b FROM es_out WHERE CAST(term AS INTEGER) < 0)""",
             f"""
gtx AS (SELECT unit, e AS j, inf / n AS x FROM {att}
  SELECT unit, e, inf, (SELECT n FROM nu) AS n FROM ifs WHERE e < 0)),
gtb AS (SELECT e AS j, aw / pp AS b FROM {att}
  SELECT e, aw, pp FROM tot WHERE e < 0))""", wald_ctes("esw", "esx", "esb"), wald_ctes("gtw", "gtx", "gtb")]
    row = lambda name, m: (f"SELECT '{name}' AS method, round(chi2, 6) + 0.0 AS chi2, df, n_omitted, round(p, 6) + 0.0 AS p_value, "  # noqa: E731
                           f"CASE WHEN p < 0.05 THEN 'joint test rejects at 5%' ELSE 'not rejected' END AS verdict "
                           f"FROM (SELECT *, {chi2_p_sql('o.chi2', 'o.df')} AS p FROM {m}_out o)")
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + row("event study", "esw") + "\nUNION ALL\n" + row("group-time ATT", "gtw")


@register("pretrend_wald", _wald_sql())
def q_pretrend_wald(spark, sf_dir):
    """E12 with covariances: joint tests of the effects before treatment, from the event study's clustered
    covariance and from the Gram matrix of the group-time influence functions."""
    fit, ks, terms = event_study_fit(_tau(spark, sf_dir), "y_qty", "tau", "never", "unit", "t", weight="w", lo=-7, hi=9)
    at = [fit.terms.index(x) for x in terms]
    names, b, V = aggte_cov(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"), "dynamic", -7, -1)
    r = pretrend_wald(spark, [("event study", np.array(ks), fit.beta[at], fit.vcov[np.ix_(at, at)]),
                              ("group-time ATT", np.array([int(x[1:]) for x in names]), b, V)])
    return r.withColumns({"chi2": rnd("chi2"), "p_value": rnd("p_value")})


@register("pretrend_rows", f"""
SELECT e AS tau, round(att, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se, round(att / se, 6) + 0.0 AS z,
       CASE WHEN abs(att / se) > 1.96 THEN '*' ELSE '' END AS star FROM {_DYN_ROWS(_P1_ATT_WQ)} WHERE e < 0""")
def q_pretrend_rows(spark, sf_dir):
    """E12 per event time, with its star."""
    a = aggte(att_gt(_p1_wq(spark, sf_dir), "y_qty", "unit", "t", "g", "wq"), "dynamic", -7, 9)
    return _rounded(pretrend_rows(a.filter(F.col("e").isNotNull()), "e", "att", "se"), "estimate", "se", "z")


def _tau(spark, sf_dir):
    return supplier_quarter(spark, sf_dir).withColumn("never", F.col("g").isNull()) \
        .withColumn("tau", (F.col("t") - F.col("g")).cast("int"))


@register("compare_series", "WITH RECURSIVE " + ",\n".join(_P1R) + "," + sweep_ctes("es", "p1r", "y_qty", _binned(-7, 9, -1), "w") + f""",
two AS (SELECT CAST(term AS INTEGER) AS tau, estimate, se, 'TWFE' AS method FROM es_out
  UNION ALL SELECT -1, 0.0, 0.0, 'TWFE'
  UNION ALL SELECT e, att, se, 'Group-time ATT' FROM {_DYN_ROWS(_P1_ATT)} WHERE e IS NOT NULL)
SELECT tau, round(estimate, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se, round(estimate - 1.96 * se, 6) + 0.0 AS ci_low,
       round(estimate + 1.96 * se, 6) + 0.0 AS ci_high, method FROM two""")
def q_compare_series(spark, sf_dir):
    """TWFE event study and group-time ATT event-time series stacked, tau in [-7, 9]."""
    tw = event_study(_tau(spark, sf_dir), "y_qty", "tau", "never", "unit", "t", weight="w", lo=-7, hi=9)
    cs = aggte(att_gt(supplier_quarter(spark, sf_dir), "y_qty", "unit", "t", "g", "w"), "dynamic", -7, 9)
    r = compare_series(tw, cs)
    return r.withColumns({c: rnd(c) for c in ("estimate", "se", "ci_low", "ci_high")})


def _compare_sql():
    fits = [sweep_ctes(f"c_{y}", "p1r", y, {x: x for x in ("post", "trend", "post_trend")}, "w",
                       lincoms={"five": {"post": "1.0", "post_trend": "5.0"}}) for y in ("y_qty", "y_cnt")]
    att = lambda y: "(" + _att_sql(_P1_ATT.replace("y_qty AS y,", f"{y} AS y,"), "never") + _raw(_SIMPLE_SQL) + ")"
    fit = lambda y: f"(SELECT * FROM {t_pvalues(f'(SELECT * REPLACE (n - 3 AS df) FROM c_{y}_out)')} WHERE term = 'five')"
    return "WITH RECURSIVE " + ",".join([",\n".join(_P1R), *fits]) + "\n" + "\nUNION ALL\n".join(
        f"""SELECT '{y}' AS outcome, printf('%.2f (%.2f)', f.estimate, f.se) AS twfe_5yr_effect, printf('%.3f', f.p_value) AS twfe_p_value,
  printf('%.2f (%.2f)', a.att, a.se) AS att, printf('%.3f', {normal_p_sql('a.att / a.se')}) AS att_p_value FROM {fit(y)} f, {att(y)} a"""
        for y in ("y_qty", "y_cnt"))


@register("compare_table", _compare_sql())
def q_compare_table(spark, sf_dir):
    """Per outcome, the TWFE 5-period trend-break effect (p with the reference's
    df = n - k) next to the simple group-time ATT (normal p), formatted."""
    from panelkit.plans.q_regression import _p1r
    p = _p1r(spark, sf_dir).persist()      # three estimations read the same prepared panel
    rows = []
    fits = feols_multi(p, [(y, ["post", "trend", "post_trend"]) for y in ("y_qty", "y_cnt")], "unit", "t",
                       weight="w", df_t="ref")
    for y, fit in zip(("y_qty", "y_cnt"), fits):
        lc = fit.lincom({"post": 1.0, "post_trend": 5.0})
        a = aggte(att_gt(p, y, "unit", "t", "g", "w"), "simple").first()
        rows.append((y, lc["estimate"], lc["se"], lc["p"], a["att"], a["se"]))
    p.unpersist()
    return comparison_table(spark, rows)


@register("stars_format", _att_sql(_P1_ATT, "never") + r""",
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(printf('%.2f', round(att / 0.01) * 0.01), '0+$', ''),
                 '\.$', ''), '^(-?)0\.', '\1.') AS sn FROM cell)
SELECT g, t, printf('%.2f (%.2f)', att, se) AS est_se, printf('%.3f', se) AS se_3dp,
       substr(CASE WHEN length(CASE WHEN sn = '-0' THEN '0' ELSE sn END) < 3
                   THEN (CASE WHEN sn = '-0' THEN '0' ELSE sn END) || '0' ELSE (CASE WHEN sn = '-0' THEN '0' ELSE sn END) END, 1, 6) AS coef,
       CAST(regexp_extract('tau::' || CAST(t - g AS VARCHAR), '(-?\d+)$', 1) AS INTEGER) AS tau,
       regexp_matches(CASE WHEN t >= g THEN 'Later vs Earlier' ELSE 'Treated vs Untreated' END, '(?i)later|earlier') AS timing,
       round(att - 1.96 * se, 6) + 0.0 AS ci_low, round(att + 1.96 * se, 6) + 0.0 AS ci_high,
       round(abs(att), 6) + 0.0 AS abs_att, round(sqrt(n_treated), 6) + 0.0 AS sqrt_n,
       round(round(att / 0.5) * 0.5, 6) + 0.0 AS att_half, att IS NULL AS missing
FROM f""")
def q_stars_format(spark, sf_dir):
    """Formatting and scalar helpers on the ATT(g,t) table."""
    c = att_gt(supplier_quarter(spark, sf_dir), "y_qty", "unit", "t", "g", "w").cell_frame().filter(F.col("att").isNotNull())
    lo, hi = S.ci95("att", "se")
    typ = F.when(F.col("t") >= F.col("g"), "Later vs Earlier").otherwise("Treated vs Untreated")
    return c.select("g", "t", S.fmt_est_se("att", "se").alias("est_se"), S.fmt_num("se").alias("se_3dp"),
                    S.pad_coef("att").alias("coef"),
                    S.tau_of(F.concat(F.lit("tau::"), (F.col("t") - F.col("g")).cast("string"))).alias("tau"),
                    S.is_timing_type(typ).alias("timing"), rnd(lo).alias("ci_low"), rnd(hi).alias("ci_high"),
                    rnd(F.abs("att")).alias("abs_att"), rnd(F.sqrt("n_treated")).alias("sqrt_n"),
                    rnd(S.round_to("att", 0.5)).alias("att_half"), S.is_missing("att").alias("missing"))


@register("period_range", with_ctes(SQL_P2) + """
SELECT CAST(unnest(range((SELECT min(t) FROM p2), (SELECT max(t) FROM p2) + 1)) AS INTEGER) AS t""")
def q_period_range(spark, sf_dir):
    """every period from the panel's first to last."""
    return S.period_range(customer_year(spark, sf_dir), "t").select(F.col("t").cast("int").alias("t"))


@register("cell_stars", _att_sql(_P1_ATT, "never") + f""",
pv AS (SELECT g, t, att, se, {normal_p_sql('cell.att / cell.se')} AS p FROM cell),
st AS (SELECT *, CASE WHEN p <= 0.01 THEN '***' WHEN p <= 0.05 THEN '**' WHEN p <= 0.10 THEN '*' ELSE '' END AS stars FROM pv)
SELECT g, t, round(att, 6) + 0.0 AS att, round(se, 6) + 0.0 AS se, round(p, 6) + 0.0 AS p_value, stars, printf('%.2f', att) || stars AS label FROM st""")
def q_cell_stars(spark, sf_dir):
    """Two-sided normal p-values of the ATT(g,t) cells (a bounded, driver-side
    table) and their significance stars as a Spark expression."""
    from panelkit.functions.dist import p_normal
    res = att_gt(supplier_quarter(spark, sf_dir), "y_qty", "unit", "t", "g", "w")
    rows = [(c["g"], c["t"], c["att"], c["se"], p_normal(c["att"] / c["se"]) if c["se"] else None)
            for c in res.cells if c["att"] is not None]
    df = spark.createDataFrame(rows, "g int, t int, att double, se double, p_value double")
    df = df.withColumn("stars", S.stars("p_value")) \
           .withColumn("label", F.concat(S.fmt_num("att", "%.2f"), F.col("stars")))
    return _rounded(df, "att", "se", "p_value")


@register("bacon_fallback", with_ctes(SQL_P2) + """,
bal AS (SELECT * FROM p2 WHERE unit IN (SELECT unit FROM p2 GROUP BY unit
                                        HAVING count(*) = (SELECT max(t) - min(t) + 1 FROM p2))),
""" + _bacon_sql("base AS (SELECT unit, t, y_cnt AS y, min(CASE WHEN t >= g THEN t END) OVER (PARTITION BY unit) AS g FROM bal)") + """
SELECT treated, control, type, round(estimate, 6) + 0.0 AS estimate, round(weight, 6) + 0.0 AS weight FROM est""")
def q_bacon_fallback(spark, sf_dir):
    """Decomposition on the unbalanced customer-year panel: falls back to the
    units observed in every year (as the reference's error path does)."""
    p = customer_year(spark, sf_dir).withColumn("d", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int"))
    return _pairs_out(B.bacon_balanced(p, "y_cnt", "d", "unit", "t"))
