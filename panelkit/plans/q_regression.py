"""Queries for R1-R14 (fixed-effects regressions) and S10 (regression table).

SQL-checkable ones use the balanced P1 panel with the unit-constant weight w,
where exact two-way absorption reduces to double demeaning (the oracle's form);
the Spark side always runs the general absorption."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions.scalar import reg_table
from panelkit.operators import panel as P
from panelkit.operators.feols import coef_series, feols, feols_multi
from panelkit.operators.regression import Policy, event_study, onestep, stage1, stage2
from panelkit.plans.registry import register, rnd
from panelkit.plans.sqlgen import fe_ols_sql, sweep_ctes, t_pvalues
from panelkit.sources.fixtures import SQL_P1, supplier_quarter
from panelkit.sources.io import read_table

# P1 with R-form trend-break terms (offset 0)
SQL_P1R = """
p1r AS (
  SELECT unit, t, y_qty, y_cnt, w,
         CAST(g IS NOT NULL AND t >= g AS INTEGER) AS post,
         CAST(coalesce(t - g, 0) AS INTEGER) AS trend,
         CAST(g IS NOT NULL AND t >= g AS INTEGER) * coalesce(t - g, 0) AS post_trend
  FROM p1)"""


def _dm_cte(y: str, xs: list[str]) -> str:
    cols = [y, *xs]
    names = ["yy"] + [f"x{i}" for i in range(1, len(xs) + 1)]
    parts = []
    for c, nm in zip(cols, names):
        parts.append(f"{c} - avg({c}) OVER (PARTITION BY unit) - sum(w * {c}) OVER (PARTITION BY t) / sum(w) OVER (PARTITION BY t)"
                     f" + sum(w * {c}) OVER () / sum(w) OVER () AS {nm}")
    return f"dm AS (SELECT unit, t, w, {', '.join(parts)} FROM p1r)"


def _p1r(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir).withColumn("never", F.col("g").isNull()) \
        .withColumn("tau", (F.col("t") - F.col("g")).cast("int"))
    return P.trend_break_terms(p, "tau", "never")


def _coef_rows(spark, fit):
    rows = [(term, b, s, tt) for term, b, s, tt, _p in fit.rows()]
    return spark.createDataFrame(rows, "term string, estimate double, se double, t_stat double") \
                .select("term", *[rnd(c).alias(c) for c in ("estimate", "se", "t_stat")])


def _twfe_sql(xs):
    return "WITH " + ",\n".join([SQL_P1.strip(), SQL_P1R.strip()]) + ",\n" + fe_ols_sql(
        _dm_cte("y_qty", xs), xs, "SELECT count(DISTINCT t) FROM p1r")


@register("twfe_2a", _twfe_sql(["post"]))
def q_twfe_2a(spark, sf_dir):
    """Mean shift, unit + period effects, weights, cluster-robust se."""
    return _coef_rows(spark, feols(_p1r(spark, sf_dir), "y_qty", ["post"], "unit", "t", weight="w"))


@register("twfe_2b", _twfe_sql(["post", "trend"]))
def q_twfe_2b(spark, sf_dir):
    """Mean shift + trend."""
    return _coef_rows(spark, feols(_p1r(spark, sf_dir), "y_qty", ["post", "trend"], "unit", "t", weight="w"))


@register("twfe_2c", _twfe_sql(["post", "trend", "post_trend"]))
def q_twfe_2c(spark, sf_dir):
    """Trend break."""
    return _coef_rows(spark, feols(_p1r(spark, sf_dir), "y_qty", ["post", "trend", "post_trend"], "unit", "t", weight="w"))


@register("lincom_5yr", "WITH " + ",\n".join([SQL_P1.strip(), SQL_P1R.strip()]) + ",\n" + fe_ols_sql(
    _dm_cte("y_qty", ["post", "trend", "post_trend"]), ["post", "trend", "post_trend"],
    "SELECT count(DISTINCT t) FROM p1r", lincom={"post": 1.0, "post_trend": 5.0}))
def q_lincom(spark, sf_dir):
    """5-period effect post + 5 * post_trend of model 2C with its delta-method se."""
    fit = feols(_p1r(spark, sf_dir), "y_qty", ["post", "trend", "post_trend"], "unit", "t", weight="w")
    lc = fit.lincom({"post": 1.0, "post_trend": 5.0})
    return spark.createDataFrame([(lc["estimate"], lc["se"], lc["t"])], "estimate double, se double, t_stat double") \
                .select(*[rnd(c).alias(c) for c in ("estimate", "se", "t_stat")])


@register("fit_stats", "WITH " + ",\n".join([SQL_P1.strip(), SQL_P1R.strip()]) + ",\n" + fe_ols_sql(
    _dm_cte("y_qty", ["post", "trend", "post_trend"]), ["post", "trend", "post_trend"],
    "SELECT count(DISTINCT t) FROM p1r", stats=True))
def q_fit_stats(spark, sf_dir):
    """N, units, K, weighted SSR and within R2 of model 2C."""
    fit = feols(_p1r(spark, sf_dir), "y_qty", ["post", "trend", "post_trend"], "unit", "t", weight="w")
    return spark.createDataFrame([(fit.n, fit.n_units, fit.K, fit.ssr, fit.r2_within)],
                                 "n long, n_units long, K long, ssr_w double, r2_within double") \
                .select("n", "n_units", "K", (F.round("ssr_w", 4) + 0.0).alias("ssr_w"), rnd("r2_within").alias("r2_within"))


def _rounded(df, *cols):
    """``df`` with double columns rounded as the oracle's."""
    return df.select(*[rnd(c).alias(c) if c in cols else c for c in df.columns])


ESTIMATES = ("estimate", "se", "t_stat", "p_value")
_SQL_EST = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ESTIMATES)
_SQL_ROWS = f"SELECT term, {_SQL_EST}, n FROM "
_P1R = [SQL_P1.strip(), SQL_P1R.replace("y_cnt, w,", "y_cnt, w, w_cell, g, g2,").strip()]
_SQL_TERMS = {"2A": ["post"], "2B": ["post", "trend"], "2C": ["post", "trend", "post_trend"]}
_TWFE = {f"{y}_{m}": (y, m, xs) for y in ("y_qty", "y_cnt") for m, xs in _SQL_TERMS.items()}
_SQL_TWFE = "WITH RECURSIVE " + ",".join([",\n".join(_P1R), *(
    sweep_ctes(f"f_{k}", "p1r", y, {x: x for x in xs}, "w_cell") for k, (y, _, xs) in _TWFE.items())]) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{y}' AS outcome, '{m}' AS model, term, {_SQL_EST}, n FROM {t_pvalues(f'f_{k}_out')}" for k, (y, m, _) in _TWFE.items())


def _binned(lo, hi, ref):
    """Event-time dummies whose end points collect the tails."""
    tau = f"CASE WHEN t - g < {lo} THEN {lo} WHEN t - g > {hi} THEN {hi} ELSE t - g END"
    return {f"{k}": f"coalesce({tau} = {k}, false)::INTEGER" for k in range(lo, hi + 1) if k != ref}


def _series_sql(source, where, reference):
    rows = f"""SELECT CAST(term AS INTEGER) AS tau, round(estimate, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se,
  round(estimate - 1.96 * se, 6) + 0.0 AS ci_low, round(estimate + 1.96 * se, 6) + 0.0 AS ci_high FROM es_out"""
    return ("WITH RECURSIVE " + ",\n".join(_P1R) + f",\nuse AS (SELECT * FROM {source} WHERE {where})," + sweep_ctes("es", "use", "y_qty", _binned(-7, 9, -1), "w_cell")
            + "\n" + rows + ("\nUNION ALL SELECT -1, 0.0, 0.0, 0.0, 0.0" if reference else ""))


@register("twfe_models", _SQL_TWFE)
def q_twfe_models(spark, sf_dir):
    """R3-R5 for two outcomes from ONE absorption (the outcome loop costs one shuffle)."""
    specs = [(y, xs) for y in ("y_qty", "y_cnt")
             for xs in (["post"], ["post", "trend"], ["post", "trend", "post_trend"])]
    fits = feols_multi(_p1r(spark, sf_dir), specs, "unit", "t", weight="w_cell")
    rows = []
    for (y, xs), fit in zip(specs, fits):
        model = {1: "2A", 2: "2B", 3: "2C"}[len(xs)]
        for term, b, s, tt, p in fit.rows():
            rows.append((y, model, term, b, s, tt, p, fit.n))
    return _rounded(spark.createDataFrame(rows, "outcome string, model string, term string, estimate double, se double, "
                                                "t_stat double, p_value double, n long"), *ESTIMATES)


@register("event_study", _series_sql("p1r", "true", True))
def q_event_study(spark, sf_dir):
    """Binned event study (ref -1) with the reference row added."""
    p = supplier_quarter(spark, sf_dir).withColumn("never", F.col("g").isNull()) \
        .withColumn("tau", (F.col("t") - F.col("g")).cast("int"))
    return _rounded(event_study(p, "y_qty", "tau", "never", "unit", "t", weight="w_cell", lo=-7, hi=9, ref=-1), "estimate", "se", "ci_low", "ci_high")


@register("coef_series", _series_sql("p1r", "g IS NOT NULL", False))
def q_coef_series(spark, sf_dir):
    """R10 + F13: event-study series with 95% intervals, never-adopters dropped (R behaviour)."""
    p = supplier_quarter(spark, sf_dir).withColumn("never", F.col("g").isNull()) \
        .withColumn("tau", (F.col("t") - F.col("g")).cast("int"))
    return _rounded(event_study(p, "y_qty", "tau", "never", "unit", "t", weight="w_cell", lo=-7, hi=9, ref=-1,
                                drop_never=True, add_reference=False), "estimate", "se", "ci_low", "ci_high")


def _two_policies(spark, sf_dir):
    return supplier_quarter(spark, sf_dir).withColumns({
        "never1": F.col("g").isNull(), "never2": F.col("g2").isNull(),
        "tau1": (F.col("t") - F.col("g")).cast("int"), "tau2": (F.col("t") - F.col("g2")).cast("int"),
        "ctrl": F.log1p(F.col("w_cell"))})




POLICIES = [Policy("s", "tau2", "never2", -7, 3), Policy("c", "tau1", "never1", -7, 9)]


def _onestep_columns():
    """The one-step columns of both policies, by name, for the oracle."""
    out = {}
    for p, g in zip(POLICIES, ("g2", "g")):
        t, is_in = f"coalesce(t - {g}, 0)", f"(coalesce(t - {g}, 0) BETWEEN {p.lo} AND {p.hi})"
        treated = f"({g} IS NOT NULL AND {t} >= 0 AND {is_in})::INTEGER"
        out |= {f"{p.name}_range": f"{is_in}::INTEGER", f"{p.name}_policy": treated, f"{p.name}_L": f"({t} < {p.lo})::INTEGER", f"{p.name}_R": f"({t} > {p.hi})::INTEGER",
                f"{p.name}_trend": f"{is_in}::INTEGER * {t}", f"{p.name}_break": f"{treated} * {t} + ({is_in} AND {t} >= 0)::INTEGER"}
    return out


def _onestep_sql():
    cols = _onestep_columns()
    parts, picks = [], []
    for model, add in (("3a", ()), ("3b", ("trend",)), ("3c", ("trend", "break"))):
        use = {c: cols[c] for p in POLICIES for c in [*(f"{p.name}_{x}" for x in ("range", "policy", "L", "R")), *(f"{p.name}_{x}" for x in add)]}
        five = {f"{p.name}: 5-year effect": {f"{p.name}_policy": "1.0", f"{p.name}_break": "5.0"} for p in POLICIES} if model == "3c" else {}
        parts.append(sweep_ctes(f"o{model}", "p1r", "y_qty", use | {"ctrl": "ln(1 + w_cell)"}, "w", lincoms=five))
        picks.append(f"SELECT '{model}' AS model, term, {_SQL_EST}, n FROM {t_pvalues(f'o{model}_out')} WHERE estimate IS NOT NULL OR term NOT LIKE '%effect'")
    return "WITH RECURSIVE " + ",".join([",\n".join(_P1R), *parts]) + "\n" + "\nUNION ALL\n".join(picks)


def _stage1_ctes(policies):
    """CTE ``s1_out`` of the stage-1 fit and ``sigmas`` (tau, taub, tause) of the last policy. policies: (prefix, g column, lo, hi)."""
    dummies = {f"{p}{k}": f"coalesce(t - {g} = {k}, false)::INTEGER" for p, g, lo, hi in policies for k in range(lo, hi + 1)}
    tails = {f"{p}{s}": f"coalesce(t - {g} {c}, false)::INTEGER" for p, g, lo, hi in policies for s, c in (("L", f"< {lo}"), ("R", f"> {hi}"))}
    p, g, lo, hi = policies[-1]
    fit = sweep_ctes("s1", "p1r", "y_qty", dummies | {"ctrl": "ln(1 + w_cell)"} | tails, "w_cell", iid=True)
    values = ", ".join(f"({k}, '{p}{k}')" for k in range(lo, hi + 1))
    return ("WITH RECURSIVE " + ",\n".join(_P1R) + "," + fit + f""",
names(tau, term) AS (VALUES {values}),
sigmas AS (SELECT names.tau, estimate AS taub, se AS tause FROM names JOIN s1_out USING (term) WHERE names.tau IN (SELECT t - {g} FROM p1r))""")


_SQL_SIGMAS = "\nSELECT CAST(tau AS INTEGER) AS tau, round(taub, 6) + 0.0 AS taub, round(tause, 6) + 0.0 AS tause FROM sigmas"
_STAGE1 = [("a", "g", -10, 5)]
_STAGE2 = {"2a": ["post"], "2b": ["post", "tau"], "2c": ["post", "tau", "post_trend"]}
_STAGE2_COLS = {"post": "(tau >= 0)::INTEGER", "tau": "tau", "post_trend": "(tau >= 0)::INTEGER * (tau + 1)"}


def _stage2_sql():
    fits = [sweep_ctes(f"s{m}", "s2", "taub", {x: _STAGE2_COLS[x] for x in xs} | {"const": "1.0"}, "1.0 / tause", fe=False, iid=True,
                       lincoms={"post + 5*post_trend": {"post": "1.0", "post_trend": "5.0"}} if m == "2c" else None) for m, xs in _STAGE2.items()]
    picks = [f"SELECT '{m}' AS model, term, {_SQL_EST}, n, round(r2, 6) + 0.0 AS r2 FROM {t_pvalues(f's{m}_out')}" for m in _STAGE2]
    return (_stage1_ctes(_STAGE1) + ",\ns2 AS (SELECT tau AS unit, 0 AS t, * FROM sigmas WHERE taub IS NOT NULL)," + ",".join(fits) + "\n" + "\nUNION ALL\n".join(picks))


@register("onestep_two_policy", _onestep_sql())
def q_onestep(spark, sf_dir):
    """One-step models of two policies with range flags, tails and a control, clustered; the
    5-period effect of either policy from 3c."""
    rows = []
    for model, (fit, effects) in onestep(_two_policies(spark, sf_dir), "y_qty", POLICIES, "unit", "t", weight="w", controls=["ctrl"]).items():
        rows += [(model, *r, fit.n) for r in fit.rows()]
        rows += [(model, f"{name}: 5-year effect", lc["estimate"], lc["se"], lc["t"], lc["p"], fit.n) for name, lc in effects.items()]
    return _rounded(spark.createDataFrame(rows, "model string, term string, estimate double, se double, t_stat double, p_value double, n long"), *ESTIMATES)


def _stage1(spark, sf_dir):
    p = supplier_quarter(spark, sf_dir).withColumn("tau", (F.col("t") - F.col("g")).cast("int")) \
        .withColumns({"never": F.col("g").isNull(), "ctrl": F.log1p(F.col("w_cell"))})
    return stage1(p, "y_qty", [Policy("_s1", "tau", "never", -10, 5)], "unit", "t", weight="w_cell", controls=["ctrl"])


@register("stage1_event_study", _stage1_ctes(_STAGE1) + _SQL_SIGMAS)
def q_stage1(spark, sf_dir):
    """Stage-1 event study (all leads/lags + tails + control), iid se,
    coefficients poured back onto the tau grid."""
    return _rounded(_stage1(spark, sf_dir), "taub", "tause")


@register("stage1_two_policy", _stage1_ctes([("s", "g2", -7, 3), ("c", "g", -7, 9)]) + _SQL_SIGMAS)
def q_stage1_two(spark, sf_dir):
    """Stage 1 with the dummies and tails of both policies; the series of the second one."""
    return _rounded(stage1(_two_policies(spark, sf_dir), "y_qty", POLICIES, "unit", "t", weight="w_cell", controls=["ctrl"]), "taub", "tause")


@register("stage2_regression", _stage2_sql())
def q_stage2(spark, sf_dir):
    """Stage-2 regressions 2a/2b/2c of the stage-1 series, weight 1/se, with the
    5-period effect of 2c; the series is handed over through the stage folder."""
    return _rounded(stage2(_stage1(spark, sf_dir).where("taub is not null"), persist_name="sigmas"), *ESTIMATES, "r2")


def _table_sql():
    star = "CASE WHEN p_value <= 0.01 THEN '***' WHEN p_value <= 0.05 THEN '**' WHEN p_value <= 0.10 THEN '*' ELSE '' END"
    fits = [sweep_ctes(f"t{m}", "p1r", "y_qty", {x: x for x in xs}, "w", lincoms={"five": {"post": "1.0", "post_trend": "5.0"}} if m == "2C" else None)
            for m, xs in _SQL_TERMS.items()]
    order = {"post": 0, "trend": 2, "post_trend": 4, "five": 8}
    row = "CASE term " + " ".join(f"WHEN '{t}' THEN {k}" for t, k in order.items()) + " END"
    cells = []
    for m in _SQL_TERMS:
        src = t_pvalues(f"t{m}_out")
        cells += [f"SELECT '{m}' AS model, {row} AS o, CASE term WHEN 'five' THEN '5-Year Effect' ELSE term END AS label, printf('%.2f', estimate) || {star} AS v FROM {src}",
                  f"SELECT '{m}', {row} + 1, CASE term WHEN 'five' THEN 'p-value' ELSE '' END, "
                  f"CASE term WHEN 'five' THEN printf('[%.2f]', p_value) ELSE printf('(%.2f)', se) END FROM {src}",
                  f"SELECT DISTINCT '{m}', 6, 'Observations', CAST(n AS VARCHAR) FROM t{m}_out",
                  f"SELECT DISTINCT '{m}', 7, 'R-squared', printf('%.3f', r2) FROM t{m}_out"]
    pick = ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN v END), '') AS \"{m}\"" for m in _SQL_TERMS)
    return ("WITH RECURSIVE " + ",".join([",\n".join(_P1R), *fits]) + ",\ncells AS (" + "\nUNION ALL ".join(cells) + ")\n"
            + f"SELECT CAST(o AS INTEGER) AS row_order, label, {pick} FROM cells GROUP BY o, label")


@register("reg_table", _table_sql())
def q_reg_table(spark, sf_dir):
    """S10 + F8/F9: models side by side with stars, selected terms and extra rows."""
    fits = feols_multi(_p1r(spark, sf_dir), [("y_qty", xs) for xs in
                       (["post"], ["post", "trend"], ["post", "trend", "post_trend"])], "unit", "t", weight="w")
    lc = fits[2].lincom({"post": 1.0, "post_trend": 5.0})
    return reg_table(spark, dict(zip(["2A", "2B", "2C"], fits)), ["post", "trend", "post_trend"],
                     extra={"5-Year Effect": {"2C": lc}})


def _gap(spark, sf_dir):
    return _p1r(spark, sf_dir).withColumn("y_gap", F.when(F.col("unit") % 2 == 0, F.col("y_cnt")))


_XS = ["post", "trend", "post_trend"]
_GAP_CTES = "WITH RECURSIVE " + ",\n".join(_P1R) + ",\neven AS (SELECT * FROM p1r WHERE unit % 2 = 0)," + ",".join(
    sweep_ctes(f"g_{y}", src, col, {x: x for x in _XS}, "w_cell") for y, src, col in (("y_qty", "p1r", "y_qty"), ("y_gap", "even", "y_cnt")))


@register("twfe_models_gaps", _GAP_CTES + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{y}' AS outcome, term, {_SQL_EST}, n FROM {t_pvalues(f'g_{y}_out')}" for y in ("y_qty", "y_gap")))
def q_twfe_models_gaps(spark, sf_dir):
    """A second outcome that misses half of the units takes no row from the first one's model."""
    fits = feols_multi(_gap(spark, sf_dir), [(y, _XS) for y in ("y_qty", "y_gap")], "unit", "t", weight="w_cell")
    rows = [(y, *r, fit.n) for y, fit in zip(("y_qty", "y_gap"), fits) for r in fit.rows()]
    return _rounded(spark.createDataFrame(rows, "outcome string, term string, estimate double, se double, t_stat double, p_value double, n long"), *ESTIMATES)


@register("twfe_models_steps", _GAP_CTES + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{y}' AS outcome, term, {_SQL_EST}, n FROM {t_pvalues(f'g_{y}_out')}" for y in ("y_qty", "y_gap")))
def q_twfe_models_steps(spark, sf_dir):
    """The same models with period effects found step by step in Spark."""
    fits = feols_multi(_gap(spark, sf_dir), [(y, _XS) for y in ("y_qty", "y_gap")], "unit", "t", weight="w_cell", periods="iterative")
    rows = [(y, *r, fit.n) for y, fit in zip(("y_qty", "y_gap"), fits) for r in fit.rows()]
    return _rounded(spark.createDataFrame(rows, "outcome string, term string, estimate double, se double, t_stat double, p_value double, n long"), *ESTIMATES)


MINUTE_TYPES = ("click", "purchase", "view")


@register("twfe_minutes", None)
def q_twfe_minutes(spark, sf_dir):
    """Value on event types with user and minute effects; a period is a minute, tens of thousands of them.

    No SQL: the sweep over all minute dummies is too slow; tested against dense dummies."""
    events = read_table(spark, sf_dir, "events").select(
        "user_id", F.date_trunc("minute", "ts").alias("minute"), "value",
        *[(F.col("event_type") == x).cast("double").alias(x) for x in MINUTE_TYPES])
    fit = feols(events, "value", list(MINUTE_TYPES), "user_id", "minute")
    rows = [(*r, fit.n, fit.n_periods, fit.K) for r in fit.rows()]
    return _rounded(spark.createDataFrame(rows, "term string, estimate double, se double, t_stat double, p_value double, n long, n_periods long, k long"), *ESTIMATES)


@register("fit_stats_outcomes", _GAP_CTES + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{y}' AS outcome, n, CAST(kk AS BIGINT) AS K, round(1 - ssr / (swyy - swy * swy / sw), 6) + 0.0 AS r2,
  round(sqrt(ssr / sw * n / (n - kk - ng)), 6) + 0.0 AS rmse FROM g_{y}_fit, g_{y}_n, g_{y}_k""" for y in ("y_qty", "y_gap")))
def q_fit_stats_outcomes(spark, sf_dir):
    """N, K, R2 and root mean squared error of every outcome of a shared fit."""
    fits = feols_multi(_gap(spark, sf_dir), [(y, _XS) for y in ("y_qty", "y_gap")], "unit", "t", weight="w_cell")
    rows = [(y, fit.n, fit.K, fit.r2, fit.rmse) for y, fit in zip(("y_qty", "y_gap"), fits)]
    return _rounded(spark.createDataFrame(rows, "outcome string, n long, K long, r2 double, rmse double"), "r2", "rmse")


_ABSORBED = {"post": "post", "per_unit": "unit * 1000.0 + 7", "trend": "trend", "per_period": "t * t + 2000.0", "twice": "2 * trend + 1"}


@register("fe_collinear_report", "WITH RECURSIVE " + ",\n".join(_P1R) + "," + sweep_ctes("fc", "p1r", "y_qty", _ABSORBED, "w_cell") + """
SELECT term, estimate IS NULL AS omitted, round(estimate, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se FROM fc_out""")
def q_fe_collinear_report(spark, sf_dir):
    """Which regressors the effects (or earlier regressors) absorb."""
    p = _p1r(spark, sf_dir).withColumns({name: F.expr(e) for name, e in _ABSORBED.items() if name not in ("post", "trend")})
    fit = feols(p, "y_qty", list(_ABSORBED), "unit", "t", weight="w_cell")
    rows = [(term, term in fit.omitted, b, s) for term, b, s, _, _ in fit.rows()]
    return _rounded(spark.createDataFrame(rows, "term string, omitted boolean, estimate double, se double"), "estimate", "se")
