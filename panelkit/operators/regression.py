"""Event study, two-stage (stage 1 series -> stage 2 trend-break fits)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators import panel as P
from panelkit.operators.feols import Fit, coef_series, feols, feols_multi, wls_multi
from panelkit.sources.io import load_stage, save_stage

SERIES_SCHEMA = "tau int, estimate double, se double, ci_low double, ci_high double"


def event_study_fit(df: DataFrame, y: str, tau: str, never: str, unit: str, period: str, weight: str | None = None, lo: int = -7, hi: int = 9,
                    ref: int = -1, drop_never: bool = False, cluster: str = "unit", controls: Sequence[str] = ()) -> tuple[Fit, list[int], list[str]]:
    """R2 as a fit, with the event times and terms of its dummies; arguments as for ``event_study``."""
    d = df.withColumn("_tb", P.bin_tau(tau, lo, hi, never))
    if drop_never:
        d = d.filter(F.col("_tb").isNotNull())
    ks = [k for k in range(lo, hi + 1) if k != ref]
    d = P.event_dummies(d, "_tb", lo, hi, prefix="_es", skip=[ref])
    terms = [P.dummy_name(k, "_es") for k in ks]
    return feols(d, y, [*terms, *controls], unit, period, weight=weight, cluster=cluster), ks, terms


def event_study(df: DataFrame, y: str, tau: str, never: str, unit: str, period: str,
                weight: str | None = None, lo: int = -7, hi: int = 9, ref: int = -1,
                drop_never: bool = False, add_reference: bool = True, cluster: str = "unit",
                controls: Sequence[str] = ()) -> DataFrame:
    """R2: y on binned event-time dummies (end points collect the tails), reference
    ``ref`` omitted, unit + period effects, cluster-robust se.

    Never-adopters keep all-zero dummies (Stata form) unless ``drop_never``
    (the R form, where their NULL binned tau drops them).  Returns the
    coefficient series (R10), plus the reference row (O4) when asked."""
    fit, ks, terms = event_study_fit(df, y, tau, never, unit, period, weight, lo, hi, ref, drop_never, cluster, controls)
    rows = coef_series(fit, ks, terms)
    if add_reference:
        rows.append((ref, 0.0, 0.0, 0.0, 0.0))
    return df.sparkSession.createDataFrame(rows, SERIES_SCHEMA)


@dataclass(frozen=True)
class Policy:
    """One policy of a several-policy model: its event time, never-adopter flag and window [lo, hi]."""

    name: str
    tau: str
    never: str
    lo: int
    hi: int


def onestep_design(df: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """R6 columns of every policy: range flag, policy, trend and trend break inside the window, tail dummies.

    Never-adopters count as event time 0.  All rows stay: those beyond a window
    have its range flag 0 and a tail dummy.  The break counts from 1 in event time
    0, also for never-adopters, as the published model has it."""
    out = {}
    for p in policies:
        t = F.when(F.col(p.never), F.lit(0)).otherwise(F.col(p.tau))
        is_in = F.coalesce((t >= p.lo) & (t <= p.hi), F.lit(False))
        treated = F.coalesce((t >= 0) & ~F.col(p.never), F.lit(False)) & is_in
        at = F.coalesce(t, F.lit(0))
        out |= {f"{p.name}_range": is_in, f"{p.name}_policy": treated,
                f"{p.name}_L": F.coalesce(t < p.lo, F.lit(False)), f"{p.name}_R": F.coalesce(t > p.hi, F.lit(False)),
                f"{p.name}_trend": is_in.cast("int") * at,
                f"{p.name}_break": treated.cast("int") * at + (is_in & (at >= 0) & t.isNotNull()).cast("int")}
    return df.withColumns({c: e.cast("int") for c, e in out.items()})


def onestep(df: DataFrame, y: str, policies: Sequence[Policy], unit: str, period: str, weight: str | None = None,
            controls: Sequence[str] = (), cluster: str = "unit", years: int = 5) -> dict[str, tuple[Fit, dict]]:
    """Mean shift (3a), with trend (3b) and with trend break (3c) of all policies at once.

    Returns model -> (fit, policy -> effect after ``years`` periods; 3c only, where both of its terms are in)."""
    d = onestep_design(df, policies)
    head = lambda p: [f"{p.name}_range", f"{p.name}_policy", f"{p.name}_L", f"{p.name}_R"]
    more = {"3a": [], "3b": ["trend"], "3c": ["trend", "break"]}
    specs = [(y, [*(c for p in policies for c in [*head(p), *(f"{p.name}_{m}" for m in add)]), *controls]) for add in more.values()]
    fits = dict(zip(more, feols_multi(d, specs, unit, period, weight=weight, cluster=cluster)))
    full, effects = fits["3c"], {}
    for p in policies:
        terms = {f"{p.name}_policy": 1.0, f"{p.name}_break": float(years)}
        if not set(terms) & set(full.omitted):
            effects[p.name] = full.lincom(terms)
    return {m: (f, effects if m == "3c" else {}) for m, f in fits.items()}


def stage1(df: DataFrame, y: str, policies: Sequence[Policy], unit: str, period: str, weight: str | None = None,
           controls: Sequence[str] = ()) -> DataFrame:
    """Stage 1, a dummy for every event time of every policy's window, tail dummies,
    controls, unit + period effects, classical (iid, analytic-weight) se.

    Collinear columns are dropped in order (R13); with every lead and lag
    present the tails absorb the redundancy, as the published fit drops a city.
    The coefficients of the last policy are then poured back onto the event times of
    the data (A11 + J3): ``tau, taub, tause``, NULL where a coefficient was omitted."""
    terms, last = [], policies[-1]
    for p in policies:
        df = P.tail_dummies(P.event_dummies(df, p.tau, p.lo, p.hi, prefix=p.name), p.tau, p.lo, p.hi, prefix=p.name)
        terms += [P.dummy_name(k, p.name) for k in range(p.lo, p.hi + 1)]
    tails = [f"{p.name}{side}" for p in policies for side in "LR"]
    fit = feols(df, y, [*terms, *controls, *tails], unit, period, weight=weight, vcov="iid")
    se = fit.se
    at = {k: fit.terms.index(P.dummy_name(k, last.name)) for k in range(last.lo, last.hi + 1)}
    coefs = [(k, float(fit.beta[j]), float(se[j])) for k, j in at.items() if fit.beta[j] == fit.beta[j]]
    cdf = df.sparkSession.createDataFrame(coefs, "tau int, taub double, tause double")  # one row an event time
    grid = df.select(F.col(last.tau).cast("int").alias("tau")).filter((F.col("tau") >= last.lo) & (F.col("tau") <= last.hi)).distinct()
    return grid.join(cdf, "tau", "left")


STAGE2_SCHEMA = ("model string, term string, estimate double, se double, t_stat double, p_value double, "
                 "n long, r2 double")


def stage2(sigmas: DataFrame, persist_name: str | None = None) -> DataFrame:
    """Regress the stage-1 series on post (2a), + tau (2b), + post trend (2c),
    analytic weight 1/se (the reference's choice, not 1/se^2), constant included;
    adds the 2c linear combination post + 5 * post_trend with df = n - K.

    The Stata post-trend counts from 1 in period 0 (offset 1)."""
    spark = sigmas.sparkSession
    if persist_name is not None:
        name = f"{persist_name}-{uuid.uuid4().hex[:8]}"
        save_stage(sigmas, name)
        sigmas = load_stage(spark, name)
    s = sigmas.withColumns({"post": (F.col("tau") >= 0).cast("int"),
                            "wt": 1.0 / F.col("tause")})
    s = s.withColumn("post_trend", (F.col("post") * F.col("tau") + F.col("post")).cast("int"))
    models = {"2a": ["post"], "2b": ["post", "tau"], "2c": ["post", "tau", "post_trend"]}
    rows = []
    fits = wls_multi(s, [("taub", xs) for xs in models.values()], weight="wt")
    for name, fit in zip(models, fits):
        rows += [(name, *r, fit.n, fit.r2) for r in fit.rows()]
    fit2c = fits[-1]
    lc = fit2c.lincom({"post": 1.0, "post_trend": 5.0})
    rows.append(("2c", "post + 5*post_trend", lc["estimate"], lc["se"], lc["t"], lc["p"], fit2c.n, fit2c.r2))
    return spark.createDataFrame(rows, STAGE2_SCHEMA)
