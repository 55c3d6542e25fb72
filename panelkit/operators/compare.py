"""Pre-trend tests, stacked comparison series and the method comparison table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.dist import p_chi2, p_normal
from panelkit.functions.scalar import fmt_est_se, fmt_num
from panelkit.operators.linalg import pivoted_solve


def pretrend_stat(series: DataFrame, tau: str = "tau", est: str = "estimate", se: str = "se") -> DataFrame:
    """Sum over tau < 0 of (est / se)^2 and its df (covariances ignored, as reported);
    valid only when every pre-period se is present and positive."""
    pre = series.filter(F.col(tau) < 0)
    return pre.agg(F.sum((F.col(est) / F.col(se)) ** 2).alias("chi2"), F.count(F.lit(1)).alias("df"),
                   F.min(F.when(F.col(se).isNull() | (F.col(se) <= 0), 0).otherwise(1)).alias("valid"))


def pretrend_test(series: DataFrame, tau: str = "tau", est: str = "estimate", se: str = "se") -> DataFrame:
    """E12 with the chi-square p-value, verdict at 5% and the count of individually
    significant pre-period coefficients (|z| > 1.96)."""
    spark = series.sparkSession
    r = pretrend_stat(series, tau, est, se).first()
    n_sig = series.filter((F.col(tau) < 0) & (F.abs(F.col(est) / F.col(se)) > 1.96)).count()
    if not r["df"] or r["valid"] != 1:
        return spark.createDataFrame([(None, 0, None, "not testable", n_sig)],
                                     "chi2 double, df long, p_value double, verdict string, n_significant long")
    p = p_chi2(r["chi2"], r["df"])
    verdict = "joint test rejects at 5%" if p < 0.05 else "not rejected"
    return spark.createDataFrame([(float(r["chi2"]), int(r["df"]), p, verdict, n_sig)],
                                 "chi2 double, df long, p_value double, verdict string, n_significant long")


def pretrend_rows(series: DataFrame, tau: str = "tau", est: str = "estimate", se: str = "se") -> DataFrame:
    """E12 per event time: estimate, se, z and a star where |z| > 1.96, for tau < 0."""
    z = F.col(est) / F.col(se)
    return series.filter(F.col(tau) < 0).select(F.col(tau).alias("tau"), F.col(est).alias("estimate"), F.col(se).alias("se"), z.alias("z"),
                                                F.when(F.abs(z) > 1.96, "*").otherwise("").alias("star"))


WALD_SCHEMA = "method string, chi2 double, df long, n_omitted long, p_value double, verdict string"


def wald(estimates: np.ndarray, cov: np.ndarray) -> tuple[float | None, int]:
    """(b' V^-1 b, rank): the joint test of all estimates being 0 with their whole covariance.

    Estimates that are missing are left out, and so are those whose variance given the
    ones before is none (1e-9 of their own): with fewer clusters than estimates, or effects
    that add up to a known sum, V has no inverse and the rank is the degrees of freedom."""
    ok = np.flatnonzero(~np.isnan(estimates) & ~np.isnan(np.diag(cov)))
    b, V = estimates[ok], cov[np.ix_(ok, ok)]
    solved, keep, _ = pivoted_solve(V, b)
    df = int(keep.sum())
    return (float(b[keep] @ solved[keep]) if df else None), df


def pretrend_wald(spark: SparkSession, tests: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], alpha: float = 0.05) -> DataFrame:
    """E12 with covariances: one row a method of (method, tau, estimates, covariance); effects with tau < 0 are tested.

    ``n_omitted`` counts pre-period effects that are missing or follow from the others."""
    rows = []
    for method, tau, b, V in tests:
        pre = np.flatnonzero(np.asarray(tau) < 0)
        chi2, df = wald(np.asarray(b, float)[pre], np.asarray(V, float)[np.ix_(pre, pre)]) if len(pre) else (None, 0)
        p = p_chi2(chi2, df) if df else None
        verdict = "not testable" if p is None else "joint test rejects at 5%" if p < alpha else "not rejected"
        rows.append((method, chi2, df, len(pre) - df, p, verdict))
    return spark.createDataFrame(rows, WALD_SCHEMA)


def compare_series(twfe: DataFrame, cs: DataFrame, lo: int = -7, hi: int = 9) -> DataFrame:
    """TWFE event-study series stacked with the group-time ATT event-time series."""
    a = twfe.select("tau", "estimate", "se", "ci_low", "ci_high", F.lit("TWFE").alias("method"))
    b = cs.filter(F.col("e").isNotNull()).select(F.col("e").alias("tau"), F.col("att").alias("estimate"), "se",
                                                 (F.col("att") - 1.96 * F.col("se")).alias("ci_low"),
                                                 (F.col("att") + 1.96 * F.col("se")).alias("ci_high"),
                                                 F.lit("Group-time ATT").alias("method"))
    return a.unionByName(b).filter((F.col("tau") >= lo) & (F.col("tau") <= hi))


def comparison_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (outcome, twfe est, se, p, att est, se) -> formatted comparison table."""
    full = [(o, te, ts, tp, ae, ase, p_normal(ae / ase) if ae is not None and ase else None)
            for o, te, ts, tp, ae, ase in rows]
    df = spark.createDataFrame(full, "outcome string, twfe_est double, twfe_se double, twfe_p double, "
                                     "att_est double, att_se double, att_p double")
    return df.select("outcome", fmt_est_se("twfe_est", "twfe_se").alias("twfe_5yr_effect"),
                     fmt_num("twfe_p").alias("twfe_p_value"), fmt_est_se("att_est", "att_se").alias("att"),
                     fmt_num("att_p").alias("att_p_value"))
