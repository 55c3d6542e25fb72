"""Exact two-way absorption = dense dummy least squares (unbalanced, weighted)."""

import numpy as np
import pandas as pd
import pytest

from panelkit.operators.feols import feols, feols_multi


def _panel(seed=7, n_units=40, n_t=9):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n_units):
        for t in range(n_t):
            if rng.random() < 0.2:      # unbalanced
                continue
            x1 = rng.normal()
            x2 = float(t >= 4 and u % 3 == 0)
            y = 1.5 * x1 - 2.0 * x2 + 0.3 * u + 0.7 * t + rng.normal()
            rows.append((u, t, y, x1, x2, float(rng.uniform(0.5, 3.0))))
    return pd.DataFrame(rows, columns=["unit", "t", "y", "x1", "x2", "w"])


def _dense(pdf):
    D = pd.get_dummies(pdf[["unit", "t"]].astype(str), drop_first=True).astype(float).values
    Z = np.column_stack([pdf[["x1", "x2"]].values, np.ones(len(pdf)), D])
    W = pdf.w.values
    ZtWZ = (Z * W[:, None]).T @ Z
    inv = np.linalg.inv(ZtWZ)
    b = inv @ (Z * W[:, None]).T @ pdf.y.values
    e = pdf.y.values - Z @ b
    return Z, W, inv, b, e


def test_coefficients_and_iid_vcov(spark):
    pdf = _panel()
    fit = feols(spark.createDataFrame(pdf), "y", ["x1", "x2"], "unit", "t", weight="w", vcov="iid")
    Z, W, inv, b, e = _dense(pdf)
    n, K = len(pdf), Z.shape[1]
    V = (e * W) @ e / (n - K) * inv
    assert np.allclose(fit.beta, b[:2], atol=1e-9)
    assert np.allclose(fit.vcov, V[:2, :2], atol=1e-9)
    assert fit.K == K


def test_cluster_vcov(spark):
    pdf = _panel(seed=11)
    fit = feols(spark.createDataFrame(pdf), "y", ["x1", "x2"], "unit", "t", weight="w")
    Z, W, inv, b, e = _dense(pdf)
    meat = np.zeros((Z.shape[1], Z.shape[1]))
    for u, idx in pdf.groupby("unit").indices.items():
        s = (Z[idx] * (W[idx] * e[idx])[:, None]).sum(axis=0)
        meat += np.outer(s, s)
    Vraw = (inv @ meat @ inv)[:2, :2]
    n, G, T = len(pdf), pdf.unit.nunique(), pdf.t.nunique()
    c = G / (G - 1) * (n - 1) / (n - (2 + T - 1))
    assert np.allclose(fit.vcov, c * Vraw, rtol=1e-8)


def test_multi_matches_single(spark):
    pdf = _panel(seed=3)
    df = spark.createDataFrame(pdf)
    a, b2 = feols_multi(df, [("y", ["x1"]), ("y", ["x1", "x2"])], "unit", "t", weight="w")
    single = feols(df, "y", ["x1", "x2"], "unit", "t", weight="w")
    assert np.allclose(b2.beta, single.beta, atol=1e-10)
    assert np.allclose(b2.vcov, single.vcov, atol=1e-10)
    assert a.terms == ["x1"]


def test_collinear_column_reported(spark):
    pdf = _panel(seed=5)
    pdf["x3"] = 2.0 * pdf["x1"]
    fit = feols(spark.createDataFrame(pdf), "y", ["x1", "x3"], "unit", "t", weight="w")
    assert fit.omitted == ["x3"]
    assert np.isnan(fit.beta[1])


def test_effects_absorb_columns(spark):
    """Unit-constant, period-constant and constant columns are dropped and reported; the others' numbers don't move."""
    pdf = _panel(seed=13)
    pdf["per_unit"], pdf["per_t"], pdf["one"] = pdf["unit"] * 1e4 + 7.0, pdf["t"] ** 2 * 1.0 + 2000, 3.0
    df = spark.createDataFrame(pdf)
    plain = feols(df, "y", ["x1", "x2"], "unit", "t", weight="w")
    more = feols(df, "y", ["per_unit", "x1", "per_t", "x2", "one"], "unit", "t", weight="w")
    assert more.omitted == ["per_unit", "per_t", "one"]
    assert more.K == plain.K
    assert np.allclose(more.beta[[1, 3]], plain.beta, atol=1e-9)
    assert np.allclose(more.se[[1, 3]], plain.se, atol=1e-9)


def test_every_outcome_has_its_own_sample(spark):
    pdf = _panel(seed=17)
    pdf["z"] = pdf["y"] * 2 + pdf["x1"]
    pdf.loc[pdf.unit % 2 == 1, "z"] = None
    df = spark.createDataFrame(pdf).replace(float("nan"), None, subset=["z"])
    both = feols_multi(df, [("y", ["x1", "x2"]), ("z", ["x1"])], "unit", "t", weight="w")
    for got, want in zip(both, (feols(df, "y", ["x1", "x2"], "unit", "t", weight="w"), feols(df, "z", ["x1"], "unit", "t", weight="w"))):
        assert got.n == want.n and np.allclose(got.beta, want.beta) and np.allclose(got.vcov, want.vcov)
    assert both[0].n == len(pdf) > both[1].n


def test_fit_statistics_of_every_outcome(spark):
    pdf = _panel(seed=19)
    pdf["z"] = pdf["y"] ** 2
    fits = feols_multi(spark.createDataFrame(pdf), [("y", ["x1", "x2"]), ("z", ["x1", "x2"])], "unit", "t", weight="w")
    for fit, name in zip(fits, ("y", "z")):
        Z, W, _, _, e = _dense(pdf.assign(y=pdf[name]))
        v = pdf[name].values
        assert fit.r2 == pytest.approx(1 - (W * e) @ e / (W @ (v - np.average(v, weights=W)) ** 2), rel=1e-9)
        assert fit.rmse == pytest.approx(np.sqrt((W * e) @ e / W.sum() * len(v) / (len(v) - Z.shape[1])), rel=1e-9)


def test_rows_that_share_unit_and_period(spark):
    pdf = pd.concat([_panel(seed=23), _panel(seed=24)])
    fit = feols(spark.createDataFrame(pdf), "y", ["x1", "x2"], "unit", "t", weight="w", vcov="iid")
    Z, W, inv, b, e = _dense(pdf)
    assert np.allclose(fit.beta, b[:2], atol=1e-9)
    assert np.allclose(fit.vcov, ((e * W) @ e / (len(pdf) - Z.shape[1]) * inv)[:2, :2], atol=1e-9)


def test_period_bound_is_an_argument(spark):
    from panelkit.operators.feols import absorb_two_way
    with pytest.raises(ValueError, match="max_periods"):
        absorb_two_way(spark.createDataFrame(_panel()), ["y"], "unit", "t", max_periods=3, periods="direct")


@pytest.mark.parametrize("extra", [0, 30])
def test_sun_abraham_equals_the_dummy_regression(spark, extra):
    """Unbalanced, weighted, with rows that share a cell: moments by cohort against feols on laid-out indicators."""
    from panelkit.operators.sunab import sunab
    pdf = pd.concat([_panel(seed=29), _panel(seed=31).head(extra)])
    pdf["g"] = pdf["unit"].map(lambda u: {0: None, 1: 3, 2: 5, 3: 0}[u % 4])
    pdf.loc[(pdf.unit % 4 == 2) & (pdf.t == 4), "y"] = None  # a cohort without its reference period
    df = spark.createDataFrame(pdf.astype({"g": object})[["unit", "t", "y", "w", "g"]].where(lambda d: d.notna(), None), "unit long, t long, y double, w double, g long")
    sa = sunab(df, "y", "g", "unit", "t", w="w")
    used = pdf[pdf.y.notna() & ~(pdf.g == 0)].copy()
    for (g, e, term, _) in sa.cells:
        used[term] = ((used.g == g) & (used.t - used.g == e)).astype(float)
    terms = [c[2] for c in sa.cells]
    want = feols(spark.createDataFrame(used[["unit", "t", "y", "w", *terms]]), "y", terms, "unit", "t", weight="w")
    assert sa.fit.omitted == want.omitted and (sa.fit.n, sa.fit.K, sa.fit.K_full) == (want.n, want.K, want.K_full)
    assert np.allclose(sa.fit.beta, want.beta, atol=1e-8, equal_nan=True)
    assert np.allclose(sa.fit.vcov, want.vcov, atol=1e-8, equal_nan=True)
    assert sa.fit.ssr == pytest.approx(want.ssr) and sa.fit.tss == pytest.approx(want.tss) and sa.fit.tss_within == pytest.approx(want.tss_within)
