"""Property tests of the DiD estimators on the driver's tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import bacon as B
from panelkit.operators.attgt import aggte, att_gt
from panelkit.operators.feols import feols
from panelkit.operators.sunab import sunab
from panelkit.sources.fixtures import supplier_quarter, user_day

from conftest import SF_SMALL


def test_bacon_total_equals_twfe(spark):
    for p, y, d in [(supplier_quarter(spark, SF_SMALL), "y_qty", "policy"),
                    (user_day(spark, SF_SMALL, grid=True), "y_cnt", "flag")]:
        pairs = B.bacon(p, y, d, "unit", "t")
        tot = B.bacon_total(pairs).first()
        assert tot["weight_sum"] == pytest.approx(1.0, abs=1e-12)
        assert tot["total"] == pytest.approx(feols(p, y, [d], "unit", "t").beta[0], abs=1e-8)


def test_planted_effect_recovered_exactly(spark):
    # noise-free: y = unit effect + period effect + 5 * treated
    p = supplier_quarter(spark, SF_SMALL).withColumn(
        "y", F.col("unit") * 1.0 + F.col("t") * 0.5 + 5.0 * F.col("policy"))
    res = att_gt(p, "y", "unit", "t", "g")
    cells = [c for c in res.cells if c["att"] is not None]
    assert all(abs(c["att"] - (5.0 if c["t"] >= c["g"] else 0.0)) < 1e-9 for c in cells)
    simple = aggte(res, "simple").first()
    assert simple["att"] == pytest.approx(5.0, abs=1e-9)


def test_never_treated_only_gives_no_cells(spark):
    p = supplier_quarter(spark, SF_SMALL).withColumn("g0", F.lit(None).cast("int"))
    res = att_gt(p, "y_qty", "unit", "t", "g0")
    assert res.cells == []


def test_sunab_equals_never_treated_att_post(spark):
    p = supplier_quarter(spark, SF_SMALL)
    sa = {(g, e): b for g, e, b, s in sunab(p, "y_qty", "g", "unit", "t").coefs()}
    res = att_gt(p, "y_qty", "unit", "t", "g")
    for c in res.cells:
        if c["att"] is not None and c["t"] >= c["g"]:
            assert sa[(c["g"], c["t"] - c["g"])] == pytest.approx(c["att"], abs=1e-8)


def test_influence_function_sums_to_zero_per_cell(spark):
    """Cells from moments equal weighted means over the units, whose influence functions sum to zero and give the se."""
    df = supplier_quarter(spark, SF_SMALL)
    res = att_gt(df, "y_qty", "unit", "t", "g", "w", control="notyet")
    pdf = df.toPandas()
    wide = pdf.pivot(index="unit", columns="t", values="y_qty").dropna()
    first = pdf.sort_values("t").groupby("unit").first().loc[wide.index]
    g, w = first["g"].to_numpy(float), first["w"].to_numpy(float)
    w = w / w.mean()
    done = 0
    for c in res.cells:
        if c["att"] is None:
            continue
        k, t = c["g"], c["t"]
        base = k - 1 if t >= k else t - 1
        dy = (wide[t] - wide[base]).to_numpy()
        psi = np.zeros(len(w))
        means = []
        for role, sign in ((g == k, 1.0), (np.isnan(g) | ((g > max(t, base)) & (g != k)), -1.0)):
            m = np.average(dy[role], weights=w[role])
            psi[role] += sign * w[role] * (dy[role] - m) / w[role].sum()
            means.append(m)
        assert c["att"] == pytest.approx(means[0] - means[1], abs=1e-8)
        assert abs(psi.sum()) < 1e-9
        assert c["se"] == pytest.approx(np.sqrt((psi ** 2).sum()), rel=1e-8)
        done += 1
    assert done > 40


def test_repartition_invariance(spark):
    p = supplier_quarter(spark, SF_SMALL)
    a = feols(p, "y_qty", ["policy"], "unit", "t", weight="w").beta[0]
    b = feols(p.repartition(3, "t"), "y_qty", ["policy"], "unit", "t", weight="w").beta[0]
    assert a == pytest.approx(b, abs=1e-9)


def _random_panel(units, periods, cohorts, seed=3, never=True):
    """Unit rows (unit, t, y, w, g); ``cohorts`` are dealt in turn, with the never-treated among them if asked."""
    rng = np.random.default_rng(seed)
    groups = [*cohorts, *([None] if never else [])]
    rows = []
    for u in range(units):
        g, w = groups[u % len(groups)], float(rng.uniform(0.5, 2))
        rows += [(u, t, float(rng.normal() + (t >= g if g is not None else 0)), w, g) for t in range(periods)]
    return rows


PANEL = "unit long, t int, y double, w double, g int"


@pytest.mark.parametrize("cohorts", [(2, 4, 6), (3, 5)])
def test_sunab_without_never_treated(spark, cohorts):
    """Cohorts whose columns give period effects: the same ones are omitted as in the laid-out regression."""
    import pandas as pd
    rows = _random_panel(24, 8, cohorts, never=False)
    sa = sunab(spark.createDataFrame(rows, PANEL), "y", "g", "unit", "t", w="w")
    pdf = pd.DataFrame(rows, columns=["unit", "t", "y", "w", "g"])
    for g, e, term, _ in sa.cells:
        pdf[term] = ((pdf.g == g) & (pdf.t - pdf.g == e)).astype(float)
    terms = [c[2] for c in sa.cells]
    want = feols(spark.createDataFrame(pdf), "y", terms, "unit", "t", weight="w")
    assert want.omitted and sa.fit.omitted == want.omitted and sa.fit.K == want.K
    assert np.allclose(sa.fit.beta, want.beta, atol=1e-7, equal_nan=True)
    assert np.allclose(sa.fit.vcov, want.vcov, atol=1e-7, equal_nan=True)
    for (g, e, b, s), j in zip(sa.coefs(), range(len(terms))):
        if b is not None:
            assert s == pytest.approx(want.se[j], abs=1e-7)
    kept = [(j, m) for j, (_, e, _, m) in enumerate(sa.cells) if e >= 0 and not np.isnan(want.beta[j])]
    a = np.zeros(len(terms))
    for j, m in kept:
        a[j] = m / sum(m for _, m in kept)
    att, se = sa.att()
    live = ~np.isnan(want.beta)
    assert att == pytest.approx(a[live] @ want.beta[live], abs=1e-7)
    assert se == pytest.approx(float(np.sqrt(a[live] @ want.vcov[np.ix_(live, live)] @ a[live])), abs=1e-7)


def test_sunab_of_nothing(spark):
    sa = sunab(spark.createDataFrame([], PANEL), "y", "g", "unit", "t")
    assert sa.coefs() == [] and sa.event_study() == [] and np.isnan(sa.att()[0])


def test_not_yet_treated_cells_of_many_cohorts(spark):
    """Every cell of 12 cohorts against plain means over its units; several tasks and cohorts without units of some kind."""
    rows = _random_panel(90, 16, range(2, 14), seed=8)
    res = att_gt(spark.createDataFrame(rows, PANEL).repartition(7), "y", "unit", "t", "g", "w", control="notyet")
    y, g, w = {}, {}, {}
    for u, t, v, x, c in rows:
        y[u, t], g[u], w[u] = v, c, x
    for c in res.cells:
        k, t = c["g"], c["t"]
        base = k - 1 if t >= k else t - 1
        tr = [u for u in g if g[u] == k]
        co = [u for u in g if g[u] is None or (g[u] > max(t, base) and g[u] != k)]
        mean = lambda us: sum(w[u] * (y[u, t] - y[u, base]) for u in us) / sum(w[u] for u in us)
        assert (c["n_tr"], c["n_co"]) == (len(tr), len(co))
        assert c["att"] == pytest.approx(mean(tr) - mean(co), abs=1e-10)
    assert len(res.cells) == 12 * 15


def test_covariance_and_bands_from_laid_out_influence(spark):
    """Covariance, replicates and sup-t bands against influence functions by hand from numerical derivatives of the estimates."""
    import hashlib
    from panelkit.operators.attgt import aggte_cov, uniform_band
    rows = _random_panel(40, 6, (2, 4), seed=11)
    p = spark.createDataFrame(rows, PANEL).repartition(3)
    res = att_gt(p, "y", "unit", "t", "g", "w")
    names, b, V = aggte_cov(res, "dynamic")
    single = {r["target"]: (r["att"], r["se"]) for r in aggte(res, "dynamic").collect()}
    assert names[-1] == "overall" and set(single) == set(names)
    assert np.allclose(np.sqrt(np.diag(V)), [single[x][1] for x in names]) and np.allclose(b, [single[x][0] for x in names])

    # a unit's influence: n times the derivative of an estimate by the unit's weight
    y, g, w = {}, {}, {}
    for u, t, v, x, c in rows:
        y[u, t], g[u], w[u] = v, c, x
    units = sorted(g)

    def estimates(w):
        out = {}
        for e in range(-3, 4):
            eff, mass = 0.0, 0.0
            for k in (2, 4):
                t = k + e
                if not 1 <= t < 6:
                    continue
                base = k - 1 if e >= 0 else t - 1
                m = lambda us: sum(w[u] * (y[u, t] - y[u, base]) for u in us) / sum(w[u] for u in us)
                share = sum(w[u] for u in units if g[u] == k)
                eff += share * (m([u for u in units if g[u] == k]) - m([u for u in units if g[u] is None]))
                mass += share
            out[f"e{e}"] = eff / mass
        out["overall"] = np.mean([v for q, v in out.items() if int(q[1:]) >= 0])
        return np.array([out[x] for x in names])

    inf = []
    for u in units:
        h = 1e-5 * w[u]
        inf.append((estimates(w | {u: w[u] + h}) - estimates(w | {u: w[u] - h})) / (2 * h) * w[u] * len(units))
    inf = np.array(inf)
    assert np.allclose(V, inf.T @ inf / len(units)**2, atol=1e-6)
    sign = lambda b, u: ord(hashlib.md5(f"7|{b}|{u}".encode()).hexdigest()[0]) % 2 * 2 - 1
    reps = np.array([[sign(b, u) for u in units] for b in range(99)]) @ inf / len(units)
    se = np.subtract(*np.quantile(reps, [0.75, 0.25], axis=0)) / 1.3489795003921634
    band = {r["target"]: r for r in uniform_band(res, "dynamic", draws=99, seed=7).collect()}
    crit = np.sort(np.abs(reps[:, :-1] / se[:-1]).max(axis=1))[94]  # ceil(0.95 * 99) = 95th
    assert set(band) == set(names[:-1])
    for q, name in enumerate(names[:-1]):
        assert band[name]["boot_se"] == pytest.approx(se[q], abs=1e-6) and band[name]["crit"] == pytest.approx(crit, abs=1e-5)
        assert band[name]["band_high"] == pytest.approx(b[q] + crit * se[q], abs=1e-5)


def test_wald_leaves_out_what_follows(spark):
    from panelkit.functions.dist import p_chi2
    from panelkit.operators.compare import pretrend_wald, wald
    rng = np.random.default_rng(2)
    A = rng.normal(size=(4, 4))
    V, b = A @ A.T, rng.normal(size=4)
    assert wald(b, V) == (pytest.approx(b @ np.linalg.solve(V, b)), 4)
    L = np.vstack([np.eye(4), [1, 1, 0, 0]])  # a fifth estimate, the sum of two others
    assert wald(L @ b, L @ V @ L.T) == (pytest.approx(b @ np.linalg.solve(V, b)), 4)
    assert wald(np.array([np.nan, b[0]]), V[:2, :2]) == (pytest.approx(b[0] ** 2 / V[1, 1]), 1)
    assert wald(np.zeros(0), np.zeros((0, 0))) == (None, 0)
    r = pretrend_wald(spark, [("all", np.array([-2, -1, 0, 1]), b, V), ("none", np.array([0, 1]), b[:2], V[:2, :2])]).collect()
    want = b[:2] @ np.linalg.solve(V[:2, :2], b[:2])
    assert r[0]["chi2"] == pytest.approx(want) and r[0]["df"] == 2 and r[0]["p_value"] == pytest.approx(p_chi2(want, 2))
    assert (r[1]["chi2"], r[1]["df"], r[1]["verdict"]) == (None, 0, "not testable")


def test_ordered_pivots_of_many_columns():
    """2,000 columns, every tenth a sum of two before it: those are left out, in seconds."""
    import time
    from panelkit.operators.linalg import ordered_pivots, pivoted_solve
    rng = np.random.default_rng(4)
    X = rng.normal(size=(2500, 2000))
    for j in range(10, 2000, 10):
        X[:, j] = X[:, j - 1] + X[:, j - 2]
    t0 = time.time()
    keep = ordered_pivots(X.T @ X)
    assert keep == [j for j in range(2000) if j % 10 or j == 0] and time.time() - t0 < 30
    G = X[:, :50].T @ X[:, :50]
    b, mask, inv = pivoted_solve(G, G @ np.ones(50))
    assert np.isnan(b[~mask]).all() and (~mask).sum() == 4
    assert np.allclose(X[:, :50][:, mask] @ b[mask], X[:, :50] @ np.ones(50))


def test_decomposition_of_3000_cohorts(spark):
    """Pairs are made in Spark: 2,999 cohorts and one never-treated unit, a constant effect of 2 in every pair."""
    C = 3000
    p = spark.range(C * (C + 2)).select((F.col("id") % C).cast("int").alias("unit"), (F.col("id") / C).cast("int").alias("t"))
    p = p.withColumn("d", F.when(F.col("unit") < C - 1, (F.col("t") > F.col("unit")).cast("int")).otherwise(0))
    p = p.withColumn("y", F.col("d") * 2.0 + F.col("unit") * 0.1 + F.col("t") * 0.3)
    r = B.bacon(p, "y", "d", "unit", "t").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("estimate")).alias("b"),
                                              F.min("estimate").alias("lo"), F.max("estimate").alias("hi")).first()
    assert r["n"] == (C - 1) * (C - 2) + (C - 1)
    assert r["w"] == pytest.approx(1.0, abs=1e-9) and r["b"] == pytest.approx(2.0, abs=1e-7)
    assert r["lo"] == pytest.approx(2.0, abs=1e-6) and r["hi"] == pytest.approx(2.0, abs=1e-6)
    assert B.bacon(p.limit(0), "y", "d", "unit", "t").count() == 0


def test_cohort_pairs_of_many_cohorts(spark):
    from panelkit.operators.joins import cohort_pairs
    df = spark.range(700).select((F.col("id") % 300).cast("int").alias("g")).union(spark.sql("SELECT CAST(NULL AS INT)"))
    got = {(r["treated"], r["control"]): r["type"] for r in cohort_pairs(df, "g").collect()}
    assert len(got) == 300 * 299 + 300
    assert got[3, None] == "Treated vs Untreated" and got[3, 5] == "Earlier vs Later Treated" and got[5, 3] == "Later vs Earlier Treated"
