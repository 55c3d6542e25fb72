"""Weighted least squares with unit and period effects absorbed exactly.

Plan of one fit (SURVEY 4.3/4.4):

1. one hash exchange on the unit: per-unit weight totals W_i and weighted
   means, giving unit-demeaned columns d_v;
2. per-period sums b_v[t] = sum_i w_it d_v,it and d_t = sum_i w_it (tiny
   groupBy on the period, partial aggregation);
3. the period matrix M = diag(d) - sum_i a_i a_i', a_i[t] = w_it / sqrt(W_i),
   accumulated by MLlib's tree aggregation over one dense T-vector per unit
   (no within-unit pairs are materialised, nothing is shuffled);
4. driver: gamma_v = M^+ b_v (least-norm, so disconnected panels still give
   the unique projection);
5. the T-row gamma table is broadcast (size = number of periods, checked) and
   each column is residualised: v - vbar_i - gamma_v[t] + sum_s w_is gamma_v[s] / W_i;
6. one global aggregate for the Gram matrix, a driver k x k solve with
   collinear-column removal, and one pass for residual scores per cluster.

Only coefficient-sized results ever reach the driver.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from panelkit.functions.dist import p_t
from panelkit.operators.linalg import gram, pivoted_solve, rowmatrix_gram
from panelkit.operators.periods import absorbed_periods

AGG_CHUNK = 48  # value columns per aggregate (bounds generated code size)


@contextlib.contextmanager
def wide_plan_conf(spark: SparkSession):
    """Regression plans carry dozens of derived columns (event dummies, residualised
    copies); Catalyst's constraint propagation is combinatorial in such aliased
    projections (minutes of planning for ~20 columns), while none of these plans
    benefits from inferred filters.  Switch it off for the fit's own actions only."""
    key = "spark.sql.constraintPropagation.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


COEF_SCHEMA = "term string, estimate double, se double, t_stat double, p_value double"


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    n_units: int
    n_periods: int
    n_clusters: int | None
    K: int
    df_t: int
    ssr: float
    tss: float
    tss_within: float
    sum_w: float
    vcov_type: str
    omitted: list[str] = field(default_factory=list)
    fe_rank_deficit: int = 0
    K_full: int | None = None  # with all unit effects, for the root mean squared error

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.vcov), 0, None))

    def coef(self, term: str) -> float:
        return float(self.beta[self.terms.index(term)])

    def rows(self):
        out = []
        for j, term in enumerate(self.terms):
            b = float(self.beta[j])
            s = float(self.se[j]) if not math.isnan(b) else float("nan")
            tt = b / s if s and not math.isnan(s) else float("nan")
            out.append((term, _nn(b), _nn(s), _nn(tt), _nn(p_t(tt, self.df_t))))
        return out

    def coef_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), COEF_SCHEMA)

    def lincom(self, weights: dict[str, float], df: int | None = None) -> dict:
        """Estimate, se, t, p of sum_j c_j beta_j (delta method on the vcov)."""
        c = np.zeros(len(self.terms))
        for term, v in weights.items():
            c[self.terms.index(term)] = v
        idx = [j for j in range(len(c)) if c[j] != 0]
        est = float(c[idx] @ self.beta[idx])
        var = float(c[idx] @ self.vcov[np.ix_(idx, idx)] @ c[idx])
        se = math.sqrt(var) if var >= 0 else float("nan")
        t = est / se if se else float("nan")
        d = self.df_t if df is None else df
        return {"estimate": est, "se": se, "t": t, "p": p_t(t, d), "df": d}

    @property
    def r2(self) -> float:
        return float(1.0 - self.ssr / self.tss) if self.tss > 0 else float("nan")

    @property
    def r2_within(self) -> float:
        return 1.0 - self.ssr / self.tss_within if self.tss_within > 0 else float("nan")

    @property
    def rmse(self) -> float:
        dfr = self.n - (self.K if self.K_full is None else self.K_full)
        return math.sqrt(self.ssr / self.sum_w * self.n / dfr) if dfr > 0 else float("nan")

    def stats(self) -> dict:
        """N, SSR (analytic weights normalised to sum n), R2, within R2, RMSE."""
        return {"n": self.n, "n_units": self.n_units, "n_periods": self.n_periods,
                "n_clusters": self.n_clusters, "K": self.K,
                "ssr": self.ssr * self.n / self.sum_w, "r2": self.r2,
                "r2_within": self.r2_within, "rmse": self.rmse}


def _nn(x: float):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def absorb_two_way(df: DataFrame, cols: Sequence[str], unit: str, period: str,
                   weight: str | None = None, extra: Sequence[str] = (), max_periods: int = 5000,
                   periods: str = "auto"):
    """Exact two-way (unit + period) weighted residualisation of ``cols``.

    Returns (demeaned DataFrame with _u, _w, extra columns and _x0.._xk,
    info dict).  Rows with any missing column or non-positive weight are
    dropped first (complete cases).  Several rows may share a (unit, period).

    Up to ``max_periods`` periods their effects are solved as a T x T system on the
    driver (``periods='direct'``), beyond by steps in Spark ('iterative', see
    ``operators.periods``), with the same residuals; 'auto' counts first.  Never more
    than ``max_periods + 1`` rows are collected; 'direct' refuses more periods."""
    if periods not in ("auto", "direct", "iterative"):
        raise ValueError(f"periods={periods!r}: auto, direct or iterative")
    spark = df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    vn = [f"_v{i}" for i in range(len(cols))]
    base = df.select(F.col(unit).alias("_u"), F.col(period).alias("_t"), w.alias("_w"),
                     *[F.col(e) for e in extra],
                     *[F.col(c).cast("double").alias(v) for c, v in zip(cols, vn)])
    base = base.na.drop(how="any", subset=["_u", "_t", "_w", *vn, *extra]).filter(F.col("_w") > 0)

    # unit-demeaned columns: whole-partition windows over the unit key (one exchange)
    nv = len(vn)
    wu = Window.partitionBy("_u")
    unit_df = base.withColumn("_wsum", F.sum("_w").over(wu)).withColumns(
        {f"_d{i}": F.col(v) - F.sum(F.col("_w") * F.col(v)).over(wu) / F.col("_wsum") for i, v in enumerate(vn)})
    unit_df = unit_df.persist(StorageLevel.MEMORY_AND_DISK)

    if periods == "iterative":
        return _by_steps(unit_df, nv, extra)

    # per-period sums grouped by the period itself (this also yields the period list);
    # a bounded number of value columns per aggregate keeps generated code small
    per: dict = {}
    for lo in range(0, nv, AGG_CHUNK):
        idx = list(range(lo, min(nv, lo + AGG_CHUNK)))
        head = [F.sum("_w").alias("d"), F.count(F.lit(1)).alias("n")] if lo == 0 else []
        sums = [F.sum(F.col("_w") * e).alias(f"{name}{i}") for i in idx
                for name, e in (("b", F.col(f"_d{i}")), ("wv", F.col(f"_v{i}")), ("wvv", F.col(f"_v{i}") * F.col(f"_v{i}")))]
        rows = unit_df.groupBy("_t").agg(*head, *sums).limit(max_periods + 1).collect()
        if len(rows) > max_periods:
            if periods == "auto":
                return _by_steps(unit_df, nv, extra)
            unit_df.unpersist()
            raise ValueError(f"more than max_periods={max_periods} periods; absorb the period effect in stages")
        for r in rows:
            per.setdefault(r["_t"], {}).update(r.asDict())
    periods = sorted(per)
    T = len(periods)
    d = np.array([per[p]["d"] for p in periods], dtype=float)
    B, wv, wvv = (np.array([[per[p][f"{name}{j}"] for j in range(nv)] for p in periods], dtype=float).reshape(T, nv)
                  for name in ("b", "wv", "wvv"))
    n = int(sum(per[p]["n"] for p in periods))
    sw = float(d.sum())
    raw = wvv.sum(axis=0) - wv.sum(axis=0) ** 2 / sw if sw > 0 else np.zeros(nv)  # weighted variance before absorption
    # a constant column's is rounding: far below its second moment
    raw = np.where(raw > 1e-14 * wvv.sum(axis=0), raw, np.inf)

    # a_i[t] = w_it / sqrt(W_i): one dense T-vector per unit; the period index is a
    # table of one row a period, so it may be broadcast
    index = spark.createDataFrame([(p, i) for i, p in enumerate(periods)], base.select("_t").schema.add("_ti", IntegerType()))
    cells = unit_df.groupBy("_u", "_t").agg(F.sum("_w").alias("_wc"), F.first("_wsum").alias("_wsum")).join(F.broadcast(index), "_t")
    per_unit = cells.groupBy("_u").agg(F.map_from_entries(F.collect_list(F.struct("_ti", "_wc"))).alias("m"),
                                       F.first("_wsum").alias("W"))
    vec = per_unit.select(F.transform(F.sequence(F.lit(0), F.lit(T - 1)),
                                      lambda j: F.coalesce(F.element_at(F.col("m"), j), F.lit(0.0))
                                      / F.sqrt(F.col("W"))).alias("a"))
    if T > 1:
        M = np.diag(d) - rowmatrix_gram(vec, "a", ncols=T)
        gamma, _, rank, _ = np.linalg.lstsq(M, B, rcond=None)
    else:  # one period: the unit effects leave nothing to it
        gamma, rank = np.zeros((T, nv)), 0
    deficit = max(0, (T - 1) - int(rank))

    # the gamma table has one row per period (bounded, checked): broadcast
    gschema = base.select("_t").schema
    for j in range(nv):
        gschema = gschema.add(f"_g{j}", DoubleType())
    gtab = spark.createDataFrame([(p, *[float(x) for x in gamma[i]]) for i, p in enumerate(periods)], gschema)
    # the broadcast join keeps the unit partitioning, so its window needs no exchange
    dm = _residuals(unit_df, F.broadcast(gtab), nv, extra)
    info = {"T": T, "n": n, "sum_w": sw, "raw": raw, "fe_rank_deficit": deficit, "_persisted": unit_df}
    return dm, info


def _residuals(unit_df: DataFrame, effects: DataFrame, nv: int, extra: Sequence[str]) -> DataFrame:
    wu = Window.partitionBy("_u")
    return unit_df.join(effects, "_t").select("_u", "_w", *extra, *[
        (F.col(f"_d{j}") - F.col(f"_g{j}") + F.sum(F.col("_w") * F.col(f"_g{j}")).over(wu) / F.col("_wsum"))
        .alias(f"_x{j}") for j in range(nv)])


def _by_steps(unit_df: DataFrame, nv: int, extra: Sequence[str]):
    """The same from period effects found in Spark; their table is joined by its size, as Spark sees it."""
    effects, info = absorbed_periods(unit_df, nv, AGG_CHUNK)
    return _residuals(unit_df, effects, nv, extra), {**info, "_persisted": unit_df}


def feols(df: DataFrame, y: str, xs: Sequence[str], unit: str, period: str,
          weight: str | None = None, cluster: str | None = "unit", vcov: str = "cluster",
          ssc: str = "nested", df_t: str = "default", periods: str = "auto") -> Fit:
    """Y ~ xs | unit + period, weights, iid (R11) or cluster-robust (R12) vcov.

    cluster='unit' clusters on the unit key (scores then need no extra exchange).
    ssc='nested': K = k + T - 1 (unit effects nested in the cluster are not
    counted); ssc='full' (Stata ``reg`` with dummies): K = k + N + T - 1.
    df_t: 'default' uses G - 1 for cluster and n - K for iid; 'ref' uses n - k
    (the reference's quirk in its 5-year p-value).
    periods: how period effects are solved, see ``absorb_two_way``."""
    return feols_multi(df, [(y, list(xs))], unit, period, weight, cluster, vcov, ssc, df_t, periods)[0]


def feols_multi(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], unit: str, period: str,
                weight: str | None = None, cluster: str | None = "unit", vcov: str = "cluster",
                ssc: str = "nested", df_t: str = "default", periods: str = "auto") -> list[Fit]:
    """Several models (outcomes x regressor sets), each on its own complete cases.

    Models whose columns are missing in the same rows share one absorption; a
    NULL in one model's column takes no row from another model."""
    specs = [(y, list(xs)) for y, xs in specs]
    if len(specs) == 1:  # one model, one sample
        with wide_plan_conf(df.sparkSession):
            return _feols_multi(df, specs, unit, period, weight, cluster, vcov, ssc, df_t, periods)
    every = list(dict.fromkeys(c for y, xs in specs for c in [y, *xs]))
    gap = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    missing = df.agg(*[F.max(gap(c).cast("int")).alias(f"m{i}") for i, c in enumerate(every)]).first()
    gaps = {c for i, c in enumerate(every) if missing[f"m{i}"]}
    groups: dict[frozenset, list[int]] = {}
    for m, (y, xs) in enumerate(specs):
        groups.setdefault(frozenset(gaps & {y, *xs}), []).append(m)
    fits: dict[int, Fit] = {}
    with wide_plan_conf(df.sparkSession):
        for models in groups.values():
            fits.update(zip(models, _feols_multi(df, [specs[m] for m in models], unit, period, weight, cluster, vcov, ssc, df_t, periods)))
    return [fits[m] for m in range(len(specs))]


def _feols_multi(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], unit: str, period: str,
                 weight: str | None, cluster: str | None, vcov: str, ssc: str, df_t: str,
                 periods: str = "auto") -> list[Fit]:
    """Models on one sample, the complete cases of all their columns, from ONE absorption.

    Two-way residualisation is column by column (Frisch-Waugh), so the union of
    all columns is absorbed once, one Gram aggregate serves every model, and
    one scores pass computes every model's residual scores."""
    cols: list[str] = []
    for y, xs in specs:
        for c in [y, *xs]:
            if c not in cols:
                cols.append(c)
    idx = {c: i for i, c in enumerate(cols)}
    cl = None if vcov == "iid" else (unit if cluster in (None, "unit") else cluster)
    extra = [] if cl in (None, unit) else [cl]
    dm, info = absorb_two_way(df, cols, unit, period, weight, extra=extra, periods=periods)
    dm = dm.persist(StorageLevel.MEMORY_AND_DISK)
    G = gram(dm, [f"_x{i}" for i in range(len(cols))], F.col("_w"))

    solved = []
    for y, xs in specs:
        yi, xi = idx[y], [idx[x] for x in xs]
        beta, keep, inv = pivoted_solve(G[np.ix_(xi, xi)], G[xi, yi], info["raw"][xi])
        kept = [j for j in range(len(xs)) if keep[j]]
        solved.append((yi, xi, beta, keep, inv, kept))

    # one pass: per unit, every model's SSR and scores (residuals projected once per row)
    res_cols = {}
    for m, (yi, xi, beta, keep, inv, kept) in enumerate(solved):
        e = F.col(f"_x{yi}")
        for j in kept:
            e = e - F.lit(float(beta[j])) * F.col(f"_x{xi[j]}")
        res_cols[f"_e{m}"] = e
    dme = dm.withColumns(res_cols)
    aggs = []
    for m, (yi, xi, beta, keep, inv, kept) in enumerate(solved):
        e = F.col(f"_e{m}")
        aggs.append(F.sum(F.col("_w") * e * e).alias(f"_ssr{m}"))
        aggs += [F.sum(F.col("_w") * F.col(f"_x{xi[j]}") * e).alias(f"_s{m}_{i}") for i, j in enumerate(kept)]
    unit_level = dme.groupBy("_u", *extra).agg(*aggs).persist(StorageLevel.MEMORY_AND_DISK)
    tot = unit_level.agg(F.count(F.lit(1)).alias("N"), *[F.sum(f"_ssr{m}").alias(f"ssr{m}") for m in range(len(specs))]).first()
    n_units = tot["N"]
    if cl is None:
        by_cl, n_clusters = None, None
    elif cl == unit:
        by_cl, n_clusters = unit_level, n_units
    else:
        score_cols = [c for c in unit_level.columns if c.startswith("_s")]
        by_cl = unit_level.groupBy(*extra).agg(*[F.sum(c).alias(c) for c in score_cols]) \
                          .persist(StorageLevel.MEMORY_AND_DISK)
        n_clusters = by_cl.count()

    n, T = info["n"], info["T"]
    # one Gram matrix of all models' scores; a model's meat is a block of it
    names = [f"_s{m}_{i}" for m, (*_, kept) in enumerate(solved) for i in range(len(kept))]
    place = {x: i for i, x in enumerate(names)}
    scores = gram(by_cl, names) if by_cl is not None and names else None
    fits = []
    for m, ((y, xs), (yi, xi, beta, keep, inv, kept)) in enumerate(zip(specs, solved)):
        k, kk = len(xs), len(kept)
        ssr = tot[f"ssr{m}"]
        K_full = kk + n_units + T - 1 - info["fe_rank_deficit"]
        K = K_full if vcov == "iid" or ssc == "full" else K_full - n_units
        V = np.full((k, k), np.nan)
        if kk:
            if vcov == "iid":
                Vk = ssr / (n - K) * inv
            else:
                at = [place[f"_s{m}_{i}"] for i in range(kk)]
                meat = scores[np.ix_(at, at)]
                Gc = n_clusters
                c = (Gc / (Gc - 1)) * ((n - 1) / (n - K))
                Vk = c * inv @ meat @ inv
            V[np.ix_(kept, kept)] = Vk
        if df_t == "ref":
            dft = n - kk
        elif vcov == "iid":
            dft = n - K
        else:
            dft = n_clusters - 1
        fits.append(Fit(terms=list(xs), beta=beta, vcov=V, n=n, n_units=n_units, n_periods=T,
                        n_clusters=n_clusters, K=K, df_t=dft, ssr=ssr, K_full=K_full, tss=float(info["raw"][yi]) if np.isfinite(info["raw"][yi]) else 0.0,
                        tss_within=float(G[yi, yi]), sum_w=info["sum_w"], vcov_type=vcov,
                        omitted=[xs[j] for j in range(k) if not keep[j]],
                        fe_rank_deficit=info["fe_rank_deficit"]))
    for held in (info["_persisted"], unit_level, dm, *([by_cl] if by_cl is not None and by_cl is not unit_level else [])):
        held.unpersist()
    if "_folder" in info:
        info["_folder"].drop()
    return fits


def wls_multi(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], weight: str | None = None,
              intercept: bool = True) -> list[Fit]:
    """Several weighted least-squares models on one table from ONE Gram aggregate."""
    with wide_plan_conf(df.sparkSession):
        return _wls_multi(df, specs, weight, intercept)


def _wls_multi(df: DataFrame, specs, weight, intercept) -> list[Fit]:
    cols: list[str] = []
    for y, xs in specs:
        for c in [y, *xs]:
            if c not in cols:
                cols.append(c)
    idx = {c: i for i, c in enumerate(cols)}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(w.alias("_w"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    base = base.na.drop(how="any").filter(F.col("_w") > 0)
    ci = len(cols)
    base = base.withColumn(f"_x{ci}", F.lit(1.0))
    G = gram(base, [f"_x{i}" for i in range(ci + 1)], F.col("_w"))
    tot = base.agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("sw")).first()
    n, sw = tot["n"], tot["sw"]
    fits = []
    for y, xs in specs:
        xs = list(xs) + (["const"] if intercept else [])
        xi = [idx[x] for x in xs if x != "const"] + ([ci] if intercept else [])
        yi = idx[y]
        beta, keep, inv = pivoted_solve(G[np.ix_(xi, xi)], G[xi, yi])
        kept = [j for j in range(len(xs)) if keep[j]]
        bk = beta[kept]
        Gk = G[np.ix_(xi, xi)][np.ix_(kept, kept)]
        ssr = float(G[yi, yi] - 2 * bk @ G[xi, yi][kept] + bk @ Gk @ bk)
        K = len(kept)
        V = np.full((len(xs), len(xs)), np.nan)
        V[np.ix_(kept, kept)] = ssr / (n - K) * inv
        wy, wyy = float(G[yi, ci]), float(G[yi, yi])   # sum w y, sum w y^2 (constant column is 1)
        tss = wyy - wy * wy / sw
        fits.append(Fit(terms=xs, beta=beta, vcov=V, n=n, n_units=n, n_periods=1, n_clusters=None, K=K,
                        df_t=n - K, ssr=ssr, tss=tss, tss_within=tss, sum_w=sw, vcov_type="iid",
                        omitted=[xs[j] for j in range(len(xs)) if not keep[j]]))
    return fits


def coef_series(fit: Fit, taus: Sequence[int], terms: Sequence[str], z: float = 1.96) -> list[tuple]:
    """(tau, estimate, se, ci_low, ci_high) per event-time coefficient."""
    out = []
    for tau, term in zip(taus, terms):
        j = fit.terms.index(term)
        b, s = float(fit.beta[j]), float(fit.se[j])
        if math.isnan(b):
            out.append((tau, None, None, None, None))
        else:
            out.append((tau, b, s, b - z * s, b + z * s))
    return out
