"""Group-time average treatment effects without covariates (varying base).

Plan:
* balanced units only (observed with y in every period); units treated in the
  first period are dropped, cohorts after the last period count as never treated;
  a unit becomes one row with its outcomes in period order;
* every ATT(g,t) and its analytic influence-function se come from sums of w, w^2,
  dy w, dy w^2 and dy^2 w^2 over a cell's treated and control units.  A task forms the
  moments of the cohorts in a batch and adds them to the cells that they serve, on
  either side, so that a row a cell is shuffled and collected, whatever the control group;
* aggregations (simple, dynamic, overall): a unit's influence function is w times
  a linear function of its outcomes whose coefficients depend on cohort and target
  only; tasks make those of the cohorts they meet from the cell table;
* errors, covariances and bootstrap replicates are sums over units that tasks add up:
  targets, targets^2 and draws x targets numbers.  The multiplier bootstrap hashes a
  sign per (unit, draw), whatever the number of targets, and is a matrix product a batch.
Unit weights are taken from the unit's first period (normalised to mean one).
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.joins import bounded_values
from panelkit.operators.linalg import add_up
from panelkit.operators.panel import over_unit

CELL_SCHEMA = "g int, t int, att double, se double, n_treated long, n_control long"


@dataclass
class AttGt:
    spark: SparkSession
    units: DataFrame            # (u, G, w, y) one row per unit, y in period order
    periods: list[int]
    cells: list[dict]           # driver copy of the cell table (bounded by cohorts x periods)
    n: int
    pg: dict                    # weighted cohort shares
    control: str

    def cell_frame(self) -> DataFrame:
        rows = [(c["g"], c["t"], c["att"], c["se"], c["n_tr"], c["n_co"]) for c in self.cells]
        return self.spark.createDataFrame(rows, CELL_SCHEMA)


def _owned(res: AttGt, *held: DataFrame) -> AttGt:
    """The caches go when nobody holds the result any more."""
    weakref.finalize(res, _release, *held)
    return res


def _release(*held: DataFrame) -> None:
    for df in held:
        df.unpersist()


def _prepare(df: DataFrame, y: str, u: str, t: str, g: str, w: str | None, max_periods: int):
    p = df.select(F.col(u).alias("u"), F.col(t).cast("int").alias("t"), F.col(y).cast("double").alias("y"),
                  F.col(g).cast("int").alias("G"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w0"))
    p = p.filter(F.col("y").isNotNull())
    periods = sorted(bounded_values(p, "t", max_periods))
    T = len(periods)
    t_lo, t_hi = periods[0], periods[-1]
    wu = over_unit("u")
    p = (p.withColumn("_n", F.size(F.collect_set("t").over(wu)))  # distinct periods: a repeated row fills no gap
          .withColumn("w", F.max(F.when(F.col("t") == t_lo, F.col("w0"))).over(wu))
          .filter((F.col("_n") == T) & F.col("w").isNotNull() & (F.col("w") > 0))
          .withColumn("G", F.when(F.col("G") > t_hi, F.lit(None)).otherwise(F.col("G")))
          .filter(F.col("G").isNull() | (F.col("G") > t_lo))
          .drop("_n", "w0"))
    return p, periods


def att_gt(df: DataFrame, y: str, u: str, t: str, g: str, w: str | None = None,
           control: str = "never", fallback: bool = False, max_periods: int = 1000) -> AttGt:
    """ATT(g,t) for every cohort and period after the first.

    control: 'never' (never-treated units) or 'notyet' (never treated or
    adopting after max(t, base), excluding the cohort itself).  With
    ``fallback`` (E3) a 'never' request without never-treated units switches
    to 'notyet', decided from cell counts, not from an error.  Cohorts and
    periods make the cells that the driver holds; more than ``max_periods`` periods
    (cohorts are some of them) are refused before anything is collected.  Cached
    data go with the returned object."""
    spark = df.sparkSession
    p, periods = _prepare(df, y, u, t, g, w, max_periods)
    T = len(periods)
    units = (p.groupBy("u", "G", "t").agg(F.avg("y").alias("y"), F.first("w").alias("w"))
             .groupBy("u", "G").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("t", "y"))).alias("ys"))
             .select("u", "G", "w", F.transform("ys", lambda x: x["y"]).alias("y")).persist(StorageLevel.MEMORY_AND_DISK))
    sizes = {r["G"]: (r["n"], r["sw"]) for r in units.groupBy("G").agg(F.count("*").alias("n"), F.sum("w").alias("sw")).collect()}  # a row a cohort
    n, sw, pos = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values()), {p: i for i, p in enumerate(periods)}
    if control == "never" and fallback and None not in sizes:
        control = "notyet"
    scaled = units.withColumn("w", F.col("w") / F.lit(sw / n if n else 1.0))
    cohorts = sorted(x for x in sizes if x is not None)
    pg = {x: sizes[x][1] / sw for x in cohorts}
    at = [(k, i, (pos.get(k - 1) if periods[i] >= k else i - 1)) for k in cohorts for i in range(1, T)]
    sums = _cell_sums(scaled, periods, [(k, i, j) for k, i, j in at if j is not None], control)
    cells = []
    for k, i, j in at:
        cell = {"g": k, "t": periods[i], "n_tr": 0, "n_co": 0, "att": None, "se": None}
        if j is not None:
            tr, co = sums[k, i]
            cell |= {"n_tr": int(round(tr[0])), "n_co": int(round(co[0]))}
            if tr[1] > 0 and co[1] > 0:
                m_tr, m_co = tr[2] / tr[1], co[2] / co[1]
                v = sum(max(x[5] - 2 * mean * x[4] + mean * mean * x[3], 0.0) / x[1] ** 2 for x, mean in ((tr, m_tr), (co, m_co)))
                cell |= {"att": float(m_tr - m_co), "se": math.sqrt(v), "m_tr": m_tr, "m_co": m_co, "s0_tr": tr[1], "s0_co": co[1], "at": (i, j)}
        cells.append(cell)
    return _owned(AttGt(spark, scaled, periods, cells, n, pg, control), units)


def _serves(control: str, cohort: int | None, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For which cells (k, t) the units of a cohort (None: never treated) are controls."""
    if cohort is None or control == "never":
        return np.full(len(k), cohort is None)
    base = np.where(t >= k, k - 1, t - 1)
    return (cohort > np.maximum(t, base)) & (k != cohort)


def _by_cohort(batch: pa.RecordBatch, T: int) -> Iterator[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(cohort, rows, weights, outcomes) of every cohort in a batch."""
    w = batch.column("w").to_numpy()
    y = batch.column("y").flatten().to_numpy().reshape(len(w), T)
    never = np.iinfo(np.int64).min
    g = batch.column("G").cast(pa.int64()).fill_null(never).to_numpy()
    order = np.argsort(g, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
        if len(rows):
            cohort = int(g[rows[0]])
            yield None if cohort == never else cohort, rows, w[rows], y[rows]


def _cell_sums(units: DataFrame, periods: list[int], at: list[tuple[int, int, int]], control: str) -> dict:
    """{(cohort, place of t): (treated, controls)} of the cells ``at`` (cohort, places of t and base), each side
    n, sum w, sum dy w, sum w^2, sum dy w^2, sum dy^2 w^2."""
    n, T = len(at), len(periods)
    if not n:
        return {}
    K, I, J = (np.array(x) for x in zip(*at))
    t = np.array(periods)[I]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 6, n))
        for batch in batches:
            for cohort, _, w, y in _by_cohort(batch, T):
                sq = w * w
                S, P, Q = w @ y, sq @ y, (y * sq[:, None]).T @ y
                for side, of in ((0, K == cohort if cohort is not None else np.zeros(n, bool)), (1, _serves(control, cohort, K, t))):
                    i, j = I[of], J[of]
                    some = np.ones(of.sum())
                    total[side][:, of] += [len(w) * some, w.sum() * some, S[i] - S[j], sq.sum() * some, P[i] - P[j], Q[i, i] - 2 * Q[i, j] + Q[j, j]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *map(pa.array, total.reshape(12, n))], ["at", *(f"v{q}" for q in range(12))])

    schema = "at long, " + ", ".join(f"v{q} double" for q in range(12))
    sums = units.select("G", "w", "y").mapInArrow(run, schema).groupBy("at").agg(*[F.sum(f"v{q}").alias(f"v{q}") for q in range(12)])
    out = {(k, i): (np.zeros(6), np.zeros(6)) for k, i, _ in at}
    for r in sums.collect():
        out[at[r["at"]][:2]] = (np.array(r[1:7]), np.array(r[7:13]))
    return out


@dataclass
class _Influence:
    """What a unit's influence on every target takes from the cells: one row a cell, a target each."""

    names: list[str]
    estimates: list[float]
    control: str
    n: int
    T: int
    cells: dict[str, np.ndarray]    # k, t, i, j, m_tr, s0_tr, m_co, s0_co, att, om, q of every cell that counts
    mass: np.ndarray                # by target: cohort shares of its cells, and those times the effects
    effect: np.ndarray
    post: list[int]                 # targets whose mean is the last one ("overall"), if any

    def coefficients(self, cohort: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(T x targets, targets): a unit's influence is w * (y @ slope + const)."""
        c, size = self.cells, len(self.mass)
        slope, const = np.zeros((self.T, size)), np.zeros(size)
        own = c["k"] == cohort if cohort is not None else np.zeros(len(c["k"]), bool)
        for of, sign, mean, s0 in ((own, 1.0, "m_tr", "s0_tr"), (_serves(self.control, cohort, c["k"], c["t"]), -1.0, "m_co", "s0_co")):
            unit, q = sign * c["om"][of] * self.n / c[s0][of], c["q"][of]
            np.add.at(slope, (c["i"][of], q), unit)
            np.add.at(slope, (c["j"][of], q), -unit)
            np.add.at(const, q, -unit * c[mean][of])
        # weight estimation: (w S(g) - A) / P - A / P^2 (w c(g) - P), whose constant parts cancel
        q = c["q"][own]
        np.add.at(const, q, c["att"][own] / self.mass[q] - self.effect[q] / self.mass[q] ** 2)
        if self.post:
            slope = np.column_stack([slope, slope[:, self.post].mean(axis=1)])
            const = np.append(const, const[self.post].mean())
        return slope, const

    def of_batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """(batch, units x targets influence)."""
        known: dict = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, len(self.names)))
            for cohort, rows, w, y in _by_cohort(batch, self.T):
                if cohort not in known:
                    known[cohort] = self.coefficients(cohort)
                slope, const = known[cohort]
                out[rows] = w[:, None] * (y @ slope + const)
            yield batch, out


def _influence(res: AttGt, kind: str, min_e: int | None, max_e: int | None) -> _Influence | None:
    """Targets by kind; NULL cells are ignored (E7). None without any."""
    ok = [c for c in res.cells if c["att"] is not None]
    if kind == "simple":
        use, names = [c for c in ok if c["t"] >= c["g"]], ["simple"]
        q = np.zeros(len(use), np.int64)
    else:
        use = [c for c in ok if (min_e is None or c["t"] - c["g"] >= min_e) and (max_e is None or c["t"] - c["g"] <= max_e)]
        events, q = np.unique([c["t"] - c["g"] for c in use], return_inverse=True)
        names = [f"e{e}" for e in events]
    if not use:
        return None
    pg, att = np.array([res.pg[c["g"]] for c in use]), np.array([c["att"] for c in use])
    mass, effect = np.bincount(q, pg), np.bincount(q, pg * att)
    get = lambda f, kind=float: np.array([f(c) for c in use], kind)
    cells = {"k": get(lambda c: c["g"], int), "t": get(lambda c: c["t"], int), "i": get(lambda c: c["at"][0], int), "j": get(lambda c: c["at"][1], int),
             **{x: get(lambda c, x=x: c[x]) for x in ("m_tr", "s0_tr", "m_co", "s0_co", "att")}, "om": pg / mass[q], "q": q}
    estimates = (effect / mass).tolist()
    post = [x for x, name in enumerate(names) if kind == "dynamic" and int(name[1:]) >= 0]
    if post:
        names, estimates = [*names, "overall"], [*estimates, sum(estimates[x] for x in post) / len(post)]
    return _Influence(names, estimates, res.control, res.n, len(res.periods), cells, mass, effect, post)


def _covariance(res: AttGt, inf: _Influence, diagonal: bool) -> np.ndarray:
    """Variances, or the covariance matrix, of all targets' estimates."""
    held, k = res.spark.sparkContext.broadcast(inf), len(inf.names)  # cohorts x periods numbers

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(k if diagonal else (k, k))
        for _, x in held.value.of_batches(batches):
            total += (x * x).sum(axis=0) if diagonal else x.T @ x
        return total.reshape(-1)

    got = add_up(res.units.select("G", "w", "y"), part, k if diagonal else k * k) / res.n**2
    return got if diagonal else got.reshape(k, k)


def _events(name: str) -> int | None:
    return None if name in ("simple", "overall") else int(name[1:])


def aggte(res: AttGt, kind: str = "simple", min_e: int | None = None, max_e: int | None = None,
          boot_draws: int = 0, seed: int = 0) -> DataFrame:
    """E5/E6/E7 (and E8 when ``boot_draws`` > 0): aggregated ATT with influence-function se.

    kind='simple': cohort-share weighted mean of post cells.  kind='dynamic':
    one row per event time e in [min_e, max_e], plus 'overall' = plain mean over e >= 0.
    Output: (target, e, att, se[, boot_se])."""
    inf = _influence(res, kind, min_e, max_e)
    schema = "target string, e int, att double, se double" + (", boot_se double" if boot_draws else "")
    if inf is None:
        return res.spark.createDataFrame([], schema)
    se = np.sqrt(_covariance(res, inf, True)).tolist()
    rows = [(name, _events(name), float(b), s) for name, b, s in zip(inf.names, inf.estimates, se)]
    if boot_draws:
        boot = _spread(multiplier_bootstrap(res, inf, boot_draws, seed)).tolist()
        rows = [(*r, s) for r, s in zip(rows, boot)]
    return res.spark.createDataFrame(rows, schema)


def aggte_cov(res: AttGt, kind: str = "dynamic", min_e: int | None = None, max_e: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(targets, estimates, covariance matrix) of an aggregation: one Gram matrix of the influence functions."""
    inf = _influence(res, kind, min_e, max_e)
    if inf is None:
        return [], np.zeros(0), np.zeros((0, 0))
    return inf.names, np.array(inf.estimates), _covariance(res, inf, False)


def multiplier_bootstrap(res: AttGt, inf: _Influence, draws: int, seed: int = 0) -> np.ndarray:
    """(draws, targets) replicates sum_i v_ib IF_i / n, with Rademacher v from a digit of md5(seed|draw|unit).

    A unit's signs serve all targets; tasks multiply their units' sign matrix with the
    influence matrix, and draws x targets numbers are added up and collected."""
    digit = lambda b: F.ascii(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), b, F.col("u")).cast("binary")), 1, 1))
    signs = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda b: (digit(b) % 2 * 2 - 1).cast("tinyint"))  # of the 16 digits 8 are even characters
    held, k = res.spark.sparkContext.broadcast(inf), len(inf.names)

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((draws, k))
        for batch, x in held.value.of_batches(batches):
            v = batch.column("v").flatten().to_numpy().reshape(-1, draws)
            for at in range(0, len(v), 4096):  # as doubles, so many rows at once
                total += v[at: at + 4096].astype(float).T @ x[at: at + 4096]
        return total.reshape(-1)

    return add_up(res.units.select("G", "w", "y", signs.alias("v")), part, draws * k).reshape(draws, k) / res.n


def _spread(reps: np.ndarray) -> np.ndarray:
    """Standard errors from replicates: interquartile range over that of a standard normal."""
    q25, q75 = np.quantile(reps, [0.25, 0.75], axis=0)
    return (q75 - q25) / 1.3489795003921634


BAND_SCHEMA = "target string, e int, att double, boot_se double, crit double, band_low double, band_high double"


def uniform_band(res: AttGt, kind: str = "dynamic", min_e: int | None = None, max_e: int | None = None,
                 draws: int = 999, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Simultaneous confidence bands of an aggregation's targets (the overall mean is not among them).

    The critical value is the ``level`` order statistic, over the draws, of the largest
    absolute replicate in bootstrap errors of all targets (sup-t), so that all bands hold
    at once with that probability.  Targets without spread have no part in it."""
    inf = _influence(res, kind, min_e, max_e)
    if inf is None:
        return res.spark.createDataFrame([], BAND_SCHEMA)
    reps = multiplier_bootstrap(res, inf, draws, seed)
    se = _spread(reps)
    of = [q for q, name in enumerate(inf.names) if name != "overall"]
    live = [q for q in of if se[q] > 0]
    crit = float(np.sort(np.abs(reps[:, live] / se[live]).max(axis=1))[math.ceil(level * draws - 1e-9) - 1]) if live else None
    rows = []
    for q in of:
        b, s = float(inf.estimates[q]), float(se[q])
        rows.append((inf.names[q], _events(inf.names[q]), b, s, crit, None if crit is None else b - crit * s, None if crit is None else b + crit * s))
    return res.spark.createDataFrame(rows, BAND_SCHEMA)
