"""Sun-Abraham interaction-weighted estimator.

A saturated regression of y on cohort x relative-period indicators (reference
period -1, never-treated units as the reference cohort, units treated in the
first period dropped) with unit and period effects absorbed exactly, then share-weighted
aggregation of the cell coefficients with their clustered covariance.

An indicator is a function of (cohort, period), so with unit effects taken out the
normal equations are blocks: one T x T matrix M_g a cohort between its own indicators
and against the period effects, nothing between cohorts, and the sum of all M_g between
period effects.  Each cohort's block is eliminated by itself, in a task; what remains is
one T x T system for the period effects, which the driver solves.  A combination of
coefficients goes the same way: one T x T solve tells how the period effects carry it,
and every cohort adds a quadratic form in its own T x T matrix of scores.  No matrix over all
cells is made; beside T x T numbers the driver holds a few for each cohort and period."""

from __future__ import annotations

import math
import weakref
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.feols import Fit
from panelkit.operators.joins import bounded_values
from panelkit.operators.linalg import add_up, ordered_pivots

NEVER = -(2**63)  # the cohort of never-treated units
ROWS = 1024  # units laid out at once
RANK = 1e-9
Combo = dict[tuple[int, int], float]  # (cohort, place of the period) -> weight


@dataclass(frozen=True)
class _Design:
    """Which periods make columns, and which of those were found to follow from columns before."""

    periods: tuple[int, ...]
    ref: int
    sum_w: float
    dropped: frozenset[tuple[int, int]] | None = None  # None: not looked for across cohorts

    def columns(self, h: int, mass: np.ndarray) -> np.ndarray:
        if h == NEVER or len(self.periods) < 2:
            return np.zeros(0, np.int64)
        return np.array([i for i, p in enumerate(self.periods) if mass[i] > 0 and p - h != self.ref], np.int64)

    def scale(self, mass: np.ndarray) -> np.ndarray:
        """A column's variance before effects were absorbed."""
        return mass - mass**2 / self.sum_w

    def kept(self, h: int, M: np.ndarray, mass: np.ndarray) -> np.ndarray:
        at = self.columns(h, mass)
        if self.dropped is not None:
            return np.array([i for i in at if (h, int(i)) not in self.dropped], np.int64)
        return at[ordered_pivots(M[np.ix_(at, at)], self.scale(mass[at]), RANK)]


def _laid_out(batch: pa.RecordBatch, T: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cohort, w, w y) as units x T matrices, cohort by cohort and some units at once."""
    h, lists = batch.column("h").to_numpy(), [batch.column(c) for c in ("i", "w", "wy")]
    offset = lists[0].offsets.to_numpy()
    i, w, wy = (x.values.to_numpy() for x in lists)
    order = np.argsort(h, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(h[order])) + 1):
        for at in range(0, len(rows), ROWS):
            some = rows[at: at + ROWS]
            n = offset[some + 1] - offset[some]
            row = np.repeat(np.arange(len(some)), n)
            src = np.repeat(offset[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.zeros((2, len(some), T))
            both[0, row, i[src]], both[1, row, i[src]] = w[src], wy[src]
            yield int(h[some[0]]), both[0], both[1]


def _by_cohort(units: DataFrame, T: int, per_units, size: int) -> DataFrame:
    """(h, v): ``size`` numbers a cohort, added up over its units.  ``per_units(h, w, wy)`` gives those of some units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for h, w, wy in _laid_out(batch, T):
                total[h] = total.get(h, 0) + per_units(h, w, wy)
        for h, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(at), pa.array(v[at])], ["h", "at", "v"])

    def dense(key, table):
        v = np.zeros(size)
        v[table.column("at").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"h": pa.array([key[0].as_py()]), "v": pa.array([v.tobytes()], pa.binary())})

    sums = units.select("h", "i", "w", "wy").mapInArrow(run, "h long, at long, v double").groupBy("h", "at").agg(F.sum("v").alias("v"))
    return sums.groupBy("h").applyInArrow(dense, "h long, v binary")


def _moments(h: int, w: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """M_g, b_g and the weight in each period."""
    W = w.sum(axis=1)
    share = w / W[:, None]
    mass = w.sum(axis=0)
    return np.concatenate([(np.diag(mass) - share.T @ w).reshape(-1), wy.sum(axis=0) - share.T @ wy.sum(axis=1), mass])


def _blocks(batches: Iterator[pa.RecordBatch], T: int, column: str = "v") -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cohort, M, b, mass) of each row."""
    for batch in batches:
        for h, v in zip(batch.column("h").to_pylist(), batch.column(column).to_pylist()):
            v = np.frombuffer(v)
            yield h, v[: T * T].reshape(T, T), v[T * T: T * T + T], v[T * T + T:]


def _eliminated(blocks: DataFrame, design: _Design) -> tuple[np.ndarray, np.ndarray]:
    """What the cohorts' own columns take from the period effects' matrix and right-hand side."""
    T = len(design.periods)

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((T, T + 1))
        for h, M, b, mass in _blocks(batches, T):
            if len(K := design.kept(h, M, mass)):
                total += M[:, K] @ np.linalg.solve(M[np.ix_(K, K)], np.column_stack([M[K], b[K]]))
        return total.reshape(-1)

    got = add_up(blocks, part, T * (T + 1)).reshape(T, T + 1)
    return got[:, :T], got[:, T]


def _dropped(blocks: DataFrame, design: _Design, every: np.ndarray) -> frozenset[tuple[int, int]]:
    """Columns that follow from those before and the period effects, cohort by cohort; one block is on the driver at a time."""
    E, out, T = every.copy(), set(), len(design.periods)
    for row in blocks.orderBy("h").toLocalIterator():
        v = np.frombuffer(bytes(row["v"]))
        h, M, mass = row["h"], v[: T * T].reshape(T, T), v[T * T + T:]
        at = design.columns(h, mass)
        if not len(at):
            continue
        left = M[np.ix_(at, at)] - M[at] @ np.linalg.pinv(E, rcond=1e-10, hermitian=True) @ M[:, at]
        K = at[ordered_pivots(left, design.scale(mass[at]), RANK)]
        out |= {(h, int(i)) for i in at if i not in K}
        if len(K):
            E -= M[:, K] @ np.linalg.solve(M[np.ix_(K, K)], M[K])
    return frozenset(out)


class SunAb:
    """The fitted regression: ``cells`` as (cohort, relative period, term, weight), their ``beta`` (NaN: omitted) and what errors are made of."""

    def __init__(self, design: _Design, blocks: DataFrame, scores: DataFrame, carry: np.ndarray, found: dict, stats: dict, factor: float):
        self.design, self.stats, self._factor, self._carry = design, stats, factor, carry
        self._rows = blocks.join(scores.withColumnRenamed("v", "s"), "h").persist(StorageLevel.MEMORY_AND_DISK)
        weakref.finalize(self, self._rows.unpersist)
        keys = [(h, int(i)) for h in sorted(found) for i in design.columns(h, found[h][0])]
        self._keys = keys
        self.beta = np.array([found[h][1][i] for h, i in keys])
        self.cells = [(h, design.periods[i] - h, f"_sa{j}", float(found[h][0][i])) for j, (h, i) in enumerate(keys)]

    @cached_property
    def _spread(self) -> np.ndarray:
        """Sum over cohorts of how their scores move the period effects (T x T)."""
        design, T = self.design, len(self.design.periods)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((T, T))
            for M, S, K, h in _scored(batches, design):
                through = _through(M, K)
                total += through.T @ S @ through
            return total.reshape(-1)

        return add_up(self._rows, part, T * T).reshape(T, T)

    def covariance(self, combos: list[Combo], diagonal: bool = False) -> np.ndarray:
        """Covariance matrix (or its diagonal) of linear combinations of coefficients."""
        design, T, q = self.design, len(self.design.periods), len(combos)
        weights: dict[int, list] = {}
        for c, combo in enumerate(combos):
            for (h, i), a in combo.items():
                weights.setdefault(h, []).append((i, c, a))
        held = self._rows.sparkSession.sparkContext.broadcast(weights)  # a number for each cell that is asked for

        def asked(h: int) -> np.ndarray:
            a = np.zeros((T, q))
            for i, c, x in held.value.get(h, ()):
                a[i, c] = x
            return a

        def toward(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((T, q))
            for M, S, K, h in _scored(batches, design):
                if h in held.value:
                    total += M[:, K] @ np.linalg.solve(M[np.ix_(K, K)], asked(h)[K])
            return total.reshape(-1)

        z = -self._carry @ add_up(self._rows, toward, T * q).reshape(T, q)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(q if diagonal else (q, q))
            for M, S, K, h in _scored(batches, design):
                if h in held.value:
                    own = np.zeros((T, q))
                    own[K] = np.linalg.solve(M[np.ix_(K, K)], asked(h)[K])
                    cross, square = (_through(M, K) @ z), S @ own
                    total += ((2 * cross + own) * square).sum(axis=0) if diagonal else cross.T @ square + square.T @ cross + own.T @ square
            return total.reshape(-1)

        own = add_up(self._rows, part, q if diagonal else q * q)
        common = ((z * (self._spread @ z)).sum(axis=0) if diagonal else z.T @ self._spread @ z)
        return self._factor * (common + (own if diagonal else own.reshape(q, q)))

    def _estimated(self, combos: list[Combo]) -> list[tuple[float, float]]:
        index = {k: j for j, k in enumerate(self._keys)}
        b = [sum(a * self.beta[index[k]] for k, a in c.items()) for c in combos]
        v = self.covariance(combos, diagonal=True) if combos else []
        return [(float(x), float(math.sqrt(max(y, 0.0)))) for x, y in zip(b, v)]

    def _shares(self, wanted) -> Combo:
        """Cells by their share of the (weighted) observations of those that ``wanted`` picks; omitted ones don't count."""
        picked = {k: m for k, (h, e, _, m), b in zip(self._keys, self.cells, self.beta) if wanted(e) and not math.isnan(b)}
        total = sum(picked.values())
        return {k: m / total for k, m in picked.items()}

    def coefs(self) -> list[tuple]:
        """(cohort, relative period, estimate, error), both None where omitted."""
        design, T = self.design, len(self.design.periods)
        held = self._rows.sparkSession.sparkContext.broadcast((self._carry, self._spread))  # T x T numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            carry, spread = held.value
            for M, S, K, h in _scored(batches, design):
                v = np.zeros(T)
                if len(K):
                    own = np.zeros((T, len(K)))
                    own[K] = np.linalg.inv(M[np.ix_(K, K)])
                    z = -carry @ (M @ own)
                    v[K] = (z * (spread @ z)).sum(axis=0) + ((2 * _through(M, K) @ z + own) * (S @ own)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([v.tolist()])], ["h", "v"])

        var = {r["h"]: r["v"] for r in self._rows.mapInArrow(run, "h long, v array<double>").collect()}  # cohorts x periods numbers
        out = []
        for (h, i), (_, e, _, _), b in zip(self._keys, self.cells, self.beta):
            gone = math.isnan(b)
            out.append((h, e, None if gone else float(b), None if gone else math.sqrt(max(self._factor * var[h][i], 0.0))))
        return out

    def att(self) -> tuple[float, float]:
        """Post cells (e >= 0) weighted by their share of (weighted) observations; (NaN, NaN) without any."""
        combo = self._shares(lambda e: e >= 0)
        return self._estimated([combo])[0] if combo else (math.nan, math.nan)

    def event_study(self) -> list[tuple[int, float, float]]:
        """Per relative period, cohorts weighted by their observation shares."""
        es = sorted({e for _, e, _, _ in self.cells})
        combos = {e: c for e in es if (c := self._shares(lambda x, e=e: x == e))}
        got = dict(zip(combos, self._estimated(list(combos.values()))))
        return [(e, *got.get(e, (math.nan, math.nan))) for e in es]

    @cached_property
    def fit(self) -> Fit:
        """The regression with the covariance of all its coefficients; cells x cells numbers, made when asked for."""
        terms = [term for _, _, term, _ in self.cells]
        gone = np.isnan(self.beta)
        V, at = np.full((len(terms), len(terms)), np.nan), np.flatnonzero(~gone)
        if len(at):
            V[np.ix_(at, at)] = self.covariance([{self._keys[j]: 1.0} for j in at])
        return Fit(terms=terms, beta=self.beta, vcov=V, omitted=[t for t, g in zip(terms, gone) if g], **self.stats)


def _scored(batches: Iterator[pa.RecordBatch], design: _Design) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(M, scores' matrix, kept columns, cohort) of each row."""
    T = len(design.periods)
    for batch in batches:
        for h, v, s in zip(*(batch.column(c).to_pylist() for c in ("h", "v", "s"))):
            v = np.frombuffer(v)
            M = v[: T * T].reshape(T, T)
            yield M, np.frombuffer(s).reshape(T, T), design.kept(h, M, v[T * T + T:]), h


def _through(M: np.ndarray, K: np.ndarray) -> np.ndarray:
    """What a cohort's own columns leave of the period effects."""
    out = np.eye(len(M))
    if len(K):
        out[K] -= np.linalg.solve(M[np.ix_(K, K)], M[K])
    return out


def sunab(df: DataFrame, y: str, g: str, u: str, t: str, w: str | None = None, ref: int = -1, max_periods: int = 1000) -> SunAb:
    """The saturated regression; errors clustered by unit.

    The driver holds T x T numbers, and a few for each cohort and period; more than ``max_periods``
    periods are refused before anything is collected.  Several rows may share a (unit, period).
    Cached data go with the returned object."""
    wt = (F.col(w) if w else F.lit(1.0)).cast("double")
    d = df.select(F.col(u).alias("u"), F.col(t).cast("long").alias("t"), F.col(g).cast("long").alias("g"), F.col(y).cast("double").alias("y"), wt.alias("w"))
    d = d.na.drop(subset=["u", "t", "y", "w"]).where("w > 0")
    first = d.agg(F.min("t")).first()[0]
    d = d.where(F.col("g").isNull() | (F.col("g") > first))  # always-treated dropped
    periods = sorted(bounded_values(d, "t", max_periods))
    T = len(periods)
    index = d.sparkSession.createDataFrame([(p, i) for i, p in enumerate(periods)], "t long, i int")
    cells = d.groupBy("u", "g", "t").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"),
                                         F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), F.count("*").alias("n"))
    units = (cells.join(F.broadcast(index), "t").groupBy("u", "g")
             .agg(*[F.collect_list(c).alias(c) for c in ("i", "w", "wy")], F.sum("wyy").alias("wyy"), F.sum("n").alias("n"))
             .withColumn("h", F.coalesce("g", F.lit(NEVER))).persist(StorageLevel.MEMORY_AND_DISK))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    tot = units.agg(F.count("*").alias("N"), F.sum("n").alias("n"), F.sum("wyy").alias("wyy"), F.sum(total("w")).alias("w"), F.sum(total("wy")).alias("wy"),
                    F.sum(F.col("wyy") - total("wy") * total("wy") / total("w")).alias("within")).first()
    design = _Design(tuple(periods), ref, tot["w"] or 1.0)
    blocks = _by_cohort(units, T, _moments, T * T + 2 * T).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(T * T + T)
        for _, M, b, _ in _blocks(batches, T):
            out += np.concatenate([M.reshape(-1), b])
        return out

    sums = add_up(blocks, summed, T * T + T)
    every, rhs = sums[: T * T].reshape(T, T), sums[T * T:]
    rank = int(np.linalg.matrix_rank(every, tol=1e-10 * max(1.0, np.abs(every).max()), hermitian=True)) if T else 0
    taken, taken_b = _eliminated(blocks, design)
    if _loses_rank(every, taken):  # cohorts whose columns together give period effects, as without never-treated units
        design = _Design(design.periods, ref, design.sum_w, _dropped(blocks, design, every))
        taken, taken_b = _eliminated(blocks, design)
    carry = np.linalg.pinv(every - taken, rcond=1e-10, hermitian=True)
    common = carry @ (rhs - taken_b)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, M, b, mass in _blocks(batches, T):
            K, beta = design.kept(h, M, mass), np.full(T, np.nan)
            if len(K):
                beta[K] = np.linalg.solve(M[np.ix_(K, K)], b[K] - M[K] @ common)
            explained = float((common + np.nan_to_num(beta)) @ b)
            yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([mass.tolist()]), pa.array([beta.tolist()]), pa.array([explained])], ["h", "mass", "beta", "explained"])

    got = blocks.mapInArrow(solved, "h long, mass array<double>, beta array<double>, explained double").collect()  # cohorts x periods numbers
    found = {r["h"]: (np.array(r["mass"]), np.array(r["beta"])) for r in got}
    effect = {h: common + np.nan_to_num(beta) for h, (_, beta) in found.items()}

    def scores(h: int, w: np.ndarray, wy: np.ndarray) -> np.ndarray:
        W, fit = w.sum(axis=1), effect[h]
        v = wy - w * (wy.sum(axis=1) / W)[:, None] - w * (fit - ((w @ fit) / W)[:, None])
        return (v.T @ v).reshape(-1)

    N, n = tot["N"], tot["n"] or 0
    kept = sum(int((~np.isnan(b)).sum()) for _, b in found.values())
    K = kept + T - 1 - max(0, T - 1 - rank)
    wyy, sum_w, sum_wy, within = (tot[c] or 0.0 for c in ("wyy", "w", "wy", "within"))
    stats = dict(n=n, n_units=N, n_periods=T, n_clusters=N, K=K, df_t=N - 1, K_full=K + N, ssr=float(within - sum(r["explained"] for r in got)),
                 tss=wyy - sum_wy**2 / sum_w if sum_w else 0.0, tss_within=float(within - rhs @ np.linalg.pinv(every, rcond=1e-10, hermitian=True) @ rhs),
                 sum_w=sum_w, vcov_type="cluster", fe_rank_deficit=max(0, T - 1 - rank))
    factor = N / (N - 1) * (n - 1) / (n - K) if N > 1 and n > K else math.nan
    out = SunAb(design, blocks, _by_cohort(units, T, scores, T * T), carry, found, stats, factor)
    weakref.finalize(out, units.unpersist)
    weakref.finalize(out, blocks.unpersist)
    return out


def _loses_rank(every: np.ndarray, taken: np.ndarray) -> bool:
    """Whether the cohorts' columns take a whole direction from the period effects."""
    value, vector = np.linalg.eigh(every) if len(every) else (np.zeros(0), every)
    live = value > 1e-10 * max(1.0, np.abs(every).max(initial=0.0))
    half = vector[:, live] / np.sqrt(value[live])
    return bool(live.any()) and bool(np.linalg.eigvalsh(half.T @ (every - taken) @ half).min() < RANK)
