"""Approximate nearest neighbours by inner product with an inverted multi-index.

The two halves of every vector are quantised by codebooks of their own
(``CODES`` centroids each, Spark's k-means on a bounded sample of ``SAMPLE``
rows); an entry's cell is the pair of its nearest centroids, and every row is an
entry.  A query walks the cells by the inner product that their entries may reach,
with a heap over the two sorted lists, until the cells hold ``SHARE`` of all
entries; those are reranked by the exact inner product in double precision.  What a
half may reach is its product with the centroid plus ``SPREAD`` standard deviations
of such products: the half's norm times the entries' root mean square distance from
the centroid a dimension, over all entries.  So norms may differ: a long vector lies
in a cell with a long centroid or, where the sample missed it, in a widely spread one.

``SHARE`` sets recall.  The given vectors are close to evenly spread in all
directions, the hardest case for any index: recall against brute force is given in
the README and tested to be 0.9 or more.

Entries meet queries by first centroid, in blocks of about ``ENTRIES`` entries and
``QUERIES`` queries, so that a centroid with a third of all entries is many tasks;
a block gives each query its ``k`` best.  The driver sees codebooks and the counts
of cells, both bounded by ``CODES``.

Edge cases: vectors that are null, zero or have null or non-finite components, of
another length than the most common one, or with a null id take no part; a query
that repeats is asked once, with the smallest of its vectors in Spark's order;
entries that repeat are entries each; a query is not its own neighbour."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import cut
from panelkit.llm.vectors import matrix, top_rows, usable

CODES, SAMPLE, SHARE, SPREAD = 64, 20_000, 0.5, 2.0
ENTRIES, QUERIES = 4096, 512
TIE = 1e-9  # more than products summed in another order can differ


def _codebook(sample: DataFrame, begin: int, size: int) -> np.ndarray:
    part = F.slice(F.col("vec").cast("array<double>"), begin + 1, size)
    model = KMeans(k=CODES, seed=11, maxIter=12, featuresCol="f").fit(sample.select(array_to_vector(part).alias("f")))
    return np.array(model.clusterCenters())


def _halves(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    return v[:, :half], v[:, half:]


def _distances(v: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    return [((part**2).sum(1)[:, None] - 2 * part @ b.T + (b**2).sum(1)[None, :]) for part, b in zip(_halves(v, books), books)]


def _costs(v: np.ndarray, books: list[np.ndarray], spread: list[np.ndarray]) -> list[np.ndarray]:
    """For each half and centroid: minus the inner product that entries there may reach."""
    return [-(part @ b.T + SPREAD * np.sqrt((part**2).sum(1))[:, None] * s[None, :]) for part, b, s in zip(_halves(v, books), books, spread)]


def _cells(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            both = _distances(matrix(batch.column("vec")), books)
            cells, far = [pa.array(d.argmin(1), pa.int32()) for d in both], [pa.array(np.maximum(d.min(1), 0.0)) for d in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells, *far], [*batch.schema.names, "c1", "c2", "far1", "far2"])


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Cells by rising ``d1[i] + d2[j]`` until they hold ``need`` entries; ``held[i, j]`` counts them."""
    i_of, j_of = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = np.sort(d1).tolist(), np.sort(d2).tolist()
    counts, heap, out = held.tolist(), [(a[0] + b[0], 0, 0)], []  # a cell is put on the heap by its left neighbour, a row's first by the one above
    while heap and need > 0:
        _, i, j = heapq.heappop(heap)
        n = counts[i_of[i]][j_of[j]]
        if n:
            out.append((i_of[i], j_of[j]))
            need -= n
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _probes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], spread: list[np.ndarray], held: np.ndarray, need: int) -> Iterator[pa.RecordBatch]:
    """For every query and first centroid that it visits: the second centroids."""
    for batch in batches:
        row, c1, c2 = [], [], []
        for q, (x, y) in enumerate(zip(*_costs(matrix(batch.column("vec")), books, spread))) if len(batch) else ():
            by: dict[int, list[int]] = {}
            for i, j in walk(x, y, held, need):
                by.setdefault(i, []).append(j)
            row += [q] * len(by)
            c1 += by
            c2 += by.values()
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), batch.column("vec").take(pa.array(row, pa.int64())),
                                          pa.array(c1, pa.int32()), pa.array(c2, pa.list_(pa.int32()))], ["id", "vec", "c1", "cells"])


def _best(k: int):
    def run(key, queries, entries):
        """The k best entries of each query in a block, exact scores, ties to the smaller id."""
        out = [[], [], []]
        if queries.num_rows and entries.num_rows:
            q, e = matrix(queries.column("vec")), matrix(entries.column("vec"))
            q_ids, e_ids, c2 = (t.column(c).to_numpy() for t, c in ((queries, "id"), (entries, "id"), (entries, "c2")))
            cells = queries.column("cells").combine_chunks()
            asked = np.zeros((len(q), CODES), bool)
            asked[np.repeat(np.arange(len(q)), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()] = True
            score = np.where(asked[:, c2] & (q_ids[:, None] != e_ids[None, :]), q @ e.T, -np.inf)
            least = np.partition(score, -k, axis=1)[:, -k] if len(e) > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                near = np.flatnonzero((score[i] >= least[i] - TIE) & (score[i] > -np.inf))
                exact = (e[near] * q[i]).sum(axis=1)
                order = np.lexsort((e_ids[near], -exact))[:k]
                out[0].append(np.full(len(order), q_ids[i])), out[1].append(e_ids[near][order]), out[2].append(exact[order])
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2])})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest. Both frames: id, vec."""
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("long").alias("id"), "vec").where(usable("vec") & F.col("id").isNotNull())

    rows, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (df.where(F.size("vec") == common["d"]) for df in (rows, asked))
    kind = dict(rows.dtypes)["vec"]
    half = -(-common["d"] // 2)
    sample = cut(top_rows(rows, SAMPLE, 12, "id"))
    books = [_codebook(sample, 0, half), _codebook(sample, half, common["d"] - half)] if common["d"] > 1 else [_codebook(sample, 0, 1), np.zeros((1, 0))]
    entries = cut(rows.mapInArrow(lambda it: _cells(it, books), f"id long, vec {kind}, c1 int, c2 int, far1 double, far2 double"))
    held = np.zeros((len(books[0]), len(books[1])), np.int64)
    far = np.zeros((2, *held.shape))
    for r in entries.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.sum("far1").alias("far1"), F.sum("far2").alias("far2")).collect():  # CODES ** 2 rows at most
        held[r["c1"], r["c2"]] = r["n"]
        far[:, r["c1"], r["c2"]] = r["far1"], r["far2"]
    entries = entries.drop("far1", "far2")
    spread = [np.sqrt(far[h].sum(1 - h) / np.maximum(held.sum(1 - h), 1) / max(books[h].shape[1], 1)) for h in (0, 1)]
    need = int(np.ceil(share * held.sum())) + k
    probes = cut(asked.repartition("id").mapInArrow(lambda it: _probes(it, books, spread, held, need), f"id long, vec {kind}, c1 int, cells array<int>"))
    blocks = lambda df, size, name: df.groupBy("c1").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    both = F.broadcast(cut(blocks(entries, ENTRIES, "n_e").join(blocks(probes, QUERIES, "n_q"), "c1")))  # CODES rows at most

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, copied to all blocks of the other side."""
        block = F.pmod(F.xxhash64(F.lit(3), "id", "vec"), F.col(f"n_{own}")).cast("int")
        return (df.join(both, "c1").withColumn(own, block)
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_e", "n_q"))

    keys = ["c1", "e", "q"]
    found = (deal(probes, "q", "e").groupBy(*keys).cogroup(deal(entries, "e", "q").groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
