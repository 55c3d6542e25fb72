"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Every word is seen twice, as it stands and as its shape (runs of letters in
either case, digits and each punctuation mark become one symbol).  Runs of 1-2
words and 1-3 shapes, and of two equal words, are hashed into ``2**BITS``
buckets; a document's value of a bucket is its share of the document's runs of
that kind.  The score is the logistic of the sparse dot product with the weights.

Fitting uses a bounded sample of the labelled rows: at most about
``sample_rows`` of them, picked by a hash of the id.  ``shards`` tasks run the
updates on their rows from the same start; after each epoch their changes are
averaged bucket by bucket, so what reaches the driver is bounded by the number
of buckets.  Scoring reads every whole text once and shuffles nothing.

Edge cases: a null or empty text has the bias as its only input and is scored;
rows with a null id are scored and never learnt from; a labelled id that repeats
counts once, with its largest label; without any usable labels all scores are
0.5.  Extra columns are ignored (``score``) or kept (``keep_good``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import textvec as V
from panelkit.llm.common import cut, text_of

BITS = 18
SAMPLE_ROWS = 10_000  # bound of the rows that the model is fitted on
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"): ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A"): ord("Z") + 1] = ord("A")
_SHAPE[ord("0"): ord("9") + 1] = ord("0")


def _shape_hash(words: V.Words) -> np.ndarray:
    symbol = _SHAPE[words.data]
    fresh = np.ones(len(symbol), bool)
    fresh[1:] = symbol[1:] != symbol[:-1]
    fresh[words.start] = True
    at = np.concatenate([[0], np.cumsum(fresh)])
    return V.spans_hash(V._BYTES[1][symbol[fresh]], at[words.start], at[words.end], seed=77)


def _runs(words: V.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of every run, one kind at a time."""
    if not len(words):
        return
    raw, shape, shift = words.hashes(), _shape_hash(words), V.U64(64 - BITS)
    for seed, hashes, n in ((1, raw, 1), (2, raw, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
        got, doc = V.ngram_hash(words, hashes, n, seed)
        yield (got >> shift).astype(np.int64), doc
    doc = words.doc()
    same = np.zeros(len(raw), np.int64)  # two buckets: this word equals the one before, or not
    same[1:] = (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])
    yield same, doc


def _features(words: V.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each document in the chunk, buckets distinct."""
    n = len(words.counts)
    buckets, docs, values = [], [], []
    for b, d in _runs(words):
        size = np.bincount(d, minlength=n)
        buckets.append(b), docs.append(d), values.append(1.0 / size[d])
    if buckets:
        key, at = np.unique(np.concatenate(docs) << BITS | np.concatenate(buckets), return_inverse=True)
        value = np.bincount(at, np.concatenate(values))
        ends = np.searchsorted(key >> BITS, np.arange(n + 1))
        key &= (1 << BITS) - 1
    for i in range(n):
        yield (key[ends[i]: ends[i + 1]], value[ends[i]: ends[i + 1]]) if buckets else (np.zeros(0, np.int64), np.zeros(0))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The regularised leader for gradient sums ``z`` and squared sums ``n``."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(batches: Iterator[pa.RecordBatch], z: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    z0, n0, z, n = z, n, z.copy(), n.copy()
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for at, words in V.chunks(batch.column("text")):
            for y, (j, x) in zip(labels[at], _features(words)):
                j, x = np.append(j, 1 << BITS), np.append(x, 1.0)  # the last one is the bias
                w = _weights(z[j], n[j])
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / ALPHA * w
                n[j] += g * g
    j = np.flatnonzero(n != n0)
    yield pa.RecordBatch.from_arrays([pa.array(j), pa.array((z - z0)[j]), pa.array((n - n0)[j])], ["bucket", "z", "n"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights by bucket, the bias last. ``docs``: doc_id, text. ``labels``: doc_id, label (0/1)."""
    labels = (labels.where("doc_id is not null and label is not null")
              .groupBy("doc_id").agg(F.max("label").cast("double").alias("label")))
    total = labels.count()
    parts = 1 << 20
    share = int(parts * min(1.0, sample_rows / max(total, 1)))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)  # about sample_rows rows at most
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(labels), "doc_id")
    rows = cut(rows.repartition(SHARDS).sortWithinPartitions(F.xxhash64("doc_id"), "text"))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        state = (rows.select("text", "label")
                 .mapInArrow(lambda it, z=z, n=n: _learn(it, z, n), "bucket long, z double, n double")
                 .groupBy("bucket").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow())
        bucket = state.column("bucket").to_numpy()
        z[bucket] += state.column("z").to_numpy()
        n[bucket] += state.column("n").to_numpy()
    return _weights(z, n)


def _scores(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    out = []
    for _, words in V.chunks(batch.column("text")):
        n = len(words.counts)
        total = np.full(n, weights[-1])
        for b, d in _runs(words):
            size = np.bincount(d, minlength=n)
            total += np.bincount(d, weights[b], minlength=n) / np.maximum(size, 1)
        out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(b, held.value))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def in_training(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").alias("label")).where(in_training())


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns only from rows that aren't held out."""
    got = score(docs, fit(docs, quality_labels(labels)))
    return got.select("doc_id", (~in_training()).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that score ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, quality_labels(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.string())
            yield b.filter(pa.array(_scores(pa.RecordBatch.from_arrays([text], ["text"]), held.value) >= least))

    return docs.mapInArrow(run, docs.schema)
