"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts are lower-cased (A-Z only) and every run of separators becomes one space.
Overlapped regular expressions then emit the spans of all runs of 1 to ``n_max``
words: lookarounds hold both ends to word boundaries, and matching goes on one
character after a match's start, so that the runs of one length overlap.  A span's
bytes go straight into a CRC, whose remainder is the feature's bucket.

Every bucket gets a gain, the floored logarithm of how much likelier it is in the
target texts than in the documents, each smoothed by one.  A document's weight is
the sum of its features' gains; weight plus Gumbel noise from a hash of the id is
its score, and the highest scores of the documents with ``least_words`` are drawn.

Texts are scanned once: a document's buckets are written, two bytes each, and read
again for counting and for weighing.  Counts are added up in every task before they
are shuffled, so the driver gets ``buckets`` rows whatever the input.  Ranks come
from a range-partitioned sort and the sizes of its partitions; no task holds more
than its part of the documents.

Edge cases: a null or wordless text has no features and weight 0; a null id has a
null score and is never drawn nor counted among the documents to draw from; rows
that share an id are scored each and drawn in the order of their weights; an empty
table of documents gives no rows, an empty target a target without features.  Extra
columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import cut, n_partitions, text_of

N_MAX = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

_WORD = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]  # digits, letters, bytes beyond ASCII
_SPACED = bytes(c if c in _WORD else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Words of ``text`` in UTF-8, lower-cased, one space between them."""
    return b" ".join([w for w in text.encode().lower().translate(_SPACED).split(b" ") if w])


@lru_cache(maxsize=None)
def _pattern(n: int) -> regex.Pattern:
    """A run of ``n`` words; taken whole (possessive), so that a start inside a word fails at once."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def spans(line: bytes, n: int) -> list[tuple[int, int]]:
    """Where each run of ``n`` words stands in a normal text."""
    return [m.span() for m in _pattern(n).finditer(line, overlapped=True)]


def buckets_of(line: bytes, n_max: int, buckets: int) -> np.ndarray:
    """Bucket of every feature of a normal text."""
    parts = [np.fromiter((crc32(line[a:b]) for a, b in spans(line, n)), np.uint32) % buckets for n in range(1, n_max + 1)]
    return np.concatenate(parts).astype(_kind(buckets))


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def features(docs: DataFrame, n_max: int = N_MAX, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and ``held`` (the buckets as bytes) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, size, held = [], [], []
            for text in batch.column("text"):
                line = normal(text.as_py())
                got = buckets_of(line, n_max, buckets)
                words.append(line.count(b" ") + 1 if line else 0), size.append(len(got)), held.append(got.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(size, pa.int64()), pa.array(held, pa.binary())],
                                             ["doc_id", "n_words", "n_features", "held"])

    return (docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, held binary"))


def _flat(held: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(held.to_pylist()), _kind(buckets))


def counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("held"), buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = found.select("held").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)  # ``buckets`` numbers reach the driver
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + n)) / ((source + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``features``."""
    held = found.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = held.value[_flat(batch.column("held"), len(held.value))]
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = np.concatenate([[0], np.cumsum(batch.column("n_features").to_numpy())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(np.diff(upto[ends]))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, weight, score) with ``rank``: 1, 2, 3... for the drawn ones, else null."""
    fits = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").desc(), F.col("n_features").asc()]
    rows = cut(rows.withColumn("fits", fits))
    # a row's number in its sorted partition, fixed by writing it; then the sizes of the partitions before
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(rows.repartitionByRange(n_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
                 .withColumn("part", F.spark_partition_id()).withColumn("inside", inside))
    parts = placed.groupBy("part").agg(F.sum(F.col("fits").cast("long")).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row a partition
    take = (placed.agg(F.sum(F.col("fits").cast("long"))).first()[0] or 0) * percent // 100
    rank = F.col("before") + F.col("inside") + 1
    return (placed.join(F.broadcast(parts), "part")
            .withColumn("rank", F.when(F.col("fits") & (rank <= take), rank)).drop("part", "inside", "before", "fits"))


def resample(docs: DataFrame, target: DataFrame, n_max: int = N_MAX, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); ``target``: text."""
    found = cut(features(docs, n_max, buckets))
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), n_max, buckets)
    rows = weighed(found, gains(counts(found, buckets), counts(aim, buckets)))
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((unit + 0.5) / 4294967296)))
    rows = rows.withColumn("score", F.col("weight") + noise)
    return drawn(rows, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
