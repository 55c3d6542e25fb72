"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words.  A word goes if it lies in a window
whose words also start in a document with a smaller id; windows are judged on
the input.

Method.  ``COVER`` holds two residues for every difference modulo ``PERIOD``, so
two equal windows, wherever they start, hold a shared anchor: ``ANCHOR`` words
that start at a covered position of either document within the first ``PERIOD``
words of the window.  Only anchors are hashed and shuffled, about a fifth of all
positions.  An anchor then extends:

* its context is all words that a window around it can hold, as far as the
  document goes.  If a smaller document has the same anchor in the same context,
  every window around it is repeated;
* where an anchor occurs in several contexts, the smallest document of each
  context gives the hashes of the windows around it, and those are compared.

Anchors of one context in the same Arrow batch are met before the shuffle: only
the smallest document's goes on, the others are known to be repeated, so a
passage in a third of all documents sends a row a batch.  Contexts and windows
are compared by two 64-bit hashes.  The text is shuffled once; no group is
gathered, and every shuffle may be recomputed on its own.

Edge cases: null text counts as empty; a null id neither removes words nor loses
any; rows that share an id are one document with several texts (none removes
words of another); documents under ``WINDOW`` words lose nothing; an empty table
gives no rows; extra columns are ignored (``digests``) or kept (``remove``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm import textvec as V
from panelkit.llm.common import cut, text_of

WINDOW = 50
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])  # a perfect difference set modulo 31
ANCHOR = WINDOW - PERIOD + 1


def _anchors(words: V.Words, hashes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, document, position in the chunk) of every anchor in documents of a window or more."""
    covered = np.zeros(PERIOD, bool)
    covered[COVER] = True
    doc = words.doc()
    low, high = words.first[:-1][doc], words.first[1:][doc]
    at = np.arange(len(words))
    at = at[covered[(at - low) % PERIOD] & (at + ANCHOR <= high) & (high - low >= WINDOW)]
    if not len(at):
        return np.zeros(0, V.U64), np.zeros(0, V.U64), at, at
    low, high = low[at], high[at]
    start, end = np.maximum(low, at - PERIOD + 1), np.minimum(high, at + WINDOW)
    anchor = V.spans_hash(hashes[0], at, at + ANCHOR, seed=1)
    context = V.spans_hash(hashes[1], start, end, seed=2) ^ V.mix((at - start).astype(V.U64), 3)
    return anchor, context, doc[at], at


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == V.U64 else x, pa.int64())


def _emit(keys: list[np.ndarray], doc: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row for each distinct (keys, doc).  Of equal keys the smallest document is open; the others are
    done (known to be repeated) and get a first key of their own, so that they don't meet in one task."""
    order = np.lexsort((doc, *keys[::-1]))
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    distinct = new.copy()
    distinct[1:] |= doc[1:] != doc[:-1]
    done = ~new[distinct]
    keys, doc = [k[distinct] for k in keys], doc[distinct]
    first = np.where(done, V.mix(keys[0] ^ V.mix(doc.astype(V.U64), 5), 6), keys[0])
    return pa.RecordBatch.from_arrays([_long(first), *map(_long, keys[1:]), _long(doc), pa.array(done)], names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, got = batch.column("doc_id").fill_null(0).to_numpy(), []
        for at, words in V.chunks(batch.column("text")):
            a, c, doc, _ = _anchors(words, [words.hashes(0), words.hashes(1)])
            got.append((a, c, ids[at][doc]))
        if got:
            a, c, doc = map(np.concatenate, zip(*got))
            yield _emit([a, c], doc.astype(np.int64), ["h", "c", "doc_id", "done"])


def _lists(column: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(document in the chunk, value) of a list column's entries."""
    part = column.slice(rows.start, rows.stop - rows.start)
    n = np.array([len(x) if x is not None else 0 for x in part.to_numpy(zero_copy_only=False)], np.int64)
    return np.repeat(np.arange(len(n)), n), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(V.U64)


def _of_doc(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return V.mix(value ^ V.mix(doc.astype(V.U64), 8), 9)


def _window_starts(words: V.Words, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows around the anchors at ``at``."""
    return np.maximum(words.first[:-1][doc], at - PERIOD + 1), np.minimum(at, words.first[1:][doc] - WINDOW)


def _marked(lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """Positions that lie in any of lo..hi."""
    ok = lo <= hi
    change = np.bincount(lo[ok], minlength=size + 1) - np.bincount(hi[ok] + 1, minlength=size + 1)
    return np.cumsum(change)[:size] > 0


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows around the open contexts of each document."""
    for batch in batches:
        # a null id has no open context; filled, the others stay whole numbers
        ids, got = batch.column("doc_id").fill_null(0).to_numpy(), []
        for rows, words in V.chunks(batch.column("text")):
            of, contexts = _lists(batch.column("open"), rows)
            if not len(of):
                continue
            hashes = [words.hashes(0), words.hashes(1)]
            _, c, doc, at = _anchors(words, hashes)
            hit = np.isin(_of_doc(doc, c), _of_doc(of, contexts))
            starts = np.flatnonzero(_marked(*_window_starts(words, at[hit], doc[hit]), len(words)))
            if len(starts):
                w = [V.spans_hash(h, starts, starts + WINDOW, seed=4) for h in hashes]
                got.append((*w, ids[rows][words.doc()[starts]]))
        if got:
            w1, w2, doc = map(np.concatenate, zip(*got))
            yield _emit([w1, w2], doc.astype(np.int64), ["w", "v", "doc_id", "done"])


def _removed(batch: pa.RecordBatch) -> Iterator[tuple[slice, V.Words, np.ndarray]]:
    """(rows, words, which words go) chunk by chunk."""
    for rows, words in V.chunks(batch.column("text")):
        gone = np.zeros(len(words), bool)
        of_c, contexts = _lists(batch.column("repeated"), rows)
        of_w, windows = _lists(batch.column("windows"), rows)
        if len(of_c) or len(of_w):
            hashes = [words.hashes(0), words.hashes(1)]
            _, c, doc, at = _anchors(words, hashes)
            hit = np.isin(_of_doc(doc, c), _of_doc(of_c, contexts))
            lo, hi = _window_starts(words, at[hit], doc[hit])
            ok = lo <= hi
            gone = _marked(lo[ok], hi[ok] + WINDOW - 1, len(words))
        if len(of_w):
            doc = words.doc()
            s = np.flatnonzero(np.isin(doc, of_w) & (np.arange(len(words)) + WINDOW <= words.first[1:][doc]))
            if len(s):
                w = V.spans_hash(hashes[1], s, s + WINDOW, seed=4)
                s = s[np.isin(_of_doc(doc[s], w), _of_doc(of_w, windows))]
                gone |= _marked(s, s + WINDOW - 1, len(words))
        yield rows, words, gone


def _kept_texts(words: V.Words, gone: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    start, end, doc = words.start[~gone], words.end[~gone], words.doc()[~gone]
    size = end - start + 1  # with the space behind the word
    upto = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
    data = words.data[np.minimum(take, len(words.data) - 1)] if len(start) else np.zeros(0, np.uint8)
    data[upto[1:] - 1] = 32
    raw, edge = data.tobytes(), upto[np.searchsorted(doc, np.arange(len(words.counts) + 1))]
    return [raw[a:b - 1] if b > a else b"" for a, b in zip(edge, edge[1:])]


def _with_repeats(docs: DataFrame, rest: list[str]) -> DataFrame:
    """doc_id, text, the ``rest`` columns as a struct, ``repeated`` (context hashes) and ``windows`` (window hashes)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       *([F.struct(*rest).alias("rest")] if rest else []))
    anchors = (base.where("doc_id is not null").select("doc_id", "text")
               .mapInArrow(_anchor_rows, "h long, c long, doc_id long, done boolean"))
    # one exchange by the anchor serves both windows
    anchors = (anchors.repartition("h")
               .withColumn("least", F.min("doc_id").over(Window.partitionBy("h", "c")))
               .withColumn("low", F.min("c").over(Window.partitionBy("h")))
               .withColumn("high", F.max("c").over(Window.partitionBy("h")))
               .withColumn("dup", F.col("done") | (F.col("least") < F.col("doc_id")))
               .where("dup or low <> high"))
    found = cut(anchors.groupBy("doc_id").agg(F.collect_list(F.when(F.col("dup"), F.col("c"))).alias("repeated"),
                                              F.collect_list(F.when(~F.col("dup"), F.col("c"))).alias("open")))
    # both joins are left ones over the same columns, so that Spark shuffles the text once
    windows = (base.join(found.select("doc_id", "open"), "doc_id", "left")
               .mapInArrow(_window_rows, "w long, v long, doc_id long, done boolean")
               .repartition("w").withColumn("least", F.min("doc_id").over(Window.partitionBy("w", "v")))
               .where("done or least < doc_id").groupBy("doc_id").agg(F.collect_list("v").alias("windows")))
    return base.join(found.select("doc_id", "repeated"), "doc_id", "left").join(windows, "doc_id", "left")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out, sha = [], [], []
            for _, words, gone in _removed(batch):
                n.append(words.counts)
                out.append(np.bincount(words.doc()[gone], minlength=len(words.counts)))
                sha += [hashlib.sha256(t).hexdigest() for t in _kept_texts(words, gone)]
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n), pa.int64()),
                                                  pa.array(np.concatenate(out), pa.int64()), pa.array(sha)],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_repeats(docs, []).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) without repeated words.

    A text that loses words becomes its kept words joined by one space; a
    document that loses all of them goes.  Other texts stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keep = [], []
            for rows, words, gone in _removed(batch):
                lost = np.bincount(words.doc()[gone], minlength=len(words.counts))
                text += [t.decode() if k else None for t, k in zip(_kept_texts(words, gone), lost)]
                keep.append((lost == 0) | (lost < words.counts))
            if text:
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(text, pa.string()),
                                                  *([batch.column("rest")] if rest else [])],
                                                 ["doc_id", "text", "kept", *(["rest"] if rest else [])])
                yield out.filter(pa.array(np.concatenate(keep)))

    base = _with_repeats(docs, rest)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = "doc_id long, text string, kept string" + (f", rest {kinds['rest']}" if rest else "")
    got = base.mapInArrow(run, schema)
    kind = dict(docs.dtypes)
    cols = {"doc_id": F.col("doc_id").cast(kind["doc_id"]), "text": F.coalesce("kept", "text"),
            **{c: F.col("rest").getField(c) for c in rest}}
    if "n_chars" in rest:
        cols["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(kind["n_chars"])).otherwise(cols["n_chars"])
    return got.select(*(cols[c].alias(c) for c in docs.columns))
