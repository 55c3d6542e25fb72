"""Stupid-backoff language-model scores, with joins between documents and count tables.

Documents are dealt into blocks.  A block explodes its documents into n-grams of
1 to ``ORDER`` words and sends each distinct one's hash and count to the part of
the count table that owns the hash; a part adds up what all blocks sent and
answers each block.  The block joins the answers to its n-grams and sums each
document's scores.  An n-gram thus crosses the network once a block, not once an
occurrence, and a word in every document makes a row a block.

A document is scored by the counts of all other documents: its own are taken off.
A word's score is c(n-gram) / c(its context) at the longest order whose n-gram
the other documents hold, times ``ALPHA`` for every order skipped; a word that no
other document holds counts as one in a corpus of one more.  The sum of natural
logarithms is the document's score.  Nothing is pruned or sampled.

Blocks hold about ``BLOCK`` characters and parts as many n-grams, at every size;
rows are dealt by a hash of the row, so no source or text makes a block large.  A
text longer than that is a block's only large one.

Edge cases: null and wordless texts score 0.0 with 0 words; null ids are scored
like others; rows that share an id are documents each; a document alone in the
corpus has words that no other one holds.  Words are runs without white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import textvec as V
from panelkit.llm.common import text_of

ORDER, ALPHA = 2, 0.4
BLOCK = 8_000_000
TOTAL = V.U64(0)  # the key under which blocks send their number of words


def _grams(words: V.Words, order: int) -> list[np.ndarray]:
    """By order, the hash of the n-gram that ends at each word; 0 where the document has too few words before it."""
    h = words.hashes()
    at = np.arange(len(h)) - (words.first[:-1][words.doc()] if len(h) else 0)
    out, key = [], np.zeros(len(h), V.U64)
    for n in range(order):
        with np.errstate(over="ignore"):  # one more word to the left
            key[n:] = V.mix(key[n:] * V.U64(V._BASE) + h[: len(h) - n], 90 + n) if len(h) > n else key[n:]
        out.append(np.where(at >= n, np.maximum(key, V.U64(1)), V.U64(0)))
    return out


def _block(table, order: int):
    """(documents' word counts, document of each word, hashes by order) of a block."""
    counts, docs, grams, base = [], [], [], 0
    for _, words in V.chunks(table.column("text")):
        counts.append(words.counts)
        docs.append(words.doc() + base)
        grams.append(_grams(words, order))
        base += len(words.counts)
    return np.concatenate(counts), np.concatenate(docs), [np.concatenate(g) for g in zip(*grams)]


def _keys(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their counts."""
    every = np.concatenate(grams)
    return np.unique(every[every != 0], return_counts=True)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns a hash, by its upper bits: parts follow each other in the order of hashes."""
    return ((keys >> V.U64(32)) * V.U64(parts) >> V.U64(32)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers with their first bytes together, then their second ones and so on: sorted hashes and small counts shrink."""
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view(np.int64).reshape(n)


def _unpacked_all(table: pa.Table, column: str) -> list[np.ndarray]:
    return [_unpacked(data, n) for data, n in zip(table.column(column).to_pylist(), table.column("size").to_pylist())]


def _ask(order: int, parts: int):
    def run(table):
        block = table.column("block")[0].as_py()
        counts, _, grams = _block(table, order)
        keys, n = _keys(grams)
        keys, n = np.append(TOTAL, keys), np.append(counts.sum(), n)
        part = _part_of(keys, parts)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1))
        keys, n = keys.view(np.int64), n.astype(np.int64)
        pieces = list(zip(cuts.tolist(), cuts[1:].tolist()))
        return pa.table({"part": pa.array(part[cuts[:-1]]), "block": pa.array(np.full(len(pieces), block)), "size": pa.array(np.diff(cuts).astype(np.int32)),
                         "keys": pa.array([_packed(keys[a:b]) for a, b in pieces], pa.binary()), "n": pa.array([_packed(n[a:b]) for a, b in pieces], pa.binary())})

    return run


def _count(table):
    """Answers each block's keys with the counts over all blocks."""
    keys, n = _unpacked_all(table, "keys"), _unpacked_all(table, "n")
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(at.max() + 1, np.int64)
    np.add.at(total, at, np.concatenate(n))
    ends = np.cumsum([0, *map(len, keys)])
    counts = [_packed(total[at[a:b]]) for a, b in zip(ends, ends[1:])]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "size": table.column("size"), "counts": pa.array(counts, pa.binary())})


def _own(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each word's document holds its n-gram (``at``: index of the n-gram)."""
    order = np.lexsort((at, doc))
    new = np.ones(len(at), bool)
    new[1:] = (at[order][1:] != at[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(at), np.int64)
    out[order] = np.bincount(run)[run]
    return out


def _score(order: int):
    def run(docs, answers):
        counts, doc, grams = _block(docs, order)
        keys, _ = _keys(grams)
        known = np.concatenate(_unpacked_all(answers.sort_by("part"), "counts"))
        total, known = int(known[0]), known[1:]  # the key of the total is the smallest
        score, todo, skipped = np.zeros(len(doc)), np.ones(len(doc), bool), np.zeros(len(doc))
        have, rest = [], total - counts[doc]  # words of the other documents
        for g in grams:
            at = np.where(g != 0, np.searchsorted(keys, g), len(keys))
            c = np.append(known, 0)[at]
            have.append(np.where(g != 0, c - _own(doc, at), 0) if len(doc) else c)
        for n in reversed(range(order)):
            held = todo & (have[n] > 0)
            context = rest if n == 0 else np.concatenate([[0], have[n - 1][:-1]])  # the n-gram that ends a word earlier
            score[held] = np.log(have[n][held] / context[held]) + skipped[held]
            todo &= ~held
            skipped += np.log(ALPHA) * (todo & (grams[n] != 0) & (n > 0))
        score[todo] = -np.log(rest[todo] + 1.0) + skipped[todo]
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(counts), "score": pa.array(np.bincount(doc, score, minlength=len(counts)))})

    return run


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, score of every row of ``docs``."""
    text = text_of()
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    asked = rows.groupBy("block").applyInArrow(_ask(order, blocks), "part int, block long, size int, keys binary, n binary")
    answers = asked.groupBy("part").applyInArrow(_count, "block long, part int, size int, counts binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order), "doc_id long, n_words long, score double")
