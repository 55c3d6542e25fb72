"""Periodic runs of words, by Kruskal's order over longest common prefixes.

A run is a stretch of words that repeats with its smallest period q, is at least
``max(LEAST, POWER * q)`` words long, and can't be extended to either side.

Method.  The suffixes of a document's words are sorted by prefix doubling, for all
documents of a chunk at once; only documents that hold some ``LEAST`` - 1 words
twice are sorted at all, as others have no run.  Neighbours in that order are united by
decreasing length of their common prefix (LCP), as Kruskal's algorithm would:
union-find over sets of start positions that are kept in order, the smaller set
going into the larger.  Where a union makes two positions neighbours, their LCP is the
union's; if their distance p is within it, p is the smallest period of the stretch
from the one to the other's end of the common prefix, for a smaller one would have put a
position between them before.  Seeds that the word before extends belong to a run that is
found elsewhere.  The first two positions a period apart of every run become
neighbours in this way, so each is found exactly once.

Documents are independent: nothing is shuffled, whole documents are read one Arrow
batch at a time.  Sorting and uniting take about n log n steps for n words.

Edge cases: a null, empty or wordless text has no words and no run; a null id is kept
and never takes planted runs; rows that repeat are answered each; an empty table
gives no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import textvec as V
from panelkit.llm.common import text_of

LEAST = 6  # words of the shortest run
POWER = 4  # periods that a run holds at least
SEED_LCP = LEAST - 1  # the least LCP of two positions a period apart at the start of a run

Run = tuple[int, int, int]  # start, length, period


def suffix_order(token: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions sorted by document, then by what the document holds from there on.

    ``token``: whole numbers; ``doc``: each one's document, ascending; ``ends``: where each position's document ends."""
    n = len(token)
    order = np.lexsort((token, doc))
    new = np.ones(n, bool)
    new[1:] = (token[order][1:] != token[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)  # of a group of equal prefixes: where it begins in the order
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size, reach = np.bincount(rank, minlength=n), 1
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        ahead = active + reach
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)], -1)
        first = rank[active]
        by = np.lexsort((second, first))
        first, second, active = first[by], second[by], active[by]
        edge = np.ones(len(by), bool)
        edge[1:] = first[1:] != first[:-1]
        fresh = edge.copy()
        fresh[1:] |= second[1:] != second[:-1]
        at = np.arange(len(by))
        begin = np.maximum.accumulate(np.where(edge, at, 0))
        rank[active] = first + np.maximum.accumulate(np.where(fresh, at, 0)) - begin
        last = np.ones(len(by), bool)
        last[:-1] = fresh[1:]
        active, reach = active[~(fresh & last)], 2 * reach
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(token: list[int], order: list[int]) -> list[tuple[int, int, int]]:
    """(LCP, position, position) of neighbours in the order of one document's suffixes, where a run may begin."""
    n = len(token)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    out, k = [], 0
    for i, j in enumerate(before):  # a suffix shares all but a word with what its predecessor shared
        if j < 0:
            k = 0
            continue
        most = n - (i if i > j else j)
        while k < most and token[i + k] == token[j + k]:
            k += 1
        if k >= SEED_LCP:
            out.append((k, i, j))
        if k:
            k -= 1
    return out


def runs(token: list[int], order: list[int]) -> list[Run]:
    """The runs of one document, by start and period. ``order``: its suffixes sorted."""
    held: dict[int, list[int]] = {}  # the set of a position that isn't alone
    out = []

    def seed(x: int, y: int, lcp: int) -> None:
        p = y - x
        if lcp >= (POWER - 1) * p and lcp + p >= LEAST and (x == 0 or token[x - 1] != token[y - 1]):
            out.append((x, lcp + p, p))

    for lcp, i, j in sorted(common_prefixes(token, order), reverse=True):
        large, small = held.get(i) or [i], held.get(j) or [j]
        if len(large) < len(small):
            large, small = small, large
        at = [bisect_left(large, x) for x in small]
        for k, x in enumerate(small):
            if at[k] and (k == 0 or at[k - 1] != at[k]):
                seed(large[at[k] - 1], x, lcp)
            if at[k] < len(large) and (k + 1 == len(small) or at[k + 1] != at[k]):
                seed(x, large[at[k]], lcp)
        if len(small) * 8 > len(large):
            large += small
            large.sort()  # two ascending runs: merged
        else:
            for k, x in zip(reversed(at), reversed(small)):
                large.insert(k, x)
        if len(large) == len(small) + 1:
            held.update((x, large) for x in large)
        else:
            held.update((x, large) for x in small)
    return sorted((s, n, p) for s, n, p in out)


def planted_index(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each of a document's ``n`` places where the id asks for a planted run, else None."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _found(words: V.Words, ids: list[int | None], plant: bool) -> tuple[np.ndarray, dict[int, list[Run]]]:
    """Which word of the chunk stands at each place, and the runs of those documents that may have some."""
    place = np.arange(len(words))
    if plant:
        for k, (d, n) in enumerate(zip(ids, words.counts.tolist())):
            if (to := planted_index(d, n)) is not None:
                place[words.first[k]: words.first[k + 1]] = words.first[k] + to
    token = words.hashes()[place]
    doc = words.doc()
    if not len(token):
        return place, {}
    ends = words.first[1:][doc]
    start = np.flatnonzero(np.arange(len(token)) + SEED_LCP <= ends)
    with np.errstate(over="ignore"):
        gram = doc[start].astype(V.U64)
        for k in range(SEED_LCP):
            gram = V.mix(gram ^ token[start + k], k)
    by = np.argsort(gram, kind="stable")
    twice = np.flatnonzero(gram[by][1:] == gram[by][:-1])
    some = np.zeros(len(words.counts), bool)
    some[doc[start][by][twice]] = True
    at = np.flatnonzero(some[doc])
    if not len(at):
        return place, {}
    here = np.cumsum(some[doc])  # positions among the documents that are looked at
    _, symbol = np.unique(token[at], return_inverse=True)
    order = suffix_order(symbol, doc[at], here[ends[at] - 1])
    out, low = {}, 0
    for k in np.flatnonzero(some).tolist():
        high = low + int(words.counts[k])
        if got := runs(symbol[low:high].tolist(), (order[low:high] - low).tolist()):
            out[k] = got
        low = high
    return place, out


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Which of a document's words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, size, p in found:
        change[s + p] += 1
        change[s + size] -= 1
    return np.cumsum(change)[:n] == 0


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length by period; ties: smallest start, then period. ``found``: sorted."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _chunks(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[list[int | None], V.Words, np.ndarray, dict[int, list[Run]]]]:
    for rows, words in V.chunks(batch.column("text")):
        ids = batch.column("doc_id")[rows].to_pylist()
        yield ids, words, *_found(words, ids, plant)


def _digest(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for ids, words, place, found in _chunks(batch, plant):
            raw = words.data.tobytes()
            for k, d in enumerate(ids):
                low, n = int(words.first[k]), int(words.counts[k])
                mine = found.get(k, [])
                at = place[low: low + n][kept(n, mine)] if mine else place[low: low + n]
                text = b" ".join([raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())])
                s, size, p = strongest(mine) or (None, None, None)
                row = (d, len(mine), s, size, p, 1000 * size // p if mine else None,
                       sha("".join(f"{a},{b},{c}\n" for a, b, c in mine).encode()), sha(text))
                for c, x in zip(cols, row):
                    c.append(x)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of every row of ``docs`` (word numbers from 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, found in _chunks(batch, False):
                rows = [(ids[k], *r) for k, got in found.items() for r in got]
                cols = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "start", "length", "period"])

    return (docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
            .mapInArrow(run, "doc_id long, start long, length long, period long"))


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row: runs cut to their first period; a text without runs stays as it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, row = batch.column("text").to_pylist(), 0
            for ids, words, _, found in _chunks(batch, False):
                raw = words.data.tobytes()
                for k, mine in found.items():
                    low, n = int(words.first[k]), int(words.counts[k])
                    at = low + np.flatnonzero(kept(n, mine))
                    text[row + k] = b" ".join([raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]).decode()
                row += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row a document: number of runs, the strongest one, digests of all runs and of the collapsed text.

    ``plant`` first lays a periodic run into the documents whose id asks for one (see ``planted_index``)."""
    return (docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
            .mapInArrow(lambda it: _digest(it, plant), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                                       "runs_sha256 string, collapsed_sha256 string"))
