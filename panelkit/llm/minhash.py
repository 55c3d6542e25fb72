"""MinHash near-dedup with DartMinHash signatures.

Elements are runs of five words (a document of one to four words is one run);
an element's weight is how often the document holds it, and similarity is the
weighted Jaccard, sum of minima over sum of maxima.  Documents of 0.8 or more
are linked; a class is a connected component of links.

Signatures.  Weight x rank space is cut into regions whose sides double; a region
of an element gets a Poisson number of darts from a hash of element and region,
each with a weight, a rank and one of ``COORDS`` coordinates.  A document keeps
darts under its weights; the earliest of each coordinate make the signature.
Only ranks up to about ``COORDS * ln(COORDS)`` over the total weight are looked
at, so a long document throws no more darts than a short one; documents with a
coordinate still empty go on with twice the ranks.  Two documents agree on a
coordinate with their similarity as probability; ``BANDS`` bands of ``ROWS``
coordinates miss a pair at 0.8 with probability 3e-5.

Verification.  Equal weighted sets are one class from the start and get a number; a
text tells by two hashes which set is its own, whatever its id.  Every band bucket links its members to
the set of its smallest document, so no pairs are made within a group; a leader's text
meets those of its members in blocks of about ``WORDS`` words, each text sent once a link,
and links are checked on whole element sets there.  Where a bucket still holds several components, its members meet in blocks
(``BLOCK`` each), where every pair from different components is compared in the
first bucket that it shares; a block gives a spanning forest, never its pairs.
Only pairs that can't be similar are passed over: a set's elements are counted in ``CELLS``
cells by hash, and two sets have no more in common than the sum of their cells' smaller counts.

Edge cases: a null or wordless text is in no class but its own; a row with a null
id is returned with null class; rows that share an id share its class (their
texts all link it); an empty table gives no rows; extra columns are ignored.
``keep_first`` keeps all columns, one row of each (id, text), and a row with a null id
only where no row with an id, and no other such row, is in its class."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import textvec as V
from panelkit.llm.blocks import block_pairs, forest, pairs_here
from panelkit.llm.common import cut, text_of
from panelkit.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 20, 4
COORDS = BANDS * ROWS
BLOCK = 500
WORDS = 1 << 20  # elements of the members that meet a leader in one block
CELLS = 128
FULL = 255  # a cell's count: so many or more
PAIRS = 1 << 13  # pairs whose cells are held against each other at once: 1 MB a side
DARTS = COORDS * math.log(COORDS) + 2 * COORDS


def _poisson_steps(mean: float) -> np.ndarray:
    """The Poisson distribution function, as far as doubles tell it from one."""
    p, total, steps = math.exp(-mean), 0.0, []
    for k in range(int(mean + 12 * math.sqrt(mean) + 16)):
        total += p
        steps.append(total)
        p *= mean / (k + 1)
    return np.array(steps)


_STEPS = {r: _poisson_steps(2.0 ** r) for r in range(9)}  # larger regions are cut into several of 2**8


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> V.U64(11)).astype(np.float64) / 2.0**53


def _region(element, weight, doc, bound, v: int, r: int):
    """Kept darts (document, coordinate, rank, id) of every element in region (v, r)."""
    low, high = (2.0**r - 1) / 2**v, (2.0 ** (r + 1) - 1) / 2**v
    seen = np.flatnonzero((weight > 2.0**v - 1) & (bound > low))
    if not len(seen):
        return None
    seed = V.mix(element[seen] ^ V.mix(np.array([v * 64 + r], V.U64), 40), 41)
    counts = np.zeros(len(seen), np.int64)
    for part in range(1 << max(0, r - 8)):
        counts += np.searchsorted(_STEPS[min(r, 8)], _unit(V.mix(seed, 42 + part)), "right")
    who = np.repeat(np.arange(len(seen)), counts)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    dart = V.mix(seed[who] ^ V.mix(nth.astype(V.U64), 50), 51)
    at = seen[who]
    rank = low + (high - low) * _unit(V.mix(dart, 52))
    height = 2.0**v - 1 + 2.0**v * _unit(V.mix(dart, 53))
    keep = (height < weight[at]) & (rank < bound[at])
    dart = dart[keep]
    return doc[at[keep]], (V.mix(dart, 54) % V.U64(COORDS)).astype(np.int64), rank[keep], dart


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, COORDS) earliest darts. ``element``, ``weight``, ``doc``: distinct elements of each document; rows without any stay 0."""
    total = np.bincount(doc, weight, minlength=n)
    out = np.zeros((n, COORDS), V.U64)
    todo = total > 0
    limit = DARTS / np.maximum(total, 1e-300)
    while todo.any():
        of = todo[doc]
        e, w, d = element[of], weight[of], doc[of]
        bound, got = limit[d], []
        for v in range(int(math.log2(w.max() + 1)) + 1):
            for r in range(int(math.log2(bound.max() * 2**v + 1)) + 1):
                if (darts := _region(e, w, d, bound, v, r)) is not None:
                    got.append(darts)
        d, c, rank, dart = map(np.concatenate, zip(*got))
        order = np.argsort(-rank, kind="stable")  # the earliest is written last
        slot = d[order] * COORDS + c[order]
        filled = np.zeros(n * COORDS, bool)
        filled[slot] = True
        out.reshape(-1)[slot] = dart[order]
        todo &= ~filled.reshape(n, COORDS).all(axis=1)
        limit = limit * 2
    return out


def _elements(words: V.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, document), sorted by document and element."""
    h, doc = V.ngram_hash(words, words.hashes(), SHINGLE) if len(words) else (np.zeros(0, V.U64), np.zeros(0, np.int64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))).astype(np.float64), doc[at]


def _names(e: np.ndarray, w: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two hashes of every weighted set; sets begin at ``ends``."""
    pair = V.mix(e ^ V.mix(w.astype(V.U64), 72), 73)
    with np.errstate(over="ignore"):
        k1, k2 = np.add.reduceat(V.mix(pair, 74), ends), np.add.reduceat(V.mix(pair, 75), ends)
    return pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))


def _cells(e: np.ndarray, w: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, CELLS) weight of each row's elements by cell, ``FULL`` at most."""
    cell = (V.mix(e, 76) % V.U64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(row * CELLS + cell, w, minlength=n * CELLS), FULL).astype(np.uint8).reshape(n, CELLS)


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a uint8 matrix."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows.tobytes())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, words in V.chunks(batch.column("text")):
            e, w, d = _elements(words)
            n = len(words.counts)
            has = np.flatnonzero(np.bincount(d, minlength=n))
            if not len(has):
                continue
            sig = signatures(e, w, d, n)[has]
            bands = np.zeros((len(has), BANDS), V.U64)
            for r in range(ROWS):
                bands = V.mix(bands ^ sig[:, r::ROWS], 60 + r)
            bands = V.mix(bands ^ V.mix(np.arange(BANDS, dtype=V.U64), 70), 71)
            ends = np.searchsorted(d, has)
            total = np.add.reduceat(w, ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at.start, at.stop - at.start).take(pa.array(has)),
                 *_names(e, w, ends), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))),
                 _bytes(_cells(e, w, np.searchsorted(has, d), len(has)))],
                ["doc_id", "k1", "k2", "total", "bands", "cells"])


def _copies(e: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Element sets as plain sets: the n-th copy of an element is an element of its own. (document, value)."""
    w = w.astype(np.int64)
    nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    return np.repeat(d, w), V.mix(np.repeat(e, w) ^ V.mix(nth.astype(V.U64), 80), 81)


def _similar(common, total):
    """Weighted Jaccard of 0.8 or more, in whole numbers: common / (total - common) >= 4 / 5."""
    return common * 9 >= total * 4


def _elements_of(texts: pa.Array, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the texts whose set has the hashes ``k1``, ``k2``; texts of other sets are passed over."""
    rows, values = [], []
    for at, words in V.chunks(texts):
        e, w, d = _elements(words)
        has = np.unique(d)
        if not len(has):
            continue
        one, two = (x.to_numpy() for x in _names(e, w, np.searchsorted(d, has)))
        right = np.zeros(len(words.counts), bool)
        right[has] = (one == k1[at][has]) & (two == k2[at][has])
        doc, value = _copies(e[right[d]], w[right[d]], d[right[d]])
        rows.append(doc + at.start), values.append(value)
    return (np.concatenate(rows), np.concatenate(values)) if rows else (np.zeros(0, np.int64), np.zeros(0, V.U64))


def _against_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar (u, v) of rows (u, block, rep, k1, k2, text) that come sorted, each block's leaders (rep = u) first."""
    held: list[pa.RecordBatch] = []  # the last block's leaders, which the next batch may go on with
    for batch in batches:
        both = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not both.num_rows:
            continue
        u, block, rep, k1, k2 = (both.column(c).to_numpy() for c in ("u", "block", "rep", "k1", "k2"))
        row, value = _elements_of(both.column("text"), k1, k2)
        size = np.bincount(row, minlength=len(u))
        group = V.mix(u.view(V.U64) ^ V.mix(block.astype(V.U64), 90), 91)
        leader = u == rep
        key = V.mix(value ^ group[row], 92)
        of_leader = leader[row]
        common = np.bincount(row[~of_leader][np.isin(key[~of_leader], key[of_leader])], minlength=len(u))
        lead = np.flatnonzero(leader & (size > 0))  # a leader's other texts (of its id) have no elements here
        by = lead[np.argsort(group[lead], kind="stable")]
        at = np.searchsorted(group[by], group) if len(by) else np.zeros(len(u), np.int64)
        at = np.minimum(at, max(len(by) - 1, 0))
        known = (group[by][at] == group) if len(by) else np.zeros(len(u), bool)
        total = np.where(known, size[by][at], 0) if len(by) else np.zeros(len(u), np.int64)
        new = np.arange(len(u)) >= sum(b.num_rows for b in held)
        hit = np.flatnonzero(new & ~leader & known & (size > 0) & _similar(common, size + total))
        yield pa.RecordBatch.from_arrays([pa.array(u[hit]), pa.array(rep[hit])], ["u", "v"])
        last = np.flatnonzero(leader & (u == u[-1]) & (block == block[-1]))
        held = both.take(pa.array(last)).to_batches()


def _linked(pairs: DataFrame, same: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets that are similar.  A leader meets its members in blocks of about ``WORDS`` words."""
    sized = pairs.join(same.select(F.col("rep").alias("v"), "total"), "v")
    blocks = cut(sized.groupBy("u").agg(F.ceil(F.sum("total") / WORDS).cast("int").alias("n")))
    members = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64(F.lit(11), "v"), F.col("n")).cast("int").alias("block"), F.col("v").alias("rep"))
    leaders = blocks.select("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.col("u").alias("rep"))
    rows = _with_texts(members.union(leaders), same, known)
    rows = rows.repartition("u", "block").sortWithinPartitions("u", "block", F.col("rep") != F.col("u"))
    return rows.mapInArrow(_against_leaders, "u long, v long")


def _with_texts(rows: DataFrame, same: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with k1, k2 of their set ``rep`` and all texts of its smallest document, of which one is the set's."""
    of = same.select("rep", "k1", "k2", F.col("first").alias("doc_id"))
    return rows.join(of, "rep").join(known, "doc_id").drop("doc_id")


def _may_be_similar(one: np.ndarray, other: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether cells leave room for 0.8; never false for a similar pair.  Where a cell is full on both sides, the common part isn't bounded."""
    least = np.minimum(one, other)
    return _similar(least.sum(axis=1, dtype=np.int64), total) | (least == FULL).any(axis=1)


def _to_compare(key, table):
    """The rows of a block pair that belong to a pair to be compared here: from different components, of
    sizes and cells that allow 0.8, and in no common bucket of an earlier band."""
    lo, hi = key[1].as_py(), key[2].as_py()
    get = lambda c: table.column(c).to_numpy()
    c, total, side = get("c"), get("total"), get("side")
    n = len(c)
    ask = pairs_here(side, lo, hi) & (c[:, None] != c[None, :])
    ask &= _similar(np.minimum(total[:, None], total[None, :]), total[:, None] + total[None, :])
    if ask.any():
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, BANDS)
        for b in range(BANDS):
            if (bands[:, b] == key[0].as_py()).all():
                break
            ask &= bands[:, b][:, None] != bands[:, b][None, :]
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(n, CELLS)
        i, j = np.nonzero(ask)
        for at in range(0, len(i), PAIRS):
            a, b = i[at: at + PAIRS], j[at: at + PAIRS]
            ask[a, b] = _may_be_similar(cells[a], cells[b], total[a] + total[b])
    return table.filter(pa.array(ask.any(axis=0) | ask.any(axis=1))).select(["bucket", "lo", "hi", "side", "rep", "c"])


def _compare(key, table):
    """Spanning edges of the similar pairs from different components in a block pair."""
    n = table.num_rows
    row, value = _elements_of(table.column("text"), table.column("k1").to_numpy(), table.column("k2").to_numpy())
    size = np.bincount(row, minlength=n)
    _, value = np.unique(value, return_inverse=True)
    c, rep = table.column("c").to_numpy(), table.column("rep").to_numpy()
    ask = pairs_here(table.column("side").to_numpy(), key[1].as_py(), key[2].as_py()) & (c[:, None] != c[None, :])
    ask &= (size > 0)[:, None] & (size > 0)[None, :]
    shared = np.flatnonzero(np.bincount(value) > 1)  # an element of one set alone is in no common part
    column = np.full(value.max() + 1 if len(value) else 0, -1)
    column[shared] = np.arange(len(shared))
    row, value = row[column[value] >= 0], column[value[column[value] >= 0]]
    common = np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 4096):  # exact: whole numbers far below 2**24
        part = (value >= at) & (value < at + 4096)
        held = np.zeros((n, min(4096, len(shared) - at)), np.float32)
        held[row[part], value[part] - at] = 1
        common += held @ held.T
    a, b = forest(ask & _similar(common, (size[:, None] + size[None, :])))
    return pa.table({"u": rep[a], "v": rep[b]})


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, first) of every text with words: its weighted set and the smallest document of that;
    (id, class_id) over the sets that are linked: the smallest document of all sets that links reach."""
    known = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).where("doc_id is not null")
    sketch = cut(known.mapInArrow(_sketch, "doc_id long, k1 long, k2 long, total long, bands array<long>, cells binary"))
    # a number for each set, given once
    same = cut(sketch.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("total", "bands", "cells")))
               .withColumn("rep", F.monotonically_increasing_id()))
    member = cut(sketch.select("doc_id", "k1", "k2").distinct().join(same.select("k1", "k2", "rep", "first"), ["k1", "k2"]).select("doc_id", "rep", "first"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("doc_id", "u")
    several = member.select("doc_id", F.col("rep").alias("v")).join(several, "doc_id").where("u < v").select("u", "v").distinct()
    buckets = same.select("rep", "first", F.explode("bands").alias("bucket"))
    least = F.min(F.struct("first", "rep"))["rep"]
    leaders = buckets.groupBy("bucket").agg(least.alias("u"), F.count("*").alias("n")).where("n > 1").select("bucket", "u")
    shared = cut(buckets.select("bucket", "rep").join(leaders, "bucket"))  # (bucket, rep, u): the buckets of two and more
    pairs = cut(shared.where("rep <> u").select("u", F.col("rep").alias("v")).distinct())
    links = cut(_linked(pairs, same, known).union(several))
    found = components(links)

    # buckets that still hold several components: all their pairs, in blocks
    left = (shared.select("bucket", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
            .select("bucket", "rep", F.coalesce("component", "rep").alias("c")))
    mixed = left.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("bucket")
    left = left.join(mixed, "bucket").join(same.select("rep", "total", "bands", "cells"), "rep")
    left = block_pairs(left, ["bucket"], "rep", BLOCK).groupBy("bucket", "lo", "hi")
    left = cut(left.applyInArrow(_to_compare, "bucket long, lo int, hi int, side int, rep long, c long"))
    more = (_with_texts(left, same, known)
            .groupBy("bucket", "lo", "hi").applyInArrow(_compare, "u long, v long"))
    tree = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    found = components(tree.union(more))
    linked = found.union(found.select("component", "component").distinct())
    least = linked.join(same.select(F.col("rep").alias("id"), "first"), "id").groupBy("component").agg(F.min("first").alias("class_id"))
    return member, linked.join(least, "component").select("id", "class_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) of every row of ``docs``; a row without words is its own class."""
    member, found = classes(docs)
    of = (member.join(found.withColumnRenamed("id", "rep"), "rep", "left")
          .groupBy("doc_id").agg(F.min(F.coalesce("class_id", "first")).alias("class_id")))
    return (docs.select(F.col("doc_id").cast("long")).join(of, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row (all columns) of each class: that of the smallest id.

    Rows that repeat an id and text whole stay once.  A null id counts as a number above all ids (2**62 and
    more, from the text), so that its row gives way to rows with an id and to one other row with a null id."""
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_of()), 2)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), late).alias("id"), F.xxhash64(text_of()).alias("hash"))
    later = (near_copies(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")))
             .where("class_id < doc_id").select(F.col("doc_id").alias("id")).distinct())
    kept = rows.join(later, "id", "left_anti")
    again = cut(rows.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "hash"))
    if not again.isEmpty():
        twice = kept.join(again, ["id", "hash"], "left_semi").withColumn("text", F.coalesce("row.text", F.lit(""))).dropDuplicates(["id", "text"]).drop("text")
        kept = kept.join(again, ["id", "hash"], "left_anti").unionByName(twice)
    return kept.select("row.*")
