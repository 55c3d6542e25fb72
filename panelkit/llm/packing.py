"""Best-fit packing by hierarchical residual packing.

Documents become token ids and a closing 0; one longer than a sequence is cut into
full sequences, the remainder first.  Pieces are dealt into partitions of about
``ITEMS``, and each is packed best-fit by decreasing length.  Bins that not even the
emptiest bin left anywhere could join are emitted.  All others go up a tree as items,
``FAN`` partitions into one, and are packed again until one is left.

No bin that could still be joined is emitted, whatever their number.  It stays small:
no two bins of a packed partition fit into one, so the partition of the emptiest bin has
no other with room for it, and as pieces are dealt by a hash, the other partitions have
few.  Should more go up than ``FAN`` partitions into one may hold, the next round has as
many partitions as they fill, at least one less than before.

Every round is written before the next one and dealt by a hash, so a lost executor
costs the round's lost partitions and gives the same bins again.

The encoder's regular expression gives up on about a million white-space characters
in a row; a text with so many goes through the automaton of ``bpe``, which gives the same ids.

Edge cases: a null or empty text is the closing 0 alone; null ids are packed like
others; rows that share an id are packed each; an empty table gives no sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.bpe import SPLIT, ids_of
from panelkit.llm.common import cut, text_of

LENGTH = 2048
ITEMS = 50_000  # pieces of a partition in the first round
FAN = 8
_GAP = re.compile(r"\s{100000}")
_PART = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


@lru_cache(maxsize=2)
def encoder(ranks: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=table, special_tokens=dict(special))


def token_ids(text: str, enc: tiktoken.Encoding, vocabulary: str) -> np.ndarray:
    """The ids of a whole text, however much white space stands in a row."""
    if not _GAP.search(text):
        return enc.encode_to_numpy(text, allowed_special="all")
    return np.array(ids_of(text, vocabulary), np.int64)


def pieces(docs: DataFrame, ranks: str, special: tuple[tuple[str, int], ...], vocabulary: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row.  ``ranks`` and ``vocabulary`` are files of one vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, special)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(token_ids(text.as_py(), enc, vocabulary), 0).astype("<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(a), size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                                              *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item, and the bins' fills: largest items first, each into the bin with the least room that holds it."""
    bin_of, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by room
    rooms = 0  # bit r: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = length, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bin_of, offset, np.array(fill, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pack a partition's items (fill, key, parts) into bins (fill, key, parts)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    got = pa.Table.from_batches(batches).sort_by([("fill", "descending"), ("key", "ascending")]).combine_chunks()
    parts = got.column("parts").combine_chunks()
    sizes = got.column("fill").to_numpy()
    bin_of, offset, fill = best_fit(sizes, length)
    count = np.diff(parts.offsets.to_numpy())
    item = np.repeat(np.arange(len(sizes)), count)
    flat = parts.flatten()
    moved = pa.array(flat.field("offset").to_numpy() + offset[item])
    flat = pa.StructArray.from_arrays([moved if f.name == "offset" else flat.field(f.name) for f in flat.type], fields=list(flat.type))
    order = np.argsort(bin_of[item], kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(bin_of[item], minlength=len(fill)))])
    key = np.zeros(len(fill), np.int64)
    key[bin_of[::-1]] = got.column("key").to_numpy()[::-1]  # of its first item
    yield pa.RecordBatch.from_arrays([pa.array(fill), pa.array(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(order)))],
                                     ["fill", "key", "parts"])


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    part = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    level = cut(items.select(F.col("length").alias("fill"), F.monotonically_increasing_id().alias("key"), F.array(part).alias("parts")))
    schema = f"fill long, key long, parts {_PART}"
    out = level.where("fill >= %d" % length)
    level = level.where("fill < %d" % length)
    waiting = level.count()
    n = -(-waiting // ITEMS)
    while waiting:
        dealt = level.withColumn("to", F.pmod(F.xxhash64(F.lit(n), "key"), F.lit(n)))
        level = cut(dealt.repartition(n, "to").drop("to").mapInArrow(lambda it: _pack(it, length), schema))
        # a bin that the emptiest one may join has room for as much, which for itself means half a sequence
        least = level.agg(F.min("fill")).first()[0] if n > 1 else length
        joinable = F.lit(length) - F.col("fill") >= least
        out, level = out.union(level.where(~joinable)), level.where(joinable)
        waiting = level.count() if n > 1 else 0
        n = max(-(-n // FAN), min(n - 1, -(-waiting // ITEMS)))
    return out.select(F.col("key").alias("sequence_id"), F.inline("parts")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
