"""Words and word hashes of Arrow text columns, computed with NumPy for many documents at once.

A word is a run of bytes other than space and tab..carriage return.  UTF-8
continuation bytes never equal those, so the split is the same on code points.
Hashes are 64-bit and depend on the word's bytes alone, never on the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # documents are taken together up to this size; a longer one is its own chunk
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; ``seed`` picks one of many."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTES = [mix(np.arange(256, dtype=U64), 100 + k) for k in range(2)]
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept up to the chunk size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span: prefix sums of a polynomial, then the finaliser."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers(len(values), _BASE), out=prefix[1:])
        got = (prefix[ends] - prefix[starts]) * powers(int(starts.max()) + 1 if len(starts) else 1, _INVERSE)[starts]
        return mix(got ^ mix((ends - starts).astype(U64), seed + 7), seed)


class Words:
    """The words of some documents.

    ``data`` bytes, ``doc_off`` byte offsets of the documents, ``start``/``end``
    byte spans of the words, ``first`` index of each document's first word (one more at the end)."""

    def __init__(self, data: np.ndarray, doc_off: np.ndarray):
        self.data, self.doc_off = data, doc_off
        n = len(data)
        space = _SPACE[data]
        edge = np.ones(n + 1, bool)  # a word may not go on over this byte boundary
        edge[1:n] = space[1:] | space[:-1] if n else False
        edge[doc_off] = True
        word = ~space
        self.start = np.flatnonzero(word & edge[:n])
        self.end = np.flatnonzero(word & edge[1:]) + 1
        self.first = np.searchsorted(self.start, doc_off).astype(np.int64)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Index of each word's document in the chunk."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, kind: int = 0) -> np.ndarray:
        return spans_hash(_BYTES[kind][self.data], self.start, self.end, seed=10 + kind)


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[slice, Words]]:
    """(rows, words) of consecutive documents, whole ones only; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield slice(i, j), Words(data[off[i]: off[j]], off[i: j + 1] - off[i])
        i = j


def ngram_hash(words: Words, hashes: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``n`` words; a document of 1 to n-1 words gives one run of all."""
    size = len(hashes)
    short = (words.counts > 0) & (words.counts < n)
    if not size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    doc = words.doc()
    last = words.first[1:][doc]  # end of each word's document
    start = np.flatnonzero(np.arange(size) + n <= last)
    with np.errstate(over="ignore"):
        got = np.zeros(len(start), U64)
        for k in range(n):
            got = got * U64(_BASE) + hashes[start + k]
    out, of = mix(got, seed + n), doc[start]
    if short.any():
        s = words.first[:-1][short]
        out = np.concatenate([out, spans_hash(hashes, s, words.first[1:][short], seed + 31)])
        of = np.concatenate([of, np.flatnonzero(short)])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
