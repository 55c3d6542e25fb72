"""Byte-pair encoding by a tokenisation automaton.

Compilation starts from the automaton that accepts every sequence of byte tokens
and puts in one merge gadget after the other: the gadget of ``u v -> w`` removes
``v`` after ``u`` and adds an arc ``w`` that enters like ``u`` and leaves like
``v``.  The result is deterministic with one state a token (the last one read).
A gadget is kept as what it inherits (``left``, ``right``, ``time``) and the arcs
as a table that is filled when first asked for, since 50k x 50k arcs would not
fit; :meth:`Automaton.follows` reads an arc back from the gadgets.

Texts are first parted into units, a word with the white space before it; the
pre-split never reaches over their borders.  Equal units of a chunk are found by
hash, with a second hash against collisions, and encoded once.

A pre-split word is read byte by byte by the tables.  For every prefix exactly one
token leads there from an earlier prefix's state, so the last states of the
prefixes give the encoding in time linear in the word.  Words are looked up in a
bounded table of those already encoded.  Decoding emits the arcs' labels.

The vocabulary file is a parameter; special tokens are cut out before pre-splitting,
as the public tokenizers library does when told to add none.

Edge cases: null and empty texts have no tokens; a very long text or word takes
time in proportion to its length; rows that repeat are encoded each."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import textvec as V
from panelkit.llm.common import text_of

CHUNK = 16 << 20  # bytes of text whose units are met together
WORDS_KEPT = 300_000  # encoded words in each of two generations; the older one goes when the younger is full
ARCS_KEPT = 1_000_000  # a full table starts anew
#: fixed value: the byte-level pre-split of the vocabulary's format
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _byte_of() -> dict[str, int]:
    """The format writes bytes as characters: printable Latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Words(dict):
    """word -> (number of ids, ids joined by commas, labels): no containers, so Python's collector needn't walk them."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: str):
        if (got := self.older.get(word)) is not None:
            self[word] = got
            return got
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = got = (len(ids), ",".join([self.automaton.name[i] for i in ids]), b"".join([self.automaton.label[i] for i in ids]))
        return got


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        byte = _byte_of()
        raw = lambda s: bytes(byte[c] for c in s)
        self.label = {i: raw(s) for s, i in vocab.items() if s not in special}
        self.reader = ahocorasick.Automaton()  # reads bytes, tells every token that ends
        for i, b in self.label.items():
            self.reader.add_word(b.decode("latin-1"), (i, len(b)))
        self.reader.make_automaton()
        self.label |= {i: s.encode() for s, i in special.items()}
        size = max(self.label) + 1
        self.left, self.right, self.time = [-1] * size, [-1] * size, [-1] * size
        self.gadget: dict[int, int] = {}  # (u, v) as one number -> when the arc from u to v was removed
        for when, (a, b) in enumerate(merges):
            u, v = vocab[a], vocab[b]
            w = vocab[a + b]
            self.gadget[u << 32 | v] = when
            self.left[w], self.right[w], self.time[w] = u, v, when
        self.name = {i: str(i) for i in self.label}
        self.special = special
        self.arcs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = _Words(self)

    def follows(self, u: int, v: int) -> bool:
        """Is there an arc ``v`` from the state of ``u``?  Walks the gadgets from the last one back: the newer of
        the two tokens entered like its left part, or left like its right part, as things stood then."""
        time, gadget, now = self.time, self.gadget, len(self.gadget)
        while True:
            removed = gadget.get(u << 32 | v)
            if removed is not None and removed < now:
                return False
            if time[v] > time[u]:  # an arc enters as its left part does behind the gadget, which tells if both parts are one token
                now, v = time[v] + 1, self.left[v]
            elif time[u] > time[v]:
                now, u = time[u], self.right[u]
            else:  # two byte tokens, or twice the same one, which is as its right part before its left part
                if time[u] < 0:
                    return True
                now, u, v = time[u], self.right[u], self.left[v]

    def encode_word(self, word: bytes) -> list[int]:
        arcs, size = self.arcs, len(word)
        last, begin = [-1] * (size + 1), [0] * (size + 1)
        for end, (t, n) in self.reader.iter(word.decode("latin-1")):  # the tokens that end here, byte by byte
            end += 1
            if last[end] < 0:
                start = end - n
                if start:  # every token leaves the start state; the others tell by their arcs
                    arc = last[start] << 32 | t
                    ok = arcs.get(arc)
                    if ok is None:
                        if len(arcs) >= ARCS_KEPT:
                            arcs.clear()
                        ok = arcs[arc] = self.follows(last[start], t)
                    if not ok:
                        continue
                last[end], begin[end] = t, start
        out = []
        while size:
            out.append(last[size])
            size = begin[size]
        out.reverse()
        return out

    def parts(self, text: str) -> list[tuple]:
        """One (number of ids, ids joined by commas, labels) for each word of a text."""
        if self.cut is None or not any(map(text.__contains__, self.special)):
            return list(map(self.words.__getitem__, self.split.findall(text)))
        out = []
        for piece in self.cut.split(text):
            if piece in self.special:
                i = self.special[piece]
                out.append((1, str(i), self.label[i]))
            else:
                out += map(self.words.__getitem__, self.split.findall(piece))
        return out

    def joined(self, unit: str) -> tuple[int, str, bytes]:
        """(number of ids, ids joined by commas, labels) of a text."""
        parts = self.parts(unit)
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(vocabulary: str) -> Automaton:
    """The compiled automaton of a vocabulary file, once a worker."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Automaton(spec["model"]["vocab"] | special, [tuple(m) for m in spec["model"]["merges"]], special)


def _wide_space(words: V.Words) -> np.ndarray:
    """Which documents hold white space beyond ASCII: there it may join with a unit's, so they aren't parted."""
    data = np.append(words.data, np.zeros(2, np.uint8))
    at = np.flatnonzero(np.isin(words.data, [0xC2, 0xE1, 0xE2, 0xE3]))
    a, b, c = data[at], data[at + 1], data[at + 2]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | np.isin(c, [0xA8, 0xA9, 0xAF])) | (b == 0x81) & (c == 0x9F))
    out = np.zeros(len(words.counts), bool)
    out[np.searchsorted(words.doc_off, at[wide], "right") - 1] = True
    return out


def _units(words: V.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every unit: a word and what stands before it, and what stands behind the last one."""
    first = np.zeros(len(words), bool)
    first[words.first[:-1][words.counts > 0]] = True
    before = np.append(0, words.end[:-1])[: len(words)]
    start, doc = np.where(first, words.doc_off[:-1][words.doc()] if len(words) else 0, before), words.doc()
    tail = words.doc_off[:-1].copy()
    has = words.counts > 0
    tail[has] = words.end[words.first[1:][has] - 1]
    d = np.arange(len(tail))
    whole = _wide_space(words)
    ok = ~whole[doc]
    more = (tail < words.doc_off[1:]) & ~whole
    some = whole & (words.doc_off[1:] > words.doc_off[:-1])
    start = np.concatenate([start[ok], tail[more], words.doc_off[:-1][some]])
    end = np.concatenate([words.end[ok], words.doc_off[1:][more], words.doc_off[1:][some]])
    doc = np.concatenate([doc[ok], d[more], d[some]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order], doc[order]


def _unit_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two hashes of every unit, piece by piece of the text to stay in the processor's cache."""
    out = np.empty((2, len(start)), V.U64)
    edges = np.searchsorted(start, np.arange(0, len(data) + V.CHUNK_BYTES, V.CHUNK_BYTES))
    for x, y in zip(edges, edges[1:]):
        if x < y:
            piece = data[start[x]: end[y - 1]]
            for k in (0, 1):
                out[k, x:y] = V.spans_hash(V._BYTES[k][piece], start[x:y] - start[x], end[x:y] - start[x], seed=20 + k)
    return out[0], out[1]


def _parted(a: Automaton, texts: pa.Array) -> Iterator[tuple[slice, list[tuple[int, str, bytes]], np.ndarray, np.ndarray]]:
    """For each chunk: (rows, each distinct unit joined, index of every unit among those, where each document's units begin)."""
    for rows, words in V.chunks(texts, CHUNK):
        start, end, doc = _units(words)
        if len(start):
            one, two = _unit_hashes(words.data, start, end)
            _, first, at = np.unique(one, return_index=True, return_inverse=True)
            if (two != two[first][at]).any():  # two units of one hash: each stands for itself
                first, at = np.arange(len(start)), np.arange(len(start))
            raw = words.data.tobytes()
            parts = [a.joined(raw[x:y].decode()) for x, y in zip(start[first].tolist(), end[first].tolist())]
        else:
            parts, at = [], np.zeros(0, np.int64)
        yield rows, parts, at, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def ids_of(text: str, vocabulary: str) -> list[int]:
    """The ids of one text."""
    parts = _parted(automaton(vocabulary), pa.array([text], pa.string()))
    return [int(i) for _, units, at, _ in parts for k in at.tolist() for i in units[k][1].split(",")]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            for rows, parts, at, begin in _parted(a, b.column("text")):
                of_unit = [[int(i) for i in names.split(",")] for _, names, _ in parts]
                ids = [[i for k in at[x:y].tolist() for i in of_unit[k]] for x, y in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[rows], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from (doc_id, ids); null ids give null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            text = pa.array([None if i is None else a.decode(i) for i in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            for rows, parts, at, begin in _parted(a, b.column("text")):
                size = np.array([n for n, _, _ in parts], np.int64)
                names, labels = [x for _, x, _ in parts], [x for _, _, x in parts]
                upto = np.append(0, np.cumsum(size[at]))
                ids, decoded = [], []
                for x, y in zip(begin.tolist(), begin[1:].tolist()):
                    units = at[x:y].tolist()
                    ids.append(sha(",".join([names[k] for k in units]).encode()))
                    decoded.append(sha(b"".join([labels[k] for k in units]).decode("utf-8", "replace").encode()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[rows], pa.array(np.diff(upto[begin])), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
