"""Toxicity by weak supervision: voters, a label model, and a linear classifier on what it says.

Tokens of a text are its distinct lower-case words, their first ``STEMS`` bytes, and, marked
as such, stems that two or more of its words share (a stem that is common by chance in
one word seldom is in two).

Voters.  Labelled texts give the tokens that toxic ones hold far more often than others;
these are dealt in turn into ``LEXICONS`` lexicons, each a voter that says yes to a text
with one of its entries.  ``FORMS`` are voters on form (repeated marks, masked
letters, shouting, stuttering), good or bad as they may be.

Label model.  How often each pattern of votes occurs is counted over all documents,
labelled or not; from these counts alone a generative model (``labelmodel``) learns
each voter's rates in either class and which voters go together, and gives every
pattern its chance of being toxic.

Classifier.  Logistic regression over hashed tokens, with a penalty that leaves most
weights 0, is fitted on that chance (not on the labels) by regularised-leader updates,
for at most about ``sample_rows`` labelled texts dealt to ``SHARDS`` tasks.  Every whole text is scored by its sparse dot product.

Labels come from a bounded sample picked by a hash of the id; near copies (the same
``KEY`` smallest tokens) count once in the lexicons.  To the driver come ``ENTRIES`` tokens, a
count for each pattern of votes and the classifier's weights.

Edge cases: a null or wordless text gets no votes and is scored by the intercept; a null
id is scored, never learnt from, and its ``held_out`` is null; a labelled id that repeats
counts once, with its largest label; where labels give no lexicon (none, or of one class) every
score is the share of toxic labels, 0 without labels.  Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm import labelmodel
from panelkit.llm import textvec as V
from panelkit.llm.common import cut, text_of

SAMPLE_ROWS = 10_000  # bound of the labelled rows that lexicons and classifier are fitted on
LEXICONS, ENTRIES = 8, 240
SUPPORT, ODDS = 4, 8.0  # an entry: in so many toxic texts, and so many times likelier there than in others
KEY = 4
STEMS = (4, 5, 6, 7, 8)
BITS = 18
SHARDS, EPOCHS = 4, 10
ALPHA, L1, L2 = 0.2, 8.0, 0.1
FORMS = ("marks", "masked", "shouting", "stutter")
VOTERS = LEXICONS + len(FORMS)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
_UPPER, _MARK, _MASK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A"): ord("Z") + 1] = True
_MARK[[ord(c) for c in "!?"]] = True
_MASK[[ord(c) for c in "*#@$%"]] = True


def _letters(words: V.Words) -> V.Words:
    """The runs of letters of the same documents, in lower case."""
    data = np.where(_LETTER[words.data], words.data, np.uint8(32))
    data[_UPPER[data]] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # the second byte of an accented letter
    big = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[big] += 32
    return V.Words(data, words.doc_off)


def _tokens(words: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of every distinct token, by document.  The three low bits of a token tell the family of its word."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, V.U64)
    raw, doc = words.hashes(), words.doc()
    order = np.lexsort((raw, doc))
    new = np.ones(len(order), bool)
    new[1:] = (raw[order][1:] != raw[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    one = order[new]  # a place of each distinct word of each document
    start, end, of = words.start[one], words.end[one], doc[one]
    bytes_ = V._BYTES[0][words.data]
    family = V.spans_hash(bytes_, start, np.minimum(end, start + STEMS[0]), 20) & V.U64(7)
    mark = lambda x, kind: (V.mix(x, 30 + kind) & ~V.U64(7))
    docs, found = [of], [mark(raw[one], 0) | family]
    for k in STEMS:
        long = np.flatnonzero(end - start > k)
        stem = V.spans_hash(bytes_, start[long], start[long] + k, 21)
        by = np.lexsort((stem, of[long]))
        long, stem = long[by], stem[by]
        same = np.zeros(len(by), bool)
        same[1:] = (stem[1:] == stem[:-1]) & (of[long][1:] == of[long][:-1])
        second = same.copy()
        second[1:] &= ~same[:-1]
        for which, kind in ((~same, 1), (second, 2)):
            docs.append(of[long][which]), found.append(mark(stem[which], kind) | family[long][which])
    docs, found = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(docs, kind="stable")
    return docs[order], found[order]


def _forms(whole: V.Words, words: V.Words) -> np.ndarray:
    """(documents, FORMS): which documents show each form."""
    n, data = len(whole.counts), whole.data
    size = len(data)
    out = np.zeros((n, len(FORMS)), bool)
    if size >= 3:
        at_doc = lambda at: np.searchsorted(whole.doc_off, at, "right") - 1
        a, b, c = data[:-2], data[1:-1], data[2:]
        inside = np.ones(size + 1, bool)  # three bytes of one document
        inside[whole.doc_off] = False
        three = inside[1: size - 1] & inside[2:size]
        for q, hit in ((0, _MARK[a] & _MARK[b] & _MARK[c]), (1, _LETTER[a] & _MASK[b] & _MASK[c])):
            out[at_doc(np.flatnonzero(three & hit)), q] = True
    if len(words) >= 2:
        doc = words.doc()
        upto = np.concatenate([[0], np.cumsum(_UPPER[data])])
        loud = (upto[words.end] - upto[words.start] == words.end - words.start) & (words.end - words.start >= 4)
        out[doc[1:][loud[1:] & loud[:-1] & (doc[1:] == doc[:-1])], 2] = True
        raw = words.hashes()
        again = (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1]) & (words.end - words.start >= 3)[1:]
        out[doc[2:][again[1:] & again[:-1]], 3] = True
    return out


def _each(batch: pa.RecordBatch) -> Iterator[tuple[slice, V.Words, V.Words, np.ndarray, np.ndarray]]:
    """(rows, all words, letter runs, document and token of every distinct token) chunk by chunk."""
    for rows, whole in V.chunks(batch.column("text")):
        words = _letters(whole)
        yield rows, whole, words, *_tokens(words)


def _form_votes(whole: V.Words, words: V.Words) -> np.ndarray:
    """The votes of the voters on form, as bits."""
    return (_forms(whole, words) @ (1 << np.arange(LEXICONS, VOTERS))).astype(np.int32)


def _lexicon_votes(doc: np.ndarray, token: np.ndarray, n: int, entries: np.ndarray) -> np.ndarray:
    """The votes of the lexicons of ``entries`` (best first), as bits."""
    yes = np.zeros((n, LEXICONS), bool)
    if len(entries) and len(token):
        by = np.argsort(entries)
        at = np.minimum(np.searchsorted(entries[by], token), len(entries) - 1)
        hit = entries[by][at] == token
        yes[doc[hit], by[at[hit]] % LEXICONS] = True
    return (yes @ (1 << np.arange(LEXICONS))).astype(np.int32)


def _lists(doc: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(value))


def tokenised(docs: DataFrame) -> DataFrame:
    """label, forms (votes on form), tokens of every row of ``docs`` (text, label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, whole, words, doc, token in _each(batch):
                label = batch.column("label").slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([label, pa.array(_form_votes(whole, words)), _lists(doc, token.view(np.int64), len(whole.counts))],
                                                 ["label", "forms", "tokens"])

    return docs.select("text", "label").mapInArrow(run, "label int, forms int, tokens array<long>")


def lexicon(sample: DataFrame) -> np.ndarray:
    """The ``ENTRIES`` tokens that tell toxic texts best, best first. ``sample``: tokens, label.

    Of tokens of one family in as many texts of either class (a word and its stems) one is taken."""
    key = F.slice(F.array_sort("tokens"), 1, KEY)
    once = sample.groupBy(key.alias("key")).agg(F.max_by(F.struct("tokens", "label"), F.struct("label", F.size("tokens"), F.xxhash64("tokens"))).alias("row")).select("row.*")
    sizes = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return np.zeros(0, V.U64)
    held = once.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = (F.col("toxic") + 0.5) / (sizes[1] + 1) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    family = F.col("token").bitwiseAND(F.lit(7)).alias("family")
    good = held.where((F.col("toxic") >= SUPPORT) & (odds >= ODDS)).withColumn("gain", F.col("toxic") * F.log(odds))
    best = good.groupBy(family, "toxic", "clean").agg(F.min("token").alias("token"), F.max("gain").alias("gain"))
    got = best.orderBy(F.col("gain").desc(), "token").select("token").limit(ENTRIES).collect()
    return np.array([r["token"] for r in got], np.int64).view(V.U64)


def vote(docs: DataFrame, entries: np.ndarray) -> DataFrame:
    """``votes`` of every row of ``docs`` (text): the pattern of all voters' votes as a whole number, bit j for voter j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, whole, words, doc, token in _each(batch):
                votes = _form_votes(whole, words) + _lexicon_votes(doc, token, len(whole.counts), entries)
                yield pa.RecordBatch.from_arrays([pa.array(votes)], ["votes"])

    return docs.select("text").mapInArrow(run, "votes int")


def label_model(patterns: DataFrame) -> labelmodel.LabelModel:
    """The label model of ``patterns`` (votes), one row an item."""
    counts = np.zeros(1 << VOTERS)
    for r in patterns.groupBy("votes").agg(F.count("*").alias("n")).collect():  # 2**VOTERS rows at most
        counts[r["votes"]] = r["n"]
    said = labelmodel.all_votes(VOTERS)[:, :LEXICONS].sum(axis=1)
    return labelmodel.fit(counts, VOTERS, np.clip(said / 3, 0.02, 0.98))


def _buckets(token: np.ndarray) -> np.ndarray:
    return (V.mix(token, 50) >> V.U64(64 - BITS)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((1 + np.sqrt(n)) / ALPHA + L2))


def _learn(batches: Iterator[pa.RecordBatch], entries: np.ndarray, chance: np.ndarray, z: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One pass of a shard's rows (tokens, forms) from the state ``z``, ``n``; the shard's changes by bucket."""
    z0, n0, z, n = z, n, z.copy(), n.copy()
    for batch in batches:
        tokens = batch.column("tokens")
        values, offset = tokens.values.to_numpy().view(V.U64), tokens.offsets.to_numpy()
        size, low = np.diff(offset), offset[0]
        doc = np.repeat(np.arange(len(size)), size)
        votes = batch.column("forms").to_numpy() + _lexicon_votes(doc, values[low: offset[-1]], len(size), entries)
        for at, pattern in enumerate(votes):
            j = np.append(np.unique(_buckets(values[offset[at]: offset[at + 1]])), 1 << BITS)  # the last one is the intercept
            w = _weights(z[j], n[j])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - chance[pattern]
            z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / ALPHA * w
            n[j] += g * g
    j = np.flatnonzero(n != n0)
    yield pa.RecordBatch.from_arrays([pa.array(j), pa.array((z - z0)[j]), pa.array((n - n0)[j])], ["bucket", "z", "n"])


def classifier(sample: DataFrame, entries: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Weights by bucket, the intercept last, fitted on the chances that the label model gives. ``sample``: tokens, forms.

    The sample's partitions (``SHARDS``) go through their rows from the same state; after each epoch their changes
    are averaged bucket by bucket over those shards that met the bucket."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        run = lambda it, z=z, n=n: _learn(it, entries, chance, z, n)
        state = sample.mapInArrow(run, "bucket long, z double, n double").groupBy("bucket").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        bucket = state.column("bucket").to_numpy()
        z[bucket] += state.column("z").to_numpy()
        n[bucket] += state.column("n").to_numpy()
    return _weights(z, n)


def in_training(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def toxic_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").alias("label")).where(in_training())


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, label) of about ``sample_rows`` labelled rows at most."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    parts = 1 << 20
    share = int(parts * min(1.0, sample_rows / max(labels.count(), 1)))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)  # so few that they are broadcast
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(labels), "doc_id").select("text", "label")


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``docs``. ``labels``: doc_id, label (0/1)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    mixed = _sample(docs, labels, sample_rows).repartition(SHARDS).sortWithinPartitions(F.xxhash64(F.lit(3), "text"))
    sample = cut(tokenised(mixed))
    entries = lexicon(sample.select("tokens", "label"))
    if not len(entries):
        share = sample.agg(F.avg("label")).first()[0] or 0.0
        return rows.select("doc_id", F.lit(float(share)).alias("score"))
    model = label_model(vote(rows, entries))
    fitted = classifier(sample, entries, model.posterior)
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            for at, whole, _, doc, token in _each(batch):
                own = np.unique(doc << BITS | _buckets(token))
                total = weights[-1] + np.bincount(own >> BITS, weights[own & ((1 << BITS) - 1)], minlength=len(whole.counts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns labels only from rows that aren't held out."""
    return score(docs, toxic_labels(labels)).select(
        "doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
