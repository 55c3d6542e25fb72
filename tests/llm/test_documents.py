"""Operators on documents against brute force in plain Python, on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import cases
from panelkit.llm import lm, minhash, packing, quality, secrets, substring
from panelkit.llm.oracles import ORACLE
from panelkit.llm.queries import RANKS, SPECIAL, VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def key(r):
    return tuple("~" if x is None else str(x) for x in r)


# ---- substring dedup

def repeats(rows, window=50):
    starts = defaultdict(lambda: math.inf)
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i:i + window])
                starts[k] = min(starts[k], d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and starts[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((d, w, gone))
    return out


def test_cover_meets_every_difference():
    got = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert got == set(range(substring.PERIOD))


def test_substring_digests(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    want = sorted(key((d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest())) for d, w, g in repeats(rows))
    assert sorted(map(key, substring.digests(cases.documents(spark)).collect())) == want
    assert sum(any(g) for _, _, g in repeats(rows)) > 4
    assert substring.digests(cases.empty(spark)).count() == 0


def test_substring_many_contexts(spark):
    """A passage of just over a window in many documents, each time between other words and at another place."""
    import random
    rng = random.Random(9)
    passage = cases.prose(rng, 52, 10**6)
    rows = [(i, cases.prose(rng, rng.randrange(0, 70), 10**6) + " " + passage + " " + cases.prose(rng, rng.randrange(0, 70), 10**6)) for i in range(60)]
    want = sorted(key((d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest())) for d, w, g in repeats(rows))
    assert sorted(map(key, substring.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())) == want


def test_substring_ids_beyond_doubles_beside_a_null_id(spark):
    """Ids above 2**53 in a batch with a null id keep their removals."""
    import random
    rng = random.Random(4)
    passage = cases.prose(rng, 55, 10**6)
    rows = [(2**60 + i, cases.prose(rng, 20, 10**6) + " " + passage + " " + cases.prose(rng, 20, 10**6)) for i in range(6)] + [(None, passage)]
    got = {r["doc_id"]: r["n_removed"] for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {2**60: 0, None: 0} | {2**60 + i: 55 for i in range(1, 6)}


def test_substring_remove_keeps_columns(spark):
    docs = cases.documents(spark)
    got = substring.remove(docs)
    assert got.dtypes == docs.dtypes
    want = []
    for r, (d, w, gone) in zip(cases.rows(), repeats([(r[0], r[1]) for r in cases.rows()])):
        if any(gone):
            if all(gone):
                continue
            t = " ".join(x for x, g in zip(w, gone) if not g)
            r = (r[0], t, r[2], r[3], len(t), *r[5:])
        want.append(key((r[0], r[1] or "", *r[2:])))
    assert sorted(key((r[0], r[1] or "", *r[2:])) for r in got.collect()) == sorted(want)
    assert substring.remove(cases.empty(spark)).count() == 0


# ---- MinHash near-dedup

def weights(t):
    w = words(t)
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def classes(rows):
    rows = [(d, weights(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 5 * sum((x & y).values()) >= 4 * sum((x | y).values()):
                u, v = find(a), find(b)
                up[max(u, v)] = min(u, v)
    return {d: find(d) for d in up}


def test_minhash_classes(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    want = classes(rows)
    got = minhash.near_copies(cases.documents(spark)).collect()
    assert sorted(key(r) for r in got) == sorted(key((d, None if d is None else want[d])) for d, _ in rows)
    assert want[8] == 6 and want[10] == 9
    kept = minhash.keep_first(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    # a row that repeats whole stays once; the row with a null id gives way to the equal text of document 6
    assert sorted(key(r) for r in kept.collect()) == sorted({key(r) for r in cases.rows() if r[0] is not None and want[r[0]] == r[0]})
    assert minhash.near_copies(cases.empty(spark)).count() == 0


def test_keep_first_of_repeats_and_null_ids(spark):
    """One row of each class, whatever repeats: whole rows, null ids, near copies of either."""
    import random
    rng = random.Random(12)
    t, u, v, x = (cases.prose(rng, 120, 10**6) for _ in range(4))
    rows = [(1, t), (1, t), (2, u), (None, t), (None, t + " tail"), (None, v), (None, v), (None, v + " tail"), (7, v + " other"), (None, x), (None, x),
            (None, None), (None, ""), (3, None), (3, None), (4, "")]
    got = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == [t] and [r["text"] for r in got if r["doc_id"] == 2] == [u]
    assert [r["text"] for r in got if r["doc_id"] == 7] == [v + " other"]
    assert [r["text"] for r in got if r["doc_id"] is None and r["text"]] == [x]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if not r["text"]) == [(False, 3), (False, 4), (True, 0)]


def test_minhash_leader_with_many_blocks(spark, monkeypatch):
    """A group whose members meet their leader in many small blocks, over several Arrow batches, loses no link."""
    import random
    rng = random.Random(21)
    base = cases.prose(rng, 200, 10**6).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, cases.prose(rng, 150, 10**6)) for i in range(20)]
    monkeypatch.setattr(minhash, "WORDS", 600)
    want = classes(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = dict(minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and set(got[i] for i in range(60)) == {0}


def test_minhash_texts_of_one_id(spark):
    """Each of the texts that share an id has a near copy, one of them also through the equal text of another id."""
    import random
    rng = random.Random(6)
    rows = []
    for i in range(12):
        t = [cases.prose(rng, 150, 10**6) for _ in range(3)]
        rows += [(i, x) for x in t] + [(100 + 10 * i + k, x + " tail") for k, x in enumerate(t)] + [(100 + 10 * i + 5, t[i % 3])]
    want = classes(rows)
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((d, want[d]) for d, _ in rows)
    assert set(want.values()) == set(range(12))


def test_minhash_bucket_of_several_components(spark, monkeypatch):
    """Copies that are near the threshold to each other: no link may be lost, whatever the leader of a bucket."""
    import random
    rng = random.Random(3)
    base = cases.prose(rng, 150, 10**6).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    want = classes(rows)
    got = dict(minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want
    assert 1 < len(set(want.values())) < len(rows)


def test_similar_pairs_of_a_bucket_are_compared_whatever_else_their_signatures_hold(monkeypatch):
    """Two similar texts and one of other words meet in one bucket, and agree on the coordinates of its band alone."""
    def one_band(element, weight, doc, n):
        out = np.arange(n * minhash.COORDS, dtype=np.uint64).reshape(n, minhash.COORDS)
        out[:, :minhash.ROWS] = 7
        return out

    monkeypatch.setattr(minhash, "signatures", one_band)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base), " ".join([*base[:70], "new", *base[71:]]), " ".join(f"v{i}" for i in range(150))]
    batch, = minhash._sketch(iter([pa.record_batch({"doc_id": [1, 2, 3], "text": texts})]))
    bands = batch.column("bands").to_pylist()
    assert bands[0][0] == bands[1][0] == bands[2][0] and bands[0][1] != bands[1][1]
    table = pa.Table.from_batches([batch])
    for name, values in (("bucket", [bands[0][0]] * 3), ("lo", [0] * 3), ("hi", [0] * 3), ("side", [0] * 3), ("rep", [1, 2, 3]), ("c", [1, 2, 3])):
        table = table.append_column(name, pa.array(values, pa.int64()))
    got = minhash._to_compare((pa.scalar(bands[0][0]), pa.scalar(0), pa.scalar(0)), table)
    assert got.column("rep").to_pylist() == [1, 2]


def test_cells_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(8)
    similar = ruled_out = 0
    for k in range(400):
        n = int(rng.choice([1, 5, 80, 400, 3000]))
        e = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        w = rng.integers(1, int(rng.choice([2, 4, 900])), 2 * n)  # the heaviest fill their cells
        share = rng.choice([0, 0.5, 0.75, 0.88, 0.95, 1])
        x, y = np.where(np.arange(2 * n) < n, w, 0), np.where(np.arange(2 * n) < n, w * (rng.random(2 * n) < share), w * (rng.random(2 * n) < 0.1))
        cells = [minhash._cells(e[v > 0], v[v > 0].astype(float), np.zeros((v > 0).sum(), np.int64), 1) for v in (x, y)]
        may = bool(minhash._may_be_similar(*cells, np.array([x.sum() + y.sum()]))[0])
        truth = np.minimum(x, y).sum() * 5 >= np.maximum(x, y).sum() * 4
        assert may or not truth
        similar, ruled_out = similar + truth, ruled_out + (not may)
    assert similar > 50 and ruled_out > 50


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 9, 300) * 0.5, rng.integers(1, 9, 300) * 0.5
    truth = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    agree = []
    for seed in range(30):
        f = minhash.V.mix(e, 1000 + seed)
        s = minhash.signatures(np.concatenate([f, f]), np.concatenate([x, y]), np.repeat([0, 1], 300), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - truth) < 0.03


# ---- quality classifier

def test_quality_on_awkward_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(6, None, 0), (None, 1, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.predictions(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(cases.rows())
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, quality.quality_labels(labels.limit(0)))).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.predictions(cases.empty(spark), labels).count() == 0


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predictions(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    for q in (0, 1):
        part = got[got["quality"] == q]
        assert len(part) > 100 and (part["predicted"] == q).mean() >= 0.97


# ---- secret scan

KINDS = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
TRICKY = ["token=token=abcdefgh", "secret: 'token: abcdefgh", "PassWord='abcdef' API_KEY : zzzzzz apikey=12345", "xAKIAAKIA" + "B" * 16 + "é AKIA12 AKIA" + "C" * 15,
          "f" * 23 + "g" + "0" * 24 + "😀" + "a" * 30, "own Abcdefghij0123456789KLMNOP end", "copied Zbcdefghij0123456789KLMNOP end", None, ""]


def spans(t):
    out = [(m.start(), k, m.end(), name, m[g]) for k, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(t or "") if len(m[g]) >= least]
    return sorted(out)


def listed(found):
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in found)


def secret_docs(spark):
    rows = [(i, t, "s0") for i, t in enumerate(TRICKY)] + [(50 + i, TRICKY[6], f"s{i}") for i in range(4)] + [(0, TRICKY[0], "s0"), (None, TRICKY[2], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_secret_spans(spark):
    docs, rows = secret_docs(spark)
    got = secrets.digests(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for d, t, _ in rows:
        want[d].append(t)
    for r in got:
        found = spans(want[r["doc_id"]][0])
        assert [r[f"n_{k[0]}"] for k in KINDS] == [sum(x[3] == k[0] for x in found) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(listed(found).encode()).hexdigest()
        added = [(4, 3, 30, "owned")] if r["doc_id"] == 5 else []  # in one document; the other one is widely copied
        assert r["spans"] == listed(sorted(found + added))
        assert r["n_live"] + r["n_example"] == len(found) + len(added)
    assert secrets.digests(cases.empty(spark)).count() == 0


def test_secrets_are_redacted(spark):
    docs, rows = secret_docs(spark)
    for r in secrets.redact(docs).collect():
        if r["doc_id"] == 5:
            assert r["text"] == "own <owned> end"
        elif r["doc_id"] == 4:
            assert r["text"] == "f" * 23 + "g<hex>😀<hex>"
        elif r["doc_id"] in (6, 50, 7, 8):
            assert r["text"] == dict((d, t) for d, t, _ in rows)[r["doc_id"]]
        assert not spans(r["text"])
    awkward = cases.documents(spark)
    got = secrets.redact(awkward)
    assert got.columns == awkward.columns and got.count() == len(cases.rows())
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["n_chars"] is not None)


def test_secrets_of_a_large_owner(spark):
    """A key in 25 documents of one source is live, one in three documents of three sources is an example."""
    rows = [(i, f"{TRICKY[5]} token: abcdefgh{i // 25}", "big") for i in range(25)] + [(100 + i, TRICKY[6], f"s{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for r in secrets.digests(docs).collect():
        assert (r["n_owned"], r["n_live"], r["n_example"]) == ((1, 2, 0) if r["doc_id"] < 100 else (0, 0, 0))
    for r in secrets.redact(docs).collect():
        assert r["text"] == ("own <owned> end <assign>" if r["doc_id"] < 100 else TRICKY[6])


def test_secrets_by_owners_and_repositories(spark):
    """Nine tenths of a value's repositories in one owner's hands make it that owner's; the SQL says the same."""
    own, near, copied = (f"x {c}bcdefghij0123456789KLMNOP end" for c in "OQW")
    rows = [(i, own, "big") for i in range(25)]
    rows += [(100 + i, near, "big" if i < 18 else f"s{i}") for i in range(20)]  # 18 of 20
    rows += [(200 + i, copied, "big" if i < 17 else f"s{i}") for i in range(20)]  # 17 of 20
    rows += [(100, near, "big")] * 30  # repeats are no repositories more
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {(r["doc_id"], r["n_owned"]) for r in secrets.digests(docs).collect()}
    assert got == {(d, int(d < 200)) for d, _, _ in rows}
    once = docs.distinct()
    con = duckdb.connect()
    con.register("documents", once.toPandas())
    want = con.execute(ORACLE["op5_secret_scan"]).df()
    mine = secrets.digests(once).toPandas()[list(want.columns)]
    assert sorted(map(tuple, want.values.tolist())) == sorted(map(tuple, mine.values.tolist()))


# ---- language model

def backoff(rows, order):
    every, own = Counter(), []
    for _, t in rows:
        w = words(t)
        c = Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        own.append((w, c))
        every.update(c)
    total, out = sum(len(w) for w, _ in own), []
    for (d, _), (w, c) in zip(rows, own):
        score, rest = 0.0, total - len(w)
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if every[g] > c[g]:
                    score += math.log((every[g] - c[g]) / (every[g[:-1]] - c[g[:-1]] if n > 1 else rest))
                    break
                if n > 1:
                    score += math.log(lm.ALPHA)
            else:
                score -= math.log(rest + 1)
        out.append((d, len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK", 10_000)
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = sorted((key(r[:2]), r[2]) for r in lm.scores(cases.documents(spark), order).collect())
    for (a, x), (b, y) in zip(got, sorted((key(r[:2]), r[2]) for r in backoff(rows, order))):
        assert a == b and x == pytest.approx(y, abs=1e-6)
    assert lm.scores(cases.empty(spark)).count() == 0


# ---- packing

def test_best_fit_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 60, 80)
        b, offset, fill = packing.best_fit(sizes, 64)
        rooms = []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [r for r in rooms if r[0] >= sizes[i]]
            if fits:
                min(fits, key=lambda r: r[0])[0] -= sizes[i]
            else:
                rooms.append([64 - sizes[i]])
        assert len(fill) == len(rooms) and sorted(64 - fill) == sorted(r[0] for r in rooms)
        for j in range(len(fill)):
            at = 0
            for i in sorted(np.flatnonzero(b == j), key=lambda i: offset[i]):
                assert offset[i] == at
                at += sizes[i]


@pytest.mark.parametrize("items", [50_000, 4])
def test_packing(spark, monkeypatch, items):
    monkeypatch.setattr(packing, "ITEMS", items)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(packing.pieces(cases.documents(spark), public_tokenizers.path(RANKS), SPECIAL, public_tokenizers.path(VOCABULARY))).collect()
    places, pieces = defaultdict(list), []
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces.append(key(r[:5]))
    want, total = [], 0
    for r in cases.rows():
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [key((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(pieces) == sorted(want)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 2
    assert packing.pack(packing.pieces(cases.empty(spark), public_tokenizers.path(RANKS), SPECIAL, public_tokenizers.path(VOCABULARY))).count() == 0


def test_packing_leaves_no_bin_behind_that_could_be_joined(spark, monkeypatch):
    """All bins with room lie in one partition, and in each other one a single piece that fits into any of them."""
    n, items = 150, 100
    monkeypatch.setattr(packing, "ITEMS", items)
    ids = spark.range(0, n * items, 1, 1)  # one partition: the rows' keys are 0, 1, 2...
    at = (ids.withColumn("to", F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(n))).repartition(n, "to").select("id", F.spark_partition_id().alias("p")))
    at = at.withColumn("nth", F.row_number().over(Window.partitionBy("p").orderBy("id"))).toPandas()
    roomy = at.groupby("p").size().idxmax()
    size = np.where(at["p"] == roomy, 1500, np.where(at["nth"] == 1, 500, 2047))
    rows = spark.createDataFrame([(int(i), int(x)) for i, x in sorted(zip(at["id"], size))], "doc_id long, length long").coalesce(1)
    got = packing.pack(rows.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.lit(0).cast("long").alias("ids_crc32"))).toPandas()
    small = (size == 500).sum()
    assert (size == 1500).sum() > small > 64 and sorted(got["doc_id"]) == list(range(n * items))
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048 and len(fill) == n * items - small


def test_packing_fills_the_least_room(spark, monkeypatch):
    """A short piece finds the room of sequences that are nearly full, in whichever partition they lie."""
    monkeypatch.setattr(packing, "ITEMS", 1)
    for alone in range(8):
        rows = [(i, 0, 0, 8 if i == alone else 2040, 0) for i in range(8)]
        rows = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(1)
        assert packing.pack(rows).select("sequence_id").distinct().count() == 7


@pytest.mark.parametrize("gap", [" ", "\n", "\t", "\u2003", " \n"])
def test_packing_takes_any_white_space(spark, gap):
    """A million white-space characters in a row, for which the encoder's pattern has no room; ids equal the library's."""
    text = "one" + gap * (1_100_000 // len(gap)) + "two  three"
    ids = [*Tokenizer.from_file(public_tokenizers.path(VOCABULARY)).encode(text, add_special_tokens=False).ids, 0]
    got = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), public_tokenizers.path(RANKS), SPECIAL, public_tokenizers.path(VOCABULARY)).collect()
    assert sum(r["length"] for r in got) == len(ids)
    for r in got:
        piece = np.array(ids[r["start"]: r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
