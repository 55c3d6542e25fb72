"""Importance resampling, periodic runs and toxicity against brute force in plain Python, on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import cases
from panelkit.llm import importance, labelmodel, periodic, toxicity

SMALL = "/root/testdata/sf0.001"


def key(r):
    return tuple("~" if x is None else str(x) for x in r)


# ---- importance resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n_max):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i:i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, n_max, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x, n_max)[1]))
    for x in target:
        t.update(map(bucket, features(x, n_max)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, x in docs:
        w, f = features(x, n_max)
        weight = sum(gain(bucket(y)) for y in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, len(w)])
    fits = [r for r in out if r[5] >= least and r[0] is not None]
    for k, r in enumerate(sorted(fits, key=lambda r: (-r[3], r[0], -r[2], r[1]))[: len(fits) * percent // 100], 1):
        r[4] = k
    return sorted(key(r[:5]) for r in out)


@pytest.mark.parametrize("n_max,percent", [(1, 10), (3, 40), (1, 100)])
def test_resampling(spark, n_max, percent):
    rng = random.Random(n_max)
    more = [(1000 + i, cases.prose(rng, rng.randrange(10, 60)).title()) for i in range(80)]
    docs = cases.documents(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("rank", F.lit("a clash"))
    target = [None, "", "W1 w2\x00w3-w3 É", cases.prose(rng, 50, 30)]
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), n_max, 500, 20, percent)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert sorted(map(key, got.collect())) == resampled([(r[0], r[1]) for r in cases.rows()] + more, target, n_max, 500, 20, percent)


def test_resampling_of_nothing(spark):
    none, one = spark.createDataFrame([], "text string"), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(cases.empty(spark), one).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in importance.resample(docs, none, least_words=0, percent=100).collect()}
    assert got[2]["weight"] == 0 and got[2]["n_features"] == 0 and {r["rank"] for r in got.values()} == {1, 2}


@given(st.text(alphabet="aB1 -\n\x00é日", max_size=40), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_spans_overlap_and_keep_to_words(text, n):
    line = importance.normal(text)
    w, _ = features(text, 1)
    assert line.decode().split(" ") == w if w else line == b""
    got = [line[a:b].decode() for a, b in importance.spans(line, n)]
    assert got == [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]


# ---- periodic runs

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            size = i - s + p
            if size >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, s + size - q)) for q in range(1, p)):
                out.append((s, size, p))
    return sorted(out)


def digest(d, text):
    w = SPACED.findall(text or "")
    n = len(w)
    if d is not None and n and zlib.crc32(str(d).encode()) % 10 == 0:
        g = zlib.crc32(str(d).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = brute_runs(w)
    best = min(got, key=lambda r: (-r[1] / r[2], r[0], r[2])) if got else (None,) * 3
    gone = {i for s, size, p in got for i in range(s + p, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (d, len(got), *best, best[1] * 1000 // best[2] if got else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in got)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests(spark):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in cases.rows() if len(r[1] or "") < 20_000]
    for i in range(60):  # few words, so that runs nest and touch; and blocks that repeat with a broken end
        rows.append((200 + i, " ".join(rng.choice("ab c".split() if i % 2 else "abc") for _ in range(rng.randrange(0, 200)))))
        block = [f"x{k}" for k in range(rng.randrange(1, 9))]
        rows.append((300 + i, " ".join([*cases.prose(rng, 5).split(), *(block * rng.randrange(3, 9)), *block[: i % 4], "end"])))
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, t in rows if t) > 5
    got = periodic.digests(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("a clash")).repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(key(digest(d, t)) for d, t in rows)
    assert periodic.digests(cases.empty(spark)).count() == 0


@given(st.lists(st.sampled_from("aab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=40).map(lambda x: x * 5 + x[:1]))
@settings(max_examples=150, deadline=None)
def test_runs_of_any_words(w):
    symbol = np.array([ord(c) for c in w], np.int64)
    order = periodic.suffix_order(symbol, np.zeros(len(w), np.int64), np.full(len(w), len(w)))
    assert [w[i:] for i in order] == sorted(w[i:] for i in range(len(w)))
    assert periodic.runs(symbol.tolist(), order.tolist()) == brute_runs(w)


def test_long_runs_take_little_time(spark):
    """100,000 words of period 1, 2, 7 and 20,000: about n log n steps."""
    import time
    t0 = time.time()
    texts = ["same " * 100_000, "two words " * 50_000, " ".join(f"w{i % 7}" for i in range(100_000)), " ".join(f"w{i % 20_000}" for i in range(100_000))]
    got = {r["doc_id"]: r for r in periodic.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i]["start"], got[i]["length"], got[i]["period"]) for i in range(4)] == [(0, 100_000, p) for p in (1, 2, 7, 20_000)]
    assert time.time() - t0 < 60


def test_collapse(spark):
    rows = [(1, "a  b a b a b a b c"), (2, "x  y"), (3, None), (4, "go go go go go go")]
    got = {r["doc_id"]: r["text"] for r in periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a b c", 2: "x  y", 3: "", 4: "go"}


# ---- toxicity

def test_label_model_finds_rates_and_ties():
    """Six voters, two of them one and the same but for noise: rates, the tie and posteriors come back without labels."""
    rng = np.random.default_rng(3)
    n = 60_000
    y = rng.random(n) < 0.2
    rates = np.array([[0.02, 0.05, 0.1, 0.03, 0.2, 0.3], [0.7, 0.6, 0.5, 0.8, 0.25, 0.3]])
    v = rng.random((n, 6)) < rates[y.astype(int)]
    v = np.column_stack([v, np.where(rng.random(n) < 0.7, v[:, 1], rng.random(n) < rates[y.astype(int), 1])])  # a copy of voter 1
    counts = np.bincount(v @ (1 << np.arange(7)), minlength=128)
    said = labelmodel.all_votes(7)[:, :4].sum(axis=1)
    m = labelmodel.fit(counts, 7, np.clip(said / 3, 0.02, 0.98))
    assert m.prior == pytest.approx(0.2, abs=0.02)
    assert np.allclose(m.rates[:, :6], rates, atol=0.04) and m.pairs == [(1, 6)]
    truth = np.array([y[v @ (1 << np.arange(7)) == k].mean() if counts[k] > 300 else np.nan for k in range(128)])
    seen = ~np.isnan(truth)
    assert seen.sum() > 10 and np.nanmax(np.abs(m.posterior - truth)[seen]) < 0.12


def test_label_model_matches_em_by_listing():
    """Without ties the fit is the plain mixture of independent votes, maximised by textbook steps."""
    rng = np.random.default_rng(9)
    y = rng.random(5000) < 0.3
    v = rng.random((5000, 4)) < np.array([[0.1, 0.15, 0.05, 0.2], [0.8, 0.7, 0.9, 0.6]])[y.astype(int)]
    counts = np.bincount(v @ (1 << np.arange(4)), minlength=16).astype(float)
    votes, q = labelmodel.all_votes(4), np.clip(labelmodel.all_votes(4).sum(axis=1) / 3, 0.02, 0.98)
    got = labelmodel.fit(counts, 4, q)
    for _ in range(3000):
        prior = counts @ q / counts.sum()
        r = [(counts * s) @ votes / (counts @ s) for s in (1 - q, q)]
        like = [np.prod(np.where(votes == 1, x, 1 - x), axis=1) for x in r]
        q = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
    if not got.pairs:
        assert np.allclose(got.posterior, q, atol=0.02) and np.allclose(got.rates, r, atol=0.02)
    assert got.prior == pytest.approx(prior, abs=0.02)


def toxic_corpus(rng, n):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k + 100))
    bad = [f"vile{name(k)}" for k in range(12)]
    rows, truth = [], {}
    for i in range(n):
        w = [name(rng.randrange(3000)) for _ in range(rng.randrange(30, 80))]
        truth[i] = int(rng.random() < 0.25)
        if truth[i]:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
    return rows, truth


def test_toxicity_learns_from_the_training_fold_alone(spark):
    rng = random.Random(17)
    rows, truth = toxic_corpus(rng, 600)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = [(i, 1 - truth[i] if held(i) else truth[i]) for i in truth]  # wrong in the held-out rows
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None), (901, ""), (902, "vilebab " * 3)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.predictions(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == held(i) for i in truth) and by[None]["held_out"] is None
    right = [by[i]["predicted"] == truth[i] for i in truth if held(i)]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert by[900]["score"] == by[901]["score"] and by[900]["predicted"] == 0


def test_toxicity_without_usable_labels(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.predictions(docs, none).collect()} == {0.0}
    clean = spark.createDataFrame([(i, 0) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.predictions(docs, clean).collect()
    assert {r["score"] for r in got} == {0.0} and len(got) == len(cases.rows())
    assert toxicity.predictions(cases.empty(spark), clean).count() == 0


def test_toxicity_on_held_out_rows_of_the_given_tables(spark):
    """Held-out accuracy and separation on sf0.1, whose labels are partly wrong."""
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = toxicity.predictions(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1].score, got[got.toxic == 0].score
    above = np.mean([a > b or 0.5 * (a == b) for a, b in itertools.product(toxic, clean)])
    assert len(got) > 600 and above > 0.95 and (clean < 0.5).mean() > 0.98 and (toxic >= 0.5).mean() > 0.7
