"""Operators on embeddings and pages, and the pipeline, against brute force."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import ann, common, graph, rpforest, urls

SMALL = "/root/testdata/sf0.01"
ODD = [None, [], [0.0] * 8, [1.0] * 7 + [math.nan], [1.0] * 7 + [math.inf], [1.0] * 7 + [None]]


def vectors(spark, n=300, near=90, dim=8):
    """Random vectors, a star of near copies around two of them, equal ones, odd ones, other lengths, null labels and ids."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(dim).astype("f4").tolist(), i % 3) for i in range(n)]
    for i in range(near):
        v = np.array(rows[i % 2][1]) + rng.standard_normal(dim) * (0.05 if i % 5 else 0.25)
        rows.append((n + i, v.astype("f4").tolist(), i % 2))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(6)] + [rows[7], (2000, rows[5][1], None), (None, rows[5][1], 0), (2001, [1.0, 2.0], 1), (2002, [1.0, 2.0], 1)]
    rows += [(3000 + i, v, 1) for i, v in enumerate(ODD)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, vec string, n_links string").repartition(5)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_forest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "LEAF", 24)
    monkeypatch.setattr(rpforest, "BLOCK", 16)
    rows, df = vectors(spark)
    n, links = Counter(), defaultdict(set)
    ok = [r for r in rows if r[0] is not None and r[2] is not None and fine(r[1])]
    for i, (a, v, x) in enumerate(ok):
        for b, w, y in ok[:i]:
            if x == y and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                n[a] += 1
                n[b] += 1
                links[a].add(b), links[b].add(a)

    def smallest(a):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return min(seen)

    got = rpforest.near_copies(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        elif i == 7:  # a row that repeats: its copy is one of its links
            assert r["n_links"] == n[7] / 2
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[i], smallest(i), smallest(i) == i)
    assert max(n.values()) > 40
    assert rpforest.near_copies(df.limit(0)).count() == 0


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_estimates_do_not_grow_with_the_levels(spark, monkeypatch):
    """A join's size is estimated as the product of its sides; carried from cut to cut, it filled the driver with digits."""
    seen = []

    def cut(df):
        seen.append(estimate(out := common.cut(df)))
        return out

    monkeypatch.setattr(rpforest, "LEAF", 16)
    monkeypatch.setattr(rpforest, "cut", cut)
    monkeypatch.setattr(graph, "cut", cut)
    rows, df = vectors(spark)
    assert rpforest.near_copies(df).count() == len(rows)
    assert len(seen) > 15 and max(seen) < 1 << 63


def test_cut_keeps_rows_and_partitions(spark):
    df = spark.createDataFrame([(i, None if i % 5 else "x") for i in range(100)] + [(3, "twice"), (None, "y")], "id long, s string")
    for n in range(3):
        other = df.select("id", F.col("s").alias(f"s{n}")).distinct()
        raw = df.join(other, "id", "left").repartition(5, "id").sortWithinPartitions("id")
        df = common.cut(raw)
        assert estimate(df) < 1 << 63 <= estimate(raw)
        assert Counter(df.collect()) == Counter(raw.collect()) and df.schema == raw.schema and df.rdd.getNumPartitions() == 5
    few = common.cut(spark.range(10))
    assert estimate(few) == estimate(spark.range(10))  # what a long holds stays


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(260, 259), (3, 3), (7, 5), (5, 9)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect())
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 200 for i in range(201, 261)}, 7: 5, 9: 5}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and fine(v) and len(v) == 8]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            out[i] = sorted((-float((v * w).sum()), j) for j, w in ok if j != i)[:k]
    return out


def search(df, **more):
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "n_links")
    return ann.search(rows, rows.where("id % 20 = 0"), **more)


def test_search_everything_is_exact(spark, monkeypatch):
    """With every cell visited the index gives the exact neighbours, ties to the smaller id."""
    monkeypatch.setattr(ann, "ENTRIES", 10)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rows, df = vectors(spark)
    want = neighbours(rows, 20)
    got = defaultdict(list)
    for r in search(df, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, near in want.items():
        assert [r[0] for r in got[q]] == list(range(1, 21))
        assert [r[1] for r in got[q]] == [j for _, j in near]
        assert [r[2] for r in got[q]] == pytest.approx([-s for s, _ in near], abs=1e-12)
    assert search(df.limit(0)).count() == 0
    few = search(df.where("vec_id in (0, 1, 2, 3)")).collect()  # fewer rows than centroids or neighbours
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3)]


def test_search_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got = defaultdict(set)
    for r in ann.search(rows, rows.where("id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    table = df.toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hits = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(got[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("sigma, outlier", [(0.25, 1.0), (0.5, 1.0), (1.0, 1.0), (0.25, 1000.0)])
def test_search_recall_with_varied_norms(spark, sigma, outlier):
    """Long vectors are neighbours of many queries and far from all of them."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x *= (np.exp(sigma * rng.standard_normal(len(x))) / np.linalg.norm(x, axis=1))[:, None]
    x[7] *= outlier
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    got = defaultdict(set)
    for r in ann.search(rows, rows.where("id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 200 and hits / (20 * 200) >= 0.9


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(2)
    a, b, held = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    got = ann.walk(a, b, held, 10**9)
    assert sorted(got) == sorted(zip(*np.nonzero(held)))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums)
    part = ann.walk(a, b, held, 20)
    assert part == got[: len(part)] and sum(held[c] for c in part) >= 20 > sum(held[c] for c in part[:-1])


# ---- URL filter

URLS = ["http://a.example.net/en/1", "http://a.example.net/fr/1", "HTTPS://B.Example.COM/de/x?q=1", "http://example.org/fr/", "http://org/fr/a#b", "http://xnet/", "http://net",
        "http://net/", "http://ÄB.net/p", "no scheme", None, "", "a://b://c/d", "http://h?x/y", "http://u.example.com/en/77?p=1&r=2#t", "x://\nnet/\nq", "://net/en", "http://example.com/de"]


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):])[0]


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def mined_by_hand(labelled, support, confidence):
    """Every frequent token set that implies a verdict surely enough, by counting all subsets."""
    count, with_label = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), n):
                count[s] += 1
                with_label[s, verdict] += 1
    least = math.ceil(support * len(labelled))
    return {(s, v): (n / count[s], n) for (s, v), n in with_label.items() if n >= least and n / count[s] >= confidence}


def tokens_of(u):
    host, path = split_url(u)
    query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", u or "")
    out = [f"host {x}" for x in host.split(".") if x] + [f"path {x}" for x in re.sub("[0-9]+", "0", path).split("/") if x]
    return frozenset(out + [f"query {x.split('=')[0]}" for x in (query[1] if query else "").split("&") if x.split("=")[0]])


def test_urls(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS * 2)] + [(None, URLS[1], "x", "y"), (3, "http://z/", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, tokens string").repartition(3)
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, u, *_ in rows:
        want[(i, *split_url(u), fixed(*split_url(u))[0])] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    for r in got:
        rule, verdict = fixed(r["host"], r["path"])
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in got if not r["host"]} == {"allow"}
    assert urls.judge(df.limit(0)).count() == 0


def test_mined_verdicts_by_counting_subsets(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    rows = [(r["page_id"], r["url"]) for r in pages.collect()]
    labelled = [(tokens_of(u), fixed(*split_url(u))[1]) for _, u in rows if fixed(*split_url(u))[1]]
    rules = mined_by_hand(labelled, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE)
    by_id = {r["page_id"]: r for r in urls.judge(pages).collect()}
    decided = 0
    for i, u in rows:
        r = by_id[i]
        if r["rule"] is None:
            t = tokens_of(u)
            hits = [(c, n, v) for (s, v), (c, n) in rules.items() if t.issuperset(s)]
            assert r["verdict"] == (max(hits)[2] if hits else "allow")
            assert (r["n_matched"] > 0) == bool(hits)
            decided += bool(hits)
    assert decided > 20


# ---- the pipeline

def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as P
    from llm import cases
    from panelkit.llm import minhash, secrets, substring

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kinds, kept = docs.dtypes, {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = kept[name] = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert docs.dtypes == kinds
    sizes = [d.count() for d in kept.values()]
    assert 1000 > sizes[0] > sizes[1] >= sizes[2] == sizes[3]
    after = [minhash.near_copies(kept["MinHash near-dedup"]).where("class_id <> doc_id").count(),
             substring.digests(kept["substring dedup"]).where("n_removed > 0").count(),
             secrets.digests(kept["secret scans"]).where("spans <> ''").count()]
    assert after[0] == 0 and after[2] == 0
    assert after[1] <= 2  # joined texts may make a window that stood nowhere before
    last = kept["best-fit packing"]
    assert last.select("doc_id").distinct().count() == sizes[3]
    full = last.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert full[0] <= 2048 and full[1] <= -(-full[2] // 2048) + 1
    assert sorted(P.run(spark, SMALL).collect()) == sorted(last.collect())
    empty = cases.empty(spark).select(*kept["secret scans"].columns)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
