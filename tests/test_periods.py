"""Period effects found step by step in Spark = dense dummies and the direct solver."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelkit.operators.feols import absorb_two_way, feols, feols_multi
from panelkit.plans import QUERIES
from panelkit.session import checkpoint_dir


def _left_folders(spark):
    return [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("steps-")]


def _same(a, b):
    assert a.omitted == b.omitted and (a.n, a.n_periods, a.K, a.fe_rank_deficit) == (b.n, b.n_periods, b.K, b.fe_rank_deficit)
    assert np.allclose(a.beta, b.beta, atol=1e-9, equal_nan=True)
    # a variance may be exactly zero, where only rounding is left: it is held against the largest entry
    assert np.allclose(a.vcov, b.vcov, rtol=1e-7, atol=1e-12 * np.nanmax(np.abs(b.vcov)), equal_nan=True)
    assert a.ssr == pytest.approx(b.ssr, rel=1e-9) and a.r2 == pytest.approx(b.r2, rel=1e-9)


def test_more_periods_than_the_driver_solves(spark):
    rng = np.random.default_rng(3)
    T, N, n = 5300, 70, 24000
    t = np.concatenate([np.arange(T), rng.integers(0, T, n - T)])
    u = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, N, n))  # a unit with a third of all rows
    x = rng.normal(size=n) + t / 1000
    y = 2 * x + np.sin(t) + u + rng.normal(size=n) + 1e5
    w = rng.uniform(0.5, 2, n)
    pdf = pd.DataFrame({"u": u, "t": t, "x": x, "y": y, "w": w})
    fit = feols(spark.createDataFrame(pdf), "y", ["x"], "u", "t", weight="w", vcov="iid")
    # dense dummies: all periods, all units but one
    M = np.zeros((T + N, T + N))
    np.add.at(M, (t, t), w), np.add.at(M, (T + u, T + u), w)
    np.add.at(M, (t, T + u), w), np.add.at(M, (T + u, t), w)
    rhs = np.zeros((T + N, 2))
    for j, v in enumerate((x, y - y.mean())):
        np.add.at(rhs[:, j], t, w * v), np.add.at(rhs[:, j], T + u, w * v)
    g = np.zeros((T + N, 2))
    g[:-1] = np.linalg.solve(M[:-1, :-1], rhs[:-1])
    rx, ry = ((v - g[t, j] - g[T + u, j]) for j, v in enumerate((x, y - y.mean())))
    beta = (w * rx) @ ry / ((w * rx) @ rx)
    ssr = w @ (ry - beta * rx) ** 2
    K = 1 + T + N - 1
    assert fit.n_periods == T and fit.K == K and fit.fe_rank_deficit == 0
    assert abs(fit.beta[0] - beta) < 1e-8
    assert fit.se[0] == pytest.approx(np.sqrt(ssr / (n - K) / ((w * rx) @ rx)), rel=1e-8)
    assert not _left_folders(spark)


def test_chains_and_unconnected_parts(spark):
    """Units that see two neighbouring periods each, in three parts, and a period of its own."""
    rng = np.random.default_rng(5)
    rows = [(100 * part + i, f"{part}-{i + k:02d}", *rng.normal(size=2).tolist(), float(rng.uniform(0.5, 2)))
            for part in range(3) for i in range(5) for k in (0, 0, 1)] + [(999, "alone", 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "u long, t string, y double, x double, w double").withColumn("of_t", F.length("t").cast("double"))
    one, other = (feols(df, "y", ["x", "of_t"], "u", "t", weight="w", periods=p) for p in ("direct", "iterative"))
    assert one.fe_rank_deficit == 3
    _same(one, other)


def test_gaps_and_a_cluster(spark):
    rng = np.random.default_rng(8)
    rows = [(u, t, *map(float, rng.normal(size=3)), u % 7) for u in range(40) for t in range(12) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "u long, t long, y double, x double, z double, c long").withColumn("g", F.when(F.col("u") % 3 > 0, F.col("z")))
    specs = [("g", ["x"])]
    for a, b in zip(*(feols_multi(df, specs, "u", "t", cluster="c", periods=p) for p in ("direct", "iterative"))):
        _same(a, b)


def test_minutes(spark):
    got = {r["term"]: r for r in QUERIES["twfe_minutes"](spark, SF_SMALL).collect()}
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("minute", F.date_trunc("minute", "ts"))
    names = list(got)
    events = events.select("*", *[(F.col("event_type") == x).cast("double").alias(x) for x in names])
    one, other = (feols(events, "value", names, "user_id", "minute", periods=p) for p in ("direct", "iterative"))
    _same(one, other)
    for x, beta in ((r[0], r[1]) for r in one.rows()):  # null: omitted
        assert got[x]["n_periods"] == one.n_periods
        assert got[x]["estimate"] is beta is None or got[x]["estimate"] == pytest.approx(beta, abs=1e-6)


def test_refusals_and_few_rows(spark):
    df = spark.createDataFrame([(u, t, float(u * t % 5), 1.0 * t) for u in range(4) for t in range(6)], "u long, t long, y double, x double")
    with pytest.raises(ValueError, match="max_periods"):
        absorb_two_way(df, ["y"], "u", "t", max_periods=3, periods="direct")
    with pytest.raises(ValueError, match="auto"):
        absorb_two_way(df, ["y"], "u", "t", periods="other")
    many, info = absorb_two_way(df, ["y"], "u", "t", max_periods=3)
    assert info["steps"] > 0 and info["T"] == 6
    few, _ = absorb_two_way(df, ["y"], "u", "t")
    a, b = (sorted((r["_u"], round(r["_x0"], 9)) for r in d.collect()) for d in (many, few))
    assert np.allclose(a, b)
    info["_folder"].drop()
    single = df.where("t = 1")
    _, info = absorb_two_way(single, ["y"], "u", "t", periods="iterative")
    assert info["T"] == 1
    info["_folder"].drop()
