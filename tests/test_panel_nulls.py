"""NULL traps, one tiny table per trap, plus key/quantile helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import describe as D
from panelkit.operators import panel as P


def test_null_flag_never_counts(spark):
    df = spark.createDataFrame([(1, 1990, None), (1, 1991, 1), (2, 1990, None), (2, 1991, None)],
                               "u int, t int, f int")
    out = {(r.u, r.t): r.first for r in P.first_treated(df, "u", "t", "f").collect()}
    assert out[(1, 1990)] == 1991 and out[(2, 1990)] is None


def test_null_tau_is_not_upper_tail(spark):
    df = spark.createDataFrame([(1, None), (2, 9), (3, -12)], "u int, tau int")
    r = {x.u: (x.tauL, x.tauR) for x in P.tail_dummies(df, "tau", -10, 5).collect()}
    assert r == {1: (0, 0), 2: (0, 1), 3: (1, 0)}


def test_all_null_outcome_unit_dropped(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, 3.0), (2, 2, None)], "u int, t int, y double")
    assert sorted({r.u for r in P.drop_all_missing_units(df, "u", "y").collect()}) == [2]


def test_adoption_null_vs_last_year(spark):
    df = spark.createDataFrame([(1, None, 2000), (2, 2005, 2000), (3, 1999, 2000)], "u int, first int, last int")
    r = {x.u: x.nev for x in df.select("u", P.never_adopt("first", "last").alias("nev")).collect()}
    assert r == {1: True, 2: True, 3: False}


def test_any_over_all_null_is_false(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0)], "u int, y double")
    r = {x.u: x.a for x in df.groupBy("u").agg(D.any_flag(F.col("y") > 1).alias("a")).collect()}
    assert r == {1: False, 2: True}


def test_eligibility_rule(spark):
    rows = [(1, t, t - 5, False) for t in range(10)] + [(2, t, t - 8, False) for t in range(10)] + \
           [(3, 0, None, True)] + [(4, t, None, True) for t in range(3)]
    df = spark.createDataFrame(rows, "u int, t int, tau int, never boolean")
    kept = {r.u for r in P.eligible_sample(df, "u", "tau", "never").collect()}
    assert kept == {1, 4}          # unit 2 lacks tau >= 3, unit 3 has one row


def test_dense_id_consecutive_in_key_order(spark):
    keys = [f"k{i:03d}" for i in np.random.default_rng(1).permutation(200)]
    df = spark.createDataFrame([(k,) for k in keys for _ in range(2)], "key string")
    ids = {r.key: r.unit_id for r in P.dense_id(df, "key", num_partitions=7).collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(1, 201))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 50, size=301).astype(float)
    grp = rng.integers(0, 3, size=301)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, x double")
    q7 = {r.g: (r.p10, r.p90) for r in D.exact_quantiles(df, ["g"], "x", {"p10": .1, "p90": .9}).collect()}
    qs = {r.g: r.p10 for r in D.exact_quantiles(df, ["g"], "x", {"p10": .1}, method="stata").collect()}
    for g in range(3):
        v = np.sort(vals[grp == g])
        assert q7[g][0] == pytest.approx(np.percentile(v, 10))
        assert q7[g][1] == pytest.approx(np.percentile(v, 90))
        n = len(v)
        j = n * 0.1
        stata = (v[int(j) - 1] + v[int(j)]) / 2 if abs(j - round(j)) < 1e-12 else v[int(np.ceil(j)) - 1]
        assert qs[g] == pytest.approx(stata)


def test_override_chain_last_wins(spark):
    df = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "a int, b int")
    c = P.override_chain([(F.col("a") == 1, 1995), (F.col("b") == 1, 1985)])
    r = {(x.a, x.b): x.v for x in df.select("a", "b", c.alias("v")).collect()}
    assert r == {(0, 0): None, (1, 0): 1995, (0, 1): 1985, (1, 1): 1985}


def test_frequent_value_is_one_row(spark):
    """Half of all rows hold one value: ranks come from value counts, quantiles stay exact."""
    vals = [7.0] * 500 + [float(i) for i in range(500)]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, x double").repartition(6)
    ranks = D.value_ranks(df, ["g"], "x")
    assert ranks.where("x = 7").count() == 1
    assert ranks.selectExpr("sum(_to - _from + 1)").first()[0] == 1000
    q = D.exact_quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(np.percentile(vals, [25, 50, 90]))


def test_rows_outside_the_old_frame_stay(spark, tmp_path):
    import datetime as dt
    from panelkit.sources.fixtures import customer_year
    rows = [(1, dt.datetime(1990, 5, 1), 10.0), (1, dt.datetime(1996, 5, 1), 10.0), (2, dt.datetime(2005, 5, 1), 5.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.unit, r.t) for r in customer_year(spark, str(tmp_path), grid=True).where("y_cnt is not null").collect()}
    assert got == {(1, 1990), (1, 1996), (2, 2005)}
    assert customer_year(spark, str(tmp_path), grid=True).count() == 2 * 16


def test_stage_hand_off_needs_no_session(spark, tmp_path):
    """A stage is found by name alone from another session of the same setting, and can be dropped."""
    from panelkit.sources.io import drop_stage, load_stage, save_stage
    other = spark.newSession()
    for s in (spark, other):
        s.conf.set("spark.panelkit.stage.dir", str(tmp_path / "stages"))
    save_stage(spark.range(5), "five")
    assert load_stage(other, "five").count() == 5
    assert drop_stage(other, "five") and not drop_stage(spark, "five")
    spark.conf.unset("spark.panelkit.stage.dir")


def test_attgt_counts_periods_not_rows(spark):
    """A repeated row doesn't fill the gap of another period."""
    from panelkit.operators.attgt import att_gt
    rows = [(u, t, float(u + t), None if u > 3 else 3) for u in range(1, 8) for t in range(1, 6) if (u, t) != (2, 4)] + [(2, 5, 9.0, 3)]
    res = att_gt(spark.createDataFrame(rows, "u long, t int, y double, g int"), "y", "u", "t", "g")
    assert res.n == 6
