"""Stages that survive a failed writer, and outer joins with hot and null keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelkit.operators.joins import heavy_keys, join_outer, join_outer_skewed
from panelkit.sources import io


def test_failed_save_leaves_the_old_stage(spark, tmp_path):
    root = str(tmp_path)
    io.save_stage(spark.range(5), "s", root)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        io.save_stage(bad, "s", root)
    assert io.load_stage(spark, "s", root).count() == 5


def test_unpublished_save_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    io.save_stage(spark.range(5), "s", root)
    with monkeypatch.context() as m:
        m.setattr(io, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            io.save_stage(spark.range(7), "s", root)
    assert io.load_stage(spark, "s", root).count() == 5
    monkeypatch.setattr(io, "_ABANDONED_S", -1)
    io.save_stage(spark.range(9), "s", root)
    assert io.load_stage(spark, "s", root).count() == 9
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")]) == 2  # the killed one is gone


def test_begun_reader_outlives_a_save(spark, tmp_path):
    root = str(tmp_path)
    io.save_stage(spark.range(5), "s", root)
    old = io.load_stage(spark, "s", root)
    io.save_stage(spark.range(6), "s", root)
    assert old.count() == 5
    io.save_stage(spark.range(7), "s", root)
    assert len(io.stage_versions(spark, "s", root)) == 2
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")]) == 2
    assert io.load_stage(spark, "s", root).count() == 7
    assert io.drop_stage(spark, "s", root) and not io.drop_stage(spark, "s", root)
    with pytest.raises(FileNotFoundError):
        io.load_stage(spark, "s", root)


def _sides(spark):
    a = [(1, 1, f"a{i}", i) for i in range(400)] + [(2, 1, f"b{i}", None) for i in range(300)] + [(None, 1, "n", 1)] * 90
    a += [(k, k % 3, "x", k) for k in range(10, 60)] + [(None, None, None, None)] + [(1, 1, "a0", 0)] * 2
    b = [(1, 1, 7, i) for i in range(30)] + [(3, 1, 8, i) for i in range(300)] + [(1, None, 9, 9)] * 80 + [(k, k % 2, 5, k) for k in range(30, 90)]
    return (spark.createDataFrame(a, "u int, t int, name string, v int").repartition(5),
            spark.createDataFrame(b, "u int, t int, w int, v int").repartition(3))


def test_skewed_outer_join_gives_the_plain_rows(spark):
    a, b = _sides(spark)
    want = join_outer(a, b, ["u", "t"])
    for least in (20, 100_000):  # with and without heavy keys
        got = join_outer_skewed(a, b, ["u", "t"], least=least)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert Counter(got.collect()) == Counter(want.collect())
    none = a.limit(0)
    assert Counter(join_outer_skewed(none, b, ["u", "t"], least=20).collect()) == Counter(join_outer(none, b, ["u", "t"]).collect())


def test_heavy_keys_are_measured_and_dealt(spark):
    a, b = _sides(spark)
    heavy = {(r["u"], r["t"]): r for r in heavy_keys(a, b, ["u", "t"], least=100).collect()}
    assert set(heavy) == {(1, 1), (2, 1), (3, 1)}  # null keys match nothing and are not counted
    assert (heavy[1, 1]["_na"], heavy[1, 1]["_nb"], heavy[1, 1]["_sa"], heavy[1, 1]["_sb"]) == (402, 30, 5, 1)
    assert heavy[2, 1]["_nb"] == 0 and heavy[3, 1]["_na"] == 0


def test_hot_key_is_spread_over_tasks(spark):
    a = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    b = spark.range(3).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("w"))
    sizes = join_outer_skewed(a, b, ["k"], least=500).where("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 60_000
    assert max(r["count"] for r in sizes) < 3 * sorted(r["count"] for r in sizes)[len(sizes) // 2]
