"""Queries for S1-S9: loading, profiling, stage hand-offs and report sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from panelkit.operators.describe import prevalence, profile_columns
from panelkit.plans.registry import register, with_ctes
from panelkit.session import checkpoint_dir
from panelkit.sources.fixtures import SQL_P1, SQL_P2, customer_year, supplier_quarter
from panelkit.sources.io import load_stage, read_csv, save_stage, write_csv, write_tsv


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "reports", f"{name}-{uuid.uuid4().hex[:8]}")


@register("panel_profile", with_ctes(SQL_P1) + """
SELECT * FROM (
  SELECT 'unit' AS column_name, 1 AS position, count(*) AS n_rows, count(unit) AS n_nonnull FROM p1 UNION ALL
  SELECT 't', 2, count(*), count(t) FROM p1 UNION ALL
  SELECT 'y_qty', 3, count(*), count(y_qty) FROM p1 UNION ALL
  SELECT 'y_cnt', 4, count(*), count(y_cnt) FROM p1 UNION ALL
  SELECT 'w', 5, count(*), count(w) FROM p1 UNION ALL
  SELECT 'w_cell', 6, count(*), count(w_cell) FROM p1 UNION ALL
  SELECT 'g', 7, count(*), count(g) FROM p1 UNION ALL
  SELECT 'g2', 8, count(*), count(g2) FROM p1 UNION ALL
  SELECT 'policy', 9, count(*), count(policy) FROM p1 UNION ALL
  SELECT 'policy2', 10, count(*), count(policy2) FROM p1)""")
def panel_profile(spark, sf_dir):
    """Rows and non-missing counts per column of the P1 panel (one scan)."""
    return profile_columns(supplier_quarter(spark, sf_dir))


@register("panel_stage_roundtrip", with_ctes(SQL_P1) + """
SELECT unit, t, y_qty, y_cnt, w, g, policy FROM p1""")
def panel_stage_roundtrip(spark, sf_dir):
    """Persist the prepared panel in the shared stage folder and reload it."""
    p = supplier_quarter(spark, sf_dir).select("unit", "t", "y_qty", "y_cnt", "w", "g", "policy")
    name = f"p1-{uuid.uuid4().hex[:8]}"
    save_stage(p, name)
    return load_stage(spark, name)


@register("outcome_partitions", with_ctes(SQL_P1) + """
SELECT outcome, unit, t, value FROM (
  SELECT 'y_qty' AS outcome, unit, t, y_qty AS value FROM p1 UNION ALL
  SELECT 'y_cnt', unit, t, y_cnt FROM p1)""")
def outcome_partitions(spark, sf_dir):
    """One dataset per outcome, written partitioned by outcome and reloaded;
    k outcomes cost one scan instead of k."""
    p = supplier_quarter(spark, sf_dir)
    long = p.unpivot(["unit", "t"], ["y_qty", "y_cnt"], "outcome", "value")
    name = f"outcomes-{uuid.uuid4().hex[:8]}"
    save_stage(long, name, partition_by=["outcome"])
    return load_stage(spark, name).select("outcome", "unit", "t", "value")


_PREV_SQL = with_ctes(SQL_P2) + """
SELECT t AS year, count(DISTINCT unit) AS n_units,
       count(DISTINCT CASE WHEN g IS NOT NULL AND t >= g THEN unit END) AS n_treated,
       count(DISTINCT CASE WHEN y_cnt >= 3 THEN unit END) AS n_busy
FROM p2 GROUP BY t"""


def _prev(spark, sf_dir):
    p = customer_year(spark, sf_dir).withColumn(
        "treated", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int")) \
        .withColumn("busy", (F.col("y_cnt") >= 3).cast("int"))
    return prevalence(p, "unit", "t", {"n_treated": "treated", "n_busy": "busy"}, units_name="n_units") \
        .withColumnRenamed("t", "year")


@register("report_csv_roundtrip", _PREV_SQL)
def report_csv_roundtrip(spark, sf_dir):
    """Report table to a header CSV and back with a fixed schema."""
    path = _scratch(spark, "prevalence_csv")
    write_csv(_prev(spark, sf_dir), path)
    return read_csv(spark, path, "year int, n_units long, n_treated long, n_busy long")


@register("report_tsv_roundtrip", _PREV_SQL)
def report_tsv_roundtrip(spark, sf_dir):
    """The same report through a tab-separated sink."""
    path = _scratch(spark, "prevalence_tsv")
    write_tsv(_prev(spark, sf_dir), path)
    return read_csv(spark, path, "year int, n_units long, n_treated long, n_busy long", sep="\t")


@register("panel_load_schema", """
SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS t, count(*) AS n_orders
FROM orders GROUP BY 1, 2""")
def panel_load_schema(spark, sf_dir):
    """Load a table with a fixed schema (no inference; only the declared
    columns are read) and key it by (unit, period)."""
    from pyspark.sql.types import LongType, StructField, StructType
    from panelkit.sources.io import load_panel
    ts_type = read_orders_ts_type(spark, sf_dir)
    schema = StructType([StructField("o_custkey", LongType()), StructField("o_orderdate", ts_type)])
    df = load_panel(spark, os.path.join(sf_dir, "orders.parquet"), schema)
    return df.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("int").alias("t")) \
             .agg(F.count(F.lit(1)).alias("n_orders"))


def read_orders_ts_type(spark, sf_dir):
    """The timestamp flavour stored in the file (with or without time zone)."""
    return spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).schema["o_orderdate"].dataType
