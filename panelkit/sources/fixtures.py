"""Policy panels derived from the driver's tables (FIXTURES.md part B).

Treatment rules use ids or first events only, never the outcome, so the
true effect is zero.  Every builder is one partial aggregation of a fact
table to (unit, period) cells, plus unit-level windows on the much smaller
cell table.  Cells are bounded by the number of periods per unit, so a hot
unit in the fact table is absorbed by the map-side combine of the first
aggregation and never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.sources.io import read_table

# Fixed fixture constants (FIXTURES.md, part B).
P1_BASE_YEAR = 1995
P1_COHORT_BY_MOD4 = {1: 8, 2: 14, 3: 20}      # unit % 4 -> first treated quarter; 0 -> never
P1_COHORT2_BY_MOD5 = {1: 10, 2: 18}           # second policy: unit % 5 -> quarter; else never
P2_COHORT_BY_MOD4 = {1: 1997, 2: 1998, 3: 1999}
P3_ORIGIN = "2024-01-01"


def _cohort(col, mapping: dict[int, int], mod: int):
    expr = None
    for k, v in mapping.items():
        cond = (col % mod) == k
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.cast("int")


def _frame(cells: DataFrame) -> DataFrame:
    """Every unit in every period from the data's first to its last one."""
    span = cells.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()  # two scalars
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
    return cells.select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("t"))


def supplier_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x quarter cells of lineitem."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    t = ((F.year("l_shipdate") - P1_BASE_YEAR) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    cells = (li.groupBy(F.col("l_suppkey").alias("unit"), t.alias("t"))
               .agg(F.sum("l_quantity").cast("double").alias("y_qty"),
                    F.count(F.lit(1)).cast("double").alias("y_cnt")))
    by_unit = Window.partitionBy("unit")
    return (cells
            .withColumn("w", F.sum("y_cnt").over(by_unit))
            .withColumn("w_cell", F.col("y_cnt"))
            .withColumn("g", _cohort(F.col("unit"), P1_COHORT_BY_MOD4, 4))
            .withColumn("g2", _cohort(F.col("unit"), P1_COHORT2_BY_MOD5, 5))
            .withColumn("policy", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int"))
            .withColumn("policy2", F.coalesce(F.col("t") >= F.col("g2"), F.lit(False)).cast("int")))


def customer_year(spark: SparkSession, sf_dir: str, grid: bool = False) -> DataFrame:
    """Customer x order-year cells; ``grid=True`` adds every unit x year with NULL outcomes."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cells = (o.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("int").alias("t"))
              .agg(F.count(F.lit(1)).cast("double").alias("y_cnt"),
                   F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y_val")))
    if grid:
        cells = _frame(cells).join(cells, ["unit", "t"], "left")
    by_unit = Window.partitionBy("unit")
    return (cells
            .withColumn("w", F.sum("y_cnt").over(by_unit))
            .withColumn("g", _cohort(F.col("unit"), P2_COHORT_BY_MOD4, 4)))


def user_day(spark: SparkSession, sf_dir: str, grid: bool = False,
             origin: str = P3_ORIGIN) -> DataFrame:
    """User x day cells of events; adoption = first purchase day (data-driven)."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    t = F.datediff(F.to_date("ts"), F.to_date(F.lit(origin))).cast("int")
    cells = (ev.groupBy(F.col("user_id").alias("unit"), t.alias("t"))
               .agg(F.count(F.lit(1)).cast("double").alias("y_cnt"),
                    F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("y_val"),
                    F.max((F.col("event_type") == "purchase").cast("int")).alias("purchase")))
    if grid:
        cells = (_frame(cells).join(cells, ["unit", "t"], "left")
                      .withColumn("y_cnt", F.coalesce("y_cnt", F.lit(0.0)))
                      .withColumn("purchase", F.coalesce("purchase", F.lit(0))))
    by_unit = Window.partitionBy("unit")
    return (cells
            .withColumn("g", F.min(F.when(F.col("purchase") == 1, F.col("t"))).over(by_unit))
            .withColumn("flag", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int"))
            .drop("purchase"))


# --- the same fixtures as SQL CTEs, for the DuckDB oracle -------------------------------

SQL_P1 = """
p1c AS (
  SELECT l_suppkey AS unit,
         CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS t,
         CAST(sum(l_quantity) AS DOUBLE) AS y_qty,
         CAST(count(*) AS DOUBLE) AS y_cnt
  FROM lineitem GROUP BY 1, 2),
p1 AS (
  SELECT unit, t, y_qty, y_cnt,
         sum(y_cnt) OVER (PARTITION BY unit) AS w,
         y_cnt AS w_cell,
         CAST(CASE unit % 4 WHEN 1 THEN 8 WHEN 2 THEN 14 WHEN 3 THEN 20 END AS INTEGER) AS g,
         CAST(CASE unit % 5 WHEN 1 THEN 10 WHEN 2 THEN 18 END AS INTEGER) AS g2,
         CAST(coalesce(t >= CASE unit % 4 WHEN 1 THEN 8 WHEN 2 THEN 14 WHEN 3 THEN 20 END, false) AS INTEGER) AS policy,
         CAST(coalesce(t >= CASE unit % 5 WHEN 1 THEN 10 WHEN 2 THEN 18 END, false) AS INTEGER) AS policy2
  FROM p1c)"""

SQL_P2 = """
p2c AS (
  SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS t,
         CAST(count(*) AS DOUBLE) AS y_cnt,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y_val
  FROM orders GROUP BY 1, 2),
p2 AS (
  SELECT unit, t, y_cnt, y_val, sum(y_cnt) OVER (PARTITION BY unit) AS w,
         CAST(CASE unit % 4 WHEN 1 THEN 1997 WHEN 2 THEN 1998 WHEN 3 THEN 1999 END AS INTEGER) AS g
  FROM p2c),
p2gf AS (
  SELECT unit, unnest(range((SELECT min(t) FROM p2c), (SELECT max(t) FROM p2c) + 1)) AS t FROM (SELECT DISTINCT unit FROM p2c)),
p2g AS (
  SELECT f.unit, CAST(f.t AS INTEGER) AS t, c.y_cnt, c.y_val,
         sum(c.y_cnt) OVER (PARTITION BY f.unit) AS w,
         CAST(CASE f.unit % 4 WHEN 1 THEN 1997 WHEN 2 THEN 1998 WHEN 3 THEN 1999 END AS INTEGER) AS g
  FROM p2gf f LEFT JOIN p2c c ON c.unit = f.unit AND c.t = f.t)"""

SQL_P3 = """
p3c AS (
  SELECT user_id AS unit,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
         CAST(count(*) AS DOUBLE) AS y_cnt,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS y_val,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchase
  FROM events GROUP BY 1, 2),
p3a AS (
  SELECT unit, t, y_cnt, y_val,
         CAST(min(CASE WHEN purchase = 1 THEN t END) OVER (PARTITION BY unit) AS INTEGER) AS g
  FROM p3c),
p3 AS (SELECT *, CAST(coalesce(t >= g, false) AS INTEGER) AS flag FROM p3a),
p3gf AS (
  SELECT d.unit, CAST(d.t AS INTEGER) AS t, coalesce(c.y_cnt, 0.0) AS y_cnt, c.y_val,
         coalesce(c.purchase, 0) AS purchase
  FROM (SELECT unit, unnest(range((SELECT min(t) FROM p3c), (SELECT max(t) FROM p3c) + 1)) AS t FROM (SELECT DISTINCT unit FROM p3c)) d
  LEFT JOIN p3c c ON c.unit = d.unit AND c.t = d.t),
p3g AS (
  SELECT unit, t, y_cnt, y_val,
         CAST(min(CASE WHEN purchase = 1 THEN t END) OVER (PARTITION BY unit) AS INTEGER) AS g,
         CAST(coalesce(t >= min(CASE WHEN purchase = 1 THEN t END) OVER (PARTITION BY unit), false) AS INTEGER) AS flag
  FROM p3gf)"""
