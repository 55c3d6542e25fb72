"""Goodman-Bacon decomposition of the static TWFE estimate (balanced panel).

Every 2x2 comparison only needs cohort x period means of the outcome, so the
panel is reduced once by ``groupBy(cohort, period)`` (partial aggregation,
#cohorts x T rows).  Pairs are rows: every treated cohort is laid against all
periods and joined to the cohorts that begin there; closed-form weights are
columns, and 2x2 estimates come from running sums at the ends of a pair's window.
Five scalars reach the driver, whatever the number of cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.scalar import is_timing_type
from panelkit.operators.panel import over_unit
from panelkit.session import checkpoint_dir

BACON_SCHEMA = "treated int, control int, type string, estimate double, weight double"


def balanced_subset(df: DataFrame, u: str, t: str, y: str | None = None, min_units: int = 3) -> DataFrame:
    """Keep units observed (with non-missing y) in every period from the
    panel's min to max period; fewer than ``min_units`` units -> empty."""
    d = df if y is None else df.filter(F.col(y).isNotNull())
    span = d.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if span["lo"] is None:
        return d.limit(0)
    n_periods = span["hi"] - span["lo"] + 1
    b = d.withColumn("_n", F.count(F.lit(1)).over(over_unit(u))).filter(F.col("_n") == n_periods).drop("_n")
    if b.select(u).distinct().count() < min_units:
        return b.limit(0)
    return b


def bacon(df: DataFrame, y: str, d: str, u: str, t: str) -> DataFrame:
    """Every 2x2 comparison (treated cohort, control cohort, type, estimate, weight).

    Treatment ``d`` is a 0/1 absorbing indicator; a unit's cohort is its first
    treated period.  Units treated from the first period are the 'Always
    Treated' group (control only); control NULL = never treated.  Weights are
    the closed forms of the decomposition, normalised to sum to one.  A panel
    without rows gives none."""
    spark = df.sparkSession
    p = df.select(u, t, y, d).filter(F.col(y).isNotNull())
    p = p.withColumn("_g", F.min(F.when(F.col(d) == 1, F.col(t))).over(over_unit(u)))
    # a row is a (unit, period); the second window keeps the unit's exchange and tells if one repeats
    p = p.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(u, t)))
    cm = p.groupBy("_g", t).agg(F.avg(y).alias("ybar"), F.count(F.lit(1)).alias("n_u"), F.max("_same").alias("_same"))
    checkpoint_dir(spark)
    cm = cm.checkpoint()
    cohorts = cm.groupBy("_g").agg(F.max("n_u").alias("n_u"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.max("_same").alias("same"))
    span = cohorts.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_u").alias("n"), F.max("same").alias("same")).first()
    if span["n"] is None:
        return spark.createDataFrame([], BACON_SCHEMA)
    if span["same"] > 1:
        raise ValueError(f"({u}, {t}) isn't a key")
    t_lo, t_hi = span["lo"], span["hi"]
    # controls are keyed by their first period; the never-treated by one after the last
    key = lambda g: F.coalesce(g, F.lit(t_hi + 1)).cast("int")
    share = F.col("n_u") / F.lit(span["n"])
    first = F.col("_g").cast("int")
    treated = cohorts.where(first > t_lo).select(first.alias("treated"), share.alias("n_tr"), F.explode(F.sequence(F.lit(t_lo).cast("int"), F.lit(t_hi + 1).cast("int"))).alias("key"))
    others = cohorts.select(key(F.col("_g")).alias("key"), first.alias("control"), share.alias("n_co"))
    pairs = treated.join(others, "key").where("control is null or control <> treated")
    # shares of treated periods: the pair's earlier cohort e and later one l; never-treated units count as l with none
    never, always = F.col("control").isNull(), F.col("control") == t_lo
    treated_share = lambda g: (F.lit(t_hi + 1) - g) / F.lit(t_hi - t_lo + 1)
    D = treated_share(F.col("treated"))
    e, l = treated_share(F.least("treated", "control")), treated_share(F.greatest("treated", "control"))
    both = F.col("n_tr") + F.col("n_co")
    split = F.col("n_tr") / both * (F.col("n_co") / both)
    earlier = F.col("treated") < F.col("control")
    raw = (F.when(never | always, both * both * split * D * (1 - D))
           .when(earlier, (both * (1 - l)) * (both * (1 - l)) * split * ((e - l) / (1 - l)) * ((1 - e) / (1 - l)))
           .otherwise((both * e) * (both * e) * split * (l / e) * ((e - l) / e)))
    kind = (F.when(never, "Treated vs Untreated").when(always, "Later vs Always Treated").when(earlier, "Earlier vs Later Treated")
            .otherwise("Later vs Earlier Treated"))
    first_of = F.when(never | always | earlier, t_lo).otherwise(F.col("control"))
    last_of = F.when(~never & earlier & ~always, F.col("control") - 1).otherwise(t_hi)
    pairs = pairs.select("treated", "control", kind.alias("type"), first_of.alias("w_lo"), last_of.alias("w_hi"), F.col("treated").alias("post_from"), raw.alias("raw"))
    total = pairs.agg(F.sum("raw")).first()[0]
    pdf = pairs.withColumn("weight", F.col("raw") / F.lit(total))
    # 2x2 estimate: (post - pre) mean of the treated cohort minus that of the control over the
    # pair's window, from the cohorts' running sums at the window's ends and before the post period
    upto = cm.select(F.col("_g"), F.col(t).alias("_t"), F.sum("ybar").over(Window.partitionBy("_g").orderBy(t)).alias("s"))
    n_pre, n_post = F.col("post_from") - F.col("w_lo"), F.col("w_hi") - F.col("post_from") + 1
    cut = lambda at, c: F.struct(at.cast("int").alias("_t"), c.alias("c"))
    cuts = F.array(cut(F.col("w_hi"), 1 / n_post), cut(F.col("post_from") - 1, -1 / n_post - 1 / n_pre), cut(F.col("w_lo") - 1, 1 / n_pre))
    rows = pdf.select("treated", "control", "type", "weight", F.inline(cuts))
    tr = upto.select(F.col("_g").alias("treated"), "_t", F.col("s").alias("s_tr"))
    co = upto.select(F.col("_g").alias("_co"), F.col("_t").alias("_tc"), F.col("s").alias("s_co"))
    j = rows.join(tr, ["treated", "_t"], "left").join(co, F.col("control").eqNullSafe(F.col("_co")) & (F.col("_t") == F.col("_tc")), "left")
    zero = F.lit(0.0)  # before the first period nothing has been summed up
    est = j.groupBy("treated", "control", "type", "weight").agg(
        F.sum(F.col("c") * (F.coalesce("s_tr", zero) - F.coalesce("s_co", zero))).alias("estimate"))
    return est.select("treated", "control", "type", "estimate", "weight")


def bacon_balanced(df: DataFrame, y: str, d: str, u: str, t: str, min_units: int = 3) -> DataFrame:
    """D1 + D2: the decomposition needs a strongly balanced panel; when the panel is
    not balanced, fall back to the units observed in every period (at least
    ``min_units`` of them), else return an empty, typed result."""
    spark = df.sparkSession
    p = df.filter(F.col(y).isNotNull())
    chk = p.groupBy(u).agg(F.count(F.lit(1)).alias("n")) \
           .agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    span = p.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    if chk["lo"] is None:
        return spark.createDataFrame([], BACON_SCHEMA)
    full = span["b"] - span["a"] + 1
    if not (chk["lo"] == chk["hi"] == full):
        p = balanced_subset(p, u, t, y, min_units=min_units)
        if p.limit(1).count() == 0:
            return spark.createDataFrame([], BACON_SCHEMA)
    return bacon(p, y, d, u, t)


def bacon_total(pairs: DataFrame) -> DataFrame:
    """D3: decomposition total (= the static TWFE coefficient) and pair count."""
    return pairs.agg(F.sum(F.col("estimate") * F.col("weight")).alias("total"),
                     F.count(F.lit(1)).alias("n_pairs"), F.sum("weight").alias("weight_sum"))


def bacon_by_type(pairs: DataFrame) -> DataFrame:
    """N, weight sum and weighted mean estimate per comparison type."""
    return pairs.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight_sum"),
                                     (F.sum(F.col("weight") * F.col("estimate")) / F.sum("weight")).alias("avg_estimate"))


def timing_weight(pairs: DataFrame) -> DataFrame:
    """Weight on comparisons whose type mentions Later/Earlier (as reported,
    this also counts the clean 'Earlier vs Later' pairs) and the weight on the
    forbidden ones only (already-treated units as controls)."""
    forbidden = F.col("type").isin("Later vs Earlier Treated", "Later vs Always Treated")
    return pairs.agg(F.coalesce(F.sum(F.when(is_timing_type(F.col("type")), F.col("weight"))), F.lit(0.0)).alias("timing_weight"),
                     F.coalesce(F.sum(F.when(forbidden, F.col("weight"))), F.lit(0.0)).alias("forbidden_weight"))
