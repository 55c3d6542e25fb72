"""Helpers shared by the operators: tables, lineage cuts and defaults for nulls."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import checkpoint_dir

_ROOT = Path(__file__).resolve().parents[2]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 16 << 20


def ready(spark: SparkSession) -> None:
    """Code on the executors, and Arrow batches that a worker holds easily.

    Texts differ a thousandfold in length, so rows are no measure of a batch; a
    smaller bound in bytes than the default is set unless the session has its own."""
    ship_code(spark)
    if spark.conf.get(_BATCH) in ("67108864b", "64MB"):  # the default, as a session shows it
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors when they could not import it otherwise.

    Nothing is sent when it is installed, on PYTHONPATH or in the working folder."""
    known = [*site.getsitepackages(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sc = spark.sparkContext
    if any(Path(p).resolve() == _ROOT for p in known if p) or getattr(sc, "_panelkit_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="panelkit-code-"), "panelkit")
    sc.addPyFile(shutil.make_archive(base, "zip", _ROOT, "panelkit"))
    sc._panelkit_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files."""
    ready(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return _plain_estimate(df.checkpoint(eager=True))


def _plain_estimate(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` whose size is unknown to the planner where its estimate is more than a long holds.

    Spark takes the estimate over from the plan before, and a join's is the product of its sides': in a loop of joins
    the number has several times the digits each round, until it alone fills the driver.  Partitioning, order and
    constraints stay, as do estimates that a long holds."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < 1 << 63:
        return df
    spark = df.sparkSession
    session, jvm = spark._jsparkSession, spark.sparkContext._jvm
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
                     session, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)


def text_of(name: str = "text") -> Column:
    """A text column as string; null becomes the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
