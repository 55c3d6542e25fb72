"""Loading, profiling, stage persistence and report sinks."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panelkit.session import checkpoint_dir

_POINTER = "_current"
_ABANDONED_S = 7 * 24 * 3600


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet); columns and filters are pruned/pushed by Catalyst."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_panel(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str = "parquet", **options) -> DataFrame:
    """Load a long unit-by-period table with a fixed schema (no inference)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def stage_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """Shared location for stage hand-offs, the same in every session.

    ``root``, else the setting ``spark.panelkit.stage.dir``, else ``stages`` in the
    folder that ``spark.checkpoint.dir`` names; in local mode without either, the
    session's own checkpoint folder."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.panelkit.stage.dir", None) or (f"{shared.rstrip('/')}/stages" if shared else None)
    return os.path.join(root or os.path.join(checkpoint_dir(spark), "stages"), name)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path class, and the file system that ``path`` lies on."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder on whatever file system it lies; False if there was none."""
    of, fs = _file_system(spark, path)
    return fs.delete(of(path), True)


def stage_versions(spark: SparkSession, name: str, root: str | None = None) -> list[str]:
    """Published versions of a stage, the current one first; empty without a stage."""
    path = stage_path(spark, name, root)
    of, fs = _file_system(spark, path)
    pointer = of(f"{path}/{_POINTER}")
    if not fs.exists(pointer):
        return []
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, versions: list[str]) -> None:
    """Point the stage at the first of ``versions`` by one rename over the old pointer."""
    of, fs = _file_system(spark, path)
    fresh = of(f"{path}/{_POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(fresh)
    try:
        stream.write(bytearray("\n".join(versions).encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(of(f"{path}/{_POINTER}")), how)


def save_stage(df: DataFrame, name: str, root: str | None = None,
               partition_by: list[str] | None = None, keep: int = 1) -> str:
    """Persist a prepared table as parquet in the shared stage folder.

    A save is a version of its own, published by a pointer file once it is written
    whole: readers see the old version until then, and after a failed save as well.
    ``keep`` older versions stay for readers that have begun; a version that no save
    published (a failed or still running one) goes once it is ``_ABANDONED_S`` old.
    Of two saves at once, the last to publish is current."""
    spark = df.sparkSession
    path = stage_path(spark, name, root)
    version = f"v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/{version}")
    versions = [version, *stage_versions(spark, name, root)]
    _publish(spark, path, versions[:keep + 1])
    of, fs = _file_system(spark, path)
    for status in fs.listStatus(of(path)):
        found, age = status.getPath().getName(), time.time() - status.getModificationTime() / 1000
        if found in versions[keep + 1:] or (found.startswith("v-") and found not in versions and age > _ABANDONED_S):
            fs.delete(status.getPath(), True)
    return f"{path}/{version}"


def drop_stage(spark: SparkSession, name: str, root: str | None = None) -> bool:
    """Delete a stage with all its versions; False if there was none."""
    return remove_folder(spark, stage_path(spark, name, root))


def load_stage(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """The current version of a stage."""
    versions = stage_versions(spark, name, root)
    if not versions:
        raise FileNotFoundError(f"no stage {name} in {stage_path(spark, name, root)}")
    return spark.read.parquet(f"{stage_path(spark, name, root)}/{versions[0]}")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Header CSV / TSV sink, a file for each partition of the report."""
    (df.write.mode("overwrite")
       .option("header", True).option("sep", sep).option("nullValue", "NA").csv(path))
    return path


def write_tsv(df: DataFrame, path: str) -> str:
    return write_csv(df, path, sep="\t")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    return (spark.read.option("header", True).option("sep", sep).option("nullValue", "NA")
                 .schema(schema).csv(path))
