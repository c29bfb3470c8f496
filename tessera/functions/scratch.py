"""The shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only in one local process, where it may be unset, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


#: With this setting Spark deletes the shuffle files of a statement when the statement ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder as compressed columns and read again.

    The shuffle files that made it go at once, so what is left of a stage is its table.  That goes with ``release``, or
    else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            fs, at = hadoop_fs(table.sparkSession, path)
            fs.delete(at(path), True)


def hadoop_fs(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at
