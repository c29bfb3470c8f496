"""Helpers that several of the text operators share: tables in the shared scratch folder, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scratch import checkpoint_dir

#: Text bytes that one pass of a vectorised kernel works on.
SLICE_BYTES = 4 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut and a lost executor costs nothing.

    The table goes with ``release``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            spark = table.sparkSession
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``max_bytes``; a longer row comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def utf8_rows(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty, without decoding them."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
