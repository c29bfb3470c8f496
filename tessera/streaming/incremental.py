"""Incremental ingest: a file stream with a checkpoint, and one committed output per shard with a ledger beside it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.inventory import with_locator

#: Ledger of committed shards, and of the calls that committed them.
LEDGER = "source_shard_id string, rows bigint, state string, batch bigint"
CALLS = "call string, began double, ended double, shards bigint, stop_reason string"


def ingest(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 64) -> DataFrame:
    """Process the files that are new since the last call, each once, and return all that has been written.

    Stopping and calling again goes on where the checkpoint stands; a call without new files adds nothing.
    """
    stream = with_locator(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    writer = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(sink)


def shards_done(written: DataFrame) -> DataFrame:
    return written.select("source_shard_id").distinct()


def ready(written: DataFrame, expected: int) -> bool:
    """Whether every expected shard is there, so that the global annotations may run as a batch."""
    return shards_done(written).count() == expected


def pending(shards: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batch form of resuming: shards that the ledger does not have."""
    return shards.join(ledger.select("source_shard_id").distinct(), "source_shard_id", "left_anti")


def merge_ledgers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("source_shard_id").union(b.select("source_shard_id")).distinct()


class _Stopped(Exception):
    """Raised inside a batch that is left for the next call."""


def ingest_shards(
    spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
    shard: Column | None = None, files_per_batch: int = 64, most_batches: int | None = None, stop: Callable[[], str | None] = lambda: None,
) -> str:
    """Write one file per source shard to ``sink``, go on where the last call stopped, and return why this one stopped.

    A batch is staged beside the sink and its shards are moved into place one by one, then noted in the ledger; a batch
    that broke off is done again and replaces what it had moved, so that every shard has exactly one file, whole, under
    ``sink/source_shard_id=<shard>``.  ``shard`` names a row's shard, else its file does; the files of a shard must not
    be spread over batches.  A shard's rows lie in one task, in the order of their file: it is what one file may hold.

    Reasons: ``exhausted`` (nothing is left), ``limit`` (``most_batches`` were done), what ``stop`` returned, which is
    asked before each batch, or ``failed: ...``, after which the error is raised.  Ledger and reasons are in ``ledger``
    and ``calls``; the driver moves at most ``files_per_batch`` files a batch.
    """
    from tessera.functions.scratch import hadoop_fs

    stream = with_locator(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    if shard is not None:
        stream = stream.withColumn("source_shard_id", shard.cast("string"))
    rows = transform(stream.withColumn("_file", F.col("_metadata.file_path")))
    fs, at = hadoop_fs(spark, sink)
    began, done, reason = time.time(), [0, 0], [""]

    def batch(part: DataFrame, number: int) -> None:
        why = "limit" if most_batches is not None and done[0] >= most_batches else stop()
        if why:
            reason[0] = why
            raise _Stopped(why)
        session = part.sparkSession
        staged = f"{sink}/_staged/{number}-{uuid.uuid4().hex}"
        ordered = part.repartition("source_shard_id").sortWithinPartitions("source_shard_id", "_file", "source_row_id").drop("_file")
        ordered.write.partitionBy("source_shard_id").parquet(staged)
        moved = []
        for place in fs.globStatus(at(f"{staged}/source_shard_id=*")) or ():
            final = at(f"{sink}/{place.getPath().getName()}")
            fs.delete(final, True)
            if not fs.rename(place.getPath(), final):
                raise OSError(f"{final} could not be put into place")
            moved.append(final.toString())
        # Counted where the shards now lie: what the ledger says is what a reader finds.
        counts = session.read.schema(ordered.schema).option("basePath", sink).parquet(*moved).groupBy("source_shard_id").agg(F.count(F.lit(1)).alias("rows")) if moved else session.createDataFrame([], "source_shard_id string, rows bigint")
        counts.withColumns({"state": F.lit("COMMITTED"), "batch": F.lit(number).cast("long")}).write.mode("overwrite").parquet(f"{sink}/_ledger/batch_{number}")
        fs.delete(at(staged), True)
        done[0] += 1
        done[1] += len(moved)

    def note() -> None:
        spark.createDataFrame([(uuid.uuid4().hex, began, time.time(), done[1], reason[0])], CALLS).coalesce(1).write.mode("append").parquet(f"{sink}/_calls")

    try:
        rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        reason[0] = reason[0] or "exhausted"
    except StreamingQueryException as e:
        if not reason[0]:
            reason[0] = f"failed: {str(e).splitlines()[0][:200]}"
            note()
            raise
    note()
    return reason[0]


def ledger(spark: SparkSession, sink: str) -> DataFrame:
    """Committed shards with their rows, state and batch."""
    return spark.read.schema(LEDGER).option("pathGlobFilter", "*.parquet").parquet(f"{sink}/_ledger/*")


def calls(spark: SparkSession, sink: str) -> DataFrame:
    """One row per call of ``ingest_shards``: when, how many shards, why it stopped."""
    return spark.read.schema(CALLS).parquet(f"{sink}/_calls")
