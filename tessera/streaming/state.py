"""Keys seen in a live feed: one small state per key in a RocksDB store, instead of a ledger that every batch reads.

A micro-batch touches the states of its own keys only, however many were seen before.  Before the state, each task adds
up the rows of a key that it reads, so a key with a third of a batch sends one row per task and Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTED = "key {key}, n bigint, at timestamp"


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by("key").aggregate([([], "count_all"), ("at", "max")])
            yield from found.rename_columns(["key", "n", "at"]).select(["key", "n", "at"]).combine_chunks().to_batches()


class SeenKeys(StatefulProcessor):
    """Per key the number of rows of earlier batches; with ``keep_ms``, forgotten once that much event time has gone by."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", T.StructType([T.StructField("n", T.LongType()), T.StructField("due", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, latest = 0, 0
        for part in rows:
            n += int(part["n"].sum())
            if self.keep_ms is not None:
                latest = max(latest, int(part["at"].max().value // 1_000_000))
        before, due = self.known.get() or (0, 0)
        if self.keep_ms is not None and latest + self.keep_ms > due:
            if due:
                self.handle.deleteTimer(due)
            due = latest + self.keep_ms
            self.handle.registerTimer(due)
        self.known.update((before + n, due))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "before": [before]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def seen_counts(stream: DataFrame, key: str, sink: str, checkpoint: str, event_time: str | None = None, keep: timedelta | None = None, lateness: str = "0 seconds") -> None:
    """Process what is new in ``stream``; per batch and non-null key one row (key, n, before, seen) goes to ``sink``.

    ``n`` counts the key's rows of this batch, ``before`` those of earlier ones, and ``seen`` says that there were any.
    A batch writes under its number, so one that is run again after a failure replaces its own rows; its states come from
    the checkpoint.  With ``keep`` a key is forgotten when the watermark of ``event_time`` has
    passed its last row by so much, and rows that are ``lateness`` behind are dropped by Spark; without, none is ever
    dropped or forgotten, and the store grows with the number of distinct keys.
    """
    spark = stream.sparkSession
    if keep is not None and event_time is None:
        raise ValueError("keys can be forgotten by event time only")
    at = F.col(event_time).cast("timestamp") if event_time else F.lit(None).cast("timestamp")
    dtype = stream.schema[key].dataType.simpleString()
    counted = stream.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), at.alias("at")).mapInArrow(_added_up, _COUNTED.format(key=dtype))
    keep_ms = None
    if keep is not None:
        counted = counted.filter("at IS NOT NULL").withWatermark("at", lateness)
        keep_ms = keep // timedelta(milliseconds=1)
    states = counted.groupBy("key").transformWithStateInPandas(SeenKeys(keep_ms), f"key {dtype}, n bigint, before bigint", "Append", "EventTime" if keep is not None else "None")

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumnRenamed("key", key).withColumn("seen", F.col("before") > 0).write.mode("overwrite").parquet(f"{sink}/run={number}")

    provider = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, provider) if provider else spark.conf.unset(_PROVIDER)
