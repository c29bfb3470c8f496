"""One output per shard, and states of keys, over stops, failures and restarts."""

from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.streaming import incremental, state

SCHEMA = "id bigint, v bigint"


def shards(spark, path, names, rows=50):
    for k in names:
        spark.range(k * rows, (k + 1) * rows).select("id", (F.col("id") * 2).alias("v")).repartition(2, "id").write.parquet(f"{path}/shard={k}")


def found(spark, sink):
    out = spark.read.parquet(sink)
    per = out.groupBy("source_shard_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_metadata.file_path").alias("files"), F.sum("v").alias("v")).collect()
    return {str(r.source_shard_id): (r.n, r.files, r.v) for r in per}


@pytest.fixture
def places(tmp_path):
    return {x: str(tmp_path / x) for x in ("source", "sink", "cp")}


def call(spark, p, transform=lambda s: s, **more):
    shard = F.regexp_extract("_metadata.file_path", r"shard=([^/]+)/", 1)
    return incremental.ingest_shards(spark, f"{p['source']}/shard=*", spark.createDataFrame([], SCHEMA).schema, transform, p["sink"], p["cp"], shard=shard, files_per_batch=4, **more)


def test_stops_failures_and_restarts(spark, places):
    shards(spark, places["source"], range(5))
    want = {str(k): (50, 1, sum(2 * i for i in range(k * 50, k * 50 + 50))) for k in range(7)}
    assert call(spark, places, most_batches=1) == "limit"
    assert set(found(spark, places["sink"])) < set(want)
    # The second call breaks off after its batch has moved some shards into place.
    tries = []
    real = incremental.F.count

    def breaks(x):
        tries.append(1)
        raise RuntimeError("killed")

    incremental.F.count = breaks
    try:
        with pytest.raises(StreamingQueryException):
            call(spark, places)
    finally:
        incremental.F.count = real
    assert tries and incremental.ledger(spark, places["sink"]).count() < len(found(spark, places["sink"])) <= 5
    asked = iter([None, "requested"])
    assert call(spark, places, stop=lambda: next(asked, "requested")) == "requested"
    assert call(spark, places) == "exhausted" == call(spark, places)
    assert found(spark, places["sink"]) == {k: want[k] for k in "01234"}
    shards(spark, places["source"], [5, 6])
    assert call(spark, places) == "exhausted" and found(spark, places["sink"]) == want
    noted = incremental.ledger(spark, places["sink"]).collect()
    assert sorted((r.source_shard_id, r.rows, r.state) for r in noted) == [(str(k), 50, "COMMITTED") for k in range(7)]
    reasons = [r.stop_reason.split(":")[0] for r in incremental.calls(spark, places["sink"]).orderBy("began").collect()]
    assert reasons == ["limit", "failed", "requested", "exhausted", "exhausted", "exhausted"]
    assert sum(r.shards for r in incremental.calls(spark, places["sink"]).collect()) == 7


def test_rows_keep_the_order_of_their_files(spark, places):
    spark.range(1000).select("id", (-F.col("id")).alias("v")).coalesce(1).write.parquet(f"{places['source']}/shard=a")
    call(spark, places)
    assert [r.id for r in spark.read.parquet(places["sink"]).coalesce(1).collect()] == list(range(1000))


def feed(spark, path, n, rows):
    spark.createDataFrame(rows, "u string, t string, n int").select("u", F.to_timestamp("t").alias("t"), "n").repartition(2).write.parquet(f"{path}/b{n}")


def seen(spark, places, **more):
    stream = spark.readStream.schema("u string, t timestamp, n int").parquet(f"{places['source']}/*")
    state.seen_counts(stream, "u", places["sink"], places["cp"], **more)
    return sorted((r.run, r.u, r.n, r.before, r.seen) for r in spark.read.parquet(places["sink"]).collect())


def test_seen_keys_over_restarts(spark, places):
    at = "2024-01-01 00:00:00"
    feed(spark, places["source"], 0, [("a", at, 1)] * 500 + [("b", at, 1), (None, at, 1), ("é", None, 1)])
    assert seen(spark, places) == [(0, "a", 500, 0, False), (0, "b", 1, 0, False), (0, "é", 1, 0, False)]
    assert len(seen(spark, places)) == 3
    feed(spark, places["source"], 1, [("b", at, 1), ("c", at, 1)])
    seen(spark, places)
    feed(spark, places["source"], 2, [("a", at, 1), ("b", at, 1), ("b", at, 1), ("c", at, 1)])
    assert seen(spark, places)[3:] == [(1, "b", 1, 1, True), (1, "c", 1, 0, False), (2, "a", 1, 500, True), (2, "b", 2, 2, True), (2, "c", 1, 1, True)]


def test_keys_are_forgotten_by_event_time(spark, places):
    more = {"event_time": "t", "keep": timedelta(minutes=10), "lateness": "5 minutes"}
    feed(spark, places["source"], 0, [("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:30", 1)])
    seen(spark, places, **more)
    feed(spark, places["source"], 1, [("b", "2024-01-01 00:08:00", 1), ("c", "2024-01-01 00:16:00", 1)])
    seen(spark, places, **more)  # the watermark is now 00:11: a is forgotten, b was seen at 00:08
    feed(spark, places["source"], 2, [("a", "2024-01-01 00:16:00", 1), ("b", "2024-01-01 00:16:00", 1)])
    assert [r[1:] for r in seen(spark, places, **more)] == [("a", 1, 0, False), ("b", 1, 0, False), ("b", 1, 1, True), ("c", 1, 0, False), ("a", 1, 0, False), ("b", 1, 2, True)]
    with pytest.raises(ValueError):
        seen(spark, places, keep=timedelta(minutes=1))
