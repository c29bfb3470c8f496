"""Queries: images, meshes, shards, streams, cleaned scalars and rules that the other modules have no query for."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from tessera.functions import scalars as S
from tessera.functions.scratch import cut, scratch_path
from tessera.functions.special import binomial_upper
from tessera.operators import discovery as V
from tessera.operators import mesh as H
from tessera.operators import selection as C
from tessera.plans.adapters import samples, table
from tessera.plans.audit import r6
from tessera.plans.catalog import catalog
from tessera.plans.learning import _TRIPLES, _VERTICES, _vertices
from tessera.sources import geometry, images, inventory
from tessera.streaming import incremental, state

QUERIES, SQL, query = catalog()


def png(pixels: np.ndarray, first: int = 0) -> bytes:
    """An 8-bit PNG of grey, RGB or RGBA pixels whose rows take the five filters in turn, from ``first`` on."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    x = pixels.reshape(*pixels.shape[:2], -1).astype(np.int32)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    guesses = [np.zeros_like(x), left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))]
    lines = b"".join(bytes([k]) + ((x[y] - guesses[k][y]) & 255).astype(np.uint8).tobytes() for y, k in ((y, (y + first) % 5) for y in range(len(x))))
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, {1: 0, 3: 2, 4: 6}[x.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def jpeg_head(width: int, height: int) -> bytes:
    """The markers of a grey JPEG without its picture."""
    return b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", height, width, 1) + b"\x01\x11\x00\xff\xd9"


def pixels_of(vector: list[float]) -> np.ndarray:
    """The 64 numbers of a vector as 8 x 8 grey values."""
    return np.clip(128 + 400 * np.array(vector, np.float64), 0, 255).astype(np.uint8).reshape(8, 8)


def _images(spark, sf_dir):
    """Vectors as image files: grey and RGB PNGs of all filters, every seventh a JPEG, every eleventh cut short, every thirteenth missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = batch.column("vec_id").to_pylist(), []
            for i, v in zip(ids, batch.column("embedding").to_pylist(), strict=True):
                grey = pixels_of(v)
                f = jpeg_head(8, 8) if i % 7 == 0 else png(grey if i % 2 else np.stack([grey] * 3, 2), i)
                files.append(None if i % 13 == 0 else f[:-20] if i % 11 == 0 else f)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(files, pa.binary())], ["vec_id", "label", "bytes"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInArrow(run, "vec_id bigint, label int, bytes binary")


_IMAGES = """x AS (SELECT vec_id, label, CASE WHEN vec_id % 13 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'corrupt' WHEN vec_id % 7 = 0 THEN 'unsupported' ELSE '' END AS error, CASE WHEN vec_id % 13 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 'JPEG' ELSE 'PNG' END AS format,
  vec_id % 13 <> 0 AND NOT (vec_id % 11 = 0 AND vec_id % 7 = 0) AS sized FROM embeddings)"""


@query("image_audit", "WITH " + _IMAGES + " SELECT vec_id, error <> 'missing' AS present, error = '' AS decodable, CASE WHEN sized THEN 8 ELSE 0 END AS width, CASE WHEN sized THEN 8 ELSE 0 END AS height, CASE WHEN sized THEN CASE WHEN format = 'JPEG' OR vec_id % 2 = 1 THEN 'L' ELSE 'RGB' END END AS mode, format, error FROM x")
def image_audit(spark, sf_dir):
    """Presence, decoding, format, header and error of each image."""
    return images.audit(_images(spark, sf_dir), keys=("vec_id",)).select("vec_id", "present", "decodable", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")), "mode", "format", "error")


@query("image_integrity", "WITH " + _IMAGES + " SELECT label, count(*) AS n, CAST(count(*) FILTER (error = 'missing') AS BIGINT) AS missing, CAST(count(*) FILTER (NOT sized) AS BIGINT) AS wrong_size, CAST(count(*) FILTER (error IN ('corrupt', 'unsupported')) AS BIGINT) AS unreadable, CAST(count(*) FILTER (error = '') AS BIGINT) AS compliant FROM x GROUP BY label")
def image_integrity(spark, sf_dir):
    """Images by label as the modality."""
    return images.integrity(images.audit(_images(spark, sf_dir), keys=("vec_id", "label")), "label", 8, 8)


@query("image_headers", "WITH " + _IMAGES + " SELECT CASE WHEN format = 'PNG' THEN 8 ELSE 0 END AS width, CASE WHEN format = 'PNG' THEN 8 ELSE 0 END AS height, count(*) AS n FROM x GROUP BY ALL")
def image_headers(spark, sf_dir):
    """B9 without Python: sizes of PNG files from the headers alone."""
    w, h = images.png_header("bytes")
    return _images(spark, sf_dir).groupBy(F.coalesce(w, F.lit(0)).alias("width"), F.coalesce(h, F.lit(0)).alias("height")).agg(F.count(F.lit(1)).alias("n"))


@query("image_hashes")
def image_hashes(spark, sf_dir):
    """Perceptual hashes; a test takes them again pixel by pixel."""
    return images.audit(_images(spark, sf_dir), keys=("vec_id",)).select("vec_id", "phash")


_HEX = "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN substr(md5(coalesce(text, '')), 1, 15) END AS a, substr(md5(lang), 1, 15) AS b FROM documents"


@query("hex_distance", "WITH x AS (" + _HEX + ") SELECT doc_id, CAST(coalesce(bit_count(xor(CAST('0x' || a AS BIGINT), CAST('0x' || b AS BIGINT))), 64) AS INTEGER) AS distance FROM x")
def hex_distance(spark, sf_dir):
    """Distances of fingerprints in hex digits; 64 where one is missing."""
    short = lambda c: F.substring(F.md5(F.coalesce(c, F.lit("")).cast("binary")), 1, 15)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, short("text")).alias("a"), F.when(F.col("lang").isNotNull(), short("lang")).alias("b"))
    return d.select("doc_id", S.hamming_hex("a", "b").cast("int").alias("distance"))


@query("shard_guard", "SELECT expected, expected = (SELECT count(DISTINCT l_suppkey % 7) FROM lineitem) AS complete FROM range(6, 9) AS r(expected)")
def shard_guard(spark, sf_dir):
    """A3: a source of as many shards as order lines have, guarded against three expected numbers."""
    path = scratch_path(spark, "guarded")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("shard"), "l_orderkey")
    lines.repartition("shard").write.partitionBy("shard").parquet(path)
    found = []
    for expected in range(6, 9):
        try:
            inventory.require_shards(spark.read.parquet(path), expected)
            found.append((expected, True))
        except ValueError:
            found.append((expected, False))
    return spark.createDataFrame(found, "expected bigint, complete boolean")


@query("split_gate", """WITH r AS (SELECT CASE WHEN (l_orderkey * 7 + l_linenumber) % 21 = 0 THEN 'eval' ELSE 'train' END AS split, l_suppkey % 20 AS shard FROM lineitem), c AS (SELECT split, count(*) AS rows, count(DISTINCT shard) AS shards FROM r GROUP BY split),
  m AS (SELECT *, CAST(CASE split WHEN 'eval' THEN 1000 ELSE 57000 END AS BIGINT) AS expected_rows, CAST(20 AS BIGINT) AS expected_shards FROM c)
  SELECT *, rows = expected_rows AND shards = expected_shards AS met, CASE WHEN (SELECT bool_and(rows = expected_rows AND shards = expected_shards) FROM m) THEN 'FROZEN' ELSE 'PARTIAL' END AS gate FROM m""")
def split_gate(spark, sf_dir):
    """Rows and shards of each split against what a frozen table must have."""
    split = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 21 == 0, "eval").otherwise("train")
    rows = table(spark, sf_dir, "lineitem").select(split.alias("split"), (F.col("l_suppkey") % 20).alias("shard"))
    return inventory.split_gate(rows, "split", "shard", {"train": 57_000, "eval": 1000}, {"train": 20, "eval": 20})


@query("file_fingerprints")
def file_fingerprints(spark, sf_dir):
    """Merkle roots of the files of a table, and of the table; a test takes them again with hashlib."""
    files = inventory.file_fingerprints(spark, f"{sf_dir}/orders.parquet*", 1 << 16)
    whole = inventory.dataset_fingerprint(files).select(F.lit("ALL").alias("file"), "bytes", "root")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "root").unionByName(whole)


@query("located_rows", "SELECT count(*) AS n, count(*) AS rows, CAST(0 AS BIGINT) AS least FROM orders")
def located_rows(spark, sf_dir):
    """A4: every row has a locator of its own, counted from 0 in its file."""
    at = inventory.with_locator(table(spark, sf_dir, "orders"))
    return at.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_shard_id", "source_row_id").alias("rows"), F.min("source_row_id").alias("least"))


@query("schema_contract", """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS rank FROM orders)
  SELECT 'o_orderkey' AS "column", 'ok' AS state, CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS bad FROM o
  UNION ALL SELECT 'rank', 'string, not int', CAST(count(*) FILTER (rank IS NULL) AS BIGINT), CAST(count(*) FILTER (rank IS NOT NULL AND try_cast(rank AS INTEGER) IS NULL) AS BIGINT) FROM o
  UNION ALL SELECT 'o_comment', 'missing', count(*), 0 FROM o UNION ALL SELECT 'o_totalprice', 'double, not string', CAST(count(*) FILTER (o_totalprice IS NULL) AS BIGINT), 0 FROM o
  UNION ALL SELECT 'o_custkey', 'extra', CAST(count(*) FILTER (o_custkey IS NULL) AS BIGINT), 0 FROM o""")
def schema_contract(spark, sf_dir):
    """The orders against a contract that they break in every way, with the rows that are affected."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("rank"))
    wanted = Y.StructType([Y.StructField("o_orderkey", o.schema["o_orderkey"].dataType), Y.StructField("rank", Y.IntegerType()), Y.StructField("o_comment", Y.StringType()), Y.StructField("o_totalprice", Y.StringType())])
    return inventory.contract_report(o, wanted)


@query("jsonable", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '{}' ELSE '{\"ratio\":' || CAST(l_tax / l_discount AS VARCHAR) || '}' END <> '{}' AS has_ratio FROM lineitem")
def jsonable(spark, sf_dir):
    """Numbers that are not one become null before they are written as JSON."""
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    text = F.to_json(F.struct(S.null_nan(ratio).alias("ratio")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (text != "{}").alias("has_ratio"))


_MESH = "WITH " + _VERTICES + """, m AS (SELECT vec_id, x, y, z, CASE WHEN greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, max(z) OVER w - min(z) OVER w) < 10 THEN 100.0 ELSE 1.0 END AS s FROM v WINDOW w AS (PARTITION BY vec_id)),
  c AS (SELECT vec_id, x * s AS x, y * s AS y, z * s AS z FROM m), r AS (SELECT vec_id, x, y, abs(x) > 0.7 * max(abs(x)) OVER w AS side, coalesce((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 0) AS h FROM c WINDOW w AS (PARTITION BY vec_id))"""


@query("mesh_regions", _MESH + " SELECT vec_id, CASE WHEN side THEN 'sleeve' WHEN h >= 0.6 THEN 'chest' WHEN h >= 0.3 THEN 'waist' ELSE 'hem' END AS region, count(*) AS n, round(avg(x), 5) AS x FROM r GROUP BY ALL")
def mesh_regions(spark, sf_dir):
    """A vector's vertices in one unit, and their regions."""
    v = H.regions(H.align_units(_vertices(spark, sf_dir).withColumnRenamed("vec_id", "mesh_id")))
    return v.groupBy(F.col("mesh_id").alias("vec_id"), "region").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("x"))


@query("mesh_files", "SELECT label AS mesh, CAST(count(*) * " + str(len(_TRIPLES)) + " AS BIGINT) AS vertices FROM embeddings GROUP BY label")
def mesh_files(spark, sf_dir):
    """Vertices written as mesh text, one folder a label, read again line by line."""
    path = scratch_path(spark, "meshes")
    lines = _vertices(spark, sf_dir).select("label", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    lines.write.partitionBy("label").text(path)
    read = spark.read.text(path)
    found = geometry.vertices(read.select(F.col("label").alias("mesh_id"), F.monotonically_increasing_id().alias("n"), "value"))
    return found.groupBy(F.col("mesh_id").alias("mesh")).agg(F.count(F.lit(1)).alias("vertices"))


@query("chest_utility", "SELECT p_partkey, round(-abs(p_size - 20.0) - 0.5 * abs(p_retailprice / 1000) - 0.05 * abs(p_size - 25.0), 6) AS utility FROM part")
def chest_utility(spark, sf_dir):
    """C13."""
    u = S.utility(F.col("p_size") - 20.0, F.col("p_retailprice") / 1000, F.col("p_size") - 25.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(u, 6).alias("utility"))


_UNITS = {"same_person_same_cloth": ["person", "cloth"], "same_person": ["person"], "same_cloth": ["cloth"], "same_target": ["target"]}


@query("unit_tiers", "WITH s AS (SELECT l_orderkey AS person, l_partkey AS cloth, l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey), g AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS unit, {i} AS place, count(*) AS groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS c FROM s GROUP BY {', '.join(k)} HAVING count(*) > 1)" for i, (n, k) in enumerate(_UNITS.items())) + ") SELECT unit, groups, rows, place = (SELECT min(place) FROM g WHERE groups > 0) AS strongest FROM g")
def unit_tiers(spark, sf_dir):
    """Groups and rows of each unit of comparison, and the strongest one that the data has."""
    return V.unit_tiers(cut(samples(spark, sf_dir).select("person", "cloth", "target")), _UNITS)


@query("finalize_when_complete", "SELECT 'partial' AS call, count(DISTINCT l_suppkey % 20) FILTER (l_suppkey % 20 < 12) AS shards, count(DISTINCT l_suppkey % 20) FILTER (l_suppkey % 20 < 12) = 20 AS ready FROM lineitem UNION ALL SELECT 'whole', count(DISTINCT l_suppkey % 20), count(DISTINCT l_suppkey % 20) = 20 FROM lineitem")
def finalize_when_complete(spark, sf_dir):
    """Annotations over all keys wait until every expected shard has been written."""
    written = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("source_shard_id"))
    calls = [("partial", written.filter("source_shard_id < 12")), ("whole", written)]
    return spark.createDataFrame([(call, incremental.shards_done(part).count(), incremental.ready(part, 20)) for call, part in calls], "call string, shards bigint, ready boolean")


@query("shard_outputs", """SELECT 'shard-' || (l_suppkey % 20) AS source_shard_id, count(*) AS rows, 1 AS files, 'COMMITTED' AS state, CAST(sum(l_quantity) AS DOUBLE) AS quantity, (SELECT count(*) FROM (VALUES ('limit'), ('exhausted'), ('exhausted'))) AS calls, 'exhausted,limit' AS reasons FROM lineitem GROUP BY 1""")
def shard_outputs(spark, sf_dir):
    """Order lines in shards, ingested in three calls - stopped by its limit, resumed, with nothing left - one file per shard."""
    base = scratch_path(spark, "shards")
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("shard-"), F.col("l_suppkey") % 20).alias("shard"), "l_orderkey", "l_quantity")
    lines.repartition("shard").write.partitionBy("shard").parquet(f"{base}/source")
    schema = lines.drop("shard").schema
    named = F.regexp_extract("_metadata.file_path", r"shard=([^/]+)/", 1)
    for most in (1, None, None):
        incremental.ingest_shards(spark, f"{base}/source/shard=*", schema, lambda s: s, f"{base}/sink", f"{base}/checkpoint", shard=named, files_per_batch=8, most_batches=most)
    found = spark.read.parquet(f"{base}/sink")
    files = found.groupBy("source_shard_id").agg(F.count_distinct("_metadata.file_path").cast("int").alias("files"), F.sum("l_quantity").alias("quantity"))
    calls = incremental.calls(spark, f"{base}/sink").agg(F.count(F.lit(1)).alias("calls"), F.array_join(F.array_sort(F.collect_set("stop_reason")), ",").alias("reasons"))
    return incremental.ledger(spark, f"{base}/sink").select("source_shard_id", "rows", "state").join(files, "source_shard_id").join(F.broadcast(calls))


@query("seen_users", """WITH b AS (SELECT CAST(user_id AS BIGINT) AS user_id, event_id % 3 AS run, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
  SELECT CAST(run AS INTEGER) AS run, user_id, n, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS before, coalesce(sum(n) OVER w, 0) > 0 AS seen FROM b WINDOW w AS (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def seen_users(spark, sf_dir):
    """Events as a feed that comes in three parts, the stream started anew for each; whether earlier batches had the user."""
    base = scratch_path(spark, "seen")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_id")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.parquet(f"{base}/feed/part={part}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/feed/part=*")
        state.seen_counts(stream, "user_id", f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")


_LADDER = "t AS (SELECT a.l_orderkey, count(*) AS pairs, min(sign(b.l_quantity - a.l_quantity)) = 1 AS exact FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey)"


@query("ladder_tests", "WITH " + _LADDER + """, g AS (SELECT o_orderpriority AS family, count(*) AS n, CAST(count(*) FILTER (exact) AS BIGINT) AS hits FROM t JOIN orders ON l_orderkey = o_orderkey WHERE pairs = 3 GROUP BY 1),
  k AS (SELECT *, unnest(range(hits, n + 1)) AS k FROM g), p AS (SELECT family, n, hits, least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(1 / 6.0) + (n - k) * ln(5 / 6.0)))) AS p FROM k GROUP BY ALL),
  h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, family) + 1)) AS a FROM p) SELECT family, n, hits, round(p, 6) AS p, round(max(a) OVER (ORDER BY p, family ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM h""")
def ladder_tests(spark, sf_dir):
    """Per family, how often ladders of three levels are in exact order, its binomial tail and Holm's correction."""
    k = C.kendall(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity").filter("pairs = 3")
    g = k.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact").cast("long")).alias("hits"))
    p = g.withColumn("p", binomial_upper(F.col("hits"), F.col("n"), 1 / 6))
    return C.holm(cut(p), "p", "family").select("family", "n", "hits", *r6("p", "adjusted"))
