"""Queries: learners, streams, sources, geometry, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.ordering import with_places
from tessera.functions.scratch import cut, scratch_path
from tessera.operators import mesh as H
from tessera.operators import models as M
from tessera.operators import selection as C
from tessera.plans.adapters import samples, table
from tessera.plans.audit import r6
from tessera.plans.catalog import catalog
from tessera.sources import geometry, inventory
from tessera.streaming import incremental

QUERIES, SQL, query = catalog()


def _measures(spark, sf_dir):
    part = F.when(F.col("person") % 5 == 0, "test").otherwise("train")
    return samples(spark, sf_dir).select("bust", "length", "sleeve", "body_a", "ease", "cloth", part.alias("part"))


def _rows(spark, sf_dir):
    return cut(_measures(spark, sf_dir))


@query("boosted_trees")
def boosted_trees(spark, sf_dir):
    """H6."""
    return M.boosted(_measures(spark, sf_dir), ["bust", "length", "sleeve", "body_a"], "ease", "part")


@query("pca_ridge")
def pca_ridge(spark, sf_dir):
    """H7 on embeddings."""
    part = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"), part.alias("part"))
    return M.pca_ridge(e, "embedding", "label", "part", k=16)


@query("decision_classifier")
def decision_classifier(spark, sf_dir):
    """H9: the return flag as the action."""
    part = F.when(F.crc32(F.col("l_orderkey").cast("string").cast("binary")) % 5 == 0, "test").otherwise("train")
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", part.alias("part"))
    return M.decisions(rows, ["l_quantity", "l_discount", "l_tax"], "l_returnflag", "part")


@query("incremental_events", "SELECT event_id, event_type, round(value, 6) AS value, 'events' AS source_shard_id, true AS located FROM events")
def incremental_events(spark, sf_dir):
    """Events as a file stream with a checkpoint, each file once."""
    base = scratch_path(spark, "ingest")
    schema = table(spark, sf_dir, "events").schema
    out = incremental.ingest(spark, f"{sf_dir}/events.parquet*", schema, lambda s: s.select("event_id", "event_type", "value", "source_shard_id", "source_row_id"), f"{base}/sink", f"{base}/checkpoint")
    return out.select("event_id", "event_type", *r6("value"), "source_shard_id", (F.col("source_row_id") >= 0).alias("located"))


@query("resume_ledger", "SELECT DISTINCT 'shard-' || l_suppkey % 20 AS source_shard_id FROM lineitem WHERE l_suppkey % 20 >= 12")
def resume_ledger(spark, sf_dir):
    """Shards that a merged ledger does not have."""
    shards = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("shard-"), F.col("l_suppkey") % 20).alias("source_shard_id"), (F.col("l_suppkey") % 20).alias("k")).distinct()
    ledger = incremental.merge_ledgers(shards.filter("k < 8"), shards.filter("k >= 5 AND k < 12"))
    return incremental.pending(shards.select("source_shard_id"), ledger)


@query("source_inventory", "SELECT 'orders.parquet' AS file, count(*) AS rows, true AS sized FROM orders")
def source_inventory(spark, sf_dir):
    """Path, size and rows of each file."""
    i = inventory.inventory(table(spark, sf_dir, "orders"))
    return i.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "rows", (F.col("bytes") > 0).alias("sized"))


@query("rehydrate", "SELECT row_number() OVER (ORDER BY p_partkey % 20, p_partkey) AS place, p_partkey, p_name, true AS intact FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def rehydrate(spark, sf_dir):
    """Wanted ids back to their rows, in the order of shards and rows, content verified by its hash."""
    part = table(spark, sf_dir, "part")
    manifest = part.select("p_partkey", (F.col("p_partkey") % 20).alias("shard"), F.sha2("p_name", 256).alias("sha"))
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    found = inventory.verify_bytes(inventory.look_up(wanted, manifest, "p_partkey"), part, ["p_partkey"], "p_name", "sha")
    return with_places(found, ["shard", "p_partkey"]).select("place", "p_partkey", "p_name", "intact")


#: A vector's 64 numbers as 22 vertices: triples from every third place, the last three places for the last.
_TRIPLES = [*range(0, 63, 3), 61]
_VERTICES = "v AS (SELECT label, vec_id, unnest([" + ", ".join(f"struct_pack(x := CAST(embedding[{i + 1}] AS DOUBLE), y := CAST(embedding[{i + 2}] AS DOUBLE), z := CAST(embedding[{i + 3}] AS DOUBLE))" for i in _TRIPLES) + "], recursive := true) FROM embeddings)"


def _vertices(spark, sf_dir):
    """All numbers of the vectors of a label as the vertices of one mesh."""
    at = lambda i: F.struct(*(F.col("embedding")[i + j].cast("double").alias(c) for j, c in enumerate("xyz")))
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.explode(F.array(*map(at, _TRIPLES))).alias("p")).select("label", "vec_id", "p.*")


@query("mesh_clearance", "WITH " + _VERTICES + ", c AS (SELECT a.label, a.vec_id, a.x, a.y, a.z, min(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2)) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY ALL) SELECT label, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.1), 6) AS p10, round(min(d), 6) AS least, round(avg(CAST(d < 0.3 AS DOUBLE)), 6) AS contact_ratio, round(avg(CAST(d < 1.0 AS DOUBLE)), 6) AS tight_ratio FROM c GROUP BY label")
def mesh_clearance(spark, sf_dir):
    """Vectors of one label as cloth and body vertices, with contact and tight ratios."""
    v = _vertices(spark, sf_dir)
    c = H.nearest_distance(v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1").select("label", "x", "y", "z"), "label")
    return H.outcomes(c, ["label"], 0.3, 1.0).select("label", "n", *r6("mean", "p10", "least", "contact_ratio", "tight_ratio"))


_UNITS = "CASE WHEN label % 3 = {} THEN 1 ELSE 100 END"


@query("mesh_outcomes", "WITH " + _VERTICES + f""", a AS (SELECT label, vec_id, x * {_UNITS.format(0)} AS x, y * {_UNITS.format(0)} AS y, z * {_UNITS.format(0)} AS z FROM v WHERE vec_id % 2 = 0), b AS (SELECT label, x * {_UNITS.format(1)} AS x, y * {_UNITS.format(1)} AS y, z * {_UNITS.format(1)} AS z FROM v WHERE vec_id % 2 = 1),
  sa AS (SELECT label, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS c FROM a GROUP BY 1), sb AS (SELECT label, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS b FROM b GROUP BY 1),
  u AS (SELECT label, CASE WHEN b < 10 AND c > 20 THEN 'body_m_to_cm_x100' WHEN c < 10 AND b > 20 THEN 'cloth_m_to_cm_x100' ELSE '1' END AS note FROM sa JOIN sb USING (label)),
  a2 AS (SELECT label, vec_id, x * s AS x, y * s AS y, z * s AS z, note FROM (SELECT *, CASE WHEN note LIKE 'cloth%' THEN 100 ELSE 1 END AS s FROM a JOIN u USING (label))), b2 AS (SELECT label, x * s AS x, y * s AS y, z * s AS z FROM (SELECT *, CASE WHEN note LIKE 'body%' THEN 100 ELSE 1 END AS s FROM b JOIN u USING (label))),
  k AS (SELECT label, min(y) AS low, max(y) AS high, max(abs(x)) AS wide FROM a2 GROUP BY 1),
  r AS (SELECT a2.*, CASE WHEN abs(x) > 0.7 * wide THEN 'sleeve' WHEN (y - low) / (high - low) >= 0.6 THEN 'chest' WHEN (y - low) / (high - low) >= 0.3 THEN 'waist' ELSE 'hem' END AS region FROM a2 JOIN k USING (label)),
  d AS (SELECT r.label, vec_id, r.x, r.y, r.z, region, note, min(sqrt((r.x - b2.x) ^ 2 + (r.y - b2.y) ^ 2 + (r.z - b2.z) ^ 2)) AS d FROM r JOIN b2 ON r.label = b2.label GROUP BY ALL),
  e AS (SELECT label, region, note, d FROM d UNION ALL SELECT label, 'ALL', note, d FROM d)
  SELECT label, region, count(*) AS n, round(avg(d), 5) AS mean, round(quantile_cont(d, 0.1), 5) AS p10, round(min(d), 5) AS least, round(avg(CAST(d < 0.4 AS DOUBLE)), 6) AS contact_ratio, round(avg(CAST(d < 0.2 AS DOUBLE)), 6) AS tight_ratio, note AS unit_alignment FROM e GROUP BY ALL""")
def mesh_outcomes(spark, sf_dir):
    """Clearance per region, of pairs of which one mesh may be in metres."""
    v = _vertices(spark, sf_dir)
    metres = lambda rest: F.when(F.col("label") % 3 == rest, 1.0).otherwise(100.0)
    cloth = v.filter("vec_id % 2 = 0").select("label", "vec_id", *((F.col(c) * metres(0)).alias(c) for c in "xyz"))
    body = v.filter("vec_id % 2 = 1").select("label", *((F.col(c) * metres(1)).alias(c) for c in "xyz"))
    found = H.pair_outcomes(cloth, body, "label")
    return found.select("label", "region", "n", *(F.round(c, 5).alias(c) for c in ("mean", "p10", "least")), *r6("contact_ratio", "tight_ratio"), "unit_alignment")


@query("mesh_wrinkle")
def mesh_wrinkle(spark, sf_dir):
    """E42."""
    return H.wrinkle(_vertices(spark, sf_dir), "label")


@query("panel_measures", "SELECT CAST(p_partkey AS VARCHAR) AS spec, p_size * 2.0 AS bust, 20.0 AS length, 5.0 AS sleeve, CAST(p_size AS DOUBLE) AS shoulder FROM part")
def panel_measures(spark, sf_dir):
    """Rectangular panels sized by parts."""
    box = lambda w, h: F.struct(F.array(*(F.array(x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h)))).alias("vertices"))
    w = F.col("p_size").cast("double")
    panels = F.create_map(F.lit("front_torso"), box(w, F.lit(20.0)), F.lit("back_torso"), box(w, F.lit(20.0)), F.lit("left_sleeve"), box(F.lit(5.0), F.lit(8.0)))
    specs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("spec"), panels.alias("panels"))
    return geometry.panel_measures(specs).select("spec", "bust", "length", "sleeve", "shoulder")


@query("kendall_ladders", "SELECT a.l_orderkey, count(*) AS pairs, round(avg(sign(b.l_quantity - a.l_quantity)), 6) AS tau, min(sign(b.l_quantity - a.l_quantity)) = 1 AS exact FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey")
def kendall_ladders(spark, sf_dir):
    """Order lines as ladders."""
    return C.kendall(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "pairs", *r6("tau"), "exact")


@query("parameter_probe", "WITH s AS (SELECT l_partkey, min((l_quantity, l_extendedprice, l_tax)) AS a, max((l_quantity, l_extendedprice, l_tax)) AS b FROM lineitem GROUP BY l_partkey), u AS (SELECT l_partkey, (b[2] - a[2]) / (b[1] - a[1]) AS p, (b[3] - a[3]) / (b[1] - a[1]) AS t FROM s WHERE b[1] <> a[1]) SELECT l_partkey, round(p, 4) AS per_unit_l_extendedprice, round(t, 6) + 0.0 AS per_unit_l_tax, abs(p) >= 0.15 AND abs(t) < 0.5 * abs(p) AS independent FROM u")
def parameter_probe(spark, sf_dir):
    """E40."""
    p = C.probe(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", ["l_extendedprice", "l_tax"])
    return p.select("l_partkey", F.round("per_unit_l_extendedprice", 4).alias("per_unit_l_extendedprice"), (F.round("per_unit_l_tax", 6) + 0.0).alias("per_unit_l_tax"), "independent")


@query("spread_states", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus, floor(o_totalprice / 20000) ORDER BY o_orderkey) AS r FROM orders) ORDER BY r, o_orderstatus, o_orderkey LIMIT 40")
def spread_states(spark, sf_dir):
    """the limit is the selection's size."""
    return C.spread_states(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", 20000.0, "o_orderkey", 40).select("o_orderkey")


@query("stratified_pilot")
def stratified_pilot(spark, sf_dir):
    """F9."""
    j = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("stratum"), F.min(F.col("l_suppkey") % 20).alias("s1"), F.max(F.col("l_suppkey") % 20).alias("s2"), F.max("l_quantity").alias("score"))
    return C.stratified_pilot(j, "stratum", ["s1", "s2"], "l_orderkey", 30, 12)
