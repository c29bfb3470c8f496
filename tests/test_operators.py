import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.prefix import running_sums
from tessera.operators import discovery as V
from tessera.operators import duplicates as D
from tessera.operators import lattice as L
from tessera.operators import mesh as H
from tessera.operators import pairs as P
from tessera.operators import quality as Q
from tessera.operators import selection as C
from tessera.operators import splits as G
from tessera.operators import stats as St
from tessera.sources import geometry, images, inventory
from tessera.streaming import incremental


def test_null_keys_are_never_duplicates(spark):
    d = spark.createDataFrame([("a", "train"), ("a", "eval"), (None, "train"), (None, "eval")], "k string, split string")
    got = D.annotate(d, {"k": "k"}).collect()
    assert [(r.k, r.duplicate_k, r.leakage_k) for r in sorted(got, key=lambda r: str(r.k))] == [(None, False, False), (None, False, False), ("a", True, True), ("a", True, True)]


def test_quality_order(spark):
    d = spark.createDataFrame([(10.0, 5.0), (None, 99.0), (10.0, 99.0), (10.0, 0.0)], "m double, e double")
    got = Q.classify(d, Q.missing_and_bounds({"m": (0.0, 20.0)}), [], [("extreme", F.col("e") > 50)], [("zero", F.col("e") == 0)]).collect()
    assert [(r.quality_status, r.quality_flags) for r in got] == [("VALID", []), ("INVALID", ["missing_m"]), ("SUSPICIOUS", ["extreme"]), ("VALID", ["zero"])]


@pytest.mark.parametrize("n, expected", [(1, 0), (2, 1), (6, 15), (7, 7), (32, 32), (33, 32), (40, 32)])
def test_pair_generator(spark, n, expected):
    d = spark.createDataFrame([(f"{i:03d}", "g", float(i)) for i in range(n)], "id string, g string, ease double")
    assert P.limited_pairs(d, ["g"], ("ease", "id")).count() == expected


def test_limited_pairs_of_partitions(spark):
    d = spark.createDataFrame([(f"{i:03d}", i % 5, float(i * 7 % 11)) for i in range(60)], "id string, g int, ease double")
    runs = [sorted(map(tuple, P.limited_pairs(d.repartition(k), ["g"], ("ease", "id")).collect())) for k in (1, 8, 64)]
    assert runs[0] == runs[1] == runs[2]


def test_ks_and_wasserstein(spark):
    d = spark.createDataFrame([(float(v), "train") for v in (0, 1, 2)] + [(float(v), "eval") for v in (1, 2, 3)], "x double, split string")
    r = St.shift(d, ["x"], "split").first()
    assert r.ks == pytest.approx(1 / 3) and r.wasserstein == pytest.approx(1)


def test_auroc_with_ties(spark):
    d = spark.createDataFrame([(s, y) for s, y in [(2.0, True), (1.0, True), (1.0, False), (0.0, False)] * 2], "s double, y boolean")
    assert St.auroc(d, "s", F.col("y")).first().auroc == pytest.approx(0.875)
    assert St.auroc(d.limit(4), "s", F.col("y")).first().auroc is None


def test_purity(spark):
    d = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k1", "b"), ("k2", "b")], "k string, y string")
    assert St.purity(d, "k", "y").first().purity == pytest.approx((2 / 3 + 1) / 2)


def test_running_sums_against_cumsum(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in rng.sample(range(1000), 200)]
    got = {(r.g, r.x): r.cum_v for r in running_sums(spark.createDataFrame(rows, "g string, x int, v int"), ["g"], "x", ["v"], buckets=7).collect()}
    assert all(got[g, x] == sum(v for h, y, v in rows if h == g and y <= x) for g, x, _ in rows)


def test_risk_coverage_falls_to_the_rest(spark):
    rows = [(i, float(i % 4), i % 3 == 0) for i in range(40)]
    got = {r.slot: (r.coverage, r.selective_accuracy) for r in St.risk_coverage(spark.createDataFrame(rows, "id int, s double, ok boolean"), "s", "id", F.col("ok")).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in range(10):
        kept = order[4 * k :]
        assert got[k] == (pytest.approx(len(kept) / 40), pytest.approx(sum(r[2] for r in kept) / len(kept)))


def test_radius_is_inclusive(spark):
    r = V.radius_summary(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (1.0,)], "x double"), ["x"], 1.0).first()
    assert (r.pairs, r.touched) == (2, 3)


def test_radius_and_hamming_against_brute_force(spark):
    rng = random.Random(3)
    pts = {(rng.randint(0, 20) / 2, rng.randint(0, 20) / 2) for _ in range(60)}
    got = V.radius_pairs(spark.createDataFrame(list(pts), "x double, y double"), ["x", "y"], 1.5)
    assert got.count() == sum((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 2.25 for a, b in itertools.combinations(pts, 2))
    base = rng.getrandbits(63)
    fps = {base ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 4))) for _ in range(60)}
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    near = V.hamming_pairs(spark.createDataFrame([(f,) for f in fps], "fp bigint"), "fp", 4)
    want = {tuple(sorted(p)) for p in itertools.combinations(fps, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 4}
    assert {(r.a, r.b) for r in near.collect()} == want


def test_star_clusters_are_not_components(spark):
    chain = [(0, 0), (1, 0b11111), (2, 0b1111111111)]
    got = {r.fp: r.head for r in V.greedy_clusters(spark.createDataFrame(chain, "id int, fp bigint"), "id", "fp", 5).collect()}
    assert got == {0: 0, 0b11111: 0, 0b1111111111: 0b1111111111}


def test_transition_errors(spark):
    d = spark.createDataFrame([(100.0, 103.0, 3.0, "measured"), (100.0, 103.0, 3.0, "intended"), (None, None, None, "measured"), (100.0, 101.5, 3.0, "measured")], "b double, a double, r double, s string")
    got = [r.e for r in d.select(L.row_errors(F.col("b"), F.col("a"), F.col("r"), F.col("s")).alias("e")).collect()]
    assert got == [[], ["copied_from_intended"], ["missing_realized", "missing_before_after"], ["delta_mismatch"]]


def test_utility_order_and_ranking(spark):
    d = spark.createDataFrame([("a", 0.04, 0.46, 0.0), ("b", 0.02, 0.51, 2.0), ("c", None, None, 1.0)], "id string, contact double, chest double, edit double").withColumn("s", F.lit(1))
    u = d.withColumn("u", L.physical_utility(F.col("contact"), F.col("chest"), F.lit(None).cast("double"), F.col("edit")))
    r = L.rank_candidates(u, ["s"], "u", "id").collect()
    assert [(x.id, x.recommended) for x in sorted(r, key=lambda x: x["rank"])] == [("b", True), ("a", False)]


def test_gates(spark):
    rows = [("f", float(i), i + 0.01, 0.0) for i in (1, 2, 3)] + [("g", float(i), 5.0, 3.0) for i in (1, 2, 3)]
    got = {r.fam: r for r in L.calibration_gates(spark.createDataFrame(rows, "fam string, i double, r double, s double"), "fam", "i", "r", ["s"]).collect()}
    assert (got["f"].decision, got["f"].g4) == ("GO", "PARTIAL") and (got["g"].decision, got["g"].g4) == ("NO-GO", "FAIL")


def test_split_has_exact_shares(spark):
    got = G.group_split(spark.range(200).select((F.col("id") % 100).alias("g")), "g", seed=1).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {"train": 70, "val": 15, "test": 15}
    assert G.group_split(spark.range(1).select(F.col("id").alias("g")), "g").first().part == "train"


def test_holm(spark):
    h = C.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", "k")
    assert {r.k: round(r.adjusted, 4) for r in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def _png(pixels, colour):
    import struct

    h, w = pixels.shape[:2]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_audit(spark):
    rng = np.random.default_rng(0)
    rgb = _png(rng.integers(0, 256, (20, 30, 3), dtype=np.uint8), 2)
    rows = [("rgb", rgb), ("grey", _png(rng.integers(0, 256, (8, 8), dtype=np.uint8), 0)), ("cut", rgb[:-20]), ("junk", b"not-a-png"), ("none", None)]
    d = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "id string, bytes binary")
    got = {r.id: r for r in images.audit(d).collect()}
    assert [(got[k].decodable, got[k].error) for k, _ in rows] == [(True, ""), (True, ""), (False, "corrupt"), (False, "corrupt"), (False, "missing")]
    assert (got["rgb"].width, got["rgb"].height, got["rgb"].mode, len(got["rgb"].phash)) == (30, 20, "RGB", 16)
    w, h = images.png_header("bytes")
    assert [(r.w, r.h) for r in d.select(w.alias("w"), h.alias("h")).collect()][0] == (30, 20)
    i = images.integrity(images.audit(d).withColumn("m", F.lit("x")), "m", 30, 20).first()
    assert (i.n, i.missing, i.compliant) == (5, 1, 1)


def test_mesh(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# x\nv 0 0 0\nv 1 0 0\nf 1 2\nv 0 1 0.5\nv 1 1 0\n")
    v = geometry.read_vertices(spark, str(tmp_path))
    assert v.count() == 4 and H.wrinkle(v).first().wrinkle == 0.0
    cm = H.align_units(v)
    assert cm.agg(F.max("x")).first()[0] == 100.0
    c = H.nearest_distance(H.regions(cm), cm)
    assert H.outcomes(c, ["mesh_id"]).first()["least"] == 0.0
    (tmp_path / "empty.obj").write_text("# none\n")
    with pytest.raises(ValueError):
        geometry.read_vertices(spark, str(tmp_path))


def test_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("f", T.BooleanType()), T.StructField("s", T.StringType())])
    out = inventory.assemble([spark.range(1).select(F.col("id").alias("a")), spark.range(1).select(F.lit(True).alias("f"))], schema)
    assert sorted(map(str, out.collect())) == ["Row(a=0, f=False, s=None)", "Row(a=None, f=True, s=None)"]
    assert inventory.schema_difference(out.schema, schema) == []
    p = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(p)
    inventory.require_shards(spark.read.parquet(p), 1)
    with pytest.raises(ValueError):
        inventory.require_shards(spark.read.parquet(p), 2)
    with pytest.raises(KeyError):
        inventory.look_up(spark.range(3), spark.range(2), "id")
    a, b = spark.range(10), spark.range(10).union(spark.range(1)).union(spark.range(1))
    assert inventory.fingerprint(a, 5).first().sum_hash != inventory.fingerprint(b, 5).first().sum_hash


def test_stream_resumes(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    spark.range(5).coalesce(1).write.parquet(src)
    spark.range(5, 10).coalesce(1).write.mode("append").parquet(src)
    run = lambda: incremental.ingest(spark, src, T.StructType([T.StructField("id", T.LongType())]), lambda s: s, sink, cp, 1)
    assert run().count() == 10 and run().count() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    out = run()
    assert out.count() == 15 == out.select("id").distinct().count() and incremental.ready(out, 3)
