"""Order, fingerprints of files, pair validation and the units of two meshes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.ordering import with_places, write_ordered
from tessera.operators import mesh as H
from tessera.operators import pairs as P
from tessera.operators import quality as Q
from tessera.plans.adapters import MEASURES
from tessera.sources import inventory


def merkle(data, chunk):
    level = [hashlib.sha256(b"\0" + data[i : i + chunk]).digest() for i in range(0, max(len(data), 1), chunk)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def test_file_fingerprints(spark, tmp_path):
    rng = random.Random(2)
    data = {f"f{n}": rng.randbytes(n) for n in (1, 10, 11, 39, 40, 200, 1000)}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    files = inventory.file_fingerprints(spark, str(tmp_path), 10)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.root) for r in files.collect()}
    assert got == {name: (len(body), merkle(body, 10)) for name, body in data.items()}
    whole = inventory.dataset_fingerprint(files).first()
    assert (whole.files, whole.bytes) == (7, sum(map(len, data.values()))) and whole.root == hashlib.sha256("".join(got[n][1] for n in sorted(got)).encode()).hexdigest()


def test_split_gate(spark):
    d = spark.createDataFrame([("train", 1), ("train", 2), ("eval", 1)], "split string, shard int")
    gate = lambda rows, shards: {(r.split, r.met, r.gate) for r in inventory.split_gate(d, "split", "shard", rows, shards).collect()}
    assert gate({"train": 2, "eval": 1}, {"train": 2, "eval": 1}) == {("train", True, "FROZEN"), ("eval", True, "FROZEN")}
    assert gate({"train": 2, "eval": 1}, {"train": 1, "eval": 1}) == {("train", False, "PARTIAL"), ("eval", True, "PARTIAL")}
    assert gate({"train": 2, "test": 0}, {"train": 2, "test": 0}) == {("train", True, "PARTIAL"), ("test", True, "PARTIAL"), ("eval", False, "PARTIAL")}


def test_places_are_those_of_one_sort(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc") if i % 11 else None, rng.randrange(40), i) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, n int, i int").repartition(7)
    got = {r.place: (r.g, r.n, r.i) for r in with_places(d, ["g", "n", "i"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [got[k] for k in range(1, 501)] == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(d, ["g", "n", "i"], str(tmp_path / "o"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "o").glob("*.parquet"))
    read = [tuple(r) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert read == want and len(files) > 1
    assert with_places(d.limit(0), ["n"]).count() == 0


def pair(anchor, other, **more):
    base = {"pair_id": None, "anchor_id": anchor, "counterfactual_id": other, "tier": "B", "control_score": 0.5, "anchor_target": 1, "counterfactual_target": 2}
    for f in (*MEASURES.garment, MEASURES.ease):
        base |= {f"anchor_{f}": 1.0, f"counterfactual_{f}": 3.5, f"delta_{f}": 2.5}
    return base | more


def test_pairs_are_validated_in_full(spark):
    def table(*rows):
        d = spark.createDataFrame([{k: v for k, v in r.items() if k != "pair_id"} for r in rows])
        right = P.pair_id("anchor_id", "counterfactual_id")
        return d.withColumn("pair_id", F.when(F.col("tier") == "X", "cf_wrong").otherwise(right))

    assert P.require_sound(table(pair("a", "b"), pair("a", "c")), MEASURES)["n"] == 2
    faults = {
        "self_pairs": pair("a", "a"), "repeated_pairs": pair("c", "a"), "wrong_ids": pair("d", "e", tier="X"), "wrong_deltas": pair("d", "e", delta_bust=2.5 + 1e-6), "same_target": pair("d", "e", counterfactual_target=1),
        "bad_scores": pair("d", "e", control_score=1.5),
    }
    for name, fault in faults.items():
        found = P.validate_pairs(table(pair("a", "b"), pair("a", "c"), fault), MEASURES).first()
        assert {k for k in faults if found[k]} == {name} | ({"wrong_ids"} if name == "self_pairs" else set()) and found[name] == 1 and not found.sound, name
        with pytest.raises(P.PairError, match=name):
            P.require_sound(table(pair("a", "c"), fault), MEASURES)
    empty = table(pair("a", "b")).limit(0)
    assert P.require_sound(empty, MEASURES)["n"] == 0
    with pytest.raises(P.PairError, match="empty"):
        P.require_sound(empty, MEASURES, require_rows=True)
    with pytest.raises(P.PairError, match="missing columns"):
        P.validate_pairs(empty.drop("delta_ease"), MEASURES)


def test_one_mesh_in_metres(spark):
    points = [(0.0, 100.0, 0.0), (40.0, 145.0, 12.0), (-35.0, 102.0, 8.0), (5.0, 130.0, -4.0)]
    schema = "mesh_id string, x double, y double, z double"
    mesh = lambda scales: spark.createDataFrame([(m, *(v / s for v in p)) for m, s in scales.items() for p in points], schema)
    cloth, body = mesh({"a": 1.0, "b": 100.0, "c": 1.0, "d": 100.0}), mesh({"a": 100.0, "b": 1.0, "c": 1.0, "d": 100.0})
    found = {(r.mesh_id, r.region): r for r in H.pair_outcomes(cloth, body).collect()}
    notes = {m: found[m, "ALL"].unit_alignment for m in "abcd"}
    assert notes == {"a": "body_m_to_cm_x100", "b": "cloth_m_to_cm_x100", "c": "1", "d": "1"}
    assert all(found[m, "ALL"].n == 4 and found[m, "ALL"].least < 1e-6 and found[m, "ALL"].contact_ratio == 1.0 for m in "abcd")
    assert {r for m, r in found if m == "a"} == {"ALL", "sleeve", "hem", "chest"} and found["a", "sleeve"].n == 2


def test_evidence(spark):
    rows = [(i, ["x"] if i % 2 else ["x", "y"]) for i in range(40)] + [(0, ["y"]), (None, ["y"])]
    got = sorted(tuple(r) for r in Q.evidence(spark.createDataFrame(rows, "id int, quality_flags array<string>"), "id", 3).collect())
    assert got == [("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("y", 1, 0), ("y", 2, 2), ("y", 3, 4)]
