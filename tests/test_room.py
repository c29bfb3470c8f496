"""What the library leaves on disk while it works."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.scratch import cut, hadoop_fs, release
from tessera.functions.ordering import with_places
from tessera.operators import discovery as V
from tessera.operators import duplicates as D
from tessera.operators import mesh as H
from tessera.operators import pairs as P
from tessera.sources.geometry import PANELS, panel_measures


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if f.endswith(".data") and "/shuffle_" in f}


def test_a_cut_leaves_columns_and_no_shuffle_files(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    before = shuffle_files(spark)
    d = cut(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.lit("the same text").alias("text")))
    assert shuffle_files(spark) <= before
    fs, at = hadoop_fs(spark, d._scratch_path)
    assert fs.getContentSummary(at(d._scratch_path)).getLength() < 20 * 50_000
    assert d.agg(F.sum("n")).first()[0] == 200_000
    release(d)
    assert not fs.exists(at(d._scratch_path))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_flags_that_nobody_wants_are_not_counted(spark):
    d = spark.createDataFrame([(1, 5, "train"), (1, 6, "eval"), (2, 6, "train"), (None, 7, "train"), (3, 8, "eval")], "a int, b int, split string")
    got = D.annotate(d, {"a": "a", "b": "b"}, flags=["leakage_b"])
    assert got.columns == ["a", "b", "split", "leakage_b"]
    assert {tuple(r) for r in got.collect()} == {(1, 5, "train", False), (1, 6, "eval", True), (2, 6, "train", True), (None, 7, "train", False), (3, 8, "eval", False)}
    assert D.annotate(d, {"a": "a"}, flags=[]) is d


def test_flags_where_nearly_all_keys_leak(spark):
    rows = [(k, s) for k in range(20) for s in ("train", "eval")] + [(50, "eval"), (51, "train"), (51, "train"), (None, "train"), (None, "eval")]
    got = D.annotate(spark.createDataFrame(rows, "k int, split string"), {"k": "k"}).distinct().collect()
    assert {(r.k, r.duplicate_k, r.leakage_k) for r in got} == {*((k, True, True) for k in range(20)), (50, False, False), (51, True, False), (None, False, False)}


def test_pairs_shuffle_their_members_once(spark):
    d = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id").cast("string").alias("id"), F.rand(1).alias("ease"))
    assert exchanges(P.limited_pairs(d, ["g"], ("ease", "id"), whole=True)) == 1
    assert exchanges(P.limited_pairs(d.repartition("g"), ["g"], ("ease", "id"), whole=True)) == 1


def test_neighbours_are_chosen_before_they_are_shuffled(spark):
    """Points that lie densely in the middle: the nearest of brute force, and no shuffle holds all that were compared."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 0.02, (600, 3)), r.normal(0, 1, (300, 3)), np.repeat(r.normal(0, 1, (5, 3)), 12, 0), [[40.0, 0.0, 0.0]]]).round(6)
    d = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(x)], "g int, pid bigint, x double, y double, z double")
    got = {n.pid: [(e.oid, e.d2) for e in n.near] for n in H.nearest(d, d.withColumnRenamed("pid", "oid"), "g", 3).collect()}
    assert len(got) == len(x)
    for i, p in enumerate(x):
        d2 = (p[0] - x[:, 0]) ** 2 + (p[1] - x[:, 1]) ** 2 + (p[2] - x[:, 2]) ** 2
        want = sorted((float(v), j) for j, v in enumerate(d2) if j != i and j % 2 == i % 2)[:3]
        assert [j for j, _ in got[i]] == [j for _, j in want]
        assert np.allclose([v for _, v in got[i]], [v for v, _ in want], rtol=1e-12, atol=0)
    lone = H.nearest(d.limit(1), d.limit(1).withColumnRenamed("pid", "oid"), "g", 3).collect()
    assert [n.near for n in lone] == [[]]


def test_panels_need_no_join(spark):
    d = spark.createDataFrame([("a", {"Front_torso": ([[0.0, 0.0], [4.0, 0.0], [3.0, 6.0], [1.0, 6.0]],), "sleeve": ([[0.0, 0.0], [2.0, 5.0]],)}), (None, {"torso": ([[0.0, 1.0]],)}), ("b", {"torso": ([[0.0, None]],)})], PANELS)
    found = panel_measures(d)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a", 4.0, 6.0, 2.0, 2.0, False, False)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_structures_do_not_multiply_their_rows(spark):
    rows = [(p, p % 3 + i % 2, 1.0, 2.0, float(b), 5.0, None if i == 1 else 7.0, i, float(b)) for p in range(12) for i, b in enumerate([1, 1, 2, 3][: 1 + p % 4])]
    d = spark.createDataFrame(rows, "person int, cloth int, ba double, bb double, bust double, length double, sleeve double, target int, ease double")
    person = V.person_structure(d, "person", ["ba", "bb"], ["bust", "length", "sleeve"], ["ease"], "cloth", "target")
    both = V.person_cloth_structure(d, ["person", "cloth"], ["ba", "bb"], ["bust", "length", "sleeve"], "target")
    assert "Expand" not in plan(person) + plan(both)
    assert plan(V.person_cloth_structure(d.repartition("person"), ["person", "cloth"], ["ba", "bb"], ["bust", "length", "sleeve"], "target")).count("Exchange hashpartitioning") == 1
    r = person.first()
    assert (r.groups, r.different_target, r.garment_varies, r.most_cloths) == (9, 9, 6, 2)
    r = both.first()
    assert r.single_variable == r.preset_like == r.different_garment


def test_small_groups_meet_without_masks(spark):
    d = spark.range(40).select((F.col("id") % 9).alias("g"), (F.col("id") * 7 % 5).alias("fp"), (F.col("id") % 2).alias("o"))
    small = {tuple(r) for r in V.group_distances(d, "g", "fp", "o").collect()}
    real, V.SMALL_GROUP = V.SMALL_GROUP, 0
    try:
        assert {tuple(r) for r in V.group_distances(d, "g", "fp", "o").collect()} == small
    finally:
        V.SMALL_GROUP = real


def test_places_in_parts_are_those_of_one_sort(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("a"), F.when(F.col("id") % 13 > 0, F.col("id") % 3).alias("b"), "id")
    got = {r.place: (r.a, r.b, r.id) for r in with_places(d, ["b", "a", "id"], parts=4).collect()}
    want = sorted(((i * 7919 % 1000, i % 3 if i % 13 else None, i) for i in range(5000)), key=lambda r: (r[1] is not None, r[1] or 0, r[0], r[2]))
    assert [got[k] for k in range(1, 5001)] == want
    assert with_places(d.limit(0), ["a"], parts=3).count() == 0
    c = with_places(d, ["c", "id"], parts=3, derived={"c": -F.col("a")}).collect()
    assert [r.id for r in sorted(c, key=lambda r: r.place)] == sorted(range(5000), key=lambda i: (-(i * 7919 % 1000), i)) and all(r.c == -r.a for r in c)


def test_validation_counts_without_multiplying_rows(spark):
    m = P.Measures(body=(), garment=("bust",))
    d = spark.range(1).selectExpr("'x' AS pair_id", "'p' AS anchor_id", "'q' AS counterfactual_id", "'A' AS tier", "0.5D AS control_score", "1 AS anchor_target", "2 AS counterfactual_target",
        *(f"{v}D AS {side}_{f}" for f in ("bust", "ease") for side, v in (("delta", 1.0), ("anchor", 2.0), ("counterfactual", 3.0))))
    found = P.validate_pairs(d.unionAll(d.selectExpr("pair_id", "counterfactual_id AS anchor_id", "anchor_id AS counterfactual_id", *d.columns[3:])), m)
    assert "Expand" not in plan(found)
    r = found.first()
    assert (r.n, r.ids, r.repeated_pairs, r.wrong_ids, r.wrong_deltas, r.sound) == (2, 1, 1, 2, 0, False)


def test_the_audit_keeps_only_what_it_reads(spark, sf, monkeypatch):
    from tessera.plans import pairing

    kept = []
    real = pairing.cut
    monkeypatch.setattr(pairing, "cut", lambda d: kept.append(d.columns) or real(d))
    assert pairing.QUERIES["shortcut_audit"](spark, sf).first().n > 0
    assert len(kept) == 1 and not {"pair_id", "anchor_id", "counterfactual_id", "reason"} & set(kept[0])
