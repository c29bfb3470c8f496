"""Verdicts of trends, structures of groups, and learners against a constant and plain fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import discovery as V
from tessera.operators import lattice as L
from tessera.operators import models as M
from tessera.operators import stats as T
from tessera.sources import inventory


def series(name, rng):
    return {
        "MONOTONIC_GROWTH": [10.0 * i for i in range(100)], "POSSIBLE_ALLOCATOR_RETENTION": [500.0 + 150 * (i > 50) + rng.uniform(-1, 1) for i in range(100)], "STABLE_PLATEAU": [500 + rng.uniform(-5, 5) for _ in range(100)],
        "INSUFFICIENT_EVIDENCE": [rng.uniform(0, 900) for _ in range(100)], "few": [1.0] * 29,
    }[name]


@pytest.mark.parametrize("name", ["MONOTONIC_GROWTH", "POSSIBLE_ALLOCATOR_RETENTION", "STABLE_PLATEAU", "INSUFFICIENT_EVIDENCE", "few"])
def test_trend_verdicts(spark, name):
    ys = series(name, random.Random(1))
    got = T.trend_verdict(spark.createDataFrame(list(enumerate(ys)), "i int, y double"), "i", "y").first()
    assert got.verdict == ("INSUFFICIENT_EVIDENCE" if name == "few" else name) and got.n == len(ys)
    if name != "few":
        last = np.array(ys[-30:])
        assert np.allclose([got.slope, got.growth, got.last_sd, got.last_spread, got.last_up_share], [np.polyfit(range(100), ys, 1)[0], last.mean() - np.mean(ys[:30]), last.std(), np.ptp(last), (np.diff(last) > 0).mean()])


def test_structures_of_groups(spark):
    rows = [
        ("p1", "c1", "t1", 1.0, 5.0, 0.1), ("p1", "c1", "t2", 1.0, 6.0, 0.2), ("p1", "c2", "t3", 1.0, 7.0, 0.1), ("p2", "c1", "t4", 2.0, 5.0, 0.1), ("p2", "c1", "t4", 3.0, 5.0, 0.1), ("p3", "c3", "t5", 1.0, 9.0, 0.1),
        ("p4", "c3", "t6", 4.0, 9.0, 0.1), (None, "c3", "t7", 5.0, 9.0, 0.1), ("p5", None, "t8", 1.0, 1.0, 0.1),
    ]
    d = spark.createDataFrame(rows, "person string, cloth string, target string, body double, bust double, ease double")
    a = V.person_cloth_structure(d, ["person", "cloth"], ["body"], ["bust"], "target").first().asDict()
    assert a == {"groups": 2, "different_target": 1, "different_garment": 1, "different_body": 1, "body_constant": 1, "tier_a": 1, "single_variable": 1, "preset_like": 1, "tier_a_rows": 2}
    p = V.person_structure(d, "person", ["body"], ["bust"], ["ease"], "cloth", "target").first().asDict()
    assert p == {"groups": 2, "inconsistent_body": 1, "body_constant": 1, "different_cloth": 1, "different_target": 1, "garment_varies": 1, "ease_varies": 1, "tier_c": 1, "inconsistent_body_rows": 2, "tier_c_rows": 3, "most_cloths": 2}
    c = V.cloth_structure(d, "cloth", ["body"], ["bust"], "person", "target").first().asDict()
    assert c == {"groups": 2, "inconsistent_garment": 1, "different_person": 2, "different_target": 2, "body_varies": 2, "garment_constant": 1, "measured_apart": 1, "body_varied_alone": 1, "inconsistent_garment_rows": 4}
    assert [tuple(r) for r in V.variation_types(d, ["cloth"], ["bust", "ease"]).collect()] == [("bust+ease", 1)]
    assert V.person_structure(d.limit(0), "person", ["body"], ["bust"], ["ease"], "cloth", "target").first().groups == 0


def test_parts_outside_the_range_may_overlap(spark):
    d = spark.createDataFrame([(1, 0.5, True), (2, 1.5, False), (3, 2.5, None), (None, 9.0, True)], "x int, e double, s boolean")
    got = {r.part: (r.n, r.mae, r.side_effect_rate) for r in L.ood_table(d, {"low": F.col("x") < 3, "odd": F.col("x") % 2 == 1}, F.col("e"), F.col("s")).collect()}
    assert got == {"low": (2, 1.0, 0.5), "odd": (2, 1.5, 1.0)}
    rows = [("a", "N", 1.0), ("a", "R", 3.0), ("a", "R", 4.0), ("b", "N", 2.0), ("c", "N", 1.0), ("c", "R", 1.5)]
    m = L.disagreement(spark.createDataFrame(rows, "s string, f string, v double"), ["s"], "f", "N", "R", "v", 1.0).first()
    assert tuple(m) == (2, 1.5, 2.5, 0.5)


def test_contract_report(spark):
    from pyspark.sql import types as Y

    d = spark.createDataFrame([(1, "7", None), (2, "x", 1.0), (3, None, 2.0)], "a bigint, b string, c double")
    wanted = Y.StructType([Y.StructField("a", Y.LongType()), Y.StructField("b", Y.IntegerType()), Y.StructField("d", Y.DateType())])
    got = [tuple(r) for r in inventory.contract_report(d, wanted).collect()]
    assert got == [("a", "ok", 0, 0), ("b", "string, not int", 1, 1), ("d", "missing", 3, 0), ("c", "extra", 1, 0)]


def learnable(spark, n=900):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n)
    rows = [(*map(float, r), [*map(float, r), float(r[0] + r[1]), 0.1 * float(r[2])], float(v), "high" if v > 1 else "low" if v < -1 else "mid", "test" if i % 4 == 0 else "train") for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, v array<double>, y double, action string, part string"), x, y


def test_boosted_trees_beat_a_constant_by_far(spark):
    d, x, y = learnable(spark)
    got = {r.part: r for r in M.boosted(d, ["a", "b", "c"], "y", "part", trees=40).collect()}
    test = np.arange(len(y)) % 4 == 0
    assert got["test"].n == test.sum() and got["train"].rmse < got["test"].rmse < 0.4 * np.sqrt(np.mean((y[test] - y[~test].mean()) ** 2))


def test_pca_ridge_against_numpy(spark):
    d, x, y = learnable(spark)
    got = {r.part: r for r in M.pca_ridge(d, "v", "y", "part", k=3, alpha=5.0).collect()}
    test = np.arange(len(y)) % 4 == 0
    v = np.column_stack([x, x[:, 0] + x[:, 1], 0.1 * x[:, 2]])
    z = (v - v[~test].mean(0)) / v[~test].std(0, ddof=1)
    w = np.linalg.eigh(np.cov(z[~test].T))[1][:, ::-1][:, :3]
    p = z @ w
    q = np.column_stack([p, np.ones(len(p))])
    # Spark weighs the penalty against the label in units of its deviation.
    beta = np.linalg.solve(q[~test].T @ q[~test] + np.diag([5.0 / y[~test].std(ddof=1)] * 3 + [0.0]), q[~test].T @ y[~test])
    for part, rows in (("train", ~test), ("test", test)):
        assert got[part].rmse == pytest.approx(np.sqrt(np.mean((y[rows] - q[rows] @ beta) ** 2)), rel=1e-3)


def test_decisions_beat_the_commonest_action(spark):
    d, x, y = learnable(spark)
    got = {r.part: r for r in M.decisions(d, ["a", "b", "c"], "action", "part").collect()}
    test = np.arange(len(y)) % 4 == 0
    kind = np.where(y > 1, 2, np.where(y < -1, 0, 1))[test]
    assert got["test"].n == test.sum() and got["test"].accuracy > 0.85 > np.bincount(kind).max() / len(kind) + 0.2
