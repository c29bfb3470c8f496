"""Bootstrap by matrices of weighted sums against resamples that are written out row by row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import resampling as R

MASK = 2**64 - 1


def weight(key, replicate, seed=0):
    """The weight in plain integers."""

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        return z ^ z >> 31

    draw = mix(mix(key & MASK) + (replicate + (seed << 32)) * 0x9E3779B97F4A7C15 & MASK) >> 34
    total, k = math.exp(-1), 0
    while int(total * 2**30) <= draw and k < 20:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_weights_are_poisson():
    keys = np.array([0, 1, -5, 2**62, 123456789])
    got = R.weights(keys, 3, 40)
    assert got.tolist() == [[float(weight(int(k), r, 3)) for r in range(1, 41)] for k in keys]
    w = R.weights(np.arange(4000), 0, 500)
    assert abs(w.mean() - 1) < 0.002 and abs(w.var() - 1) < 0.005 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05
    assert w.max() >= 7
    share = [math.exp(-1) / math.factorial(k) for k in range(7)]
    assert all(abs((w == k).mean() - p) < 0.001 for k, p in enumerate(share))


def test_bootstrap_against_plain_resamples(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("pq"), rng.random() if i % 9 else None) for i in range(90)] + [(5, "p", 0.5), (1000, "r", None)]
    d = spark.createDataFrame(rows, "k bigint, g string, x double").repartition(3)
    got = {r.g: r for r in R.bootstrap(d, F.col("x"), "k", 60, by=["g"]).collect()}
    root = {r.g: r for r in R.bootstrap(d, F.col("x"), "k", 60, by=["g"], sums=lambda x: {"xx": x * x}, statistic=lambda: F.sqrt(F.try_divide("xx", "weight"))).collect()}
    for g in "pq":
        own = [(k, x) for k, h, x in rows if h == g and x is not None]
        draws = [[weight(k, r) for k, _ in own] for r in range(1, 61)]
        means = [sum(w * x for w, (_, x) in zip(ws, own, strict=True)) / sum(ws) for ws in draws]
        roots = [math.sqrt(sum(w * x * x for w, (_, x) in zip(ws, own, strict=True)) / sum(ws)) for ws in draws]
        assert np.allclose([got[g].low, got[g].high, got[g].mean], [*np.percentile(means, [2.5, 97.5]), np.mean([x for _, x in own])]) and got[g].n == len(own)
        assert np.allclose([root[g].low, root[g].high], np.percentile(roots, [2.5, 97.5]))
    assert (got["r"].n, got["r"].mean, got["r"].low) == (0, None, None)
    assert R.bootstrap(d.filter("k < 0"), F.col("x"), "k", 5).first().n == 0


def test_clusters_share_their_weights(spark):
    rows = [(f"c{i % 7}", i % 3 == 0) for i in range(100)]
    d = spark.createDataFrame(rows, "cluster string, hit boolean").withColumn("hit", F.col("hit").cast("double"))
    whole = R.replicate_sums(d, "cluster", {"hit": F.col("hit")}, 500)
    added = R.replicate_sums(d.groupBy("cluster").agg(F.sum("hit").alias("hit"), F.count(F.lit(1)).alias("n")), "cluster", {"hit": F.col("hit"), "n": F.col("n")}, 500)
    a = {r.replicate: (r.hit, r.weight) for r in whole.collect()}
    assert a == {r.replicate: (r.hit, r.n) for r in added.collect()} and len(a) == 501 and a[0] == (34.0, 100.0)


def test_groups_are_handed_on_when_they_are_many(spark, monkeypatch):
    d = spark.range(300).select("id", (F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("x"))
    want = {(r.g, r.replicate): (r.weight, r.x) for r in R.replicate_sums(d, "id", {"x": F.col("x")}, 9, by=["g"]).collect()}
    monkeypatch.setattr(R, "HELD", 1000)
    task = R._adder(["g"], ["_v0"], 0, 9, lambda w, v: np.concatenate([w.sum(0)[:, None], w.T @ v], 1), 2)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"g": [i % 50 for i in range(300)], "_key": list(range(300)), "_v0": [float(i) for i in range(300)]})
    got, parts = {}, list(task([batch.slice(0, 100), batch.slice(100)]))
    for part in parts:
        for r in part.to_pylist():
            w, x = got.get((r["g"], r["replicate"]), (0, 0))
            got[r["g"], r["replicate"]] = (w + r["s0"], x + r["s1"])
    assert got == want and len(parts) > 50


def test_refits_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = 120
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 2 * a - b + 0.5 + rng.normal(size=n) / 5
    rows = [(i, float(a[i]), float(b[i]), float(y[i]), "test" if i % 4 == 0 else "train") for i in range(n)] + [(999, None, 1.0, 1.0, "train")]
    d = spark.createDataFrame(rows, "k bigint, a double, b double, y double, part string").repartition(3)
    features = {"a": F.col("a"), "b": F.col("b")}
    beta = R.fit_replicates(d.filter("part = 'train'"), "k", features, F.col("y"), 25)
    train, test = [i for i in range(n) if i % 4], [i for i in range(n) if i % 4 == 0]
    x = np.stack([a, b, np.ones(n)], 1)
    maes = {"ols": [], "identity": []}
    for r in range(26):
        w = np.sqrt([weight(i, r) if r else 1 for i in train])
        want = np.linalg.lstsq(x[train] * w[:, None], y[train] * w, rcond=None)[0]
        assert np.allclose(beta[r], want)
        v = np.array([weight(i, r, 1) if r else 1 for i in test])
        maes["ols"].append((v * np.abs(y[test] - x[test] @ want)).sum() / v.sum())
        maes["identity"].append((v * np.abs(y[test] - a[test])).sum() / v.sum())
    got = {m.model: m for m in R.model_ladder(d, "k", "part", F.col("y"), {"ols": features}, {"identity": F.col("a")}, 25).collect()}
    for model, found in maes.items():
        assert np.allclose([got[model].mae, got[model].low, got[model].high], [found[0], *np.percentile(found[1:], [2.5, 97.5])])
    assert got["ols"].high < got["identity"].low
