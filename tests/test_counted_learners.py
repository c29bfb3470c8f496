"""Learners over counted rows: as many rows again must not cost as much again, nor change what is learnt."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import perceptron as N


def test_gradient_of_counted_rows_against_differences():
    r = np.random.default_rng(1)
    layers = [3, 5, 4, 3]
    x, y, n, w = r.normal(size=(7, 3)), r.integers(0, 3, 7), r.integers(1, 5, 7).astype(float), N.start(layers, 2)
    loss, gradient = N.loss_and_gradient(x, y, n, w, layers)
    many = np.repeat(np.arange(7), n.astype(int))
    assert np.isclose(loss, N.loss_and_gradient(x[many], y[many], np.ones(len(many)), w, layers)[0])
    for i in range(0, len(w), 5):
        d = np.zeros(len(w))
        d[i] = 1e-6
        slope = (N.loss_and_gradient(x, y, n, w + d, layers)[0] - N.loss_and_gradient(x, y, n, w - d, layers)[0]) / 2e-6
        assert np.isclose(slope, gradient[i], atol=1e-5)


def grid(spark, copies):
    d = spark.range(400 * copies).select((F.col("id") % 400).alias("i"))
    a, b = (F.col("i") % 20).cast("double"), F.floor(F.col("i") / 20).cast("double")
    action = F.when(F.col("i") % 97 == 0, F.lit(None)).when(a + b > 24, "high").when(a + b < 14, "low").otherwise("mid")
    return d.select(a.alias("a"), b.alias("b"), (3 * a - b + F.col("i") % 3).alias("y"), action.alias("action"), F.when(F.col("i") % 4 == 0, "test").otherwise("train").alias("part"))


def test_copies_of_rows_change_no_decision(spark):
    seen = []
    real = N.summed

    def watched(counts, *a):
        seen.append(counts.count())
        return real(counts, *a)

    try:
        N.summed = watched
        one, ten = ({r.part: r for r in M.decisions(grid(spark, k), ["a", "b"], "action", "part").collect()} for k in (1, 10))
    finally:
        N.summed = real
    assert seen == [300, 300]
    assert {p: r.n * 10 for p, r in one.items()} == {p: r.n for p, r in ten.items()}
    assert all(abs(one[p].accuracy - ten[p].accuracy) < 0.03 and one[p].accuracy > 0.85 for p in one)


def test_copies_of_rows_change_no_tree(spark):
    one, ten = ({r.part: r for r in M.boosted(grid(spark, k), ["a", "b"], "y", "part", trees=10).collect()} for k in (1, 10))
    for p in ("train", "test"):
        assert ten[p].n == 10 * one[p].n
        assert abs(one[p].mae - ten[p].mae) < 1e-9 and abs(one[p].rmse - ten[p].rmse) < 1e-9
