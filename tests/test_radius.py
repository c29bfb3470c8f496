"""Counts within a radius against all pairs, on clouds that need no halving, few and many."""

import random

import pytest

from tessera.operators import discovery as V


def brute(rows, radius):
    pts = sorted({r for r in rows if None not in r})
    near = [(a, b) for i, a in enumerate(pts) for b in pts[i + 1 :] if sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)) ** 0.5 <= radius]
    return len(near), len({p for pair in near for p in pair})


def clouds():
    rng = random.Random(9)
    yield "sparse", [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(300)], 1.0
    yield "one dense cell", [(rng.uniform(0, 0.6), rng.uniform(0, 0.6)) for _ in range(800)], 1.0
    yield "two cells and their border", [(rng.uniform(0.2, 1.9), rng.uniform(0.3, 0.5)) for _ in range(700)] + [(5.0, 5.0)], 1.0
    yield "grid, on the radius", [(float(i), float(j)) for i in range(25) for j in range(25)], 3.0
    yield "repeats and nulls", [(1.0, 1.0)] * 50 + [(1.0, None), (None, None), (-1.0, 1.0), (1.0, 3.5)], 2.0
    yield "three axes", [tuple(rng.gauss(0, 1.2) for _ in range(3)) for _ in range(400)], 1.5
    yield "neighbouring doubles", [(1.0 + k * 2.0**-52, 0.0) for k in range(60)] + [(2.0 + k * 2.0**-51, 0.0) for k in range(60)], 1.0
    yield "none", [], 1.0


@pytest.mark.parametrize("name, rows, radius", list(clouds()), ids=lambda x: x if isinstance(x, str) else "")
def test_against_all_pairs(spark, name, rows, radius):
    columns = ["x", "y", "z"][: len(rows[0]) if rows else 2]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = V.radius_summary(df, columns, radius, leaf=8).first()
    assert (got.pairs, got.touched) == brute(rows, radius)


def test_radius_must_be_positive(spark):
    with pytest.raises(ValueError):
        V.radius_summary(spark.createDataFrame([(0.0,)], "x double"), ["x"], 0.0)
