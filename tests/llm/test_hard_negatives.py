import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, score string, v string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**31), st.sampled_from([1, 2, 7, 16]))
def test_strassen_against_the_plain_product(m, k, n, seed, leaf):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**24), 2**24, (m, k)), rng.integers(-(2**24), 2**24, (k, n))
    assert (H.strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    s = rng.integers(-5, 5, (3, 90))
    ids = np.sort(rng.integers(0, 40, 90))
    for cuts in ([0, 90], [0, 2, 30, 31, 90]):
        heaps = H.Heaps(3, 5)
        parts = list(zip(cuts, cuts[1:], strict=False))
        for lo, hi in parts[::-1]:
            heaps.push(0, s[:, lo:hi].copy(), ids[lo:hi], np.arange(lo, hi))
        for i in range(3):
            want = sorted((-int(s[i, j]), int(ids[j]), j) for j in range(90))[:5]
            assert [(-int(a), int(b), int(c)) for a, b, c in zip(heaps.score[i], heaps.id[i], heaps.row[i], strict=True)] == want


def brute(rows, positives=5, negatives=5, low=80, high=100):
    part = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        e = [float(np.float32(x)) for x in e]
        part.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for at, (i, label, v) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, lab) for k, (j, lab, w) in enumerate(part) if k != at]
        for p, pid, _ in sorted((x for x in scored if x[2] == label), key=lambda x: (-x[0], last(x[1])))[:positives]:
            window = sorted((x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p), key=lambda x: (-x[0], last(x[1])))[:negatives]
            out += [(i, pid, r, n, p, s) for r, (s, n, _) in enumerate(window, 1)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "clash", "clash", "clash") for i, e, label in rows], SCHEMA).repartition(5)


def got(spark, rows, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = H.whole_vectors(table(spark, rows), label)
    found = H.hard_negatives(vectors, F.col("vec_id") % 100 == 0, **options)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"group": 2, "tile": (3, 37)}])
def test_against_brute_force(spark, options):
    rng = random.Random(2)
    base = [[rng.gauss(0.1, 0.2) for _ in range(50)] for _ in range(30)]
    rows = [(i * 10, [x + rng.gauss(0, 0.05) for x in base[i % 30]], rng.randrange(3)) for i in range(260)]
    rows += [(100, base[0], 1), (None, base[1], 0), (None, base[1], 1), (7, base[2], 9), (7, base[2], 9), (14, base[2][:20], 1), (500, [], 1), (600, base[3] + [0.5], 2), (605, base[3] + [0.5], 0)]
    rows += [(700, None, 1), (701, [float("nan")] * 50, 1), (702, [1.0, None] * 25, 0), (703, [float("inf")] * 50, 2), (704, base[4], None)]
    assert got(spark, rows, **options) == brute(rows) != []


def test_ties_few_rows_and_nothing(spark):
    same = [(i, [0.5, 0.25], i % 2) for i in range(0, 60, 5)] + [(100, [0.5, 0.25], 0)]
    assert got(spark, same) == brute(same)
    assert got(spark, [(0, [0.5], 1)]) == [] and got(spark, [(5, [0.5], 1), (6, [0.5], 2)]) == [] and got(spark, [(None, None, None)]) == []
    assert got(spark, [(100, [-1.0], 1), (2, [1.0], 1), (3, [1.0], 2)]) == []


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        H.scores(np.full((1, 2), 2**30), np.full((1, 2), 2**30))


def test_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(H.ORACLE_SQL["op11_hard_negatives"]).df()
    result = H.op11_hard_negatives(spark, sf).toPandas()[list(want.columns)]
    by = ["anchor_id", "positive_id", "rank"]
    assert (result.sort_values(by).to_numpy() == want.sort_values(by).to_numpy()).all() and len(want) == len(result) > 0
