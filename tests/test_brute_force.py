"""Operators whose queries have no SQL, or whose scalable form differs from the plain one, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.prefix import exact_percentiles, running_sums
from tessera.operators import discovery as V
from tessera.operators import mesh as H
from tessera.operators import pairs as P
from tessera.operators import selection as C
from tessera.operators import stats as T
from tessera.plans import registry
from tessera.plans.sources import pixels_of
from tessera.sources.images import perceptual_hash


def points(rng, n):
    return [(float(rng.choice([0, 1, 50]) + rng.random()), float(rng.random()), float(rng.random() * 0.1)) for _ in range(n)]


def test_nearest(spark):
    rng = random.Random(1)
    cloth = [(g, *p) for g in ("a", "b", "lonely") for p in points(rng, 60)] + [("a", 0.5, 0.5, 0.5)] * 3
    body = [(g, *p) for g in ("a", "b") for p in points(rng, 40)] + [("a", 300.0, 0.0, 0.0), ("a", 300.0, 0.0, 0.0), ("flat", 1.0, 1.0, 1.0)]
    schema = "mesh_id string, x double, y double, z double"
    got = H.nearest_distance(spark.createDataFrame(cloth, schema), spark.createDataFrame(body, schema)).collect()
    assert len(got) == len(cloth)
    for r in got:
        near = [((r.x - x) ** 2 + (r.y - y) ** 2 + (r.z - z) ** 2) ** 0.5 for g, x, y, z in body if g == r.mesh_id]
        assert (r.clearance is None) == (not near) and (not near or abs(r.clearance - min(near)) < 1e-9)


def test_wrinkle(spark):
    rng = random.Random(2)
    rows = [(g, *p) for g, n in (("a", 50), ("b", 9), ("c", 8), ("d", 120)) for p in points(rng, n)]
    got = {r.mesh_id: r.wrinkle for r in H.wrinkle(spark.createDataFrame(rows, "mesh_id string, x double, y double, z double")).collect()}
    for g in "abcd":
        p = np.array([r[1:] for r in rows if r[0] == g])
        off = []
        for i in range(len(p)) if len(p) > 8 else ():
            near = np.argsort(((p - p[i]) ** 2).sum(axis=1), kind="stable")
            near = near[near != i][:8]
            centred = p[near] - p[near].mean(axis=0)
            off.append(abs((p[i] - p[near].mean(axis=0)) @ np.linalg.svd(centred)[2][-1]))
        assert abs(got[g] - (np.mean(off) if off else 0.0)) < 1e-9


@pytest.mark.parametrize("width, limit", [(64, 3), (24, 2), (12, 1)])
def test_hamming_pairs(spark, width, limit):
    rng = random.Random(width)
    base = [rng.getrandbits(width) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(width), rng.randrange(limit + 2))) for b in base for _ in range(3)] + [base[0], 0, (1 << width) - 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b): r.distance for r in V.hamming_pairs(spark.createDataFrame([(x,) for x in signed] + [(None,)], "fp bigint"), "fp", limit, width).collect()}
    distinct = sorted(set(signed))
    want = {(a, b): d for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (d := ((a ^ b) & ((1 << 64) - 1)).bit_count()) <= limit}
    assert got == want and len(want) > 40


def test_greedy_clusters(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(24) for _ in range(12)]
    rows = [(i, rng.choice(base) ^ sum(1 << k for k in rng.sample(range(24), rng.randrange(4)))) for i in range(200)]
    heads, want, counts = [], {}, Counter(f for _, f in rows)
    for _, f in rows:
        if f not in want:
            want[f] = next((h for h in heads if (h ^ f).bit_count() <= 2), f)
            if want[f] == f:
                heads.append(f)
    got = {r.fp: (r.head, r.n) for r in V.greedy_clusters(spark.createDataFrame(rows, "k bigint, fp bigint"), "k", "fp", 2).collect()}
    assert got == {f: (h, counts[f]) for f, h in want.items()}


def test_near_clusters_query(spark, sf):
    signs = sorted((r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    heads, want, counts = [], {}, Counter()
    for _, v in signs:
        f = sum(1 << b for b in range(24) if sum(v[i] for i in range(b, 64, 24)) > 0)
        counts[f] += 1
        if f not in want:
            want[f] = next((h for h in heads if (h ^ f).bit_count() <= 2), f)
            if want[f] == f:
                heads.append(f)
    got = {r.fp: (r.head, r.n) for r in registry.queries()["near_clusters"](spark, sf).collect()}
    assert got == {f: (h, counts[f]) for f, h in want.items()}


def test_group_distances(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(60) for _ in range(4)]
    rows = [(rng.randrange(5), rng.choice(base) ^ sum(1 << k for k in rng.sample(range(60), rng.randrange(6))), rng.randrange(3)) for _ in range(150)] + [(0, base[0], 1)] * 30 + [(None, 1, 1), (1, None, 1)]
    want = Counter()
    differ = Counter()
    known = [r for r in rows if None not in r]
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if a[0] == b[0]:
                d = min(5, (a[1] ^ b[1]).bit_count())
                want[d] += 1
                differ[d] += a[2] != b[2]
    got = {r.distance: (r.pairs, r.different) for r in V.group_distances(spark.createDataFrame(rows, "g int, fp bigint, o int"), "g", "fp", "o").collect()}
    assert got == {d: (n, differ[d]) for d, n in want.items()}


def plain_pilot(rows, size, cap, forced):
    """rows: (key, stratum, shards, score)"""
    taken, used, counts = [], set(), Counter()
    first = [r for r in sorted(rows, key=lambda r: (-r[3], r[0])) if forced(r)]
    for r in first:
        if len(taken) < size and len(used | set(r[2])) <= cap:
            taken.append(r[0])
            used |= set(r[2])
            counts[r[1]] += 1
    while len(taken) < size:
        fit = [r for r in rows if r[0] not in taken and len(used | set(r[2])) <= cap]
        if not fit:
            break
        r = min(fit, key=lambda r: (len(set(r[2]) - used), counts[r[1]], -r[3], r[0]))
        taken.append(r[0])
        used |= set(r[2])
        counts[r[1]] += 1
    return sorted(taken)


def test_stratified_pilot(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), (rng.randrange(9), rng.randrange(9)), float(rng.randrange(20))) for i in range(400)]
    d = spark.createDataFrame([(i, s, *p, v) for i, s, p, v in rows], "k bigint, s string, a int, b int, score double")
    best = {s: min((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[0]))[0] for s in "xyz"}
    got = sorted(r.k for r in C.stratified_pilot(d, "s", ["a", "b"], "k", 12, 6).collect())
    assert got == plain_pilot(rows, 12, 6, lambda r: r[0] in best.values())
    got = sorted(r.k for r in C.stratified_pilot(d, "s", ["a", "b"], "k", 12, 5, forced=F.col("a") == F.col("b")).collect())
    assert got == plain_pilot(rows, 12, 5, lambda r: r[2][0] == r[2][1])


@pytest.mark.parametrize("buckets", [2, 7, 300])
def test_running_sums(spark, buckets):
    rng = random.Random(buckets)
    rows = [(g, v, rng.randrange(9)) for g in "ab" for v in rng.sample(range(1000), 200)]
    got = {(r.g, r.v): r.cum_c for r in running_sums(spark.createDataFrame(rows, "g string, v int, c int"), ["g"], "v", ["c"], buckets).collect()}
    assert got == {(g, v): sum(c for h, w, c in rows if h == g and w <= v) for g, v, _ in rows}


def test_exact_percentiles(spark):
    rng = random.Random(8)
    rows = [(g, float(rng.randrange(30)) if rng.random() < 0.7 else rng.random()) for g in "ab" for _ in range(301)] + [("one", 4.0), ("a", None)]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    shares = (0.0, 0.01, 0.25, 0.5, 0.777, 1.0)
    got = {r.g: list(r)[1:] for r in exact_percentiles(counts, ["g"], "v", "n", shares, [f"p{i}" for i in range(6)]).collect()}
    for g in ("a", "b", "one"):
        assert np.allclose(got[g], [np.percentile([v for h, v in rows if h == g and v is not None], 100 * p) for p in shares])


def test_risk_coverage_with_a_common_score(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.5, 0.5, 0.5, 0.1, 0.9, rng.random()]), rng.random() < 0.6) for i in range(333)]
    got = [(r.coverage, r.selective_accuracy) for r in T.risk_coverage(spark.createDataFrame(rows, "k bigint, s double, ok boolean"), "s", "k", F.col("ok")).orderBy("slot").collect()]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = [(len(left) / 333, sum(r[2] for r in left) / len(left)) for left in (order[at:] for at in range(0, 333, 33))]
    assert np.allclose(got, want)


def test_limited_pairs_of_a_hot_group(spark):
    rng = random.Random(10)
    rows = [("hot", i, rng.random()) for i in range(3000)] + [(f"g{n}", 10_000 + 100 * n + i, rng.random()) for n in range(1, 40) for i in range(n)] + [(None, 5, 0.1)]
    want = set()
    for g in {r[0] for r in rows if r[0]}:
        m = [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))]
        if len(m) <= 6:
            want |= {(a, b) for k, a in enumerate(m) for b in m[k + 1 :]}
        else:
            want |= set(list(zip(m, m[1:], strict=False))[:32])
            if len(m) - 1 < 32:
                want.add((m[0], m[-1]))
    d = spark.createDataFrame(rows, "g string, id bigint, ease double")
    assert {(r.a, r.b) for r in P.limited_pairs(d, ["g"], ("ease", "id")).collect()} == want
    assert {(r.a.id, r.b.id) for r in P.limited_pairs(d, ["g"], ("ease", "id"), whole=True).collect()} == want


def test_perceptual_hashes(spark, sf):
    def plain(pixels):
        grey = pixels.astype(float)
        n, m = grey.shape
        ys, xs = [int(i * n / 32) for i in range(33)], [int(i * m / 32) for i in range(33)]
        small = [[grey[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean() for j in range(32)] for i in range(32)]
        low = [sum(small[y][x] * np.cos((2 * y + 1) * u * np.pi / 64) * np.cos((2 * x + 1) * v * np.pi / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        middle = np.median(low[1:])
        return sum(1 << (63 - i) for i, v in enumerate(low) if v > middle)

    rng = np.random.default_rng(0)
    for shape in ((8, 8), (40, 70), (33, 5), (100, 64)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert perceptual_hash(np.repeat(pixels[..., None], 3, axis=2)) == plain(pixels)
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(300).collect()}
    got = {r.vec_id: r.phash for r in registry.queries()["image_hashes"](spark, sf).collect()}
    for i in list(vectors)[:6]:
        assert got[i] == (None if i % 13 == 0 or i % 11 == 0 or i % 7 == 0 else f"{plain(pixels_of(vectors[i])):016x}")


@pytest.mark.parametrize("name", ["pca_ridge", "decision_classifier", "boosted_trees"])
def test_learner_queries(spark, sf, name, monkeypatch):
    """On the given tables; ``test_trends`` holds the learners against a constant and numpy where there is something to learn."""
    if name == "boosted_trees":
        real = registry.learning.M.boosted
        monkeypatch.setattr(registry.learning.M, "boosted", lambda *a, **k: real(*a, **k | {"trees": 20}))
    got = {r.part: r for r in registry.queries()[name](spark, sf).collect()}
    assert set(got) == {"train", "test"} and all(r.n > 0 for r in got.values())
    if name == "boosted_trees":
        spread = registry.learning._rows(spark, sf).filter("part = 'test'").select(F.stddev("ease")).first()[0]
        assert got["test"].rmse < 0.9 * spread
    elif name == "decision_classifier":
        top = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().select(F.max("count") / F.sum("count")).first()[0]
        assert got["train"].accuracy >= top - 0.02
    else:
        assert 0 < got["train"].rmse <= got["test"].rmse * 1.1
