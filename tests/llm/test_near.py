import random

import numpy as np
import xxhash

from tessera.llm import near_copies as N
from tessera.llm import simhash as S

SCHEMA = "doc_id bigint, text string, fp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, int), 0
    for i in range(max(1, len(words) - 2)):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42)
        ones += [h >> k & 1 for k in range(64)]
        n += 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > n)


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def texts(n, seed=0):
    rng = random.Random(seed)
    base = ["w%d" % rng.randrange(400) for _ in range(300)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(300)] = "new%d" % rng.randrange(9)
        out.append(" ".join(t))
    return out


def test_covering_masks_cover():
    masks = S.covering_masks(list(range(64)))
    rng = random.Random(5)
    for _ in range(2000):
        diff = sum(1 << p for p in rng.sample(range(64), 3))
        assert any(not diff & m for m in masks)
    assert all(28 <= m.bit_count() <= 36 for m in masks)


def test_groups_against_brute_force(spark):
    rows = list(enumerate(texts(60) + ["", None, "  ", "One", "one two", "x " * 50_000])) + [(5, texts(60)[5])]
    for limit in (2000, 3):
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs(spark, rows), bucket_limit=limit).collect()}
        fps = {i: fingerprint(t) for i, t in rows}
        assert {i: f for i, (f, _) in got.items()} == fps
        assert {i: c for i, (_, c) in got.items()} == components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def test_very_long_words(spark):
    rows = [(1, "x" * 300_000), (2, "x" * 300_000), (3, "y" * 300_000 + " z"), (4, "ab " * 3 + "w" * 100_000)]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs(spark, rows)).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: fingerprint(t) for i, t in rows} and got[2][1] == 1 and got[3][1] == 3
    assert {r.doc_id for r in N.drop_near_copies(docs(spark, rows)).collect()} == {1, 3, 4}


def test_nothing_and_null_ids(spark):
    assert S.near_duplicates(docs(spark, [])).count() == 0
    got = S.near_duplicates(docs(spark, [(None, "a b c"), (4, "a b c"), (None, "other words here")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "None"]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in S.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(65)}, 100: 100, 101: 100}


def test_near_copies_of_four_fifths(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, copies = [], set()
    for g in range(20):
        t = [word() for _ in range(200)]
        rows.append((10 * g, " ".join(t)))
        for k in (1, 2):
            u = list(t)
            u[rng.randrange(200)] = word()
            rows.append((10 * g + k, " ".join(u)))
            copies.add(10 * g + k)
        half = t[:100] + [word() for _ in range(100)]
        rows.append((10 * g + 5, " ".join(half)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "one two")]
    kept = [r.doc_id for r in N.drop_near_copies(docs(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in rows if i not in copies)
    assert N.drop_near_copies(docs(spark, [])).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(words, shape, new):
    """A copy of similarity just above 0.8: of n shingles, about n / 5 are added or cut, or n / 9 replaced."""
    n = max(1, len(words) - 4)
    tail = [new() for _ in range(int(0.24 * n))]
    return {
        "appended": words + tail, "prepended": tail + words, "truncated": words[: len(words) - int(0.19 * n)], "beheaded": words[int(0.19 * n) :],
        "replaced": words[: n // 2] + [new() for _ in range(max(1, int(0.105 * n) - 4))] + words[n // 2 + max(1, int(0.105 * n) - 4) :],
    }[shape]


SHAPES = ["appended", "prepended", "truncated", "beheaded", "replaced"]


def test_near_copies_of_any_shape(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, close = [], set()
    for n in (12, 30, 60, 200, 600):
        for shape in SHAPES * 4:
            a = [word() for _ in range(n)]
            b = edited(a, shape, word)
            i = 10 * len(rows)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
            if len(x & y) >= 0.8 * len(x | y):
                close.add(i + 1)
    assert len(close) > 70
    met = {}
    for r in N.candidates(N.describe(docs(spark, rows))).collect():
        met.setdefault(r.bucket, set()).add(r.doc_id)
    assert close <= {i for i in close if any({i - 1, i} <= m for m in met.values())}
    kept = {r.doc_id for r in N.drop_near_copies(docs(spark, rows)).collect()}
    assert not close & kept and {i for i, _ in rows if i not in close} <= kept


def test_near_copies_of_a_table_against_brute_force(spark):
    """Every document of the table that brute force removes goes, and no other: sets of up to 1,024 shingles are exact."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect() if r.text and r.text.split()]
    sets = {i: shingles(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    close = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    root = components(sorted(sets), lambda a, b: (a, b) in close or (b, a) in close)
    got = {r.doc_id for r in N.drop_near_copies(d).collect()}
    assert {i for i in sets if i not in got} == {i for i, r in root.items() if i != r} and len(close) > 10


def test_long_texts_are_compared_by_their_small_hashes():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    a = [word() for _ in range(9000)]
    texts = [a, a[:8000] + [word() for _ in range(1000)], a[:6000] + [word() for _ in range(3000)], a[:500]]
    found = [N._describe(" ".join(t).encode(), 5, 2, 1024)[2] for t in texts]
    assert all(len(f) <= 4 * 1025 for f in found) and np.frombuffer(found[0], "<u4")[0] >= 3
    assert N._forest(np.arange(4), found, 0.7) == [(0, 1)]
    assert N._forest(np.arange(4), found, 0.4) == [(0, 1), (0, 2)]
    assert N._forest(np.arange(4), [N._describe(" ".join(t).encode(), 5, 2, 1 << 20)[2] for t in texts], 0.8) == [(0, 1)] * (len(shingles(" ".join(a)) & shingles(" ".join(texts[1]))) >= 0.8 * len(shingles(" ".join(a)) | shingles(" ".join(texts[1]))))


def test_large_buckets_are_split(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(300)]
    put = lambda t: t[: (at := rng.randrange(300))] + [word()] + t[at + 1 :]
    rows = [" ".join(put(base)) for _ in range(120)] + [" ".join(base).upper()] * 30
    for _ in range(12):  # away from the others, and near one another
        side = [w if i % 24 else word() for i, w in enumerate(base)]
        rows += [" ".join(side), " ".join(put(side))]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    sets = [shingles(t) for _, t in rows]
    want = components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    described = N.materialize(N.describe(docs(spark, rows)), "described")
    for limit in (10, 2000):
        largest = N.candidates(described, bucket_limit=limit).groupBy("bucket").count().agg({"count": "max"}).first()[0]
        assert largest <= 40 if limit == 10 else largest > 60
        kept = {r.doc_id for r in N.drop_near_copies(docs(spark, rows), bucket_limit=limit).collect()}
        assert kept == set(want.values())
