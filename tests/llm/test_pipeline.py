import array
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tessera.llm import language_id as L
from tessera.llm import packing as P
from tests.llm.test_near import components, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, _row int, _gone string, spans string, tokens int, _text string"


def stage(name):
    return dict(C.STAGES)[name]


@pytest.fixture(scope="module")
def edge(spark, sf):
    """Documents of the smallest table, and nulls, empty and long texts, repeated rows, ties and names that clash."""
    given = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = " ".join(f"the word number {i} stands here and there" for i in range(4000))
    more = [
        (9000, None, "en", "s", None), (9001, "", "en", None, 0), (9002, " \t", None, "s", 2), (9003, long, "en", "s", len(long)), (9003, long, "en", "s", len(long)), (9004, long + " end", "en", "s", len(long) + 4),
        (None, "a text without an id, which nobody can name", "en", "s", 44), (None, "a text without an id, which nobody can name", "en", "s", 44), (9005, "the tie of the two texts is here", "en", "s", 32), (9006, "the tie of the  two texts is here", "en", "s", 33),
        (9007, "the tie of the two  texts is here", "en", "s", 33), (9008, "one text of this id", "en", "s", 19), (9008, "another text of this id", "en", "s", 23), (9009, "my password = hunter2hunter2hunter2 and token: abcdefghijklmnopqrst", "en", "s", 66),
    ]
    return spark.createDataFrame([(*r, 1, "gone", "spans", 2, "text") for r in given + more], SCHEMA).cache(), given + more


def test_language(spark, edge):
    docs, rows = edge
    model = L.fit(docs)
    want = sorted(str((i, t)) for i, t, *_ in rows if (s := model.score(t))[0] != L.UNKNOWN and s[1] >= model.threshold)
    got = stage("language")(spark, docs, "")
    assert got.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in got.collect()) == want
    assert len(want) >= len(rows) - 8 and not {"9000", "9001", "9002"} & {w[1:5] for w in want}


def test_exact_copies(spark, edge):
    docs, rows = edge
    groups = {}
    for i, t, *_ in rows:
        if i is not None:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i, t))
    got = stage("exact_copies")(spark, docs, "")
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and sorted(str(k) for k in kept if k[0] is not None) == sorted(str(min(g, key=lambda x: x[:2])[1:]) for g in groups.values())
    assert sum(k[0] is None for k in kept) == 2 and (9006, "the tie of the  two texts is here") in kept


def test_near_copies(spark, edge):
    docs, rows = edge
    docs, rows = docs.filter("doc_id IS NULL OR doc_id <> 9008"), [r for r in rows if r[0] != 9008]
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None and (t or "").split()}
    root = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = sorted(str((i, t)) for i, t, *_ in rows if i is None or root.get(i, i) == i)
    got = stage("near_copies")(spark, docs, "")
    assert got.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in got.collect()) == want


def test_secrets(spark, edge):
    docs, rows = edge
    got = stage("secrets")(spark, docs, "")
    out = [(r.doc_id, r.text, r.n_chars, r._row, r._gone, r.spans) for r in got.collect()]
    assert got.columns == docs.columns and len(out) == len(rows) and all(o[3:] == (1, "gone", "spans") for o in out)
    named = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}""")
    by = {}
    for i, t, _, _, n in rows:
        by.setdefault(i, []).append((t, n))
    assert not any(named.search(t or "") for _, t, *_ in out) and any(named.search(r[1] or "") for r in rows)
    for i, t, n, *_ in out:
        if "[secret]" not in (t or ""):
            assert (t, n) in by[i]
        else:
            parts = t.split("[secret]")
            assert n == len(t) and any(re.fullmatch("(?s:.+)".join(map(re.escape, parts)), w or "") for w, _ in by[i])


def test_packing(spark, edge):
    docs, rows = edge
    encode = P.encoder(P.default_vocabulary())
    whole = {}
    for i, t, *_ in rows:
        whole.setdefault(i, []).append(list(array.array("I", encode(t or ""))) + [0])
    got = stage("packing")(spark, docs, "").collect()
    assert sum(r.length for r in got) == sum(len(x) for xs in whole.values() for x in xs)
    bins = {}
    for r in got:
        assert any(zlib.crc32(array.array("I", x[r.start : r.start + r.length]).tobytes()) == r.ids_crc32 for x in whole[r.doc_id])
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0]
        for offset, length in sorted(b):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = C.run(spark, sf)
    assert got.select("doc_id").distinct().join(docs, "doc_id", "left_anti").isEmpty() and got.agg(F.max("length")).first()[0] <= 2048
    assert 0.9 * docs.select("text").distinct().count() < got.select("doc_id").distinct().count() <= docs.count()


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, f in C.STAGES:
        docs = C.materialize(f(spark, docs, sf), name)
    assert docs.count() == 0
