import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, part string, phrase string, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", "clash") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def count(rows, longest):
    found, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    found[lang, tuple(w[i : i + k])] += 1
    return found, totals


def brute(rows, least, longest=5, top=2000, cover=100):
    found, totals = count(rows, longest)
    often = {p: f for p, f in found.items() if f >= least and len(p[1]) >= 2}
    gone = {(lang, w[i : i + k]) for (lang, w), f in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * f >= cover * found[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(1000 * a * totals[lang] // (found[lang, w[:k]] * found[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), found[lang, w[:k]], found[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, totals[lang], -s) for lang, some in out.items() for r, (s, a, p, x, y) in enumerate(sorted(some)[:top], 1))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    rng = random.Random(4)
    words = ["a", "B", "é", "日本", "of", "the", "x-y", "q r", "End", "\x01"]
    rows = []
    for i in range(120):
        w = [rng.choice(words[: rng.choice([3, 10])]) for _ in range(rng.randrange(60))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", ":", " \x0b"]) for x in w)
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows + [("of the end " * 40, "en"), ("of the end " * 40, "en"), (None, "en"), ("", None), ("only", "fr"), (" . ,", "de"), ("New York City. " * 9, "de"), ("new\tyork", "de")]


@pytest.mark.parametrize("least, top, cover, part_bytes", [(5, 2000, 100, 1 << 22), (3, 7, 60, 64)])
def test_against_brute_force(spark, least, top, cover, part_bytes):
    rows = corpus()
    assert got(C.collocations(docs(spark, rows), least, top=top, cover=cover, part_bytes=part_bytes)) == brute(rows, least, top=top, cover=cover) != []


def test_parts_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 50)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "und"], "text": ["one two three. " * 40, "short"]})
    parts = [x for texts, _, _ in C._texts(batch) for x in texts]
    assert len(parts) > 5 and b"".join(parts) == ("one two three. " * 40).encode().translate(C._FOLD) + b"short"


def test_nothing(spark):
    assert C.collocations(docs(spark, [])).count() == 0 and C.collocations(docs(spark, [("a b", "en"), (None, None)])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), max_size=40), max_size=6), st.integers(2, 40), st.booleans())
def test_summaries_keep_every_frequent_key(parts, threshold, at_once):
    exact = Counter()
    for part in parts:
        for k, n in part:
            exact[k] += n
    mass = sum(exact.values())
    s = C.Summary(mass // threshold + 1)
    for part in parts:
        keys, counts = C.added(np.array([k for k, _ in part], np.uint32), np.array([n for _, n in part], np.int64))
        s.add(*C.unpack(C.pack(keys, counts)))
        if not at_once:
            s.settle()
            assert len(s.keys) <= s.capacity
    kept = set(s.survivors(threshold).tolist())
    assert {k for k, n in exact.items() if n >= threshold} <= kept and s.taken * (s.capacity + 1) <= mass and len(kept) <= s.capacity


def test_a_collision_in_the_first_pass_changes_no_count(spark, monkeypatch):
    monkeypatch.setattr(C, "survivors_bitmap", lambda *_: np.full(1 << 14, 2**64 - 1, np.uint64))
    rows = corpus()
    grams, totals = C.phrase_counts(docs(spark, rows), 4)
    found, n = count(rows, 5)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in grams.collect()} == {p: f for p, f in found.items() if f >= 4}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if k in {"en", "de", "und", "fr"}}
