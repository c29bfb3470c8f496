import array
import os
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


MIXED = st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "b c", "  ", "<|endof"]), max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9.,'\n\t é日 <|endoftext|>"), max_size=40) | MIXED)
def test_ids_equal_the_tokenizers(text):
    assert P.encoder(P.default_vocabulary())(text) == array.array("I", reference([text])[0]).tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(counts):
    segments = P.plan(counts, 32)
    bins = {}
    for s, rank, n, first, per, offset in segments.tolist():
        for i in range(n):
            bins.setdefault(first + i // per, []).append((offset + i % per * s, s))
    assert sum(len(b) for b in bins.values()) == sum(counts.values())
    for b in bins.values():
        at = 0
        for offset, s in sorted(b):
            assert offset == at
            at += s
        assert at <= 32
    total = sum(s * n for s, n in counts.items())
    assert len(bins) <= max(2 * total / 32 + 1, sum(n for s, n in counts.items() if 2 * s > 32) + 1) and set(bins) == set(range(len(bins)))


def test_pack_documents(spark):
    long = "word " * 5000
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (5, long), (5, long), (None, "x"), (6, "<|endoftext|>")]
    got = P.pack_documents(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, piece int"), P.default_vocabulary()).collect()
    ids = {i: [*x, 0] for (i, _), x in zip(rows, reference([t or "" for _, t in rows]), strict=True)}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(array.array("I", part).tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), P.default_vocabulary()).count() == 0
