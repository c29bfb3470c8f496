"""Packing of tokenised documents into sequences: large-item matching, then best fit for the gaps.

Items are interchangeable when they are equally long, so the plan is made on the histogram of lengths, which has at
most ``capacity`` rows whatever the corpus: pieces above a third of the capacity go at most two to a bin and are
matched greedily (the longest with the longest that still fits); the shorter ones, from long to short, each go where
the gap is tightest.  The plan is a short list of segments "of the pieces of length s, those with rank r .. go to
bins b ..", so every piece finds its bin from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, text_or_empty

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are ranked in lots of about so many, however many there are.
LOT_ROWS = 1000
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 300_000

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary (a tokenizers json file), as little-endian unsigned 32-bit bytes.

    A single space that stands between two other characters always begins a new pre-token, so a text without two
    spaces in a row is the concatenation of its space-led words, whose ids are remembered.  Added tokens of the
    vocabulary, such as its end mark, have their own id wherever a text holds them, and what stands between them is
    encoded on its own.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, added = said["model"]["vocab"], said.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: array.array("I", [t["id"]]).tobytes() for t in added}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and token not in self.added}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array.array("I", self.encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if x in self.added else self._plain(x) for x in self.mark.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if "  " in text or not text:
            return self._ids(text)
        first, *rest = text.split(" ")
        words = self.words
        while True:
            try:
                return self._ids(first) + b"".join(map(words.__getitem__, rest))
            except KeyError:
                if len(words) > CACHED_WORDS:
                    words.clear()
                new = {w: self._ids(" " + w) for w in set(rest) if w not in words}
                if len(new) > CACHED_WORDS:
                    return self._ids(text)
                words |= new


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with ``with_ids`` also ids (array<int>), of each document's pieces.

    A document is its ids and ``end_id``.  Only those longer than ``capacity`` are cut, into full pieces from the end,
    so that the first piece takes the rest.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    fields += [("ids", "array<int>")] * with_ids
    end = array.array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, cols = [], [[] for _ in fields[1:]]
            for r, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n - at - 1) % capacity + 1)
                    part = ids[4 * at : 4 * to]
                    rows.append(r)
                    for c, v in zip(cols, (k, at, to - at, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None), strict=False):
                        c.append(v)
                    at, k = to, k + 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], [n for n, _ in fields])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Segments (length, first rank, pieces, first bin, per bin, offset), sorted by length and first rank.

    ``counts``: number of pieces of each length.  Piece ``first rank + i`` of a length goes to bin
    ``first bin + i // per bin`` at ``offset + (i % per bin) * length``.
    """
    left = {s: n for s, n in counts.items() if n}
    used: dict[int, int] = dict.fromkeys(left, 0)
    segments: list[tuple[int, ...]] = []
    bins = 0
    # gap -> [(first bin, number of bins)]; bins of one entry are filled alike
    open_bins: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in open_bins:
                open_bins[gap] = []
                insort(gaps, gap)
            open_bins[gap].append((first, n))

    def place(s: int, n: int, first: int, per: int, offset: int) -> None:
        segments.append((s, used[s], n, first, per, offset))
        used[s] += n
        left[s] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, min(a, capacity - a) + 1) - 1
        while k >= 0 and left[large[k]] < (2 if large[k] == a else 1):
            k -= 1
        if k < 0:
            n = left[a]
            place(a, n, bins, 1, 0)
            leave(capacity - a, bins, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, bins, 1, 0)
            place(b, n, bins, 1, a)
            leave(capacity - a - b, bins, n)
        bins += n
        large = [s for s in large if left[s]]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                n = -(-left[s] // (capacity // s))
                leave(capacity, bins, n)
                bins += n
                continue
            gap = gaps[k]
            first, n = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[k]
            per = min(gap // s, left[s])
            take = min(n, left[s] // per)
            place(s, take * per, first, per, capacity - gap)
            leave(gap - per * s, first, take)
            leave(gap, first + take, n - take)
    return np.array(sorted(segments), np.int64).reshape(-1, 6)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (doc_id, piece, length <= capacity, ...).

    Only the histogram of lengths, ``capacity`` rows, reaches the driver.  Pieces of one length are ranked in lots of
    about ``LOT_ROWS``, and a running sum over the sizes of the lots makes the ranks those of the whole length.
    """
    rows = materialize(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    shared = parts.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    lots = parts.sparkSession.createDataFrame([(s, -(-n // LOT_ROWS)) for s, n in sorted(counts.items())], "length bigint, _lots bigint")
    marked = rows.join(F.broadcast(lots), "length").withColumn("_lot", F.pmod(F.xxhash64("_row"), F.col("_lots")))
    sizes = marked.groupBy("length", "_lot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_lot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_lot").orderBy("_row")))
    ranked = ranked.join(bases, ["length", "_lot"]).withColumn("_rank", F.col("_base") + F.col("_rank") - 1)

    columns = parts.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = shared.value
        starts = segments[:, 0] << 44 | segments[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            s = segments[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            i = rank - s[:, 1]
            found = [pa.array(s[:, 3] + i // s[:, 4]), pa.array(s[:, 5] + i % s[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(look_up, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is the single id ``end_id``.  A very long text is encoded whole and cut into pieces;
    pieces of one length are interchangeable, so ties change only which sequence holds which.  Rows that repeat a doc_id are packed as they come;
    an empty table gives an empty result; other columns are not read.
    """
    return pack(pieces(docs, vocabulary, capacity, end_id), capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), default_vocabulary())
