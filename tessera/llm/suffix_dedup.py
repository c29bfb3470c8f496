"""Removal of long repeated passages with enhanced suffix arrays and their common-prefix interval trees.

Every string of ``least`` bytes is owned by the smallest-hashed ``KMER``-gram inside it (leftmost on ties), which its
bytes alone decide, so equal strings have equal owners.  The starts that an occurrence of an owner has form a run; the
run with the ``least`` bytes behind its last start is a context.  Contexts of owners that occur once are dropped, equal
contexts are counted, and the distinct contexts of an owner meet in one task.  There the suffixes at the owned starts
are put in an order that keeps equal prefixes together (by the name of their first ``least`` bytes, then byte by
byte), neighbours get their common prefix lengths, and a stack scan walks the tree of common-prefix intervals.  An
interval whose occurrences have different left neighbours, or whose run begins there, cannot be extended to the left:
it is a maximal repeat, and comes out with all its occurrences.

A hot owner - over ``context_limit`` distinct contexts - is split: its runs are cut in four and keyed by the bytes
that all starts of a part share, again and again if need be, down to single starts, whose strings are then equal or
not.  Nothing is capped or sampled on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, slices, text_or_empty, utf8_rows

LEAST = 400
KMER = 128
#: Distinct contexts of one owner that one task takes, and bytes of contexts that are searched together.
CONTEXT_LIMIT = 200
CHUNK_BYTES = 4 << 20
#: Places share 64 bits with hashes, so texts are read in pieces of so many bytes that all places fit.
_POSITION = np.uint64((1 << 24) - 1)
PIECE = 8 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def names(x: np.ndarray, length: int, h: np.ndarray | None = None, known: int = 1) -> np.ndarray:
    """64-bit names of the ``length`` bytes from each place (a power of two times ``known``), by doubling."""
    if h is None:
        h = _mix(x.astype(np.uint64) + np.uint64(0x51ED270B))
    while known < length:
        h = _mix(h[:-known] * np.uint64(0xD1B54A32D192ED03 + 2 * known) + h[known:])
        known *= 2
    return h


def long_names(h: np.ndarray, known: int, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes from ``at``, where known <= length <= 2 * known, from overlapping halves."""
    return _mix(h[at] * np.uint64(0x2545F4914F6CDD1D) + h[at + length - known])


def _power(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def owned_runs(texts: list[bytes], least: int = LEAST, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, owner's place, owner's name, context's name) of every run of the texts.

    Over ``PIECE`` bytes, each text is read in pieces that overlap by ``least - 1`` bytes, so that each has its starts
    whole and its places fit ``_POSITION``; a run that a cut went through is put together again.
    """
    if PIECE + least > int(_POSITION):
        raise ValueError(f"strings of {least} bytes are too long for places of {int(_POSITION).bit_length()} bits")
    if sum(map(len, texts)) <= PIECE:
        pieces = [(0, 0, texts)]
    else:
        pieces = [(k, at, [t[at : at + PIECE + least - 1]]) for k, t in enumerate(texts) for at in range(0, len(t) - least + 1, PIECE)]
    found = [_piece_runs(some, least, kmer) for _, _, some in pieces]
    shift = lambda i, by: np.concatenate([np.zeros(0, np.int64), *(f[i] + p[by] for p, f in zip(pieces, found, strict=True))]).astype(np.int64)
    whose, first, last, owner = shift(0, 0), shift(1, 1), shift(2, 1), shift(3, 1)
    name, head, tail = (np.concatenate([np.zeros(0, np.uint64), *(f[i] for f in found)]) for i in (4, 5, 6))
    cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (whose[1:] != whose[:-1])])[: len(whose)]
    end = np.concatenate([cut[1:], [True]])[: len(whose)]
    whose, first, owner, name, head, last, tail = whose[cut], first[cut], owner[cut], name[cut], head[cut], last[end], tail[end]
    context = _mix(head * np.uint64(3) + tail + (last - first).astype(np.uint64))
    return whose, first, last, owner, name.view(np.int64), context.view(np.int64)


def _piece_runs(texts: list[bytes], least: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, owner's place, owner's name, names of the strings at first and last)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not (sizes >= least).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    x = np.frombuffer(b"".join(texts), np.uint8)
    h = names(x, kmer)
    window = least - kmer + 1
    low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (window - span)], low[window - span :]) if window > span else low
    begin = np.cumsum(sizes) - sizes
    usable = np.maximum(sizes - least + 1, 0)
    text = np.repeat(np.arange(len(texts)), usable)
    start = np.arange(len(text)) - np.repeat(np.cumsum(usable) - usable, usable) + begin[text]
    owner = (low[start] & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
    first, last = start[cut], start[np.concatenate([cut[1:], [len(start)]]) - 1]
    half = _power(least)
    g = names(x, half, h, kmer)
    whose = text[cut]
    return whose, first - begin[whose], last - begin[whose], owner[cut] - begin[whose], h[owner[cut]], long_names(g, half, first, least), long_names(g, half, last, least)


def interval_tree(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the maximal repeats of a suffix array: intervals of depth >= least, deepest first.

    ``lcp[i]``: common prefix of suffixes i - 1 and i.  ``left[i]``: the byte before suffix i, or a negative number of
    its own where the suffix cannot be followed to the left, which differs from any other.
    """
    n = len(left)
    # depth, first suffix, left byte shared by all suffixes so far (None: they differ)
    stack: list[list] = []
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        begin, shared = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            d, begin, inner = stack.pop()
            shared = inner if inner == shared and shared is not None and shared >= 0 else None
            if d >= least and shared is None:
                yield begin, i - 1, d
        if depth >= least:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                top[2] = top[2] if top[2] == shared and shared is not None and shared >= 0 else None
            else:
                stack.append([depth, begin, shared])


def repeats(contexts: list[bytes], starts: list[int], least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(context number, from, to, name of the repeat) for the deepest maximal repeat of each suffix that has one.

    ``starts[c]``: context c owns the suffixes at its first ``starts[c]`` places.
    """
    x = np.frombuffer(b"".join(contexts), np.uint8)
    sizes, owned = np.array([len(c) for c in contexts]), np.array(starts)
    begin = np.cumsum(sizes) - sizes
    half = _power(least)
    g = names(x, half)
    context = np.repeat(np.arange(len(contexts)), owned)
    at = np.arange(len(context)) - np.repeat(np.cumsum(owned) - owned, owned)
    place = at + begin[context]
    name = long_names(g, half, place, least)
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    edge = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    many = np.flatnonzero(np.diff(edge) > 1)
    # A group all of whose suffixes have one left byte is part of a longer repeat: nothing to do for it here.
    before = np.where(at > 0, x[place - 1].astype(np.int64), -1 - context)[order]
    low, high = np.minimum.reduceat(before, edge[:-1])[many], np.maximum.reduceat(before, edge[:-1])[many]
    out = []
    for g0, g1 in zip(edge[:-1][many][(low != high) | (low < 0)].tolist(), edge[1:][many][(low != high) | (low < 0)].tolist(), strict=True):
        group = order[g0:g1]
        rest = [contexts[c][p + least :] for c, p in zip(context[group].tolist(), at[group].tolist(), strict=True)]
        if all(r == rest[0] for r in rest):
            depth = least + len(rest[0])
            out += [(c, p, p + depth, int(name[group[0]])) for c, p in zip(context[group].tolist(), at[group].tolist(), strict=True)]
            continue
        rank = sorted(range(len(rest)), key=rest.__getitem__)
        lcp = [0] + [least + _common(rest[a], rest[b]) for a, b in zip(rank, rank[1:], strict=False)]
        lefts = before[g0:g1].tolist()
        seen: set[int] = set()
        for a, b, depth in interval_tree(lcp, [lefts[i] for i in rank], least):
            for i in range(a, b + 1):
                if i not in seen:
                    seen.add(i)
                    k = group[rank[i]]
                    out.append((int(context[k]), int(at[k]), int(at[k]) + depth, int(name[group[0]]) ^ depth))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


#: ``key`` brings contexts together: the owner's name, or what the starts of a part share.  A context is known by
#: ``owner`` and ``ctx``; its row holds the starts off .. off + starts - 1 of it; ``anchor`` is the owner's place.
_CONTEXT = "key bigint, owner bigint, ctx bigint, off int, starts int, anchor int, many boolean, bytes binary"
_COLUMNS = [c.split()[0] for c in _CONTEXT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
_FOUND = "owner bigint, ctx bigint, s int, e int, repeat bigint"


def _steps(least: int) -> list[int]:
    """Widths of the parts that hot owners are split into, each a quarter of the one before; the last is one start.

    The first is at most a third of ``least``, so that the starts of a part share most of their bytes.
    """
    steps = [1 << ((max(3, least) // 3).bit_length() - 1)]
    while steps[-1] > 1:
        steps.append(max(1, steps[-1] // 4))
    return steps


def _search(rows: DataFrame, least: int) -> DataFrame:
    """Repeats among the contexts of each key; rows of a key come together, several small keys share one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        weight, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "owner", "ctx", "off", "starts", "bytes")), strict=True):
                if row[0] != last and weight > CHUNK_BYTES:
                    yield found(list(held.values()))
                    held, weight = {}, 0
                last = row[0]
                if row[:4] not in held:
                    held[row[:4]] = row
                    weight += len(row[5])
        if held:
            yield found(list(held.values()))

    def found(held: list[tuple]) -> pa.RecordBatch:
        out = repeats([r[5] for r in held], [r[4] for r in held], least)
        out = [(held[c][1], held[c][2], held[c][3] + s, held[c][3] + e, n - (1 << 64) if n >> 63 else n) for c, s, e, n in out]
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["owner", "ctx", "s", "e", "repeat"])

    ordered = rows.select("key", "owner", "ctx", "off", "starts", "bytes").repartition("key").sortWithinPartitions("key", "owner", "ctx", "off")
    return ordered.mapInArrow(run, _FOUND)


def _parts(rows: DataFrame, step: int, least: int) -> DataFrame:
    """Contexts cut at multiples of ``step`` before their owner; a part's key names what all its starts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = []
            for _, owner, ctx, off, starts, anchor, many, raw in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
                for block in range((anchor - off - starts + 1) // step, (anchor - off) // step + 1):
                    a, b = max(off, anchor - block * step - step + 1), min(off + starts, anchor - block * step + 1)
                    shared = raw[anchor - block * step - off : anchor - block * step - step + 1 + least - off]
                    key = xxh64_intdigest(shared, owner ^ block & 0xFFFFFFFF)
                    out.append((key - (1 << 64) if key >> 63 else key, owner, ctx, a, b - a, anchor, many, raw[a - off : b - 1 + least - off]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 8, _TYPES, strict=True)], _COLUMNS)

    return rows.select(_COLUMNS).mapInArrow(run, _CONTEXT)


def _whole(rows: DataFrame, least: int) -> DataFrame:
    """Contexts that occur twice as wholes are repeats as wholes."""
    return rows.select("owner", "ctx", F.col("off").alias("s"), (F.col("off") + F.col("starts") - 1 + least).alias("e"), F.xxhash64("owner", "ctx", "off").alias("repeat"))


def _context_repeats(contexts: DataFrame, least: int, limit: int) -> list[DataFrame]:
    """Repeats of the distinct contexts (with ``rows``, the number of contexts of a key), hot keys split and split again."""
    found = []
    for step in _steps(least):
        found.append(_search(contexts.filter(F.col("rows") <= limit), least))
        hot = contexts.filter(F.col("rows") > limit)
        if hot.isEmpty():
            break
        parts = materialize(_parts(hot, step, least), "parts")
        kind = ["key", F.xxhash64("bytes").alias("kind")]
        classes = parts.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("owner", "ctx", "off")).alias("first"))
        classes = materialize(classes.filter(F.col("n") > 1), "classes")
        marked = materialize(parts.withColumn("kind", F.xxhash64("bytes")).join(classes, ["key", "kind"], "left"), "marked")
        found.append(_whole(marked.filter("n > 1"), least))
        kept = marked.filter(F.col("n").isNull() | (F.col("first") == F.struct("owner", "ctx", "off")))
        kept = kept.withColumn("many", F.col("many") | F.col("n").isNotNull()).select(_COLUMNS)
        sizes = materialize(kept.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "sizes")
        contexts = materialize(kept.join(sizes, "key"), "contexts")
    return found


def _digest() -> Column:
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def _runs(docs: DataFrame, least: int, kmer: int) -> DataFrame:
    """Owned runs of every text: owner, ctx, digest of the text, first and last start, the owner's place in the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                whose, first, last, anchor, owner, context = owned_runs(utf8_rows(part, "text"), least, kmer)
                cols = [pa.array(owner), pa.array(context), part.column("digest").take(pa.array(whose)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array((anchor - first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["owner", "ctx", "digest", "first", "last", "anchor"])

    rows = docs.select(text_or_empty().alias("text"), _digest().alias("digest")).filter(F.octet_length("text") >= least)
    return rows.mapInArrow(run, "owner bigint, ctx bigint, digest binary, first int, last int, anchor int")


def _cut_contexts(chosen: DataFrame, least: int) -> DataFrame:
    """Contexts with their bytes, from rows (text, list of places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, places in zip(utf8_rows(part, "text"), part.column("places").to_pylist(), strict=True):
                    for p in places:
                        out.append((p["owner"], p["owner"], p["ctx"], 0, p["last"] - p["first"] + 1, p["anchor"], p["many"], text[p["first"] : p["last"] + least], p["rows"]))
                cols = list(zip(*out, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*_TYPES, pa.int64()], strict=True)], [*_COLUMNS, "rows"])

    return chosen.mapInArrow(run, _CONTEXT + ", rows bigint")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest, text, copies of each distinct text; copies are counted where they are read before they are shuffled."""
    return docs.select(_digest().alias("digest"), text_or_empty().alias("text")).groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def maximal_repeats(docs: DataFrame, least: int = LEAST, kmer: int = KMER, context_limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Occurrences of maximal repeats of ``least`` or more bytes: digest (md5 of the text), start, stop, repeat.

    A repeat longer than a context comes as overlapping pieces, one for each owner along it.  Texts that are equal
    share their digest; that such a text occurs as a whole more than once is a repeat like any other.
    """
    runs = materialize(_runs(docs, least, kmer), "runs")
    often = runs.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("owner")
    members = materialize(runs.join(materialize(often, "owners"), "owner"), "members")
    distinct = members.groupBy("owner", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "first", "last", "anchor")).alias("at"))
    distinct = materialize(distinct, "contexts")
    sizes = distinct.groupBy("owner").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    searched = distinct.join(materialize(sizes, "sizes"), "owner")
    place = F.struct("owner", "ctx", "at.first", "at.last", "at.anchor", (F.col("n") > 1).alias("many"), "rows")
    wanted = searched.groupBy(F.col("at.digest").alias("digest")).agg(F.collect_list(place).alias("places"))
    contexts = materialize(_cut_contexts(distinct_texts(docs).join(wanted, "digest").select("text", "places"), least), "cut")
    whole = distinct.filter("n > 1").select("owner", "ctx", F.lit(0).alias("s"), (F.col("at.last") - F.col("at.first") + least).alias("e"), F.xxhash64("owner", "ctx").alias("repeat"))
    found = whole
    for part in _context_repeats(contexts, least, context_limit):
        found = found.unionByName(part)
    found = materialize(found.groupBy("owner", "ctx").agg(F.collect_set(F.struct("s", "e", "repeat")).alias("found")), "repeats")
    placed = members.join(found, ["owner", "ctx"]).select("digest", "first", F.explode("found").alias("f"))
    return placed.select("digest", (F.col("first") + F.col("f.s")).alias("start"), (F.col("first") + F.col("f.e")).alias("stop"), F.col("f.repeat").alias("repeat"))


def _without(text: bytes, spans: list[tuple[int, int]] | None) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the rest joined)."""
    kept, at, runs, removed = [], 0, 0, 0
    for s, e in sorted(spans or ()):
        if s > at or not runs:
            kept.append(text[at:s])
            runs += 1
            removed += e - s
        elif e > at:
            removed += e - at
        at = max(at, e)
    kept.append(text[at:])
    return removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, least: int = LEAST, kmer: int = KMER, context_limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, ``kept``, the bytes that stay, and kept_sha256.

    Every byte of a string of ``least`` bytes that also starts anywhere else goes, judged on the input.  Null counts
    as empty; texts shorter than ``least`` bytes are left whole; rows that repeat a text of that length lose all of
    it; an empty table gives an empty result; other columns are not read.
    """
    spans = maximal_repeats(docs, least, kmer, context_limit).groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8_rows(part, "text")
                found = [_without(t, [(x["start"], x["stop"]) for x in s or ()]) for t, s in zip(texts, part.column("spans").to_pylist(), strict=True)]
                cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("digest"), *cols], ["digest", "n_bytes", "n_removed", "n_spans", "kept"])

    done = distinct_texts(docs).join(spans, "digest", "left").select("digest", "text", "spans").mapInArrow(run, "digest binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumn("kept_sha256", F.sha2("kept", 256))
    return docs.select("doc_id", _digest().alias("digest")).join(done, "digest").drop("digest")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))
