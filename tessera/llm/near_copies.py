"""Near copies of a given similarity on word shingles: SimHash with covering tables and MinHash bands find, sets verify.

Where single words are changed, a copy that shares 0.8 of its five-word shingles still shares about 0.97 of its distinct
words, so the fingerprints are SimHashes of the set of words: several with different seeds, each with the covering tables
of ``simhash``.  Text added, cut or replaced as a block changes far more words; there the bands of a MinHash of the
shingles find the copy, whatever the edit: a pair of similarity s misses all bands with probability
``(1 - s ** BAND_ROWS) ** BANDS``, 6e-5 at 0.8, at any length.  What meets in a bucket is a candidate; a link asks that
the sets of five-word shingles, as 32-bit hashes, have the similarity.  That is exact for texts of up to ``SET_LIMIT``
distinct shingles; of longer ones those with small hashes are compared, a half, a quarter and so on, so that a row never
grows with its text: at 0.8 their similarity is known to about 0.015.  Buckets with the same members are searched once.

A bucket of over ``bucket_limit`` members is dealt into blocks by a hash of the id, each with the same few pivots; where
that leaves it in several components, those outside the largest are compared with all of its members, block by block.
So no task takes more than about twice ``bucket_limit`` members of a bucket together, and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, slices, text_or_empty, utf8_rows
from tessera.llm.simhash import BUCKET_LIMIT, RADIUS, SEED, _signed, connected_components, covering_masks

SHINGLE = 5
SIMILARITY = 0.8
#: Independent fingerprints per text.
FINGERPRINTS = 2
#: Shingles of a text that are kept for the comparison, at most.
SET_LIMIT = 1024
#: Members of a large bucket that all of its blocks see.
PIVOTS = 4
#: Bands of the MinHash, the hash functions of each, and shingles that are hashed together.
BANDS, BAND_ROWS, BAND_CHUNK = 32, 6, 4096
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), np.uint32)
_FACTORS |= np.uint32(1)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bands(h: np.ndarray) -> list[int]:
    """A 64-bit name for each band of the MinHash of the hashes ``h``."""
    from xxhash import xxh64_intdigest

    low = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), BAND_CHUNK):
        low = np.minimum(low, (_FACTORS * h[at : at + BAND_CHUNK].astype(np.uint32) + _SHIFTS).min(axis=1))
    return [_signed(xxh64_intdigest(row.tobytes(), SEED + 1 + i)) for i, row in enumerate(low.reshape(BANDS, BAND_ROWS))]


def _kept_shingles(h: np.ndarray, limit: int) -> bytes:
    """The level, then the sorted distinct 32-bit hashes below ``2 ** (32 - level)``: the lowest level with ``limit`` at most."""
    u, level = np.unique((h >> np.uint64(32)).astype(np.uint32)), 0
    while len(u) > limit:
        level += 1
        u = u[: np.searchsorted(u, 1 << (32 - level))]
    return np.concatenate([np.array([level], np.uint32), u]).astype("<u4").tobytes()


def _describe(text: bytes, shingle: int, count: int, limit: int) -> tuple[list[int], list[int], bytes]:
    """Fingerprints of the set of words; bands and kept hashes of the set of shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    of_words = np.array([xxh64_intdigest(w, SEED) for w in set(words)], np.uint64)
    fps = []
    for turn in range(count):
        bits = np.unpackbits(_mixed(of_words, turn).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        fps.append(int(np.packbits(2 * ones > len(of_words), bitorder="little").view("<i8")[0]))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return fps, _bands(h), _kept_shingles(h, limit)


def describe(docs: DataFrame, shingle: int = SHINGLE, count: int = FINGERPRINTS, limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, fps and bands (array<bigint>) and shingles (binary) of each text with a doc_id; texts without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_describe(t, shingle, count, limit) for t in utf8_rows(part, "text")]
                arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "fps", "bands", "shingles"])

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", text_or_empty().alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fps array<bigint>, bands array<bigint>, shingles binary")


def _buckets(described: DataFrame, radius: int, count: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bucket, doc_id) of the buckets of 2 to ``limit`` members; (bucket, n, key, pivots) of the larger; their members.

    The larger are ``keys / limit`` at most, a row each, which Spark broadcasts if their written size allows; their
    members never meet in a task, as joins split their partitions.
    """
    masks = covering_masks(list(range(64)), radius)
    cells = [F.xxhash64(F.lit(i * len(masks) + t), F.col("fps")[i].bitwiseAND(F.lit(_signed(m)))) for i in range(count) for t, m in enumerate(masks)]
    keyed = described.select("doc_id", F.explode(F.concat(F.array(*cells), F.col("bands"))).alias("key"))
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("key"), "hot-keys")
    together = Window.partitionBy("key")
    x, y = F.bit_xor(F.xxhash64("doc_id")), F.bit_xor(F.xxhash64(F.lit(1), "doc_id"))
    counted = keyed.join(hot, "key", "left_anti").select("doc_id", F.count(F.lit(1)).over(together).alias("n"), x.over(together).alias("x"), y.over(together).alias("y"))
    small = counted.filter("n > 1").select(F.xxhash64("n", "x", "y").alias("bucket"), "doc_id").distinct()
    pivots = F.array(*(F.min(F.struct(F.xxhash64(F.lit(2 + k), "doc_id").alias("h"), "doc_id"))["doc_id"] for k in range(PIVOTS)))
    sums = keyed.join(hot, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), x.alias("x"), y.alias("y"), pivots.alias("pivots"))
    large = sums.groupBy(F.xxhash64("n", "x", "y").alias("bucket")).agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("pivots").alias("pivots"))
    large = materialize(large, "large-buckets")
    return small, large, keyed.join(large, "key").select("bucket", "doc_id", "n")


def _blocks(n: str, limit: int) -> Column:
    return F.ceil(F.col(n) / limit).cast("int")


def _dealt(large: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """(bucket, doc_id) of the blocks of large buckets, each with its bucket's pivots."""
    dealt = members.select("bucket", "doc_id", F.pmod(F.xxhash64(F.lit(-1), "doc_id"), _blocks("n", limit)).cast("int").alias("block"))
    pivots = large.select("bucket", "pivots", F.explode(F.sequence(F.lit(0), _blocks("n", limit) - 1)).alias("block")).select("bucket", F.explode("pivots").alias("doc_id"), "block")
    return dealt.unionByName(pivots).select(F.xxhash64("bucket", "block").alias("bucket"), "doc_id").distinct()


def _crossed(members: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """(bucket, doc_id) of blocks in which the members outside a bucket's largest component meet all of its members."""
    known = members.join(roots, members["doc_id"] == roots["node"], "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    known = materialize(known, "large-members")
    parts = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    split = parts.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most")).filter("n > most.c")
    split = split.select("bucket", F.col("most.root").alias("main"), _blocks("n", limit).alias("every"), F.ceil((F.col("n") - F.col("most.c")) / limit).cast("int").alias("rest"))
    rows = known.join(materialize(split, "split-buckets"), "bucket")
    mine = F.pmod(F.xxhash64(F.lit(-2), "doc_id"), F.col("every")).cast("int")
    all_rows = rows.select("bucket", "doc_id", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("i"), mine.alias("j"))
    outer = rows.filter("root <> main").select("bucket", "doc_id", F.pmod(F.xxhash64(F.lit(-3), "doc_id"), F.col("rest")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("every") - 1)).alias("j"))
    return all_rows.unionByName(outer).select(F.xxhash64("bucket", "i", "j").alias("bucket"), "doc_id").distinct()


def candidates(described: DataFrame, radius: int = RADIUS, count: int = FINGERPRINTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(bucket, doc_id) of every bucket or block with several members; buckets with equal members come once."""
    small, large, members = _buckets(described, radius, count, bucket_limit)
    return small.unionByName(_dealt(large, members, bucket_limit))


def _forest(ids: np.ndarray, shingles: list[bytes], similarity: float) -> list[tuple]:
    """Links that connect the members of a bucket whose sets of shingles are similar, steps between included.

    Hashes get small numbers within the bucket; a member marks its own, and the marks that the others hit are counted.
    """
    sets = [np.frombuffer(s, "<u4") for s in shingles]
    levels, sets = np.array([int(s[0]) for s in sets]), [s[1:] for s in sets]
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    known, flat = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = np.cumsum(sizes) - sizes
    # By level that occurs: how many hashes a member has below its bound.
    held = {int(v): np.bincount(owner[values < 1 << (32 - int(v))], minlength=len(sets)) for v in set(levels.tolist())}
    links, alive, mark = [], np.ones(len(ids), bool), np.zeros(len(known), bool)

    def near(root: int) -> np.ndarray:
        here = flat[at[root] : at[root] + sizes[root]]
        out = []
        for other in held:
            level = max(other, int(levels[root]))
            low = here[known[here] < 1 << (32 - level)]
            mark[low] = True
            hits = np.bincount(owner[mark[flat]], minlength=len(sets))
            mark[low] = False
            union = held[level] + len(low) - hits
            out.append(np.flatnonzero(alive & (levels == other) & (hits >= similarity * union - 1e-9)))
        return np.concatenate(out)

    for root in range(len(ids)):
        if not alive[root]:
            continue
        alive[root] = False
        front = [root]
        while front and alive.any():
            a = front.pop()
            found = near(a)
            alive[found] = False
            links += [(ids[a], ids[j]) for j in found]
            front += found.tolist()
            if 2 * alive[owner].sum() < len(owner):  # only those left are looked at from now on
                kept = alive[owner]
                for member in front:
                    kept[at[member] : at[member] + sizes[member]] = True
                owner, flat = owner[kept], flat[kept]
                values = values[kept]
                sizes = np.bincount(owner, minlength=len(ids))
                at = np.cumsum(sizes) - sizes
    return links


def near_links(described: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, count: int = FINGERPRINTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between doc_ids whose components are those of "similar", each bucket giving a spanning forest."""
    small, large, members = _buckets(described, radius, count, bucket_limit)
    if large.isEmpty():
        return _linked(described, small, similarity)
    links = _linked(described, small.unionByName(_dealt(large, members, bucket_limit)), similarity)
    return links.unionByName(_linked(described, _crossed(members, connected_components(links), bucket_limit), similarity))


def _linked(described: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that span each bucket of ``members`` (bucket, doc_id)."""
    members = materialize(members, "members")
    # Members grow with the table, so they are not broadcast: the plan is the same at every size.
    rows = members.join(described.select("doc_id", "shingles").hint("merge"), "doc_id").repartition("bucket").sortWithinPartitions("bucket", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            bucket = rows["bucket"].to_numpy()
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            held = rows.iloc[cuts[-1] if len(cuts) else 0 :]
            yield linked(rows, cuts)
        if held is not None:
            yield linked(held, np.array([len(held)]))

    def linked(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        bounds, out = np.concatenate([[0], cuts]).astype(int), []
        ids, sets = rows["doc_id"].to_numpy(), rows["shingles"].tolist()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                out += _forest(ids[a:b], sets[a:b], similarity)
        return pd.DataFrame(out, columns=["a", "b"], dtype=rows["doc_id"].dtype)

    kind = described.schema["doc_id"].dataType.simpleString()
    links = materialize(rows.mapInPandas(run, f"a {kind}, b {kind}").distinct(), "near-links")
    release(members)
    return links


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of ``docs`` without those that have a near copy of smaller doc_id in their group.

    Rows with a null doc_id and texts without a word all stay; rows that repeat a doc_id share its fate.  An empty
    table gives an empty result; columns other than doc_id and text pass through.  Whole rows are shuffled once, by
    doc_id: what goes grows with the table, so it is never broadcast and the plan is the same at every size.
    """
    described = materialize(describe(docs, shingle), "described")
    links = near_links(described, similarity, bucket_limit=bucket_limit)
    gone = materialize(connected_components(links).filter("node <> root").select(F.col("node").alias("_gone")), "gone")
    release(described)
    rows = docs.filter("doc_id IS NOT NULL")
    kept = rows.hint("merge").join(gone, rows["doc_id"] == gone["_gone"], "left_anti")
    return kept.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
