"""Near-duplicate groups by SimHash, found with covering locality-sensitive hashing.

Each of the 64 bit places gets a non-zero vector of ``radius + 1`` bits; table v keeps the places whose vector has an
odd product with v.  The vectors of any ``radius`` places are orthogonal to some v, so fingerprints that differ in at
most ``radius`` bits agree on every kept place of that table: no pair is lost, whatever the data.  Work is done on
distinct fingerprints.  Buckets are linked by a spanning forest (n - 1 links at most, not all pairs); a bucket of over
``bucket_limit`` fingerprints is split by a second covering of the places its own table does not keep.  After that at
most 16 places are free, so no bucket holds over 65,536 fingerprints.  Groups come from a star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, release, slices, text_or_empty, utf8_rows

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET_LIMIT = 2000


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the signed 64-bit ``fp`` of each whole text, however long; null counts as empty, whose fingerprint is 0.

    A bit that exactly half of the hashes set is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([_fingerprint(t, shingle, seed) for t in utf8_rows(part, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def covering_masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """One mask per table over the given bit places; pairs within ``radius`` on these places agree under some mask."""
    n = 1 << (radius + 1)
    return [sum(1 << p for i, p in enumerate(places) if ((i % (n - 1) + 1) & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """A row for each fingerprint and table: table number, kept bits, fp."""
    cells = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for k, m in tables))
    return fps.select("fp", F.explode(cells).alias("c")).select("c.t", "c.kept", "fp")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of a bucket that are within ``radius``, steps between included."""
    rest, links = np.unique(fps), []
    bits = rest.view(np.uint64)
    alive = np.ones(len(rest), bool)
    for root in range(len(rest)):
        if not alive[root]:
            continue
        alive[root] = False
        front = [root]
        while front:
            at = front.pop()
            near = np.flatnonzero(alive)
            near = near[np.bitwise_count(bits[near] ^ bits[at]) <= radius]
            alive[near] = False
            links += [(int(rest[at]), int(rest[j])) for j in near]
            front += near.tolist()
    return links


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of every bucket (t, kept); buckets come sorted, so memory holds one bucket at a time."""
    sorted_rows = keyed.repartition("t", "kept").sortWithinPartitions("t", "kept", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            t, kept = rows["t"].to_numpy(), rows["kept"].to_numpy()
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (kept[1:] != kept[:-1])) + 1
            held = rows.iloc[cuts[-1] if len(cuts) else 0 :]
            yield linked(rows["fp"].to_numpy()[: cuts[-1] if len(cuts) else 0], cuts)
        if held is not None:
            yield linked(held["fp"].to_numpy(), np.array([len(held)]))

    def linked(fp: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
        bounds = np.concatenate([[0], cuts])
        many = np.flatnonzero(np.diff(bounds) > 1)
        out = [x for i in many for x in _forest(fp[bounds[i] : bounds[i + 1]], radius)]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return sorted_rows.mapInPandas(run, "a bigint, b bigint")


def near_links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps.fp`` whose components are those of "within radius"."""
    masks = covering_masks(list(range(64)), radius)
    keyed = _keyed(fps, list(enumerate(masks)))
    sizes = keyed.groupBy("t", "kept").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = materialize(keyed.join(sizes, ["t", "kept"]), "buckets")
    links = _links(keyed.filter(F.col("n") <= bucket_limit), radius)
    large = keyed.filter(F.col("n") > bucket_limit)
    finer = []
    for t, mask in enumerate(masks):
        free = [p for p in range(64) if not mask >> p & 1]
        tables = [(t * len(masks) + k, mask | m) for k, m in enumerate(covering_masks(free, radius))]
        cells = F.array(*(F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("mask")) for k, m in tables))
        finer.append(F.when(F.col("t") == t, cells))
    split = large.select(F.explode(F.coalesce(*finer)).alias("c"), "fp").select("c.t", F.col("fp").bitwiseAND(F.col("c.mask")).alias("kept"), "fp")
    return links.unionByName(_links(split, radius)).distinct()


def _settled(state: DataFrame) -> bool:
    """Whether each node of the links (u, v), u > v, has one partner below it or none, and no such partner one itself."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(state.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 OR c = 1 AND r = 1").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, for every node of a link.

    Large-star and small-star rounds, until all components are stars; every round is written to the shared folder, none
    passes through the driver.
    """
    state = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        if _settled(state):
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, state = state, materialize(small.filter("u <> v").distinct(), "small-star")
        release(before, lows, large, least)
    else:
        raise RuntimeError("the star contraction did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp (signed 64-bit), component_id, the smallest doc_id reachable.

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any other.  Rows with a null
    doc_id are members of their group but never name it, unless no other row is in it.  Repeated rows get equal
    values, an empty table gives an empty result, and other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius, bucket_limit))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(grouped.join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that name their group, with all their columns; rows without a doc_id all stay."""
    kept = near_duplicates(docs, **options).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
