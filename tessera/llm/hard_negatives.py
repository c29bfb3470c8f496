"""Hard negatives: exact integer inner products by Strassen's recursion on tiles, and bounded heaps that merge.

Vectors become whole numbers.  Anchors are a stated query set; they are dealt into groups of bounded size, each group
is broadcast, and every task multiplies the anchors with its own candidates tile by tile.  A first round keeps, per
anchor, a heap of the best rows of its label; the heaps of all tasks are merged by Spark.  A second round keeps, per
anchor and positive, a heap of the best rows of other labels whose score lies in the positive's window.  Neither the
score matrix nor the candidates are ever gathered: a task holds one tile and its heaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, release

#: Positives of an anchor and negatives of a positive that are kept, and the window's ends in percent of the positive's score.
POSITIVES, NEGATIVES, WINDOW = 5, 5, (80, 100)
#: Anchors of a group: what a broadcast holds is at most GROUP vectors, whatever the table.
GROUP = 8192
#: Rows of a tile, anchors by candidates.
TILE = (512, 4096)
#: Sides from which the recursion goes on; smaller products are taken as they are.
LEAF = 32
#: Scores stay below this in size, so that a percentage of them fits 64 bits.
LIMIT = 2**55
#: Stands for a missing id or no row in the heaps: after every id, below every score.
LAST, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices of any shape, by seven products of halves; odd sides are padded with zeros.

    All additions are of whole numbers, so the result is exact where it fits 64 bits: what wraps around in between wraps back.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, p, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :p], a[:i, p:], a[i:, :p], a[i:, p:]
    b11, b12, b21, b22 = b[:p, :j], b[:p, j:], b[p:, :j], b[p:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out[:m, :n]


class Heaps:
    """The best ``size`` (score, id, row) of each slot, best first: larger scores, then smaller ids, then smaller rows."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.score = np.full((slots, size), NONE, np.int64)
        self.id = np.full((slots, size), LAST, np.int64)
        self.row = np.full((slots, size), LAST, np.int64)

    def push(self, first: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge the columns of a masked tile (``NONE``: not a member; ids and rows ascending) into slots from ``first`` on."""
        best = min(self.size, scores.shape[1])
        slots = slice(first, first + len(scores))
        worst = self.score[slots, -1]
        live = np.flatnonzero(scores.max(1) > np.where(self.id[slots, -1] == LAST, NONE, worst - 1)) if scores.shape[1] else np.array([], int)
        if not len(live):
            return
        left = scores[live]
        got = np.empty((3, len(live), best), np.int64)
        at = np.arange(len(live))
        for i in range(best):
            k = left.argmax(1)  # the first of equal scores, so the smallest id
            s = left[at, k]
            got[:, :, i] = s, np.where(s == NONE, LAST, ids[k]), np.where(s == NONE, LAST, rows[k])
            left[at, k] = NONE
        self._merge(first + live, *got)

    def _merge(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.concatenate([mine[slots], theirs], 1) for mine, theirs in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, ~score))[:, : self.size]
        for mine, all_ in ((self.score, score), (self.id, ids), (self.row, rows)):
            mine[slots] = np.take_along_axis(all_, order, 1)

    def rows_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots and places of all members."""
        return np.nonzero(self.row != LAST)


def whole_vectors(rows: DataFrame, relabel: Column | None = None, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, in the shared folder; ``v`` holds ``floor(scale * x)``.

    Rows with a null label, a null vector, or a null or non-finite component take no part.  ``relabel`` replaces the
    label.  ``row`` tells rows apart that repeat an id; a null vec_id comes after all others where scores tie.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    part = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    # Numbers beyond 64 bits become the largest one here; ``scores`` refuses those.
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    label = F.col("label") if relabel is None else relabel
    return materialize(part.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")), "vectors")


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros, which change no inner product."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = int(lengths.max(initial=0)) if dims is None else max(dims, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _size(m: np.ndarray) -> int:
    return max((abs(int(x)) for x in (m.max(initial=0), m.min(initial=0))), default=0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``."""
    if a.shape[1] != b.shape[1]:
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if _size(a) * _size(b) * max(a.shape[1], 1) >= LIMIT:
        raise OverflowError("inner products of these vectors may pass 55 bits")
    return strassen(a, np.ascontiguousarray(b.T))


def _tiles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """row, vec_id, label and matrix of up to ``rows`` candidates at a time, by ascending (vec_id, row)."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            row, label = part.column("row").to_numpy(), part.column("label").to_numpy()
            ids = part.column("vec_id").fill_null(LAST).to_numpy()
            order = np.lexsort((row, ids))
            yield row[order], ids[order], label[order], _matrix(part.column("v"))[order]


def _positives(shared, size: int, tile: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, labels, matrix = shared.value
        heaps = Heaps(len(rows), size)
        for row, ids, label, b in _tiles(batches, tile[1]):
            for i in range(0, len(rows), tile[0]):
                s = scores(matrix[i : i + tile[0]], b)
                s[(labels[i : i + tile[0], None] != label) | (rows[i : i + tile[0], None] == row)] = NONE
                heaps.push(i, s, ids, row)
        slot, place = heaps.rows_of()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[slot], heaps.row[slot, place], heaps.id[slot, place], heaps.score[slot, place])], ["anchor", "row", "vec_id", "score"])

    return run


def _negatives(shared, size: int, window: tuple[int, int], tile: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, positive, labels, matrix = shared.value
        low, high = -(-window[0] * positive // 100), window[1] * positive // 100
        k = positive.shape[1]
        heaps = [Heaps(len(rows), size) for _ in range(k)]
        for row, ids, label, b in _tiles(batches, tile[1]):
            for i in range(0, len(rows), tile[0]):
                s = scores(matrix[i : i + tile[0]], b)
                s[labels[i : i + tile[0], None] == label] = NONE
                for p in range(k):
                    lo, hi = low[i : i + tile[0], p, None], high[i : i + tile[0], p, None]
                    heaps[p].push(i, np.where((s >= lo) & (s <= hi), s, NONE), ids, row)
        for p, heap in enumerate(heaps):
            slot, place = heap.rows_of()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[slot], np.full(len(slot), p), heap.row[slot, place], heap.id[slot, place], heap.score[slot, place])], ["anchor", "p", "row", "vec_id", "score"])

    return run


def _first(found: DataFrame, by: list[str], size: int) -> DataFrame:
    """Merges the heaps of all tasks; ``place`` counts from 1.  Spark cuts each partition's rows to ``size`` before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    group: int = GROUP, tile: tuple[int, int] = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``vectors`` (of ``whole_vectors``).

    ``anchors`` selects the anchors.  Of the other rows of an anchor's label the ``positives`` best scores are its
    positives; of the rows of other labels with ``window[0] * positive <= 100 * negative <= window[1] * positive`` the
    ``negatives`` best are returned for each.  Ties go to the smaller vec_id, null last.  Rows that repeat a vec_id are
    separate rows, and one may be the other's positive.  Vectors of unequal length count as padded with zeros.  An
    inner product that may pass 55 bits raises.  An empty table, or one without anchors, gives an empty result.  Each
    group of anchors reads all candidates once per round; its bound is ``group`` vectors.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    chosen = materialize(vectors.filter(F.coalesce(anchors, F.lit(False))), "anchors")
    groups = -(-chosen.count() // group)
    results = []
    for g in range(groups):
        # Row numbers are hashed, so groups are even; each is collected by itself and holds about ``group`` anchors.
        part = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toArrow().combine_chunks()
        rows = part.column("row").to_numpy()
        if not len(rows):
            continue
        labels = part.column("label").to_numpy()
        matrix = _matrix(part.column("v").combine_chunks())
        shared = sc.broadcast((rows, None, labels, matrix))
        best = materialize(_first(vectors.mapInArrow(_positives(shared, positives, tile), "anchor bigint, row bigint, vec_id bigint, score bigint"), ["anchor"], positives), "positives")
        held = best.select("anchor", "place", "vec_id", "score").toPandas()
        at = {int(r): i for i, r in enumerate(rows)}
        # Without a positive the window is empty: its low end lies above its high one.
        positive, there = np.zeros((len(rows), positives), np.int64), np.zeros((len(rows), positives), bool)
        slot = np.fromiter((at[int(a)] for a in held["anchor"]), int, len(held))
        positive[slot, held["place"] - 1], there[slot, held["place"] - 1] = held["score"], True
        positive[~there] = -1
        windows = sc.broadcast((rows, positive, labels, matrix))
        found = _first(vectors.mapInArrow(_negatives(windows, negatives, window, tile), "anchor bigint, p bigint, row bigint, vec_id bigint, score bigint"), ["anchor", "p"], negatives)
        named = best.select("anchor", (F.col("place") - 1).alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = found.join(named, ["anchor", "p"]).join(chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        missing = lambda c: F.nullif(F.col(c), F.lit(int(LAST))).alias(c)
        results.append(materialize(joined.withColumnRenamed("vec_id", "negative_id").select("anchor_id", missing("positive_id"), F.col("place").alias("rank"), missing("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        shared.destroy()
        windows.destroy()
        release(best)
    if not results:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole_vectors(table, label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
}
