"""Exact deduplication with a heavy-hitter split.  DataFrame functions only.

One pass turns each text into a digest.  ``freqItems`` (the Misra-Gries / Karp-Shenker-Papadimitriou counters)
names at most ``1 / support`` digests that may be frequent; their exact counts are then taken, and those that
truly exceed the support - at most ``1 / support`` rows, whatever the corpus - are broadcast, so the rows of hot
groups are settled where they are read.  All other digests, none of which holds more than ``support`` of the rows,
go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, text_or_empty

#: A digest is a heavy hitter when it holds more than this share of the rows; 1 / SUPPORT bounds the broadcast.
SUPPORT = 1e-3


def normalized(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, r"[ \x09-\x0D]+", "")


def _best(n: Column, doc_id: Column) -> Column:
    """Orders rows of a group: most code points first, then smallest id, null ids last; the minimum stays."""
    return F.struct((-n).alias("longest"), doc_id.isNull().alias("no_id"), doc_id.alias("id"))


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars (of the original text).

    Null texts count as empty; empty texts form one group like any other.  Of equal texts the one with the most
    code points stays, then the smallest doc_id; a null doc_id comes after all others.  Rows that repeat one doc_id
    with the same length are one document and share its ``kept``.  A very long text is normalised and hashed where it is
    read; only its digest travels.  An empty table gives an empty result, and columns
    other than doc_id and text are ignored, whatever their names.
    """
    text = text_or_empty()
    digests = materialize(
        docs.select("doc_id", F.sha2(normalized(text), 256).alias("text_sha256"), F.char_length(text).cast("long").alias("n")),
        "digests",
    )
    candidates = digests.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    group = [F.count(F.lit(1)).alias("group_size"), F.min(_best(F.col("n"), F.col("doc_id"))).alias("best")]
    rows = digests.count()
    heavy = (
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*group)
        .filter(F.col("group_size") > support * rows)
    )
    heavy = materialize(heavy, "heavy")
    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    key = Window.partitionBy("text_sha256")
    light = marked.filter("best IS NULL").select(
        "doc_id", "text_sha256", "n", F.count(F.lit(1)).over(key).alias("group_size"),
        F.min(_best(F.col("n"), F.col("doc_id"))).over(key).alias("best"),
    )
    hot = marked.filter("best IS NOT NULL").select("doc_id", "text_sha256", "n", "group_size", "best")
    return hot.unionByName(light).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size",
        F.col("best").eqNullSafe(_best(F.col("n"), F.col("doc_id"))).alias("kept"), "text_sha256", F.col("n").alias("n_chars"),
    )


def deduplicate(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A decision holds for a doc_id, the hash of its normalised text and its length together, so different texts under
    one doc_id are different documents; of rows that repeat all three one stays.  Rows without a doc_id cannot be
    named by a decision and all stay.  Whole rows are shuffled once, by doc_id, at any size.
    """
    n, key = F.char_length(text_or_empty()).cast("long"), ["_id", "_sha", "_n"]
    kept = materialize(exact_duplicates(docs, support).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n")).distinct(), "kept")
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.sha2(normalized(text_or_empty()), 256).alias("_sha"), n.alias("_n"))
    named = rows.hint("merge").join(kept, key, "left_semi").dropDuplicates(key)
    return named.select("_row.*").unionByName(docs.filter("doc_id IS NULL"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("n_chars")


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
}
