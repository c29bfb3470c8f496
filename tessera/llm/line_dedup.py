"""Lines that many documents repeat: levelled sorted runs of line hashes.  DataFrame functions only.

Documents come in batches.  The distinct line keys of each document are counted per batch; keys that the runs already
know to be repeated are taken out by merge anti-joins, and what is left is added as the batch's own run, bucketed and
sorted by hash.  When a level holds ``FANOUT`` runs they are compacted into one run of the next level, so of B batches
at most ``(FANOUT - 1) log B`` runs are alive, and a hash is rewritten ``log B`` times.  A run and a batch meet bucket
by bucket: only a compaction shuffles runs again.

The texts are then read once more.  Lines of heavy keys, a bounded number, are settled where they are read; the hashes
of the other lines meet the repeated ones in one shuffle, and the places of the lines that go meet their documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, release, text_or_empty
from tessera.functions.scratch import scratch_path

#: Characters that are stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key goes when it has MIN_CHARS code points and is found in MIN_DOCS documents.
MIN_DOCS, MIN_CHARS = 10, 1
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Batches that a table is read in, one after the other.
BATCHES = 8
#: A key is heavy in a batch when it holds more than this share of the batch's (document, key) pairs: 1 / SUPPORT keys at most.
SUPPORT = 1e-3
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5EED), key).alias("h2")]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """Levelled runs over the batches that were added so far."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, fanout: int = FANOUT, support: float = SUPPORT):
        self.spark, self.min_docs, self.min_chars, self.fanout, self.support = spark, min_docs, min_chars, fanout, support
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.heavy_parts: list[DataFrame] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        counts.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _unbucketed(self, name: str) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, n bigint").parquet(self.paths[name])

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def document_counts(self, docs: DataFrame) -> DataFrame:
        """(h1, h2, n): in how many rows of ``docs`` a key stands; keys are distinct within a row before they are counted."""
        keys = F.array_distinct(F.transform(lines_of(text_or_empty()), line_key))
        rows = docs.select(F.explode(keys).alias("key")).filter(F.char_length("key") >= max(self.min_chars, 1))
        return rows.select(*_hashes(F.col("key"))).groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n"))

    def add(self, docs: DataFrame) -> None:
        """Count one batch of documents and add its run.

        Keys that a run already counts in ``min_docs`` documents are settled and not added again, so the runs grow with
        the keys that are still open; their counts say "at least".
        """
        own = self._write(self.document_counts(docs))
        counted = self.spark.table(own)
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.heavy_parts.append(materialize(counted.filter((F.col("n") >= self.min_docs) & (F.col("n") > self.support * total)).select(*_HASH), "heavy-lines"))
        if self.runs():
            fresh = counted
            for name in self.runs():
                settled = self.spark.table(name).filter(F.col("n") >= self.min_docs).select(*_HASH)
                fresh = fresh.join(settled.hint("merge"), _HASH, "left_anti")
            run = self._write(fresh)
            self._drop([own])
        else:
            run = own
        self._place(run, 0)

    def _place(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._summed(old))
            self._drop(old)
            self._place(merged, level + 1)

    def _summed(self, names: list[str]) -> DataFrame:
        # By path, not as bucketed tables: Spark 4.1 counts a union of those as dealt out by hash and leaves the shuffle out even
        # where it then reads them unbucketed.
        union = self._unbucketed(names[0])
        for name in names[1:]:
            union = union.unionByName(self._unbucketed(name))
        return union.groupBy(*_HASH).agg(F.sum("n").alias("n"))

    def repeated(self) -> DataFrame:
        """(h1, h2) of all keys that stand in ``min_docs`` documents of the batches so far."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return self._summed(self.runs()).filter(F.col("n") >= self.min_docs).select(*_HASH)

    def heavy(self) -> DataFrame:
        """(h1, h2) of repeated keys that were heavy in some batch: at most batches / ``support`` rows.

        A key with more than ``support`` of all pairs has more than that in one batch at least, so none that could make
        a hot task is left for the shuffle.
        """
        found = self.heavy_parts[0] if self.heavy_parts else self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        for part in self.heavy_parts[1:]:
            found = found.unionByName(part)
        return found.distinct()

    def close(self) -> None:
        self._drop(self.runs())
        release(*self.heavy_parts)
        self.levels, self.heavy_parts = [], []


def mark_lines(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc (the row as a struct), lines, dropped (places from 0 of the lines that go).

    Rows are told apart by hashes of doc_id and text; rows that repeat both have the same lines to lose.  Only hashes of
    lines are shuffled, and whole texts once, unless Spark finds the table of dropped places small enough to broadcast.
    """
    key = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(0x5EED), "doc_id", "text").alias("_k2")]
    lines = docs.select(*key, F.posexplode(lines_of(text_or_empty())).alias("pos", "line")).select("_k1", "_k2", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.char_length("key") >= max(runs.min_chars, 1)).select("_k1", "_k2", "pos", *_hashes(F.col("key")))
    heavy = materialize(runs.heavy(), "heavy")
    repeated = materialize(runs.repeated(), "repeated")
    light = repeated.join(F.broadcast(heavy), _HASH, "left_anti")
    known = lines.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), _HASH, "left").withColumn("hot", F.col("hot").isNotNull())
    # Heavy lines are settled; they travel under hashes of their own place, so that no task gets them all.
    dealt = known.withColumns({"h1": F.when(F.col("hot"), F.xxhash64("_k1", "pos")).otherwise(F.col("h1")), "h2": F.when(F.col("hot"), F.col("_k2")).otherwise(F.col("h2"))})
    hits = dealt.join(light.withColumn("found", F.lit(True)).hint("merge"), _HASH, "left").filter("hot OR found").select("_k1", "_k2", "pos")
    places = materialize(hits.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "line-places")
    rows = docs.select(F.struct("*").alias("doc"), *key)
    joined = rows.join(places, ["_k1", "_k2"], "left").select("doc", F.coalesce("dropped", F.expr("cast(array() AS array<int>)")).alias("dropped"))
    return joined.select("doc", lines_of(F.coalesce("doc.text", F.lit(""))).alias("lines"), "dropped")


def kept_text() -> Column:
    """The lines between the dropped ones, joined by a line feed; linear in the lines."""
    ends = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("dropped")), F.concat(F.col("dropped"), F.array(F.size("lines"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.array_join(F.flatten(F.transform(ends, lambda r: F.slice(F.col("lines"), r["a"] + 2, r["b"] - r["a"] - 1))), "\n")


def drop_repeated_lines(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """``docs`` without the lines whose key the runs find repeated; other columns and all rows stay, n_chars follows.

    A null text stays null; an empty one is one empty line, whose key is too short to be counted.  Blank lines stay.
    A document that repeats a line counts once for it and loses it everywhere.  Very long texts are split where they are
    read, in time linear in their lines.  Rows that repeat a doc_id are separate documents.  An empty table gives an
    empty result, and columns of any other name pass through.
    """
    marked = mark_lines(docs, runs).select("doc", F.when(F.col("doc.text").isNotNull(), kept_text()).alias("new"))
    new = {"text": F.col("new")} | ({"n_chars": F.char_length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return marked.select(*(new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


def file_batches(table: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A Parquet table as up to ``batches`` DataFrames of whole files."""
    files = sorted(table.inputFiles())
    step = -(-len(files) // batches) or 1
    return [table.sparkSession.read.schema(table.schema).parquet(*files[i : i + step]) for i in range(0, len(files), step)]


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    runs = LineRuns(spark)
    for batch in file_batches(docs):
        runs.add(batch)
    marked = mark_lines(docs.select("doc_id", "text"), runs)
    runs.close()
    return marked.select(
        F.col("doc.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


ORACLE_SQL = {
    "op12_line_dedup": r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d
), r AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, r.key IS NOT NULL AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
