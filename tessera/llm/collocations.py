"""Collocations: frequent phrases by Misra-Gries summaries per hash partition, counted exactly in a second pass.

First pass.  Every task hashes its n-grams and keeps, per hash partition, a summary of sorted keys with counts.  The
summaries of a partition meet and are merged by the rule of Misra and Gries: counts of equal keys are added, and where
more than ``capacity`` keys are held, the count of the next largest is taken off all.  ``capacity`` exceeds the
partition's mass divided by the threshold, so less than the threshold is ever taken off, and every frequent n-gram
survives; the number of partitions follows the text, so a summary has a bounded size.  Keys are hashes, which may only
let more survive, never fewer.

Second pass.  Survivors are marked in a bitmap of bounded size.  Tasks read the texts again, number the n-grams whose
marks are set by their words, not by hashes, and Spark adds up their counts: those are exact.  The rest is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, release, slices

#: Words of the longest phrase, the least number of occurrences, phrases of a language that are returned.
WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: A longer candidate with this percentage of a candidate's occurrences replaces it.
COVER = 100
#: Bytes of text whose n-grams fall into one hash partition, on average, and the bounds of the number of partitions.
PART_BYTES, PARTS = 4 << 20, (16, 1 << 16)
#: Bits of a key inside its partition; bits of the bitmap for each survivor, and its least and greatest size (128 MiB).
KEY_BITS, MARKS, BITMAP = 32, 32, (20, 30)
#: n-grams of a task that are sorted together, and bytes of text that are cut into words together.
RUN_GRAMS, SLICE_BYTES = 4 << 20, 8 << 20
#: Counted phrases of a task that are added up together; it holds up to twice as many.
RUN_ROWS = 1 << 20
#: Counts of a summary stop here, far above any threshold in use.
MOST = 2**31 - 1

# Marks that end a piece, and blanks between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in PIECE_ENDS else 32 if c in b"\t " else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Tokens:
    """Words of some texts: dictionary ``words``, ``code`` of each occurrence, ``lang`` code and ``piece`` number of each."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        joined = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
        blank = (joined == 32) | (joined == 10)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        data = pa.py_buffer(joined[~blank].tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), data]).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        breaks = np.flatnonzero(joined == 10)
        self.piece = np.searchsorted(breaks, start)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = langs[np.searchsorted(ends, start, "right")]

    def follows(self, k: int) -> np.ndarray:
        """Whether the ``k``-th word after an occurrence stands in its piece."""
        n = max(len(self.code) - k, 0)
        return self.piece[:n] == self.piece[k : k + n]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash, a bijection."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def gram_hashes(t: Tokens, lang_hashes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: places where such an n-gram starts, and its hash, into which the language enters."""
    w = _word_hashes(t.words)[t.code] if len(t.code) else np.zeros(0, np.uint64)
    at, h = np.arange(len(w)), _mix(w ^ lang_hashes[t.lang]) if len(w) else w
    yield at, h
    for k in range(1, longest):
        ok = t.follows(k)
        keep = (at < len(ok)) & ok[np.minimum(at, len(ok) - 1)] if len(ok) else np.zeros(len(at), bool)
        at, h = at[keep], h[keep]
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[at + k])
        yield at, h


# Summaries: sorted keys with counts, packed as bytes.


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted 32-bit keys and counts, byte by byte of equal weight, compressed."""
    planes = np.concatenate([np.diff(keys, prepend=np.uint32(0)).astype("<u4"), counts.astype("<u4")]).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    half = len(values) // 2
    return np.cumsum(values[:half], dtype=np.uint32), values[half:].astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, their counts added."""
    packed = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.minimum(counts, MOST).astype(np.uint64))
    keys, counts = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.minimum(np.add.reduceat(counts, first), MOST) if len(first) else counts


class Summary:
    """Misra-Gries counters of weighted keys; ``taken`` is what was taken off every count, at most mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.waits = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge another summary's counters; several wait for one merge while they are no more than the counters held."""
        self.waiting.append((keys, counts))
        self.waits += len(keys)
        if self.waits > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.waiting, self.waits = [], 0
        keys, counts = added(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += off
            keys, counts = keys[counts > off], counts[counts > off] - off
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have ``least`` occurrences: all that do are among them."""
        self.settle()
        return self.keys[self.counts + self.taken >= least]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, pa.Array]]:
    """Texts with the codes of their languages, and the languages; a long text comes in parts that end where a piece ends."""
    for part in slices(batch, "text", SLICE_BYTES):
        langs = part.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy().astype(np.int64)
        texts = part.column("text").cast(pa.large_binary()).to_pylist()
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
            text, at = texts[0].translate(_FOLD), 0
            while at < len(text):
                cut = text.find(b"\n", at + SLICE_BYTES)
                cut = len(text) if cut < 0 else cut + 1
                yield [text[at:cut]], codes, langs.dictionary
                at = cut
        else:
            yield texts, codes, langs.dictionary


def _summaries(bits: int, longest: int):
    """Task of the first pass: rows (part, mass, grams) of its texts."""

    def emit(hashes: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(hashes) >> np.uint64(64 - KEY_BITS - bits))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.minimum(np.diff(first, append=len(keys)), MOST)
        keys = keys[first]
        parts = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
        there = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        ends = np.append(there[1:], len(parts))
        low = (keys & np.uint64(2**KEY_BITS - 1)).astype(np.uint32)
        blobs = [pack(low[i:j], counts[i:j]) for i, j in zip(there, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(parts[there]), pa.array(np.add.reduceat(counts, there)), pa.array(blobs, pa.binary())], ["part", "mass", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for texts, codes, langs in _texts(batch):
                for _, h in gram_hashes(Tokens(texts, codes), _word_hashes(langs.cast(pa.large_binary())), longest):
                    held.append(h)
                    n += len(h)
                if n >= RUN_GRAMS:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def _merged(threshold: int):
    """Task that merges the summaries of its partitions, which come one after the other: rows (part, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def done() -> pa.RecordBatch:
            keys = summary.survivors(threshold)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([pack(keys, np.ones(len(keys)))], pa.binary())], ["part", "n", "grams"])

        for batch in batches:
            for p, total, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "total", "grams")), strict=True):
                if p != part:
                    if summary is not None:
                        yield done()
                    # Held in a task: counters up to mass / threshold, and as many that wait.
                    part, summary = p, Summary(total // threshold + 1)
                summary.add(*unpack(blob))
        if summary is not None:
            yield done()

    return run


def _marks(bits: int, size: int):
    """Rows (part, keys) -> the places of their marks in a bitmap of 2 ** size bits, as sorted words of 64 bits that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                keys = unpack(blob)[0].astype(np.uint64) | np.uint64(p << KEY_BITS)
                place = np.unique(keys >> np.uint64(bits + KEY_BITS - size))  # a key has more bits than the bitmap's places
                word = place >> np.uint64(6)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(value.astype(np.uint64).view(np.int64))], ["word", "value"])

    return run


def survivors_bitmap(rows: DataFrame, least: int = MIN_COUNT, longest: int = WORDS, part_bytes: int = PART_BYTES) -> np.ndarray:
    """A bitmap, as 64-bit words, in which the first bits of the hash of every n-gram with ``least`` occurrences are set.

    It has ``MARKS`` bits for each survivor, between 2 ** 20 and 2 ** 30; the driver holds no more than that.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(PARTS[0], min(PARTS[1], -(-size // part_bytes))).bit_length() - 1
    summaries = rows.mapInArrow(_summaries(bits, longest), "part bigint, mass bigint, grams binary")
    # The window brings a partition's summaries together, in order, beside its mass.
    together = summaries.withColumn("total", F.sum("mass").over(Window.partitionBy("part"))).select("part", "total", "grams")
    kept = materialize(together.mapInArrow(_merged(least), "part bigint, n bigint, grams binary"), "phrases-kept")
    survivors = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log = max(BITMAP[0], min(BITMAP[1], (survivors * MARKS).bit_length()))
    marks = kept.mapInArrow(_marks(bits, log), "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value"))
    bitmap = np.zeros(1 << (log - 6), np.uint64)
    found = marks.toArrow()
    bitmap[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    release(kept)
    return bitmap


def _counts(shared, longest: int):
    """Task of the second pass: rows (lang, phrase, words, n) of n-grams whose marks are set, and (lang, null, 0, n) for all words."""

    def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, first, inverse, n = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
        return first, inverse, n

    names = ["lang", "phrase", "words", "n"]

    def added_up(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).group_by(names[:3]).aggregate([("n", "sum")])
        return table.rename_columns(names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task's slices are added up before they leave it, ``RUN_ROWS`` at a time."""
        held, fresh = [], 0
        for rows in counts(batches):
            held.append(rows)
            fresh += rows.num_rows
            if fresh >= RUN_ROWS:
                held = added_up(held)
                n = sum(x.num_rows for x in held)
                if n > RUN_ROWS:
                    yield from held
                    held = []
                fresh = 0
        if held:
            yield from added_up(held)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        shift = np.uint64(64 - (len(bitmap).bit_length() + 5))
        for batch in batches:
            for texts, codes, langs in _texts(batch):
                t = Tokens(texts, codes)
                n = np.bincount(t.lang, minlength=len(langs))
                yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), pa.nulls(len(n), pa.string()), pa.array(np.zeros(len(n)), pa.int32()), pa.array(n.astype(np.int64))], names)
                number = np.full(len(t.code), -1, np.int64)
                words = t.words
                for k, (at, h) in enumerate(gram_hashes(t, _word_hashes(langs.cast(pa.large_binary())), longest)):
                    place = h >> shift
                    marked = (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
                    # The parts of a frequent n-gram are frequent: its first words have a number from the step before.
                    at = at[marked & (number[at] >= 0)] if k else at[marked]
                    last = t.code[at + k]
                    own = (number[at] if k else t.lang[at]) * np.int64(len(words)) + last
                    first, inverse, count = numbered(own)
                    number = np.full(len(t.code), -1, np.int64)
                    number[at] = inverse
                    if not len(first):
                        break
                    where = at[first]
                    columns = [words.take(pa.array(t.code[where + j])) for j in range(k + 1)]
                    phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if k else columns[0]
                    # Distinct n-grams of a slice only; the phrase is a string again.
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(t.lang[where])).cast(pa.string()), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(where), k + 1), pa.int32()), pa.array(count.astype(np.int64))], names)

    return run


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, longest: int = WORDS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all n-grams with ``least`` occurrences in a language, and (lang, n) of all its words.

    Both tables lie in the shared folder.
    """
    rows = docs.filter("text IS NOT NULL AND text <> ''").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(survivors_bitmap(rows, least, longest, part_bytes))
    counted = rows.mapInArrow(_counts(shared, longest), "lang string, phrase string, words int, n bigint").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    all_counts = materialize(counted.filter((F.col("words") == 0) | (F.col("f") >= least)), "phrases")
    shared.destroy()
    return all_counts.filter("words > 0"), all_counts.filter("words = 0").select("lang", F.col("f").alias("n"))


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = WORDS, top: int = TOP, cover: int = COVER, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A null text counts as empty, a null lang as ``und``.  Ties go to the larger a, then to the smaller phrase in bytes.
    Rows that repeat a text, or a doc_id, count each.  A very long text is read in parts that end where a piece ends.
    An empty table, or one without a frequent phrase, gives an empty result; other columns are not read.
    """
    grams, totals = phrase_counts(docs, least, longest, part_bytes)
    words = F.split("phrase", " ", -1)
    candidates = grams.filter("words >= 2").withColumnRenamed("f", "a")
    # Parts of a longer candidate, from two words on, that it may replace.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _part(F.col("w"), i, k))))
    longer = candidates.filter("words > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(cover).cast("decimal(10,0)") * F.col("a"))).drop("longer")
    cuts = free.withColumn("w", words).select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    lefts = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    # Whole numbers of up to 38 digits; the quotient is one of 64 bits.
    score = F.expr("(CAST(1000 * CAST(a AS decimal(14,0)) AS decimal(18,0)) * CAST(n AS decimal(19,0))) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(19,0)))")
    scored = scored.withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op13_collocations": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), g AS (
  SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM w, range(1, 6) AS ks(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
), n AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words >= 2
), sub AS (
  SELECT DISTINCT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, f
  FROM c, range(2, 5) AS ks(k), LATERAL (SELECT unnest(range(1, words - k + 2)) AS i) WHERE k < words
), free AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = c.lang AND sub.phrase = c.phrase AND 100 * sub.f >= 100 * c.f)
), cut AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : words], ' ') AS rest
  FROM free, range(1, 5) AS ks(k) WHERE k < words
), scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n.n AS n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN n ON n.lang = cut.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""
}
