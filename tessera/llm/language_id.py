"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text is lower-cased, everything but letters becomes one space, and its byte n-grams of ``NGRAMS`` are hashed into
``BUCKETS`` rows of an embedding table.  Their mean feeds a softmax.  Table and weights are trained by stochastic
gradient descent in numpy on a bounded, evenly spread sample of labelled rows, in one task of its own; a part of it that
is not fitted sets the temperature that makes scores probabilities and the score below which an answer is rejected.
Embedding times weights is folded into one small table of logits per bucket, so scoring a text is a gather and a mean
over all of it, and the folded table is all that the driver ever sees.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read_table, slices, text_or_empty

NGRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
#: The labelled rows that training sees at most, over all languages together.
SAMPLE_ROWS = 3000
#: More labelled languages than this are refused, as each has a row of the quota and a column of the logits.
MAX_LANGUAGES = 1000
EPOCHS, STEPS, RATE, BATCH = 60, 40_000, 4.0, 32
#: Rejection: at most MISSED of the right answers on validation rows may be refused, and none that is likelier right
#: than wrong, so the threshold is never above LEAST_SCORE.
MISSED, LEAST_SCORE = 0.002, 0.5
UNKNOWN = "und"


def is_training_row(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 0 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows with an id whose crc32 is 0 modulo 5; a row without an id is neither held out nor learned from."""
    return F.coalesce(~is_training_row(doc_id), F.lit(False))


def _beyond_ascii_no_letters() -> re.Pattern:
    """Runs of characters from 128 on that are punctuation, symbols, spaces, numbers or controls, by their category."""
    dull = [c for c in range(128, 1 << 16) if unicodedata.category(chr(c))[0] in "PSZN" or unicodedata.category(chr(c)) == "Cc"]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(dull), lambda x: x[1] - x[0])]
    return re.compile("[" + "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs) + "]+")


_DULL = _beyond_ascii_no_letters()
#: Bytes to bytes: lower-case letters of ASCII and UTF-8's longer forms stay, others become a space.
_LETTERS = np.array([c if 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint8)


def clean(text: str) -> bytes:
    """Lower-cased UTF-8 in which only letters, marks and what ``subwords`` makes a space are left."""
    text = text.lower()
    return (text if text.isascii() else _DULL.sub(" ", text)).encode()


def subwords(text: bytes) -> np.ndarray:
    """Bucket numbers of all n-grams of the cleaned text; empty if it holds no letter."""
    x = _LETTERS[np.frombuffer(text, np.uint8)]
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])] if len(x) else x
    if not (x != 32).any():
        return np.zeros(0, np.int64)
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in NGRAMS:
            m = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((m ^ (m >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """What workers need: logits per bucket, the languages, temperature and threshold of rejection."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; ``und`` and 0 for null and for texts without a letter."""
        if not has_letter(text):
            return UNKNOWN, 0.0
        z = self.bias.astype(np.float64).copy()
        found = subwords(clean(text))
        if len(found):
            total = np.zeros(len(z))
            for at in range(0, len(found), 1 << 18):
                total += self.logits[found[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
            z += total / len(found)
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])

    def rejects(self, text: str | None) -> bool:
        """Whether a filter drops the text; a model that has learned no language drops only what has no letter."""
        if self.languages == [UNKNOWN]:
            return not has_letter(text)
        best, score = self.score(text)
        return best == UNKNOWN or score < self.threshold


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with weights: the same mean as of all n-grams, and it fits however long the text is."""
    found = subwords(clean(text))
    ids, n = np.unique(found, return_counts=True)
    return ids.astype(np.int32), (n / max(len(found), 1)).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit on four fifths of the rows, calibrate on the rest.  Without usable rows the model has one answer, ``und``."""
    rows = [(_bag(t), y) for t, y in zip(texts, labels, strict=True) if has_letter(t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    kept = order[len(rows) // 5 :] if len(rows) >= 50 else order
    bags = [b for b, _ in rows]
    y = np.array([languages.index(v) for _, v in rows])
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    mean = lambda i: bags[i][1] @ table[bags[i][0]]
    epochs = max(5, min(EPOCHS, STEPS // len(rows)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(kept)
        for at in range(0, len(kept), BATCH):
            part = kept[at : at + BATCH]
            hidden = np.stack([mean(i) for i in part])
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(part)), y[part]] -= 1
            back = error @ weights.T
            weights -= rate / len(part) * hidden.T @ error
            bias -= 0.1 * rate / len(part) * error.sum(axis=0)
            for i, g in zip(part, back, strict=True):
                table[bags[i][0]] -= rate / len(part) * 8 * bags[i][1][:, None] * g
    z = np.stack([mean(i) for i in held]) @ weights + bias
    grid = np.geomspace(0.25, 16, 49)
    nll = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(nll))])
    return Model(languages, (table @ weights).astype(np.float32), bias, temperature, rejection_threshold(_softmax(z / temperature), y[held]))


def rejection_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The score below which an answer is refused, from calibrated probabilities ``p`` of rows with the labels ``y``."""
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    return float(min(LEAST_SCORE, right[int(MISSED * len(right))])) if len(right) else LEAST_SCORE


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> Model:
    """The model of the sample of ``docs``, trained in one task that holds the sample; its folded table is fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("lang", "ascending"), ("r", "ascending")])
        m = train(table["text"].to_pylist(), table["lang"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([m.languages]), pa.array([m.logits.tobytes()]), pa.array([m.bias.astype(np.float64).tobytes()]), pa.array([m.temperature]), pa.array([m.threshold])], ["languages", "logits", "bias", "temperature", "threshold"])

    chosen = sample(docs, rows, max_languages)
    if chosen is None:
        return train([], [])
    m = chosen.repartition(1).mapInArrow(run, "languages array<string>, logits binary, bias binary, temperature double, threshold double").first()
    languages = list(m["languages"])
    return Model(languages, np.frombuffer(bytes(m["logits"]), np.float32).reshape(BUCKETS, len(languages)), np.frombuffer(bytes(m["bias"])), m["temperature"], m["threshold"])


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> DataFrame | None:
    """text, lang, r: of the labelled rows at most ``rows // languages`` (one at least) for each language; None if there are none.

    They are the first by a hash of doc_id, doc_id and a hash of the text, whatever the order of the table.  A filter on the hash
    leaves a little over the quota of each language, so that no window takes a whole one.  Raises over ``max_languages``.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_training_row())
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(max_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled")
    quota = max(1, rows // len(counts))
    # Eight standard deviations over the quota; where ids repeat that can still fall short, and the share is widened.
    shares = {k: min(1.0, (quota + 8 * quota**0.5 + 32) / n) for k, n in counts.items()}
    while True:
        share = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))])
        near = labelled.filter(place < share[F.col("lang")])
        got = {r["lang"]: r["count"] for r in near.groupBy("lang").count().collect()}
        short = [k for k, v in shares.items() if v < 1.0 and got.get(k, 0) < min(counts[k], quota)]
        if not short:
            break
        shares |= {k: min(1.0, 4 * shares[k]) for k in short}
    first = Window.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text"), "text")
    return near.select("text", "lang", "doc_id").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= quota).select(F.col("text").cast("string"), F.col("lang").cast("string"), "r")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, rejected.

    Null texts and texts without a letter get ``und``, score 0, and are rejected; so are texts whose calibrated score
    is below the model's threshold, though their best language is still named.  Whole texts are read, nothing but the
    text enters; of languages with equal scores the alphabetically first is named; repeated rows get equal values, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.score(t) for t in part.column("text").to_pylist()]
                lang, score = [f[0] for f in found], [f[1] for f in found]
                rejected = [a == UNKNOWN or s < model.threshold for a, s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns and in one pass over the table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([not model.rejects(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
