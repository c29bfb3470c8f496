"""Quality scores: random Fourier features of document statistics, ridge by partition-summed normal equations.

The cosine features approximate a Gaussian kernel over standardised statistics.  Each partition adds up its part of
the normal equations, the parts are summed by row of the Gram matrix on the executors, and only the final
``FEATURES + 1`` rows reach the driver, which solves for ridge weights.  Isotonic regression (pool adjacent violators
on a histogram of raw scores with a fixed number of bins) turns raw scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, slices, text_or_empty, utf8_rows
from tessera.llm.language_id import is_held_out, is_training_row

FEATURES = 192
#: Width of the Gaussian kernel on standardised statistics, ridge weight per training row, seed of the features.
WIDTH, RIDGE, SEED = 4.0, 1e-3, 11
#: Bins of raw scores that isotonic calibration sees.
BINS = 512
THRESHOLD = 0.3
#: Rows from which on the calibration has a fold of its own; lots in which the sums of partitions are added first.
LEAST_ROWS, LOTS = 200, 256

STATISTICS = [
    "log_bytes", "log_words", "word_mean", "word_sd", "long_words", "upper", "digits", "punctuation", "symbols", "high_bytes", "spaces",
    "distinct_words", "top_word", "repeated_next", "lines", "distinct_lines", "line_mean", "capital_words", "shout_words", "marked_words", "bars", "sentence_ends",
]


def statistics(text: bytes) -> list[float]:
    """The numbers of STATISTICS for one whole text; an empty text has zeros."""
    n = len(text)
    x = np.frombuffer(text, np.uint8)
    words, lines = text.split(), text.split(b"\n")
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    byte = np.bincount(x, minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    w, counts = len(words), Counter(words)
    count = lambda chars: int(byte[list(chars)].sum()) / n
    filled = [v for v in lines if v]
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(sizes.mean()), float(sizes.std()), float((sizes > 15).mean()), count(range(65, 91)), count(range(48, 58)),
        count(b".,;:'\"()-"), count(b"#$%&*|!@^~<>{}[]\\/_=+`"), int(byte[128:].sum()) / n, count(b" \t\n\r"),
        len(counts) / w, max(counts.values()) / w, sum(map(bytes.__eq__, words, words[1:])) / w, float(np.log1p(len(filled))), len(set(filled)) / max(1, len(filled)),
        float(np.log1p(n / max(1, len(filled)))), sum(v[:1].isupper() for v in counts) / len(counts), sum(v.isupper() and len(v) > 1 for v in counts) / len(counts),
        sum(v[-1] in b"#$%&*!" for v in counts) / len(counts), words.count(b"|") / w, count(b".?!"),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array<double>, in the order of STATISTICS) of each whole text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([statistics(t) for t in utf8_rows(part, "text")], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>")


class Scorer:
    """Standardisation, features, weights and calibration; ``raw`` maps statistics to uncalibrated scores."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.directions = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.edges, self.values = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phase) * (2 / FEATURES) ** 0.5, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATISTICS)))


def isotonic(at: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``at``: the centres of the pools and their shares of ones."""
    pools: list[list[float]] = []
    for x, k, n in zip(at, ones, total, strict=True):
        pools.append([x * n, k, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def fit(rows: DataFrame) -> Scorer:
    """Fit on ``rows`` (stats array<double>, label 0/1): the ridge on four fifths, the calibration on the rest.

    The folds are told apart by a hash of the statistics, so equal texts share one; below ``LEAST_ROWS`` both steps see all
    rows.  Without rows, or with one class, scores are its share.
    """
    width = len(STATISTICS)
    every, aside = rows, F.pmod(F.xxhash64("stats"), F.lit(5)) == 0
    if every.count() >= LEAST_ROWS:
        rows, rest = every.filter(~aside), every.filter(aside)
    else:
        rest = every
    moments = rows.select(*(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)), F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        return Scorer(np.zeros(width), np.ones(width))
    scorer = Scorer(np.array([moments[f"m{i}"] for i in range(width)]), np.array([moments[f"s{i}"] for i in range(width)]))
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = shared.value.features(_stack(batch["stats"]))
            total += x.T @ np.hstack([x, batch["label"].to_numpy(np.float64)[:, None]])
        yield pd.DataFrame({"i": np.arange(len(total)), "part": list(total)})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("pid")
        return pd.DataFrame({"i": parts["i"].iloc[:1], "pid": parts["lot"].iloc[:1], "lot": [0], "part": [np.sum(np.stack(parts["part"].to_numpy()), axis=0)]})

    # Each partition gives one sum a row of the matrix; they are added in two steps, so that no group holds all of them.
    schema = "i int, pid int, lot int, part array<double>"
    parts = rows.select("stats", "label").mapInPandas(sums, "i int, part array<double>").withColumn("pid", F.spark_partition_id()).withColumn("lot", F.col("pid") % LOTS)
    parts = parts.select("i", "pid", "lot", "part").groupBy("i", "lot").applyInPandas(add, schema)
    summed = parts.groupBy("i").applyInPandas(add, schema).select("i", "part").collect()
    gram = np.array([r["part"] for r in sorted(summed, key=lambda r: r["i"])])
    ridge = RIDGE * moments["n"] * np.eye(FEATURES + 1) / FEATURES
    ridge[-1, -1] = 1e-9
    scorer.weights = np.linalg.solve(gram[:, :-1] + ridge, gram[:, -1])
    fitted = rows.sparkSession.sparkContext.broadcast(scorer)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"raw": fitted.value.raw(_stack(batch["stats"])), "label": batch["label"]})

    bin_of = F.greatest(F.lit(0), F.least(F.floor((F.col("raw") + 0.5) / 2 * BINS), F.lit(BINS - 1)))
    bins = rest.select("stats", "label").mapInPandas(raw, "raw double, label int").groupBy(bin_of.alias("bin")).agg(F.avg("raw").alias("at"), F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    scorer.edges, scorer.values = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("at", "ones", "n")))
    return scorer


def score(described: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score in [0, 1] and predicted (score >= threshold) of rows from ``describe``.

    A row without a doc_id is not held out.  A very long text is described whole; a score equal to the threshold is
    predicted 1.  Null and empty texts are scored like any other, from zero statistics; repeated rows get equal scores, and an empty
    table gives an empty result.
    """
    shared = described.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shared.value.score(_stack(batch["stats"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": found, "predicted": (found >= threshold).astype(np.int32)})

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def training_rows(described: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and label of the rows that may be learned from; a document with several labels counts with each."""
    usable = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    return described.join(usable, "doc_id").filter(is_training_row()).select("stats", "label")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = materialize(describe(read_table(spark, sf_dir, "documents")), "statistics")
    rows = materialize(training_rows(described, read_table(spark, sf_dir, "labels")), "training")
    return score(described, fit(rows)).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
