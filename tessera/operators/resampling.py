"""Bootstrap resamples as weights: matrices of weighted sums that tasks add up, one row of sums per replicate.

A row, or a cluster of rows, has a Poisson(1) weight in every replicate, drawn by a hash of seed, key and replicate, so a
resample is the same wherever the row is read.  A task holds a matrix (replicates x sums) per group and adds a block of
rows to it by one matrix product; no row is repeated, and what is shuffled does not grow with the rows.  Replicate 0 is
the sample itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scratch import cut

#: Bits of a draw.  The weight is exact to these: the probability of each count is right to 2 ** -30, and no tail is cut above that.
BITS = 30
#: Rows times replicates of one block, and bytes of matrices that a task holds before it hands them on.
BLOCK, HELD = 1 << 20, 64 << 20

# The increment and the multipliers of the splitmix64 generator.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def thresholds() -> list[int]:
    """A draw counts as many events as there are thresholds not above it: 2 ** BITS times the distribution of Poisson(1)."""
    out, p, total, k = [], np.exp(-1.0), 0.0, 0
    while True:
        total += p
        at = int(total * 2**BITS)
        if at >= 2**BITS or (out and at == out[-1]):
            return out
        out.append(at)
        k += 1
        p /= k


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def weights(keys: np.ndarray, seed: int, replicates: int) -> np.ndarray:
    """Weights (rows x replicates 1..n) of 64-bit keys."""
    stream = (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed << 32 & 2**64 - 1)) * np.uint64(GOLDEN)
    draws = mix(mix(keys.astype(np.int64).view(np.uint64))[:, None] + stream) >> np.uint64(64 - BITS)
    return np.searchsorted(np.array(thresholds(), np.uint64), draws, "right").astype(np.float64)


def _key(df: DataFrame, key: str) -> Column:
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long")) if whole else F.xxhash64(key)


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1).astype(np.float64) if names else np.zeros((batch.num_rows, 0))


def _adder(by: list[str], sums: list[str], seed: int, replicates: int, block: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int):
    """Task that adds ``block(weights with a first column of ones, values)`` per group and gives one row per group and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for group, m in held.items():
                keys = [pa.array([g] * len(m), types[i]) for i, g in enumerate(group)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(m)), pa.int32()), *(pa.array(m[:, k].copy()) for k in range(width))], [*by, "replicate", *(f"s{k}" for k in range(width))])
            held.clear()

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(b).type for b in by]
            keys, values = batch.column("_key").to_numpy(), _matrix(batch, sums)
            groups = list(zip(*(batch.column(b).to_pylist() for b in by), strict=True)) if by else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                places.setdefault(g, []).append(i)
            step = max(1, BLOCK // (replicates + 1))
            for group, rows in places.items():
                for start in range(0, len(rows), step):
                    at = np.array(rows[start : start + step])
                    w = np.ones((len(at), replicates + 1))
                    w[:, 1:] = weights(keys[at], seed, replicates)
                    got = block(w, values[at])
                    held[group] = held[group] + got if group in held else got
                if len(held) * (replicates + 1) * width * 8 > HELD:
                    yield from emit()
        yield from emit()

    return run


def _added(df: DataFrame, key: str, values: dict[str, Column], by: list[str], seed: int, replicates: int, block, width: int) -> DataFrame:
    names = [f"_v{k}" for k in range(len(values))]
    rows = df.select(*by, _key(df, key).alias("_key"), *(v.cast("double").alias(n) for n, v in zip(names, values.values(), strict=True))).dropna(subset=names)
    schema = T.StructType([*(df.schema[b] for b in by), T.StructField("replicate", T.IntegerType()), *(T.StructField(f"s{k}", T.DoubleType()) for k in range(width))])
    added = rows.mapInArrow(_adder(by, names, seed, replicates, block, width), schema)
    return added.groupBy(*by, "replicate").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))


def replicate_sums(df: DataFrame, key: str, values: dict[str, Column], replicates: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Per group and replicate (0: the sample) the sum of the weights, ``weight``, and of each value times its weight.

    ``key`` names what is resampled: a row's own id, or that of its cluster, whose rows then share their weights.  Rows
    with a null value are left out; rows without a key count as one cluster.  A task holds ``replicates`` x sums numbers
    for each group that it meets, and hands them on when they pass ``HELD`` bytes.
    """
    by = by or []
    got = _added(df, key, values, by, seed, replicates, lambda w, v: np.concatenate([w.sum(0)[:, None], w.T @ v], 1), len(values) + 1)
    return got.select(*by, "replicate", F.col("s0").alias("weight"), *(F.col(f"s{k + 1}").alias(n) for k, n in enumerate(values)))


def intervals(figures: DataFrame, figure: str, by: list[str], level: float = 0.95) -> DataFrame:
    """(by, figure of replicate 0, low, high): the percentile interval over the replicates; they are bounded by a parameter."""
    tail = (1 - level) / 2
    drawn = F.when(F.col("replicate") > 0, F.col(figure))
    return figures.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col(figure))).alias(figure), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"))


def bootstrap(
    df: DataFrame, value: Column, key: str, replicates: int = 800, level: float = 0.95, seed: int = 0, by: list[str] | None = None,
    sums: Callable[[Column], dict[str, Column]] = lambda x: {"x": x}, statistic: Callable[[], Column] = lambda: F.try_divide("x", "weight"),
) -> DataFrame:
    """Per group: n, the statistic as ``mean``, and its percentile interval (low, high).

    A statistic is a function of sums: ``sums`` builds their terms from the value, ``statistic`` combines the sums and
    ``weight``.  The mean needs the default only; a root mean square is ``{"xx": x * x}`` and ``sqrt(xx / weight)``.  A
    group without a value has n = 0 and nulls; a replicate in which no row has a weight has no statistic.
    """
    by = by or []
    rows = df.withColumn("_x", value.cast("double"))
    figures = replicate_sums(rows, key, sums(F.col("_x")), replicates, seed, by).withColumn("mean", statistic())
    whole = rows.groupBy(*by).agg(F.count("_x").alias("n"))
    found = intervals(figures, "mean", by, level)
    return whole.join(found, by, "left") if by else whole.join(F.broadcast(found))


def fit_replicates(train: DataFrame, key: str, features: dict[str, Column], target: Column, replicates: int, seed: int = 0) -> np.ndarray:
    """Least squares coefficients (replicates + 1 x features + 1, the intercept last), refitted in every replicate.

    One pass adds the weighted Gram matrices of all replicates beside one another; the driver solves ``replicates`` + 1
    small systems.  Where a replicate's system is singular the solution of least norm is taken.
    """
    columns = [*features.values(), F.lit(1.0), target]
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def gram(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return w.T @ np.stack([v[:, i] * v[:, j] for i, j in pairs], 1)

    rows = _added(train, key, {str(i): c for i, c in enumerate(columns)}, [], seed, replicates, gram, len(pairs)).orderBy("replicate").toPandas()
    out = np.full((replicates + 1, p - 1), np.nan)
    for r, sums in zip(rows["replicate"], rows[[f"s{k}" for k in range(len(pairs))]].to_numpy(), strict=True):
        g = np.zeros((p, p))
        for (i, j), s in zip(pairs, sums, strict=True):
            g[i, j] = g[j, i] = s
        out[r] = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    return out


def replicate_errors(test: DataFrame, key: str, features: dict[str, Column], target: Column, coefficients: np.ndarray, seed: int = 1) -> DataFrame:
    """(replicate, mae, rmse): errors on resampled test rows of the coefficients of the same replicate.

    All replicates are judged in one pass; ``coefficients`` has a row for each, from ``fit_replicates`` or fixed ones.
    """
    beta = coefficients

    def errors(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        e = v[:, -1:] - v[:, :-1] @ beta.T
        return np.stack([w.sum(0), (w * np.abs(e)).sum(0), (w * e * e).sum(0)], 1)

    columns = [*features.values(), F.lit(1.0), target]
    got = _added(test, key, {str(i): c for i, c in enumerate(columns)}, [], seed, len(beta) - 1, errors, 3)
    return got.select("replicate", F.try_divide("s1", "s0").alias("mae"), F.sqrt(F.try_divide("s2", "s0")).alias("rmse"))


def model_ladder(
    rows: DataFrame, key: str, part: str, target: Column, models: dict[str, dict[str, Column]], fixed: dict[str, Column], replicates: int = 800, level: float = 0.95, seed: int = 0,
) -> DataFrame:
    """(model, mae, low, high) on the rows whose ``part`` is test: ``fixed`` guesses as they are, and least squares ``models``
    (their features), which are refitted on the resampled training rows of every replicate.

    The interval of a refitted model holds the spread of its fit beside that of the test rows.
    """
    train, test = rows.filter(F.col(part) == "train"), rows.filter(F.col(part) == "test")
    parts = []
    for name, guess in fixed.items():
        parts.append(replicate_errors(test, key, {"guess": guess}, target, np.tile([1.0, 0.0], (replicates + 1, 1)), seed + 1).withColumn("model", F.lit(name)))
    for name, features in models.items():
        parts.append(replicate_errors(test, key, features, target, fit_replicates(train, key, features, target, replicates, seed), seed + 1).withColumn("model", F.lit(name)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return intervals(cut(out), "mae", ["model"], level)


def weights_sql(keys: str, key: str, seed: int, replicates: int) -> str:
    """Common table expressions for DuckDB: ``weighted`` is ``keys`` with a row per replicate 1..n and its weight ``w``."""
    low = "18446744073709551615::UHUGEINT"
    step = lambda z, shift, factor: f"(xor({z}, {z} >> {shift}) * {factor}::UHUGEINT) & {low}"
    chain = lambda name, source, start, keep: (
        f"{name}_0 AS (SELECT {keep}, ({start}) & {low} AS z FROM {source}), {name}_1 AS (SELECT {keep}, {step('z', 30, MIX_A)} AS z FROM {name}_0), "
        f"{name}_2 AS (SELECT {keep}, {step('z', 27, MIX_B)} AS z FROM {name}_1), {name}_3 AS (SELECT {keep}, xor(z, z >> 31) AS z FROM {name}_2)"
    )
    count = " + ".join(f"(z >> {64 - BITS} >= {t})::INTEGER" for t in thresholds())
    return (
        chain("hashed", f"(SELECT DISTINCT {key} AS k FROM {keys})", "k::UHUGEINT", "k")
        + f", drawn AS (SELECT k, r AS replicate, z + ({seed << 32} + r)::UHUGEINT * {GOLDEN}::UHUGEINT AS start FROM hashed_3, range(1, {replicates + 1}) AS rs(r)), "
        + chain("mixed", "drawn", "start", "k, replicate")
        + f", weighted AS (SELECT {keys}.*, mixed_3.replicate, {count} AS w FROM mixed_3 JOIN {keys} ON {keys}.{key} = mixed_3.k)"
    )
