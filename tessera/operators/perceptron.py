"""A perceptron over counted rows: the loss and its gradient are summed by Spark, the weights are stepped by L-BFGS."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one matrix product.
_ROWS = 8192


def start(layers: list[int], seed: int) -> np.ndarray:
    """Weights and offsets of all layers in one vector, as Spark's perceptron draws them."""
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.uniform(-2.4 / a, 2.4 / a, a * b + b) for a, b in zip(layers, layers[1:], strict=False)])


def _unpacked(w: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, w: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """The layers' values: logistic between, and what the softmax takes at the end."""
    values = [x]
    for i, (m, b) in enumerate(_unpacked(w, layers)):
        z = values[-1] @ m + b
        values.append(z if i == len(layers) - 2 else 0.5 * (1 + np.tanh(0.5 * z)))
    return values


def loss_and_gradient(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Cross entropy of rows that count ``n`` times, summed, and its gradient."""
    values = _forward(x, w, layers)
    z = values[-1] - values[-1].max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -float(n @ (z[at, y] - np.log(np.exp(z).sum(axis=1))))
    p[at, y] -= 1
    back, parts = p * n[:, None], []
    for i, (m, _) in reversed(list(enumerate(_unpacked(w, layers)))):
        parts.append(np.concatenate([(values[i].T @ back).ravel(), back.sum(axis=0)]))
        if i:
            back = (back @ m.T) * values[i] * (1 - values[i])
    return loss, np.concatenate(parts[::-1])


def _arrays(batch: pa.RecordBatch, features: list[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features], axis=1) - mean) / scale


def summed(counts: DataFrame, features: list[str], label: str, n: str, mean: np.ndarray, scale: np.ndarray, layers: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The loss and gradient at given weights over a table of (features, label, n); a task sends one vector of their size."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 1)
            for batch in batches:
                x, y, times = _arrays(batch, features, mean, scale), batch.column(label).to_numpy().astype(np.int64), batch.column(n).to_numpy().astype(np.float64)
                for k in range(0, len(y), _ROWS):
                    loss, gradient = loss_and_gradient(x[k : k + _ROWS], y[k : k + _ROWS], times[k : k + _ROWS], w, layers)
                    total += np.r_[loss, gradient]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        total = sum((np.frombuffer(r.sums) for r in counts.mapInArrow(run, "sums binary").toLocalIterator()), np.zeros(len(w) + 1))
        return float(total[0]), total[1:]

    return at


def descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with steps halved until the loss falls as its slope says; ends when it hardly falls any more."""
    value, slope = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y in reversed(past):
            kept.append((s @ q) / (y @ s))
            q -= kept[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        step, downhill = 1.0, float(slope @ q)
        for _ in range(20):
            there, slope_there = f(w - step * q)
            if there <= value - 1e-4 * step * downhill:
                break
            step /= 2
        else:
            return w
        s, y = -step * q, slope_there - slope
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        fell, w, value, slope = value - there, w + s, there, slope_there
        if fell <= tolerance * max(abs(value), 1e-12):
            break
    return w


def predicted(rows: DataFrame, features: list[str], mean: np.ndarray, scale: np.ndarray, w: np.ndarray, layers: list[int], name: str) -> DataFrame:
    """``rows`` with the likeliest label as a bigint ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _arrays(batch, features, mean, scale)
            guess = [_forward(x[k : k + _ROWS], w, layers)[-1].argmax(axis=1) for k in range(0, len(x), _ROWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *guess]))], [*batch.schema.names, name])

    from pyspark.sql import types as Y

    return rows.mapInArrow(run, Y.StructType([*rows.schema.fields, Y.StructField(name, Y.LongType())]))
