"""A perceptron with tanh units trained by Adam on mini-batches, its gradients summed over partitions.

Rows are dealt once, by a hash of their key, into ``batches`` folders; a step reads one of them, and each epoch takes them in
another seeded order. In a step every partition runs its rows forward and back and gives one row of gradient sums, these are
added in two steps, and the driver moves the weights, whose number does not depend on the rows. Loss, penalty, first weights and steps
are those of the usual definition: mean cross-entropy plus ``alpha`` / 2n times the squared weights, uniform first weights within
sqrt(6 / (in + out)).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.runtime import Scratch

Weights = list[tuple[np.ndarray, np.ndarray]]


def first_weights(sizes: Sequence[int], seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = np.sqrt(6.0 / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def forward(x: np.ndarray, weights: Weights) -> list[np.ndarray]:
    """The values of every layer, the last as probabilities of the classes."""
    layers = [x]
    for i, (w, b) in enumerate(weights):
        z = layers[-1] @ w + b
        if i < len(weights) - 1:
            z = np.tanh(z)
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            z = e / e.sum(axis=1, keepdims=True)
        layers.append(z)
    return layers


def gradient_sums(x: np.ndarray, labels: np.ndarray, weights: Weights) -> tuple[float, np.ndarray]:
    """The cross-entropy and its gradient, summed over rows; the gradient as one row of numbers."""
    layers, flat = forward(x, weights), []
    loss = -float(np.log(np.maximum(layers[-1][np.arange(len(x)), labels], 1e-300)).sum())
    delta = layers[-1] - (labels[:, None] == np.arange(layers[-1].shape[1]))
    for i in range(len(weights) - 1, -1, -1):
        flat = [(layers[i].T @ delta).ravel(), delta.sum(axis=0), *flat]
        if i:
            delta = delta @ weights[i][0].T * (1 - layers[i] ** 2)
    return loss, np.concatenate(flat)


def flattened(weights: Weights) -> np.ndarray:
    return np.concatenate([p.ravel() for pair in weights for p in pair])


def unflattened(flat: np.ndarray, sizes: Sequence[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


class Adam:
    """The usual moments and steps."""

    def __init__(self, rate: float = 1e-3, first: float = 0.9, second: float = 0.999, eps: float = 1e-8):
        self.rate, self.first, self.second, self.eps, self.step, self.m, self.v = rate, first, second, eps, 0, 0.0, 0.0

    def moved(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient**2
        rate = self.rate * np.sqrt(1 - self.second**self.step) / (1 - self.first**self.step)
        return weights - rate * self.m / (np.sqrt(self.v) + self.eps)


def _batch_of(key: str, batches: int, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)).cast("int")


def fit(rows: DataFrame, classes: int, hidden: Sequence[int] = (80,), epochs: int = 200, batches: int = 8, rate: float = 1e-3, alpha: float = 1e-4, tol: float = 1e-4, patience: int = 10, seed: int = 0) -> tuple[list[int], Weights, list[float]]:
    """The layers' sizes, the weights and the loss of each epoch, of rows (label from 0, x array, key).

    Training ends early once the loss has not fallen by ``tol`` for ``patience`` epochs. Rows without features are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "perceptron")
    folder = f"{scratch.folder}/rows"
    dealt = rows.where("x IS NOT NULL").select(F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"), _batch_of("key", batches, seed).alias("batch"))
    dealt.repartition("batch", F.pmod(F.xxhash64("x"), F.lit(64))).write.partitionBy("batch").parquet(folder)
    data = spark.read.schema("label int, x array<double>, batch int").parquet(folder)
    counts = {r.batch: r.n for r in data.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row a batch
    width = data.select(F.max(F.size("x"))).first()[0] or 0
    sizes = [width, *hidden, max(2, classes)]
    flat, adam, losses, rng = flattened(first_weights(sizes, seed)), Adam(rate), [], np.random.default_rng([seed, 1])
    # the penalty holds weights, not offsets
    held = flattened([(np.ones_like(w), np.zeros_like(b)) for w, b in unflattened(flat, sizes)])
    for _ in range(epochs):
        lost = 0.0
        for batch in rng.permutation(sorted(counts)).tolist():
            n = counts[batch]
            loss, gradient = _summed(data.where(F.col("batch") == batch), unflattened(flat, sizes), len(flat))
            lost += loss + n * 0.5 * alpha * float((held * flat**2).sum()) / n
            flat = adam.moved(flat, (gradient + alpha * held * flat) / n)
        losses.append(lost / max(1, sum(counts.values())))
        if len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience]) - tol:
            break
    scratch.remove()
    return sizes, unflattened(flat, sizes), losses


def _summed(batch: DataFrame, weights: Weights, size: int, merge: int = 16) -> tuple[float, np.ndarray]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = np.nan_to_num(np.array([[np.nan if v is None else v for v in r] for r in b.column(1).to_pylist()], float))
                more, gradient = gradient_sums(x, b.column(0).to_numpy(), weights)
                loss, total = loss + more, total + gradient
        yield pa.RecordBatch.from_pydict({"loss": [loss], "gradient": [total.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, np.zeros(size)
        for b in batches:
            loss += sum(b.column(0).to_pylist())
            for g in b.column(1).to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_pydict({"loss": [loss], "gradient": [total.tobytes()]})

    parts = batch.select("label", "x").mapInArrow(part, "loss double, gradient binary")
    if parts.rdd.getNumPartitions() > merge:
        parts = parts.repartition(merge).mapInArrow(added, "loss double, gradient binary")
    found = parts.collect()  # at most ``merge`` rows
    return sum(r.loss for r in found), np.sum([np.frombuffer(r.gradient) for r in found], axis=0)
