"""t-SNE of feature vectors: a bounded number of landmarks on the driver, all other rows placed among them in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    n, target = len(d2), np.log(min(perplexity, max(2.0, (len(d2) - 1) / 3)))
    p = np.zeros((n, n))
    for i in range(n):
        row, low, high, beta = np.delete(d2[i], i), 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(row - row.min()) * beta)
            s = w.sum()
            h = np.log(s) + beta * float((row - row.min()) @ w) / s
            if abs(h - target) < 1e-5:
                break
            low, high = (beta, high) if h > target else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i, np.arange(n) != i] = w / s
    return (p + p.T) / (2 * n)


def embed(x: np.ndarray, perplexity: float = 100.0, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """Two coordinates for each row."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros((len(x), 2))
    d2 = np.maximum(((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T), 0)
    p = np.maximum(_affinities(d2, perplexity), 1e-12)
    y, velocity = np.random.default_rng(seed).standard_normal((len(x), 2)) * 1e-2, np.zeros((len(x), 2))
    for step in range(rounds):
        squares = (y * y).sum(axis=1)
        w = 1 / (1 + np.maximum(squares[:, None] + squares[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(w, 0)
        pull = (p * (4 if step < 100 else 1) - np.maximum(w / w.sum(), 1e-12)) * w
        grad = 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)
        velocity = (0.5 if step < 100 else 0.8) * velocity - 0.1 * len(x) * grad
        y = y + velocity
        y -= y.mean(axis=0)
    return y


def place(x: np.ndarray, landmarks: np.ndarray, y: np.ndarray, perplexity: float = 100.0, rounds: int = 100) -> np.ndarray:
    """Two coordinates for each row of ``x`` among fixed ``landmarks`` embedded at ``y``.

    A row starts at its neighbours' mean, weighted by its affinities, and descends the divergence of its own affinities.
    """
    d2 = np.maximum((x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None, :] - 2 * x @ landmarks.T, 0)
    d2 -= d2.min(axis=1, keepdims=True)
    target = np.log(min(perplexity, max(2.0, len(landmarks) / 3)))
    low, high, beta = np.zeros(len(x)), np.full(len(x), np.inf), np.ones(len(x))
    for _ in range(50):
        w = np.exp(-d2 * beta[:, None])
        s = w.sum(axis=1)
        h = np.log(s) + beta * (d2 * w).sum(axis=1) / s
        if (np.abs(h - target) < 1e-5).all():
            break
        low, high = np.where(h > target, beta, low), np.where(h > target, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = w / s[:, None]
    at, step = p @ y, 0.1 * y.std()
    for _ in range(rounds):
        w = 1 / (1 + np.maximum((at * at).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * at @ y.T, 0))
        pull = (p - w / w.sum(axis=1, keepdims=True)) * w
        grad = 2 * (pull.sum(axis=1)[:, None] * at - pull @ y)
        size = np.sqrt((grad * grad).sum(axis=1, keepdims=True))
        at = at - grad * np.minimum(1.0, step / np.maximum(size, 1e-12))
    return at


def tsne(df: DataFrame, column: str = "features", key: str = "object_id", rows: int = 2000, perplexity: float = 100.0, seed: int = 0) -> DataFrame:
    """(key, x, y) of every row: the first ``rows`` by hash are embedded together, the others placed among them."""
    kind = dict(df.dtypes)[key]
    numbered = df.select(F.col(key), F.col(column).cast("array<double>").alias("_x"), F.xxhash64(F.lit(seed), key, column).alias("_h"))
    sample = numbered.orderBy("_h", key).limit(rows + 1).collect()
    known, more = sample[:rows], len(sample) > rows
    x = np.array([r["_x"] for r in known], float)
    y = embed(x, perplexity, seed=seed) if known else np.zeros((0, 2))
    schema = f"{key} {kind}, x double, y double"
    done = df.sparkSession.createDataFrame([(r[0], float(a), float(b)) for r, (a, b) in zip(known, y, strict=True)], schema)
    if not more:
        return done
    edge, spread = known[-1], df.sparkSession.sparkContext.broadcast((x, y))
    same = sum(r["_h"] == edge["_h"] and r[0] == edge[0] for r in known)
    after = (F.col("_h") > edge["_h"]) | (F.col("_h") == edge["_h"]) & (F.col(key) > F.lit(edge[0]))
    again = numbered.where((F.col("_h") == edge["_h"]) & F.col(key).eqNullSafe(F.lit(edge[0])))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        landmarks, at = spread.value
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                found = place(np.stack(part["_x"].to_numpy()).astype(float), landmarks, at, perplexity)
                yield pd.DataFrame({key: part[key], "x": found[:, 0], "y": found[:, 1]})

    # rows alike in hash and key are copies: those that the landmarks have no room for are placed too
    spare = again.count() - same
    rest = numbered.where(after).select(key, "_x")
    rest = rest.unionAll(again.limit(spare).select(key, "_x")) if spare else rest
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return done.unionAll(rest.repartition(parts).mapInPandas(placed, schema))
