"""Gradient boosting with trees grown leaf by leaf, one softmax model over all classes.

Features are cut into at most ``max_bin`` bins at quantiles. A round grows one tree a class (one in all for two classes). A pass over
the rows sums gradients, second derivatives and rows by (tree, leaf, feature, bin) in each partition; partitions' sums are
dealt by (tree, leaf, feature) and merged, which also finds each feature's best split there, so that histograms never meet on the driver: it
gets one split a leaf.

The leaf with the greatest gain is split next, until a tree has ``num_leaves``. One pass serves all leaves of all trees that this
order may split as far as it is known; leaves that turn out not to be reached stay leaves. So the trees are those of one split at a
time, in as many passes as they are deep. Margins are kept beside the bins and written anew each round.

Missing values are above all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.runtime import Scratch, materialised

_ROUNDING = 1e-9  # gains below are what is left of equal sums


@dataclass
class Tree:
    """Node 0 is the root; a node without a feature is a leaf. Rows at or below the bin (or threshold) go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node], self.left[node], self.right[node] = feature, at, threshold, left, left + 1
        for column, empty in zip((self.feature, self.bin, self.threshold, self.left, self.right, self.value), (-1, 0, 0.0, 0, 0, 0.0), strict=True):
            column += [empty, empty]
        return left, left + 1

    def leaves(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of each row of bins or of features."""
        node, feature = np.zeros(len(x), np.int64), np.array(self.feature)
        cut, left, right = np.array(self.bin if binned else self.threshold), np.array(self.left), np.array(self.right)
        going = np.flatnonzero(feature[node] >= 0)
        while len(going):
            at = node[going]
            node[going] = np.where(x[going, feature[at]] <= cut[at], left[at], right[at])
            going = going[feature[node[going]] >= 0]
        return node


@dataclass
class Boosted:
    """Margins start at ``start`` and gain each tree's value; ``trees[round][k]`` belongs to margin ``k``."""

    start: list[float]
    trees: list[list[Tree]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start), (len(x), 1))
        for grown in self.trees:
            for k, tree in enumerate(grown):
                out[:, k] += np.array(tree.value)[tree.leaves(x, False)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return probabilities(self.margins(x))

    def plain(self) -> dict:
        return {"start": self.start, "trees": [[asdict(t) for t in grown] for grown in self.trees]}

    @staticmethod
    def of(plain: dict) -> Boosted:
        return Boosted(plain["start"], [[Tree(**t) for t in grown] for grown in plain["trees"]])


def probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], 1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logarithmic loss by margin."""
    p, k = probabilities(margins), margins.shape[1]
    if k == 1:
        return p[:, 1:] - (labels == 1)[:, None], p[:, 1:] * p[:, :1]
    return p - (labels[:, None] == np.arange(k)), k / (k - 1) * p * (1 - p)


@dataclass(frozen=True)
class Growth:
    """How trees grow; the names are those of the common library for such trees."""

    n_estimators: int = 100
    num_leaves: int = 31
    learning_rate: float = 0.1
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    min_split_gain: float = 0.0
    max_depth: int = -1
    reg_lambda: float = 0.0
    max_bin: int = 255


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, how: Growth) -> tuple[float, int, list[float]] | None:
    """Of one feature's bins the cut of the greatest gain, the first of equals: gain, bin, sums on the left."""
    left = [np.cumsum(x)[:-1] for x in (g, h, n)]
    all_ = [x.sum() for x in (g, h, n)]
    right = [t - x for t, x in zip(all_, left, strict=True)]
    fair = (left[2] >= how.min_child_samples) & (right[2] >= how.min_child_samples) & (left[1] >= how.min_child_weight) & (right[1] >= how.min_child_weight)
    if not fair.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + how.reg_lambda) + right[0] ** 2 / (right[1] + how.reg_lambda) - all_[0] ** 2 / (all_[1] + how.reg_lambda)
    gain = np.where(fair, gain, -np.inf)
    at = int(gain.argmax())
    return (float(gain[at]), at, [float(x[at]) for x in left]) if gain[at] > how.min_split_gain + _ROUNDING else None


class _Grower:
    """One tree as far as it is known: the sums and the best split of nodes, and which have been expanded."""

    def __init__(self, how: Growth):
        self.how, self.tree, self.sums, self.best, self.depth, self.pending = how, Tree(), {}, {}, {0: 0}, [0]

    def told(self, node: int, sums: list[float], best: tuple | None) -> None:
        self.sums[node] = sums
        if best and not 0 <= self.how.max_depth <= self.depth[node]:
            self.best[node] = best

    def order(self, edges: list[np.ndarray]) -> list[int]:
        """The nodes that are split, greatest gain first; expands those whose parts are not known yet."""
        leaves, splits, self.pending = [0], [], []
        while len(splits) < self.how.num_leaves - 1:
            ready = [x for x in leaves if x in self.best]
            if not ready:
                break
            node = min(ready, key=lambda x: (-self.best[x][0], x))
            _, feature, at, _ = self.best[node]
            leaves.remove(node)
            splits.append(node)
            if self.tree.feature[node] < 0:
                for child in self.tree.split(node, feature, at, float(edges[feature][at])):
                    self.depth[child] = self.depth[node] + 1
                    self.pending.append(child)
            children = [self.tree.left[node], self.tree.right[node]]
            leaves += [c for c in children if c not in self.pending]
        return splits

    def grown(self, splits: list[int]) -> Tree:
        """The tree of these splits only, with its leaves' values."""
        out, place = Tree(), {0: 0}
        for node in splits:
            children = out.split(place[node], self.tree.feature[node], self.tree.bin[node], self.tree.threshold[node])
            place[self.tree.left[node]], place[self.tree.right[node]] = children
        for node, at in place.items():
            if out.feature[at] < 0:
                g, h, _ = self.sums[node]
                out.value[at] = -self.how.learning_rate * g / (h + self.how.reg_lambda) if h + self.how.reg_lambda > 0 else 0.0
        return out


def bin_edges(rows: DataFrame, max_bin: int) -> list[np.ndarray]:
    """For each feature the greatest value of each bin but the last: quantiles, each once."""
    places = rows.select(F.posexplode("x").alias("i", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    shares = [i / max_bin for i in range(1, max_bin)]
    found = {r.i: r for r in places.groupBy("i").agg(F.percentile_approx("v", shares, 10_000).alias("q"), F.max("v").alias("top")).collect()}  # a row a feature
    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    return [np.array([v for v in sorted(set(found[i].q)) if v < found[i].top]) if i in found else np.zeros(0) for i in range(width)]


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def fit(rows: DataFrame, classes: int, how: Growth) -> tuple[Boosted, list[np.ndarray]]:
    """The model of rows (label from 0, x array, w weight) and the edges of its bins."""
    if not 2 <= how.max_bin <= 256:
        raise ValueError("a bin is one byte")
    spark = rows.sparkSession
    rows = materialised(rows.select(F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"), F.col("w").cast("double").alias("w")).where("x IS NOT NULL"))
    edges, margins = bin_edges(rows, how.max_bin), 1 if classes <= 2 else classes
    weight = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("w").alias("w")).collect()}  # a row a class
    share = np.maximum([weight.get(k, 0.0) for k in range(max(2, classes))], 1e-12)
    start = [float(np.log(share[1] / share[0]))] if margins == 1 else np.log(share / share.sum()).tolist()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(start).tobytes()
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column(1).to_pylist()], float).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([first] * len(x), pa.binary())], names=["label", "w", "bins", "margins"])

    schema, scratch, trees = "label int, w double, bins binary, margins binary", Scratch(spark, "boosting"), []
    data = scratch.written(rows.mapInArrow(cut, schema))
    for _ in range(how.n_estimators):
        growers = [_Grower(how) for _ in range(margins)]
        splits = [[] for _ in growers]
        while any(g.pending for g in growers):
            for r in _best_splits(data, growers, how).collect():  # a row a pending leaf
                g = growers[r.tree]
                g.told(r.node, list(r.sums), (r.best["gain"], r.best["feature"], r.best["bin"], list(r.best["left"])) if r.best else None)
            for g in growers:
                for node in g.pending:
                    g.sums.setdefault(node, [0.0, 0.0, 0.0])  # no feature, or no row
            splits = [g.order(edges) for g in growers]
        grown = [g.grown(s) for g, s in zip(growers, splits, strict=True)]
        if all(len(t.feature) == 1 for t in grown):
            break
        trees.append(grown)

        def moved(batches: Iterator[pa.RecordBatch], grown=grown) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins, held = _matrix(batch.column(2), np.uint8), _matrix(batch.column(3), np.float64).copy()
                    for k, tree in enumerate(grown):
                        held[:, k] += np.array(tree.value)[tree.leaves(bins, True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in held], pa.binary())], names=batch.schema.names)

        data = scratch.written(data.mapInArrow(moved, schema))
        scratch.remove(but_last=True)
    scratch.remove()
    return Boosted(start, trees), edges


def _best_splits(data: DataFrame, growers: list[_Grower], how: Growth) -> DataFrame:
    """(tree, node, sums, best) of the pending leaves."""
    trees, pending, size = [g.tree for g in growers], [g.pending for g in growers], how.max_bin + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = _matrix(batch.column(2), np.uint8), _matrix(batch.column(3), np.float64)
            labels, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first, second = gradients(margins, labels)
            width = bins.shape[1]
            held = held or [np.zeros((3, len(p) * width * size)) for p in pending]
            for k, nodes in enumerate(pending):
                if not nodes:
                    continue
                leaf = trees[k].leaves(bins, True)
                place = np.full(len(trees[k].feature), -1)
                place[nodes] = np.arange(len(nodes))
                slot = place[leaf]
                at = np.flatnonzero(slot >= 0)
                cells = ((slot[at, None] * width + np.arange(width)) * size + bins[at]).ravel()
                for i, values in enumerate((first[at, k] * w[at], second[at, k] * w[at], np.ones(len(at)))):
                    held[k][i] += np.bincount(cells, np.repeat(values, width), held[k].shape[1])
        if held is None:
            return
        for k, nodes in enumerate(pending):
            if nodes:
                cube = held[k].reshape(3, len(nodes), -1, size)
                for j, node in enumerate(nodes):
                    full = [np.flatnonzero(n) for n in cube[2, j]]  # of a small leaf most bins are empty
                    columns = [pa.array([x] * len(full), pa.int32()) for x in (k, node)] + [pa.array(range(len(full)), pa.int32())]
                    columns += [pa.array([x.astype("<u2").tobytes() for x in full], pa.binary()), pa.array([cube[:, j, f][:, x].tobytes() for f, x in enumerate(full)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "feature", "bins", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, bins, cells in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held = totals.setdefault(tuple(key), np.zeros((3, size)))
                held[:, np.frombuffer(bins, "<u2")] += np.frombuffer(cells).reshape(3, -1)
        rows = []
        for (tree, node, feature), total in totals.items():
            found = best_split(*total, how)
            best = None if found is None else {"gain": found[0], "feature": feature, "bin": found[1], "left": found[2]}
            rows.append({"tree": tree, "node": node, "feature": feature, "sums": total.sum(axis=1).tolist(), "best": best})
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    struct = pa.struct([("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.list_(pa.float64()))])
    out = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("sums", pa.list_(pa.float64())), ("best", struct)])
    each = data.mapInArrow(summed, "tree int, node int, feature int, bins binary, cells binary").repartition("tree", "node", "feature")
    each = each.mapInArrow(merged, "tree int, node int, feature int, sums array<double>, best struct<gain: double, feature: int, bin: int, left: array<double>>")
    order = F.when(F.col("best").isNotNull(), F.struct(F.col("best.gain"), -F.col("feature")))
    return each.groupBy("tree", "node").agg(F.min_by("sums", "feature").alias("sums"), F.max_by("best", order).alias("best"))
