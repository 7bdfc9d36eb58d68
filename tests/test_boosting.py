"""Leaf-wise boosting against a plain booster of one split at a time, persistence, missing values, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import boosting
from fluxloom.operators import classify as K


def _plain(x, labels, w, classes, edges, how):
    """Margins of the training rows and all trees, one split at a time on the driver."""
    n, margins = len(x), 1 if classes == 2 else classes
    share = np.array([w[labels == k].sum() for k in range(classes)])
    held = np.tile([np.log(share[1] / share[0])] if margins == 1 else np.log(share / share.sum()), (n, 1))
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    shapes = []
    for _ in range(how.n_estimators):
        p = 1 / (1 + np.exp(-held)) if margins == 1 else np.exp(held) / np.exp(held).sum(axis=1, keepdims=True)
        y = (labels == 1)[:, None] if margins == 1 else labels[:, None] == np.arange(classes)
        g, h = (p - y) * w[:, None], p * (1 - p) * (1 if margins == 1 else classes / (classes - 1)) * w[:, None]
        for k in range(margins):
            leaves, depth, split = [np.arange(n)], {0: 0}, []
            while len(leaves) < how.num_leaves:
                best = None
                for i, rows in enumerate(leaves):
                    if 0 <= how.max_depth <= depth[i]:
                        continue
                    for f, e in enumerate(edges):
                        for b in range(len(e)):
                            go = bins[rows, f] <= b
                            a, z = rows[go], rows[~go]
                            if min(len(a), len(z)) < how.min_child_samples or min(h[a, k].sum(), h[z, k].sum()) < how.min_child_weight:
                                continue
                            gain = sum(s * g[r, k].sum() ** 2 / (h[r, k].sum() + how.reg_lambda) for s, r in ((1, a), (1, z), (-1, rows)))
                            if gain > how.min_split_gain + 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, i, f, b, a, z
                if best is None:
                    break
                _, i, f, b, a, z = best
                split.append((f, b))
                depth[len(leaves)] = depth[i] = depth[i] + 1
                leaves[i] = a
                leaves.append(z)
            for rows in leaves:
                held[rows, k] -= how.learning_rate * g[rows, k].sum() / (h[rows, k].sum() + how.reg_lambda)
            shapes.append(split)
    return held, shapes


def _rows(spark, n=240, width=4, classes=3, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)).round(2)
    labels = (np.digitize(x[:, 0] + x[:, 1] ** 2, [0.0, 1.2][: classes - 1])).astype(int)
    w = r.uniform(0.5, 2.0, n)
    return spark.createDataFrame([(int(k), [float(v) for v in row], float(v)) for k, row, v in zip(labels, x, w, strict=True)], "label int, x array<double>, w double"), x, labels, w


@pytest.mark.parametrize(("classes", "how"), [(3, {"num_leaves": 6}), (2, {"num_leaves": 9, "min_split_gain": 0.05, "reg_lambda": 1.0}), (3, {"num_leaves": 40, "max_depth": 3, "min_child_weight": 2.0})])
def test_same_as_one_split_at_a_time(spark, classes, how):
    how = boosting.Growth(n_estimators=3, min_child_samples=8, max_bin=16, learning_rate=0.3, **how)
    df, x, labels, w = _rows(spark, classes=classes)
    model, edges = boosting.fit(df.repartition(3), classes, how)
    assert all(len(e) <= 15 for e in edges)
    held, shapes = _plain(x, labels, w, classes, edges, how)
    assert np.allclose(model.margins(x), held, atol=1e-6)
    assert [sum(f >= 0 for f in t.feature) for grown in model.trees for t in grown] == [len(s) for s in shapes]


def test_missing_values_and_odd_tables(spark):
    rows = [(i % 2, [float(i % 7), None if i % 3 == 0 else float("nan") if i % 3 == 1 else 1.0, None], 1.0) for i in range(120)] + [(1, None, 1.0)]
    df = spark.createDataFrame(rows, "label int, x array<double>, w double")
    model, edges = boosting.fit(df, 2, boosting.Growth(n_estimators=2, min_child_samples=5))
    assert [len(e) for e in edges][1:] == [0, 0]
    told = model.probabilities(np.array([[np.nan, np.nan, np.nan], [3.0, 1.0, 0.0]]))
    assert np.isfinite(told).all() and np.allclose(told.sum(axis=1), 1)
    one, _ = boosting.fit(df.where("label = 1"), 2, boosting.Growth(n_estimators=2))  # one class alone
    assert one.probabilities(np.zeros((1, 3)))[0, 1] > 0.99
    none, _ = boosting.fit(df.limit(0), 3, boosting.Growth(n_estimators=2))
    assert none.trees == []
    with pytest.raises(ValueError):
        boosting.fit(df, 2, boosting.Growth(max_bin=1000))


def test_classifier_learns_and_is_saved(spark, tmp_path):
    df, *_ = _rows(spark, 900, seed=4)
    rows = df.select(F.monotonically_increasing_id().alias("object_id"), F.concat(F.lit("c"), "label").alias("label"), F.col("x").alias("features"))
    model = K.LeafwiseTrees(n_estimators=12, num_leaves=8, learning_rate=0.3).fit(rows)
    told = model.predict(rows)
    plain = K.BoostedTrees(maxIter=12, maxDepth=3, stepSize=0.3).fit(rows).predict(rows)
    ours, theirs = (np.mean([K.score_auc(t, model.labels, i) for i in range(3)]) for t in (told, plain))
    assert ours >= theirs - 0.005 and ours > 0.95 and K.score_accuracy(told, model.labels) > 0.9
    model.save(spark, str(tmp_path / "m"))
    again = K.Classifier.load(spark, str(tmp_path / "m")).predict(rows)
    key = lambda r: r.object_id
    assert sorted(told.collect(), key=key) == sorted(again.collect(), key=key)


def test_search_at_defaults(spark):
    df, *_ = _rows(spark, 200)
    rows = df.select(F.monotonically_increasing_id().alias("object_id"), "label", F.col("x").alias("features"))
    grid = {"num_leaves": (2, 4), "learning_rate": (0.1, 0.3)}
    asked = []

    def make(**p):
        asked.append(p)
        return K.DecisionTree()

    found = K.coordinate_search(make, rows, grid, at_defaults=True, folds=2, scoring="accuracy")
    one = [set(p) for p in asked if len(p) == 1]
    assert {frozenset(s) for s in one} == {frozenset({"num_leaves"}), frozenset({"learning_rate"})} and set(found.best) == set(grid)
