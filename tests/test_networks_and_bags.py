"""The tanh perceptron against a plain trainer; out-of-bag votes against trees asked one by one."""

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fluxloom.operators import classify as K
from fluxloom.operators import perceptron as P


def _rows(spark, n=150, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    labels = np.digitize(x[:, 0] * x[:, 1] + x[:, 2], [-0.5, 0.5])
    return spark.createDataFrame([(i, f"c{k}", [float(v) for v in row]) for i, (k, row) in enumerate(zip(labels, x, strict=True))], "object_id long, label string, features array<double>")


def test_same_as_a_plain_trainer(spark):
    rows, how = _rows(spark), {"hidden": (7, 4), "epochs": 6, "batches": 3, "rate": 0.01, "alpha": 0.1, "seed": 5}
    model = K.TanhPerceptron(**how).fit(rows.repartition(4))
    batch = {r.object_id: r.b for r in rows.select("object_id", P._batch_of("object_id", 3, 5).alias("b")).select(F.col("object_id"), F.pmod(F.xxhash64(F.lit(5), F.col("object_id").cast("string")), F.lit(3)).alias("b")).collect()}
    data = [(batch[r.object_id], int(r.label[1]), r.features) for r in rows.collect()]
    sizes = [5, 7, 4, 3]
    weights = [p.copy() for pair in P.first_weights(sizes, 5) for p in pair]
    m, v, t, rng = [0.0] * 6, [0.0] * 6, 0, np.random.default_rng([5, 1])
    for _ in range(6):
        for b in rng.permutation(sorted(set(batch.values()))):
            x, y = np.array([f for k, _, f in data if k == b]), np.array([c for k, c, _ in data if k == b])
            a1 = np.tanh(x @ weights[0] + weights[1])
            a2 = np.tanh(a1 @ weights[2] + weights[3])
            e = np.exp(a2 @ weights[4] + weights[5])
            d3 = (e / e.sum(axis=1, keepdims=True) - np.eye(3)[y]) / len(x)
            d2 = (d3 @ weights[4].T) * (1 - a2**2)
            d1 = (d2 @ weights[2].T) * (1 - a1**2)
            grads = [x.T @ d1 + 0.1 * weights[0] / len(x), d1.sum(0), a1.T @ d2 + 0.1 * weights[2] / len(x), d2.sum(0), a2.T @ d3 + 0.1 * weights[4] / len(x), d3.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                weights[i] = weights[i] - 0.01 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[i] / (np.sqrt(v[i]) + 1e-8)
    assert np.allclose(P.flattened(model.model), np.concatenate([w.ravel() for w in weights]), atol=1e-9)
    assert len(model.losses) == 6


def test_gradients_are_slopes():
    weights = P.first_weights([3, 4, 2], 1)
    r = np.random.default_rng(2)
    x, y, flat = r.normal(size=(9, 3)), r.integers(0, 2, 9), P.flattened(weights)
    _, gradient = P.gradient_sums(x, y, weights)
    for i in range(0, len(flat), 3):
        up, down = flat.copy(), flat.copy()
        up[i], down[i] = up[i] + 1e-6, down[i] - 1e-6
        slope = (P.gradient_sums(x, y, P.unflattened(up, [3, 4, 2]))[0] - P.gradient_sums(x, y, P.unflattened(down, [3, 4, 2]))[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-5


def test_learns_stops_and_is_saved(spark, tmp_path):
    rows = _rows(spark, 300)
    model = K.TanhPerceptron(hidden=(16,), epochs=40, batches=2, rate=0.05, patience=3, tol=1e-3).fit(rows)
    told = model.predict(rows)
    assert K.score_accuracy(told, model.labels) > 0.85 and len(model.losses) <= 40 and model.losses[-1] < model.losses[0] / 2
    model.save(spark, str(tmp_path / "m"))
    again = K.Classifier.load(spark, str(tmp_path / "m")).predict(rows)
    assert sorted(map(str, told.collect())) == sorted(map(str, again.collect()))


def test_out_of_bag_votes(spark, tmp_path):
    rows = _rows(spark, 120)
    forest = K.BaggedForest(numTrees=9, maxDepth=4, seed=11).fit(rows)
    bags = rows.select("object_id", array_to_vector("features").alias("v"), "label", *[K.bag_count(t, "object_id", 11).alias(f"w{t}") for t in range(9)]).collect()
    assert 0.8 < np.mean([r[f"w{t}"] for r in bags for t in range(9)]) < 1.2
    assert 0.3 < np.mean([r[f"w{t}"] == 0 for r in bags for t in range(9)]) < 0.44  # 1 / e
    right = voted = 0
    told = {r.object_id: r for r in forest.out_of_bag(rows).collect()}
    for r in bags:
        votes = [forest.model[t].predictProbability(r.v).toArray() for t in range(9) if r[f"w{t}"] == 0]
        got = told[r.object_id]
        assert got.votes == len(votes) and got.label == r.label
        if votes:
            assert np.allclose(got.probability, np.mean(votes, axis=0)) and got.y_pred == forest.labels[int(np.argmax(np.mean(votes, axis=0)))]
            voted, right = voted + 1, right + (got.y_pred == r.label)
        else:
            assert got.y_pred is None and got.probability is None
    assert abs(forest.out_of_bag_score(rows) - right / voted) < 1e-12
    whole = forest.predict(rows)
    assert K.score_accuracy(whole, forest.labels) > right / voted  # rows that trees saw flatter them
    forest.save(spark, str(tmp_path / "f"))
    again = K.Classifier.load(spark, str(tmp_path / "f"))
    assert sorted(map(str, again.predict(rows).collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, again.out_of_bag(rows).collect())) == sorted(map(str, told.values()))


def test_few_trees_leave_rows_without_votes(spark):
    rows = _rows(spark, 60)
    forest = K.BaggedForest(numTrees=1, maxDepth=3).fit(rows)
    assert 0 < forest.out_of_bag(rows).where("votes = 0 AND y_pred IS NULL").count() < 60
