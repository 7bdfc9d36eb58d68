"""The metric index against all pairs: exact with ties and copies, few distances on clustered rows, groups, odd rows."""

import numpy as np
import pytest

from fluxloom.operators import augment
from fluxloom.operators.neighbours import MetricIndex, nearest_rows, spread_pivots

SCHEMA = "object_id long, label string, features array<double>"


def _frame(spark, x, start=0, labels="abc"):
    return spark.createDataFrame([(start + i, labels[i % len(labels)], None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def _brute(train, test, k):
    out = []
    for name, _, q in test:
        if q is not None:
            d = sorted((float(np.sqrt(((np.array(x) - np.array(q)) ** 2).sum())), other, y) for other, y, x in train if x is not None)[:k]
            out += [(name, other, y, round(dist, 9)) for dist, other, y in d]
    return sorted(out)


def _got(found):
    return sorted((r[0], r.other, r.y, round(r.d, 9)) for r in found.collect())


def _clusters(n, spread=0.02, seed=1, width=4, centres=40):
    r = np.random.default_rng(seed)
    return r.uniform(-10, 10, (centres, width))[r.integers(0, centres, n)] + r.normal(0, spread, (n, width))


@pytest.mark.parametrize("index", [{}, {"cell_rows": 10}, {"cell_rows": 10, "block": 7}, {"cell_rows": 1, "max_pivots": 5, "sample": 20}])
def test_exact(spark, index):
    train, test = _frame(spark, _clusters(300, 1.5)), _frame(spark, _clusters(90, 3.0, 2), 1000)
    assert _got(nearest_rows(train, test, 7, **index)) == _brute(train.collect(), test.collect(), 7)


def test_copies_ties_and_odd_rows(spark):
    x = [[0.0, 0.0]] * 120 + [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [1e6, 1e6], [1e6, 1e6 + 1]] * 5 + [None]
    train, test = _frame(spark, x), _frame(spark, [[0.0, 0.0], [0.4, 0.0], [1e6, 1e6], None], 1000)
    assert _got(nearest_rows(train, test, 9, cell_rows=5, block=4)) == _brute(train.collect(), test.collect(), 9)
    few = _frame(spark, x[:3])
    assert _got(nearest_rows(few, test, 9)) == _brute(few.collect(), test.collect(), 9)  # fewer rows than asked for
    none = _frame(spark, [])
    assert nearest_rows(none, test, 3).count() == 0 and nearest_rows(train, none, 3).count() == 0


def test_few_distances_on_clusters(spark):
    train, test = _frame(spark, _clusters(4000)), _frame(spark, _clusters(500, seed=1), 10_000)
    index = MetricIndex(train, 5, cell_rows=100)
    assert _got(index.nearest(test, 5)) == _brute(train.collect(), test.collect(), 5)
    assert index.evaluated < 4000 * 500 / 8  # the task of the index: below a quarter of all pairs
    visits = index._next(test.selectExpr("object_id AS name", "features AS q", "0 AS g", "0.5D AS most"), 0, 99, "name long, q array<double>, g int, most double").collect()
    away = np.sqrt(((index.pivots[None] - np.array([v.q for v in visits])[:, None]) ** 2).sum(axis=2))
    for v, a in zip(visits, away, strict=True):  # no query is sent to a cell that cannot hold a row within its reach
        assert max(a - index.high[v.cell]) <= 0.5001 and max(index.low[v.cell] - a) <= 0.5001


def test_groups(spark):
    x = _clusters(200, 1.0)
    train = _frame(spark, x)
    got = _got(nearest_rows(train, train, 4, cell_rows=9, group="label"))
    rows = train.collect()
    assert got == sorted(t for g in "abc" for t in _brute([r for r in rows if r.label == g], [r for r in rows if r.label == g], 4))


def test_pivots_are_apart():
    x = np.repeat(np.arange(5.0)[:, None], 10, axis=0)
    assert len(spread_pivots(x, 20)) == 5 and len(spread_pivots(x[:0], 3)) == 0


def test_a_rare_class_is_made_in_many_tasks(spark):
    rows = [(i, "rare", [float(i), 0.0]) for i in range(50)] + [(1000 + i, "common", [0.0, float(i)]) for i in range(100_000)]
    made = augment.smote(spark.createDataFrame(rows, SCHEMA), 5)
    sizes = made.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 100_000 - 50 and max(sizes) <= 10_000
    each = {r.original_event: r["count"] for r in made.groupBy("original_event").count().collect()}
    assert len(each) == 50 and max(each.values()) - min(each.values()) <= 1
    assert made.select("object_id").distinct().count() == sum(sizes)
    assert made.where("features[1] <> 0 OR features[0] < 0 OR features[0] > 49").isEmpty()


def test_size_estimates_do_not_multiply(spark):
    """Nearest rows of nearest rows: an estimate that grows from round to round by products of others fills the driver."""
    rows = _frame(spark, _clusters(60, 1.0))
    found = nearest_rows(rows, rows, 3, cell_rows=10)
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(size)) <= 8
