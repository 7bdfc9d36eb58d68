"""Gaussian processes of many objects at once: the same as one by one, dealt out whole."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fluxloom.operators import gp as G
from fluxloom.runtime import in_groups


def test_groups_of_joined_rows_are_dealt_over_all_partitions(spark):
    def seen(table, starts):
        yield pa.table({"k": table["k"].take(starts)})

    left, right = (spark.range(64).select(F.col("id").alias("k"), F.lit(1.0).alias(v)) for v in ("x", "y"))
    joined = left.groupBy("k").agg(F.sum("x").alias("x")).join(right.groupBy("k").agg(F.sum("y").alias("y")), "k")
    out = in_groups(joined, ["k"], seen, "k long")
    assert out.rdd.getNumPartitions() == 4 and sorted(r.k for r in out.collect()) == list(range(64))


def _curves(count=9):
    r = np.random.default_rng(4)
    out = []
    for n in r.integers(3, 30, count):
        t, w = np.sort(r.uniform(0, 30, n)), r.choice([3685.0, 6231.0], n)
        out.append((np.column_stack([t, w]), 50 * np.exp(-(((t - 12) / 6) ** 2)) + r.normal(0, 2, n), r.uniform(1, 9, n)))
    return out


def test_many_processes_are_those_of_one():
    curves = _curves()
    params, ok = G.many_fit_2d(curves)
    flat = [(x[:, 0], y, e) for x, y, e in curves]
    for (x, y, e), p, good, (t, *_), found in zip(curves, params, ok, flat, G.many_fit_1d(flat), strict=True):
        own, _, converged = G.fit_2d(x[:, 0], x[:, 1], y, e)
        assert np.allclose(p, own, rtol=1e-6) and good == converged
        i, own, _, converged, chi = G.fit_1d(t, y, e)
        assert found[0] == i and np.allclose(found[1], own, rtol=1e-6) and found[3] == converged and np.isclose(found[4], chi, rtol=1e-6)


def test_objects_that_cannot_be_fitted_leave_the_others(spark):
    rows = [(1, "a", float(t), 1.0, 0.0) for t in range(3)] + [(2, "a", float(t), float(t), 1.0) for t in range(5)] + [(3, "a", float(t), float("nan"), 1.0) for t in range(5)]
    obs = spark.createDataFrame(rows, "object_id long, filter string, mjd double, flux double, flux_error double")
    for dim in (1, 2):
        told = {r.object_id: r.status for r in G.fit_gps(obs, 3, 0, 5, dim, ("a",), wavelengths={"a": 5000.0}).select("object_id", "status").distinct().collect()}
        assert told[1] == "failed: no usable observation" and told[2] == "ok" and 3 in told
