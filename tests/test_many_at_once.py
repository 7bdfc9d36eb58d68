"""Steps that take many objects at once: the same results as one by one, and plans that stay whole at size."""

import numpy as np
from pyspark.sql import functions as F

from fluxloom.operators import chisq as X
from fluxloom.operators import features as T
from fluxloom.operators import gp as G
from fluxloom.sources.fixtures import grid_models


def test_restored_points_are_not_broadcast(spark, small):
    models = grid_models(spark, small)
    plan = G.reconstruction_error(models, models)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_many_splines_are_those_of_one():
    r = np.random.default_rng(3)
    x, y = np.cumsum(r.uniform(0.1, 1, (5, 9)), axis=1), r.normal(size=(5, 9))
    at, row = r.uniform(-1, 6, 40), np.sort(r.integers(0, 5, 40))
    found = X.splines_not_a_knot(x, y, at, row)
    assert all(np.allclose(found[row == i], X.spline_not_a_knot(x[i], y[i], at[row == i])) for i in range(5))
    f = lambda t: 2 * t**3 - t + 1
    assert np.allclose(X.splines_not_a_knot(x, f(x), at, row), f(at))


def test_cubic_model_of_bands_of_other_lengths(spark):
    obs = [(k, "a", float(t), 1.0, 2.0) for k in (1, 2, 3, 4) for t in (0.5, 1.5, 9.0)] + [(None, "a", 1.0, 1.0, 1.0)]
    models = [(k, "a", float(t), float(t**n)) for k, n, size in ((1, 3, 6), (2, 2, 3), (3, 1, 2), (None, 1, 4)) for t in range(size)]
    rows = X.on_model_cubic(spark.createDataFrame(obs, "object_id long, filter string, mjd double, flux double, flux_error double"), spark.createDataFrame(models, "object_id long, filter string, mjd double, flux double"))
    got = {(r.object_id, r.mjd): r.model_flux for r in rows.collect()}
    want = {(k, t): t**n if t <= size - 1 else None for k, n, size in ((1, 3, 6), (2, 2, 3), (3, 1, 2)) for t in (0.5, 1.5, 9.0)} | {(4, t): None for t in (0.5, 1.5, 9.0)} | {(None, 1.0): 1.0}
    assert got.keys() == want.keys() and all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan


def test_models_are_dealt_over_all_partitions(spark):
    x = [np.arange(n, dtype=float) for n in (8, 32, 8, 16)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "object_id long, x array<double>")
    again = T.iswt(T.swt(df, "x", 3), 3, "again").orderBy("object_id").collect()
    assert all(np.allclose(r.again, v) for r, v in zip(again, x, strict=True))  # lengths may differ from row to row
    models = spark.range(64).select(F.col("id").alias("object_id"), F.format_string("b%d", F.col("id") % 3).alias("filter"), F.lit(0.0).alias("mjd"), F.lit(1.0).alias("flux"), F.lit(1.0).alias("flux_error"))
    assert T.pack_models(models).rdd.getNumPartitions() == 4


def _bands(n=12, count=7):
    from fluxloom.operators import fit as P

    r = np.random.default_rng(5)
    low, high, start = (np.array([b[i] for b in P.MODELS["karpenka"][0].values()], float) for i in range(3))
    t = np.sort(r.uniform(0, 30, (count, n)), axis=1)
    y, e = r.uniform(0, 200, (count, n)), r.uniform(1, 9, (count, n))
    chi = lambda rows, p: np.sum(((y[rows] - P._karpenka(t[rows], p.T[:, :, None])) / e[rows]) ** 2, axis=1)
    each = lambda v: np.tile(v, (count, 1))
    return t, y, e, chi, (start, low, high), tuple(map(each, (start, low, high))), list(range(count))


def test_many_fits_and_samplers_are_those_of_one():
    from fluxloom.operators import fit as P

    t, y, e, chi, one, many, seeds = _bands()
    for name in P.SAMPLERS:
        more = {"mcmc": {"rounds": 31, "walkers": 7}, "nested": {"rounds": 120, "live": 20}}.get(name, {})
        found, value = P.MANY[name](chi, t.shape[1], *many, 3, seeds, **more)
        for i in seeds:
            p, c = P.SAMPLERS[name](P._karpenka, t[i], y[i], e[i], *one, 3, i, **more)
            assert np.allclose(found[i], p, rtol=1e-9) and np.isclose(value[i], c, rtol=1e-9), name


def test_many_nested_runs_are_those_of_one():
    from fluxloom.operators import fit as P

    t, y, e, chi, one, many, seeds = _bands(9, 4)
    runs = P.many_nested_runs(chi, many[1], many[2], seeds, 15, 6)
    for i, r in enumerate(runs):
        own = P.nested_run(lambda p: -0.5 * float(np.sum(((y[i] - P._karpenka(t[i], p)) / e[i]) ** 2)), one[1], one[2], 15, 6, i)  # noqa: B023
        assert np.allclose(r.points, own.points, rtol=1e-9) and np.allclose(r.weight, own.weight) and np.isclose(r.log_evidence, own.log_evidence)


def test_groups_are_whole_whatever_the_batches(spark):
    import pyarrow as pa

    from fluxloom.runtime import in_groups

    def counted(table, starts):
        sizes = np.diff(np.append(starts, table.num_rows))
        yield pa.table({"k": table["k"].take(starts), "n": pa.array(sizes)})

    df = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 50 + 2**60).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = sorted(in_groups(df, ["k"], counted, "k long, n long", rows=150).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([(None, 100), *((i + 2**60, 100) for i in range(1, 50))], key=str)


def test_likelihood_by_one_factorisation():
    r = np.random.default_rng(8)
    x = np.column_stack([np.sort(r.uniform(0, 30, 40)), r.choice([3685.0, 6231.0], 40)])
    y, e = r.uniform(0, 300, 40), r.uniform(1, 9, 40)
    for amp, time in ((2.0, 1.0), (9.0, 6.0), (14.0, 13.0)):
        k = G.kernel_2d(amp, time)
        assert np.isclose(G.negative_log_likelihood(k, x, y, e), G.condition(k, x, y, e)[1], rtol=1e-10)
    assert np.isclose(G.negative_log_likelihood(k, x, 0 * y, e), G.condition(k, x, 0 * y, e)[1], rtol=1e-10)


def test_mixtures_draw_as_choice_does():
    from fluxloom.operators import augment as A

    parts = A.SURVEYS["noroll_v20_subset_wfd"].n_obs
    a, b = np.random.default_rng(2), np.random.default_rng(2)
    weights = np.array([w for w, _, _ in parts])
    for _ in range(200):
        _, mean, variance = parts[b.choice(len(parts), p=weights / weights.sum())]
        assert A.mixture(a, parts) == b.normal(mean, np.sqrt(variance))


def test_templates_found_and_read(spark):
    from fluxloom.operators import fit as P

    templates = spark.createDataFrame([("a", "lsstr", float(t), float(np.exp(-((t / 5) ** 2)))) for t in range(-10, 20)], "name string, filter string, phase double, flux double")
    obs = spark.createDataFrame([(k, "lsstr", float(t), float(9 * np.exp(-(((t - 8) / 5) ** 2))), 0.5) for k in range(20) for t in range(0, 20, 2)], "object_id long, filter string, mjd double, flux double, flux_error double")
    fits = P.fit_template(obs, templates)
    assert all(abs(r.t0 - 8) < 0.1 and abs(r.stretch - 1) < 0.05 and abs(r.amplitude - 9) < 0.2 for r in fits.collect())
    assert P.reconstruct_template(obs, fits, templates, 5).count() == 100
