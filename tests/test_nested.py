"""Nested sampling against closed forms, posterior tables, percentiles of many equal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import fit as P
from fluxloom.operators import metrics as M


@pytest.mark.parametrize(("width", "sigma"), [(1, 1.0), (2, 0.5), (3, 1.0)])
def test_evidence_of_a_gaussian_in_a_box(width, sigma):
    centre = np.arange(width) * 0.5 - 0.4
    runs = [P.nested_run(lambda p: -0.5 * float((((p - centre) / sigma) ** 2).sum()), np.full(width, -6.0), np.full(width, 6.0), live=120, steps=20, seed=s) for s in range(4)]
    truth = width * (np.log(sigma * np.sqrt(2 * np.pi)) - np.log(12.0))
    for r in runs:
        assert abs(r.log_evidence - truth) < 4 * r.error and 0.02 < r.error < 0.4
        assert r.weight.sum() == pytest.approx(1) and (r.weight >= 0).all()
        mean = r.weight @ r.points
        assert np.allclose(mean, centre, atol=0.35 * sigma) and np.allclose(np.sqrt(r.weight @ (r.points - mean) ** 2), sigma, rtol=0.35)
    assert abs(np.mean([r.log_evidence for r in runs]) - truth) < 2.5 * runs[0].error / 2
    assert runs[0].log_evidence == P.nested_run(lambda p: -0.5 * float((((p - centre) / sigma) ** 2).sum()), np.full(width, -6.0), np.full(width, 6.0), live=120, steps=20, seed=0).log_evidence


def test_flat_likelihood_has_the_prior_as_posterior():
    r = P.nested_run(lambda p: 0.0, np.zeros(2), np.ones(2), live=50, seed=3)
    assert r.log_evidence == pytest.approx(0.0, abs=1e-6) and r.error == pytest.approx(0.0, abs=1e-3)


def test_posterior_tables(spark):
    t = np.linspace(0, 30, 25)
    truth = np.array([4.0, 5.0, 1.0, 0.5, 1.0])
    flux = P.CURVES["newling"](t, truth)
    rows = [(k, "lsstr", float(a), float(f), 0.05 * float(flux.max())) for k in (1, 2) for a, f in zip(t, flux, strict=True)] + [(3, "lsstg", 1.0, 1.0, 0.0)]
    obs = spark.createDataFrame(rows, "object_id long, filter string, mjd double, flux double, flux_error double")
    found = P.nested_posterior(obs, live=30, steps=12)
    rows = found.collect()
    assert {r.object_id for r in rows} == {1, 2}  # a band whose errors are all 0 has no row
    for k in (1, 2):
        mine = sorted((r for r in rows if r.object_id == k), key=lambda r: r.point)
        assert sum(r.weight for r in mine) == pytest.approx(1) and [r.point for r in mine] == list(range(len(mine))) and len({r.log_evidence for r in mine}) == 1
    means = {r.object_id: r for r in P.posterior_means(found).collect()}
    mine = [r for r in rows if r.object_id == 1]
    assert np.allclose(means[1].params, sum(r.weight * np.array(r.params) for r in mine))
    assert means[1].best == max(mine, key=lambda r: r.log_likelihood).params
    assert abs(means[1].params[1] - truth[1]) < 4 * means[1].deviations[1] + 0.5  # the start of the rise
    assert sorted(map(str, rows)) == sorted(map(str, P.nested_posterior(obs.repartition(3), live=30, steps=12).collect()))


def test_percentiles_of_equal_values_are_spread(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") < 19_000, 3.5).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r.k: (r.low, r.high) for r in M.percentile_interval(rows, "v", ["k"]).collect()}
    for k in (0, 1):
        v = np.array([3.5 if i < 19_000 else float(i) for i in range(k, 20_000, 2)])
        assert got[k] == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])))
