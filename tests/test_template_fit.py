import numpy as np
import pytest

from fluxloom.operators.fit import fit_template


@pytest.mark.parametrize("sampler", ["leastsq", "mcmc", "nested"])
def test_late_peaks_are_found(spark, sampler):
    shape = [("bump", "lsstr", float(x), float(np.exp(-((x / 8) ** 2)))) for x in range(-30, 31)]
    rows = [(o, "lsstr", float(t), float(50 * np.exp(-(((t - t0) / s / 8) ** 2))), 1.0) for o, (t0, s) in enumerate([(120.7, 1.0), (15.3, 1.4)]) for t in range(0, 176, 3)]
    obs = spark.createDataFrame(rows, "object_id long, filter string, mjd double, flux double, flux_error double")
    found = fit_template(obs, spark.createDataFrame(shape, "name string, filter string, phase double, flux double"), sampler=sampler).orderBy("object_id").collect()
    assert [r.status for r in found] == ["ok", "ok"]
    assert [(r.t0, r.stretch, r.amplitude) for r in found] == [(pytest.approx(120.7, abs=0.3), pytest.approx(1.0, abs=0.05), pytest.approx(50, rel=0.05)), (pytest.approx(15.3, abs=0.3), pytest.approx(1.4, abs=0.07), pytest.approx(50, rel=0.05))]
