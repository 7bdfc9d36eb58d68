"""Template surfaces against numpy: band fluxes, curves at redshifts, recovered fits, files of passbands."""

import numpy as np
import pytest

from fluxloom.operators import surfaces as S
from fluxloom.plans import surfaces as Q

BANDS = {"g": ([4000.0, 4700.0, 5500.0], [0.0, 0.8, 0.0]), "r": ([5500.0, 5703.0, 6800.0, 7000.0], [0.1, 0.7, 0.6, 0.0])}
PHASES, WAVES = np.array([-10.0, -3.0, 0.0, 8.0, 30.0]), np.array([1000.0, 2500.0, 4100.0, 5200.0, 6600.0, 9000.0])


def _flux(k):
    r = np.random.default_rng(k)
    return r.uniform(0.2, 1.0, (len(PHASES), len(WAVES))) * np.array([0.0, 0.7, 1.0, 0.6, 0.1])[:, None] * 1e-17


def _tables(spark):
    surface = [(name, float(p), float(w), float(_flux(k)[i, j])) for k, name in enumerate(("a", "b")) for i, p in enumerate(PHASES) for j, w in enumerate(WAVES)]
    bands = [(f, w, t) for f, (ws, ts) in BANDS.items() for w, t in zip(ws, ts, strict=True)]
    return spark.createDataFrame(surface, "template string, phase double, wavelength double, flux double"), spark.createDataFrame(bands, "filter string, wavelength double, transmission double")


def _plain(k, band, z, phase, zp=27.5, step=5.0):
    """Flux at a phase by a direct sum over the grid."""
    ws, ts = BANDS[band]
    grid = np.arange(np.ceil(ws[0] / step), np.ceil(ws[-1] / step)) * step
    t = np.interp(grid, ws, ts)
    if not PHASES[0] <= phase <= PHASES[-1]:
        return 0.0
    at = np.array([np.interp(phase, PHASES, _flux(k)[:, j]) for j in range(len(WAVES))])
    flux = np.interp(grid / (1 + z), WAVES, at, left=0.0, right=0.0) / (1 + z)
    return float((flux * grid * t).sum() / ((t / grid).sum() * 3.631e-20 * 2.99792458e18) * 10 ** (0.4 * zp))


def test_band_flux(spark):
    surface, bands = _tables(spark)
    r = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], "gr"[i % 3 % 2], float(r.choice([0.0, 0.1, 0.37, 1.2])), 3.0, 2.5, float(r.uniform(-30, 70))) for i in range(200)] + [(200, "a", "x", 0.1, 0.0, 1.0, 0.0), (201, "a", "g", None, 0.0, 1.0, 0.0), (202, "b", "r", 0.1, 5.0, 1.0, 5.0 - 11.0)]
    found = S.band_flux(spark.createDataFrame(rows, "id int, template string, filter string, z double, t0 double, amplitude double, mjd double"), surface, bands).collect()
    assert len(found) == len(rows)
    for r in found:
        want = 0.0 if r.filter == "x" or r.z is None else r.amplitude * _plain("ab".index(r.template), r.filter, r.z, (r.mjd - r.t0) / (1 + r.z))
        assert r.model_flux == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_a_flat_reference_has_its_zero_point(spark):
    """A source of 3631 Jy at all wavelengths has 10^(0.4 zp) in every band."""
    _, bands = _tables(spark)
    waves = [float(w) for w in range(1000, 12000, 5)]
    surface = spark.createDataFrame([("ab", p, w, 3.631e-20 * 2.99792458e18 / w**2) for p in (0.0, 1.0) for w in waves], "template string, phase double, wavelength double, flux double")
    for r in S.band_curves(surface, bands, spark.createDataFrame([(0.0,)], "z double")).collect():
        assert r.flux == pytest.approx(10 ** (0.4 * 27.5), rel=1e-9)


def test_fit_finds_what_was_drawn(spark):
    surface, bands = _tables(spark)
    truth = {1: ("a", 0.2, 14.0, 3.0), 2: ("b", 0.05, -2.0, 0.5), 3: ("a", 0.6, 30.3, 10.0)}
    rows = [(i, b, float(t), a * _plain("ab".index(n), b, z, (t - t0) / (1 + z)), 1e-3 * a) for i, (n, z, t0, a) in truth.items() for b in "gr" for t in np.arange(-20.0, 90.0, 3.0)]
    obs = spark.createDataFrame([*rows, (4, "g", 1.0, 1.0, 1.0)], "object_id int, filter string, mjd double, flux double, flux_error double")
    known = spark.createDataFrame([(i, z) for i, (_, z, _, _) in truth.items()] + [(1, 0.45), (1, None), (9, 0.1)], "object_id int, z double")
    found = {r.object_id: r for r in S.fit_surfaces(obs, surface, bands, known, days=2.0).collect()}
    assert set(found) == {1, 2, 3}
    for i, (name, z, t0, a) in truth.items():
        r = found[i]
        assert (r.template, r.z, r.n_points) == (name, z, 74) and r.t0 == pytest.approx(t0, abs=0.02) and r.amplitude == pytest.approx(a, rel=0.01)


def test_passband_files(spark, tmp_path):
    for band, text in (("u", "# wave trans\n3000 0.0\n3500,0.5\n\n4000\t0.0\n"), ("g", "4000 0\n5000 1\n")):
        (tmp_path / f"total_{band}.dat").write_text(text)
    rows = S.read_bands(spark, str(tmp_path), "total_", ".dat", "ug").orderBy("filter", "wavelength").collect()
    assert [tuple(r) for r in rows] == [("lsstg", 4000.0, 0.0), ("lsstg", 5000.0, 1.0), ("lsstu", 3000.0, 0.0), ("lsstu", 3500.0, 0.5), ("lsstu", 4000.0, 0.0)]


def test_empty(spark):
    surface, bands = _tables(spark)
    assert S.band_curves(surface, bands, spark.createDataFrame([], "z double")).count() == 0
    assert S.fit_surfaces(spark.createDataFrame([], "object_id int, filter string, mjd double, flux double, flux_error double"), surface, bands, spark.createDataFrame([], "object_id int, z double")).count() == 0
    assert Q._bands(spark).count() == 15
