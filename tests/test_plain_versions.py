"""Numeric operators against direct numpy and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom import plans
from fluxloom.operators import augment as A
from fluxloom.operators import classify as K
from fluxloom.operators import features as T
from fluxloom.operators import fit as P
from fluxloom.operators import gp as G
from fluxloom.operators import metrics as M
from fluxloom.operators import pca as C
from fluxloom.operators import subset as U
from fluxloom.ordering import ranked, running_sums
from fluxloom.schema import PASSBANDS
from fluxloom.sources import fits
from fluxloom.sources.fixtures import grid_models, objects, observations

BANDS = ("lsstu", "lsstg", "lsstr", "lssti", "lsstz")


def test_ranks_and_running_sums(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "all").otherwise(F.when(F.col("id") % 2 > 0, "odd")).alias("g"), ((F.col("id") * 37) % 101).alias("v")).repartition(5)
    plain = [r.asDict() for r in rows.collect()]
    for g in ("all", "odd", None):
        want = sorted((r["v"], r["id"]) for r in plain if r["g"] == g)
        found = sorted((r._r, r.v, r.id) for r in ranked(rows, ["g"], [F.col("v"), F.col("id")]).where(F.col("g").eqNullSafe(g)).collect())
        assert found == [(i, v, x) for i, (v, x) in enumerate(want)]
    total = 0
    for r in sorted(running_sums(rows, [F.col("id")], before=F.col("v")).collect(), key=lambda r: r.id):
        assert r.before == total
        total += r.v


def test_percentile_intervals_are_numpys(spark):
    rng = np.random.default_rng(3)
    values = [(g, float(v)) for g in ("a", "b", None) for v in rng.standard_normal(rng.integers(2, 90))] + [("one", 5.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    for level in (0.95, 0.5):
        for r in M.percentile_interval(df, "v", ["g"], level).collect():
            own = [v for g, v in values if g == r.g]
            assert np.allclose([r.low, r.high], np.percentile(own, [50 - 50 * level, 50 + 50 * level]))
    whole = M.percentile_interval(df, "v").first()
    assert np.allclose([whole.low, whole.high], np.percentile([v for _, v in values], [2.5, 97.5]))


def test_thresholds_on_an_expression(spark):
    rng = np.random.default_rng(5)
    p, y = rng.random(400), rng.random(400) < 0.4
    df = spark.createDataFrame([(f'{{"p": {a!r}}}', bool(b)) for a, b in zip(p.tolist(), y, strict=True)], "j string, positive boolean").select(F.get_json_object("j", "$.p").cast("double").alias("probability"), "positive")
    for r in M.roc(df, 11).collect():
        called = p >= r.threshold
        assert abs(r.tpr - (called & y).sum() / y.sum()) < 1e-9 and abs(r.fpr - (called & ~y).sum() / (~y).sum()) < 1e-9


def test_gp_against_dense_algebra(spark, small):
    obs = observations(spark, small).where("object_id % 7 = 0")
    rows = obs.toPandas()
    fits_ = G.fit_gps(obs.select("object_id", "event_id", "mjd", "filter", "flux", "flux_error"), 8, 0, 31, filters=BANDS).where("status = 'ok'").toPandas()
    assert len(fits_)
    for name, told in fits_.groupby("object_id"):
        own = rows[(rows.object_id == name) & (rows.flux_error != 0)]
        a, m = told.params.iloc[0]
        x = np.column_stack([own.mjd, own["filter"].map(PASSBANDS)]).astype(float)

        def k(p, q, a=a, m=m):
            r = np.sqrt(((p[:, None, 0] - q[None, :, 0]) ** 2) / math.exp(m) + ((p[:, None, 1] - q[None, :, 1]) / 6000.0) ** 2)
            return math.exp(a) * (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r)

        at = np.column_stack([told.mjd, told["filter"].map(PASSBANDS)]).astype(float)
        inverse = np.linalg.inv(k(x, x) + np.diag(own.flux_error.to_numpy() ** 2))
        mean = k(at, x) @ inverse @ own.flux.to_numpy()
        var = math.exp(a) - np.einsum("ij,jk,ik->i", k(at, x), inverse, k(at, x))
        assert np.allclose(told.flux, mean, atol=1e-3 * (1 + abs(mean).max())) and np.allclose(told.flux_error, np.sqrt(np.maximum(var, 0)), atol=1e-2 * math.exp(a / 2))


def test_one_dimensional_gp_improves_on_its_start():
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 60, 25))
    y = 40 * np.exp(-(((t - 30) / 9) ** 2)) + rng.normal(0, 1, 25)
    i, params, gp, ok, chi = G.fit_1d(t, y, np.ones(25))
    assert ok and chi < 2 and abs(chi - float(((y - gp.predict(t)[0]) ** 2).mean())) < 1e-9 and len(params) in (2, 5) and i in range(5)


def test_peak_of_the_process(spark, small):
    obs = observations(spark, small)
    found = {r.object_id: r.peak_mjd for r in plans.queries()["t_peak_gp"](spark, small).collect()}
    params = {r.object_id: r.params for r in G.params_of(G.fit_gps(obs.select("object_id", "event_id", "mjd", "filter", "flux", "flux_error"), 2, 0, 31, filters=BANDS)).collect()}
    rows = obs.toPandas()
    seen = rows[rows.detected].groupby("object_id").mjd.agg(["min", "max"])
    assert set(found) == set(seen.index) & set(params)
    for name in sorted(found)[:5]:
        own = rows[(rows.object_id == name) & (rows.flux_error != 0)]
        days = np.arange(seen.loc[name, "min"] - 105, seen.loc[name, "max"] + 301)
        x = np.column_stack([own.mjd, own["filter"].map(PASSBANDS)]).astype(float)
        gp, _ = G.condition(G.kernel_2d(*params[name]), x, own.flux.to_numpy(), own.flux_error.to_numpy())
        flux = np.stack([gp.predict(np.column_stack([days, np.full(len(days), PASSBANDS[f])]))[0] for f in BANDS]).max(axis=0)
        assert abs(found[name] - days[flux.argmax()]) < 1e-6 or abs(flux.max() - flux[int(round(found[name] - days[0]))]) < 1e-6


@pytest.mark.parametrize("n, width", [(12, 30), (80, 6)])
def test_pca_against_svd(spark, n, width):
    x = np.random.default_rng(n).standard_normal((n, width)) @ np.diag(np.linspace(3, 0.3, width))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>")
    model = C.fit_pca(df, "v")
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    top = min(n - 1, width)
    assert np.allclose(model.eigenvalues[:top], s[:top] ** 2 / (n - 1)) and np.allclose(np.abs((model.vectors[:top] * vt[:top]).sum(axis=1)), 1, atol=1e-6)
    back = model.reconstructed(model.transform(df, "v", wanted="all"), "reduced", "again").collect()
    assert all(np.allclose(r.again, x[r.i], atol=1e-6) for r in back)


def test_svd_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([[float(v) for v in r.embedding] for r in rows])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = np.abs((x - x.mean(axis=0)) @ vt[:5].T)
    found = {r.object_id: r.reduced for r in plans.queries()["pca_svd"](spark, small).collect()}
    assert all(np.allclose(np.abs(found[r.vec_id]), want[i], atol=1e-6) for i, r in enumerate(rows))


def _median(values):
    values = sorted(v for v in values if v is not None)
    return None if not values else (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def test_all_classification_features(spark, small):
    """The 41 columns, by plain arithmetic on the raw ones; and the raw ones that are plain statistics."""
    raw = [r.asDict() for r in T.raw_features(observations(spark, small), grid_models(spark, small), objects(spark, small), BANDS).collect()]
    found = {r.object_id: r.asDict() for r in plans.queries()["classification_features_full"](spark, small).collect()}
    assert len(found) == len(raw) > 0 and all(len(f) == 42 for f in found.values())
    over = lambda a, b: None if a is None or b in (None, 0) else a / b
    plus = lambda *v: None if None in v else sum(v)
    for r in raw:
        w, m, red, blue = {"host_photoz": r["host_photoz"], "host_photoz_error": r["host_photoz_error"], "length_scale": r.get("gp_fit_1")}, "lssti", "lsstz", "lsstg"
        w["max_mag"] = -2.5 * math.log10(abs(r[f"max_flux_{m}"]))
        w["pos_flux_ratio"] = over(r[f"max_flux_{m}"], r[f"max_flux_{m}"] - r[f"min_flux_{m}"])
        for side in ("max", "min"):
            for name, f in (("red", red), ("blue", blue)):
                a, b = abs(r[f"{side}_flux_{f}"]), abs(r[f"{side}_flux_{m}"])
                w[f"{side}_flux_ratio_{name}"] = over(a, a + b)
        w["max_dt"] = r[f"max_dt_{red}"] - r[f"max_dt_{blue}"]
        w |= {f"{s}_width": r[f"{s}_width_{m}"] for s in ("positive", "negative")}
        for way in ("fwd", "bwd"):
            for t in ("0_5", "0_2"):
                name = f"time_{way}_max_{t}"
                w[name] = r[f"{name}_{m}"]
                for colour, f in (("red", red), ("blue", blue)):
                    w[f"{name}_ratio_{colour}"] = over(r[f"{name}_{f}"], plus(r[f"{name}_{f}"], r[f"{name}_{m}"]))
        w |= {"frac_s2n_5": r["count_s2n_5"] / r["count"], "frac_s2n_-5": r["count_s2n_-5"] / r["count"], "frac_background": r["frac_background"], "time_width_s2n_5": r["time_width_s2n_5"]}
        w["count_max_center"] = r["count_max_center"]
        for way in ("rise", "fall"):
            total = r["count_max_center"]
            for edge in (20, 50, 100):
                total += r[f"count_max_{way}_{edge}"]
                w[f"count_max_{way}_{edge}"] = total
        w["peak_frac_2"] = _median([r[f"peaks_pos_{f}_frac_2"] for f in BANDS])
        w["total_s2n"] = math.sqrt(sum(r[f"total_s2n_{f}"] ** 2 for f in BANDS))
        share = {p: _median([over(r[f"percentile_{f}_{p}"] - r[f"min_flux_{f}"], r[f"max_flux_{f}"] - r[f"min_flux_{f}"]) for f in BANDS]) for p in (10, 30, 50, 70, 90)}
        w |= {f"percentile_diff_{p}_50": share[p] - share[50] for p in (10, 30, 70, 90)}
        got = found[r["object_id"]]
        assert set(w) == set(got) - {"object_id"}
        for name, value in w.items():
            assert (got[name] is None) == (value is None) and (value is None or abs(got[name] - value) < 1e-6), name


def test_raw_features_by_loops(spark, small):
    grid = grid_models(spark, small).toPandas().sort_values("mjd")
    obs = observations(spark, small).toPandas()
    for r in plans.queries()["avocado_raw_full"](spark, small).collect():
        for f, g in grid[grid.object_id == r.object_id].groupby("filter"):
            x, e = g.flux.to_numpy(), g.flux_error.to_numpy()
            want = {"max_flux": x.max(), "min_flux": x.min(), "positive_width": np.maximum(x, 0).sum() / x.max(), "negative_width": np.minimum(x, 0).sum() / x.min(), "abs_diff": np.abs(np.diff(x)).sum(), "total_s2n": np.sqrt(((x / e) ** 2).sum())}
            want |= {f"percentile_{f}_{p}": np.percentile(x, p) for p in (10, 30, 50, 70, 90)}
            for name, value in want.items():
                column = name if name.startswith("percentile") else f"{name}_{f}"
                assert abs(r[column] - value) < 1e-6, column
            peak, high = int(x.argmax()), x.max()
            for share, tag in ((0.8, "0_8"), (0.5, "0_5"), (0.2, "0_2")):
                after = [i for i in range(1, len(x) - peak) if x[peak + i] < share * high]
                assert r[f"time_fwd_max_{tag}_{f}"] == (after[0] if after else None)
            peaks = sorted((x[i] for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= max(abs(x.max()), abs(x.min())) / 5), reverse=True)
            assert r[f"peaks_pos_{f}_count" if f"peaks_pos_{f}_count" in r.asDict() else f"peaks_pos_count_{f}"] == len(peaks)
        own = obs[obs.object_id == r.object_id]
        s = (own.flux / own.flux_error).to_numpy()
        assert r["count"] == len(own) and r["count_s2n_5"] == (s > 5).sum() and r["count_s2n_-5"] == (s < -5).sum() and abs(r.frac_background - (np.abs(s) < 3).mean()) < 1e-9


def test_spline_query_against_numpy(spark, small):
    found = {r.object_id: r for r in plans.queries()["chisq_cubic_interp"](spark, small).collect()}
    grid, obs = grid_models(spark, small).toPandas(), observations(spark, small).toPandas()

    def spline(x, y, at):
        """Not-a-knot, by one linear system for all pieces' coefficients."""
        n, h = len(x), np.diff(x)
        a, b = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        m = np.linalg.solve(a, b)
        i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
        d, left = at - x[i], x[i + 1] - at
        return (m[i] * left**3 + m[i + 1] * d**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * left + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * d

    assert found
    for name, r in list(found.items())[:6]:
        total, n = 0.0, 0
        for f, own in obs[obs.object_id == name].groupby("filter"):
            g = grid[(grid.object_id == name) & (grid["filter"] == f)].sort_values("mjd")
            own = own[(own.mjd >= g.mjd.min()) & (own.mjd <= g.mjd.max()) & (own.flux_error != 0)]
            total += float((((own.flux - spline(g.mjd.to_numpy(), g.flux.to_numpy(), own.mjd.to_numpy())) / own.flux_error) ** 2).sum())
            n += len(own)
        assert r.n_points == n and abs(r.chisq - total) < 1e-3 * (1 + total)


def _classes(spark, n=40):
    rng = np.random.default_rng(9)
    rows = [(f"a{i}", 0, rng.normal(0, 1, 3).tolist()) for i in range(n)] + [(f"b{i}", 1, rng.normal(1.5, 1, 3).tolist()) for i in range(n // 3)]
    return rows, spark.createDataFrame(rows, "object_id string, label int, features array<double>")


@pytest.mark.parametrize("method", A.METHODS)
def test_resampling(spark, method):
    rows, df = _classes(spark)
    out = A.resample(df, method, seed=2).collect()
    assert sorted(map(str, out)) == sorted(map(str, A.resample(df.repartition(3), method, seed=2).collect()))
    counts = {y: sum(r.label == y for r in out) for y in (0, 1)}
    names = {i for i, _, _ in rows}
    assert all((r.original_event is None) == (r.object_id in names) and (r.original_event is None or r.original_event in names) for r in out)
    if method in ("SMOTE", "ADASYN", "SVMSMOTE"):
        assert counts == {0: 40, 1: 40}
    else:
        assert 0 < counts[0] <= 40 and 0 < counts[1] <= 40
    x, y = np.array([r.features for r in out]), np.array([r.label for r in out])
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(len(x), np.inf))
    if method == "SMOTETomek":  # no two of the input that are each other's nearest and of different classes stay together
        near = d.argmin(axis=1)
        first = A.resample(df, "SMOTE", seed=2).collect()
        fx, fy = np.array([r.features for r in first]), np.array([r.label for r in first])
        fd = np.linalg.norm(fx[:, None] - fx[None], axis=2) + np.diag(np.full(len(fx), np.inf))
        links = {i for i in range(len(fx)) if fd[fd[i].argmin()].argmin() == i and fy[i] != fy[fd[i].argmin()]}
        assert len(out) == len(first) - len(links) and len(near) == len(out)
    with pytest.raises(ValueError):
        A.resample(df, "none")


def test_hard_rows_are_drawn_more_often(spark):
    rows, df = _classes(spark, 60)
    made = [r.original_event for r in A.resample(df, "ADASYN", seed=1).collect() if r.original_event]
    x = np.array([f for _, _, f in rows])
    alien = {}
    for i, (name, y, _) in enumerate(rows):
        near = [j for j in np.argsort(np.linalg.norm(x - x[i], axis=1)) if j != i][:5]
        alien[name] = sum(rows[j][1] != y for j in near)
    assert all(alien[name] > 0 for name in made)


def test_redshift_tables_are_checked(spark):
    both = spark.createDataFrame([(0.5, 0.6, 0.1)], "hostgal_specz double, hostgal_photoz double, hostgal_photoz_err double")
    assert abs(A.redshift_table(both, z_table=both)[0][0] - 0.1) < 1e-12
    assert A.redshift_table(both, z_table=both.selectExpr("0.2D AS z_diff", "hostgal_photoz_err"))[0].tolist() == [0.2, 0.1]
    with pytest.raises(ValueError):
        A.redshift_table(both, z_table=both.drop("hostgal_photoz_err"))


def test_survey_constants():
    assert A.SURVEYS["plasticc_wfd"].n_obs == ((1.0, 24.5006006, 72.5106613),)
    assert A.SURVEYS["plasticc_ddf"].n_obs == ((0.34393457, 57.36015146, 271.58889272), (0.65606543, 92.7741619, 338.53085446))


def test_neighbours_in_blocks(spark):
    rows, df = _classes(spark)
    whole = sorted(map(str, K.nearest_rows(df, df, 4).collect()))
    assert whole == sorted(map(str, K.nearest_rows(df, df, 4, block=7).collect()))


def test_chains_stay_in_the_box(spark):
    t = np.linspace(0, 40, 30)
    obs = spark.createDataFrame([("o", "lsstg", float(x), float(100 * math.exp(-((x - 15) ** 2) / 50)), 2.0) for x in t], "object_id string, filter string, mjd double, flux double, flux_error double")
    rows = P.sample_chains(obs, rounds=15, walkers=12).collect()
    bounds = list(P.MODELS["newling"][0].values())
    assert len(rows) == 15 * 12 and all(lo <= v <= hi for r in rows for v, (lo, hi, _) in zip(r.params, bounds, strict=True))
    assert max(r.log_likelihood for r in rows if r.step == 14) >= max(r.log_likelihood for r in rows if r.step == 0)


def test_templates_with_bounds_and_redshift(spark):
    phase = np.arange(-20.0, 41.0)
    templates = spark.createDataFrame([("one", "lsstr", float(p), float(math.exp(-((p / 8) ** 2)))) for p in phase], "name string, filter string, phase double, flux double")
    t = np.arange(0.0, 90.0, 2.0)
    obs = spark.createDataFrame([("o", "lsstr", float(x), float(50 * math.exp(-((((x - 40) / (1.2 * 1.5)) / 8) ** 2))), 1.0) for x in t], "object_id string, filter string, mjd double, flux double, flux_error double")
    zs = spark.createDataFrame([("o", 0.5)], "object_id string, z double")
    r = P.fit_template(obs, templates, redshifts=zs).first()
    assert abs(r.stretch - 1.2) < 0.05 and abs(r.t0 - 40) < 0.5 and abs(r.amplitude - 50) < 1
    held = P.fit_template(obs, templates, redshifts=zs, bounds={"stretch": (0.9, 1.1), "t0": (30, 39)}).first()
    assert 0.9 <= held.stretch <= 1.1 and 30 <= held.t0 <= 39
    again = P.reconstruct_template(obs, P.fit_template(obs, templates, redshifts=zs), templates, 40, redshifts=zs).collect()
    assert len(again) == 40 and max(abs(x.flux - 50 * math.exp(-((((x.mjd - 40) / 1.8) / 8) ** 2))) for x in again) < 2
    with pytest.raises(ValueError):
        P.fit_template(obs, templates, bounds={"z": (0, 1)})


def test_published_filters():
    assert np.allclose(T.filters_of("sym4")[0], [-0.0757657148, -0.0296355276, 0.4976186676, 0.8037387518, 0.2978577956, -0.0992195436, -0.0126039673, 0.0322231006], atol=1e-9)
    assert np.allclose(T.filters_of("db4")[0], [-0.0105974018, 0.0328830117, 0.0308413818, -0.1870348117, -0.0279837694, 0.6308807679, 0.7148465706, 0.2303778133], atol=1e-9)
    for name in T.wavelets():
        low = np.array(T.filters_of(name)[0])
        assert all(abs((low[2 * k :] * low[: len(low) - 2 * k]).sum() - (k == 0)) < 1e-9 for k in range(len(low) // 2))


def test_folds_of_a_large_class(spark):
    rows = spark.range(300).select(F.col("id").alias("object_id"), F.lit(1).alias("target"))
    folds = [r["count"] for r in U.stratified_folds(rows, 5, 3).groupBy("fold").count().collect()]
    assert folds == [60] * 5


def test_simulated_unions(spark, tmp_path):
    from tests.test_sources import _fits

    for kind, base in (("Ia", 1), ("NONIa", 5)):
        (tmp_path / f"LSST_{kind}_HEAD.FITS").write_bytes(_fits([("SNID", "S4", "4A", [str(base).encode(), str(base + 1).encode()]), ("PTROBS_MIN", ">i4", "1J", [1, 3]), ("PTROBS_MAX", ">i4", "1J", [2, 3])]))
        (tmp_path / f"LSST_{kind}_PHOT.FITS").write_bytes(_fits([("MJD", ">f8", "1D", [1.0, 2.0, 3.0]), ("FLUXCAL", ">f4", "1E", [5.0, 1.0, 7.0])]))
    schema = ("SNID string, PTROBS_MIN int, PTROBS_MAX int", "MJD double, FLUXCAL float")
    ids = lambda subset: sorted({r.SNID for r in fits.opsim(spark, str(tmp_path), *schema, subset)[1].collect()})
    assert ids("all") == ["1", "2", "5", "6"] and ids("Ia") == ["1", "2"] and ids("nIa") == ["5", "6"]
    assert ids(spark.createDataFrame([("2",), (" 5 ",)], "SNID string")) == ["2", "5"]


@pytest.mark.parametrize("name", sorted(K.CLASSIFIERS))
def test_classifiers_rank_held_out_rows(spark, name):
    """Overlapping classes: the area under the curve of rows not learned from, near that of the best possible score."""
    rng = np.random.default_rng(12)
    rows = [(i, i % 2, (rng.normal(0, 1, 4) + 1.6 * (i % 2) * np.array([1, 1, 0, 0])).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "object_id long, label int, features array<double>")
    params = {"boosted_trees": {"maxIter": 5}, "boost_dt": {"rounds": 3, "maxDepth": 2}, "boost_rf": {"rounds": 2, "numTrees": 5, "maxDepth": 3}, "random_forest": {"numTrees": 20}, "knn": {"k": 15}, "neural_network": {"hidden": 8, "maxIter": 40}, "decision_tree": {"maxDepth": 3}, "bagged_forest": {"numTrees": 10, "maxDepth": 4}, "leafwise_trees": {"n_estimators": 6, "num_leaves": 5}, "tanh_network": {"hidden": (8,), "epochs": 25, "rate": 0.05, "batches": 2}}.get(name, {})
    fitted = K.CLASSIFIERS[name](**params).fit(df.where("object_id % 3 > 0"))
    told = fitted.predict(df.where("object_id % 3 = 0"))
    best = np.array([sum(f[:2]) for i, _, f in rows if i % 3 == 0])
    y = np.array([y for i, y, _ in rows if i % 3 == 0])
    ceiling = np.mean([b > a for b in best[y == 1] for a in best[y == 0]])
    assert K.score_auc(told, fitted.labels, 1) > ceiling - 0.15 > 0.7
