import numpy as np
import pytest

from fluxloom.operators import augment as A
from fluxloom.operators import classify as K
from fluxloom.operators import features as T
from fluxloom.operators import fit as P
from fluxloom.operators import gp as G
from fluxloom.operators import pca as C
from fluxloom.operators.chisq import spline_not_a_knot
from fluxloom.operators.tsne import embed


def test_spline_repeats_cubics():
    x = np.array([0.0, 1.0, 2.5, 3.0, 4.5, 6.0])
    f = lambda t: 2 * t**3 - t**2 + 3 * t - 1
    at = np.linspace(0, 6, 31)
    assert np.allclose(spline_not_a_knot(x, f(x), at), f(at))


@pytest.mark.parametrize("wavelet", ["haar", "db2", "sym2", "coif1", "db5", "db12", "sym4", "sym9"])
def test_wavelets_invert(wavelet):
    x = np.random.default_rng(0).standard_normal(32)
    parts = T.swt_array(x, 5, wavelet)
    assert np.allclose(T.iswt_array(parts[-1][0], [d for _, d in parts], wavelet), x)


def test_levels():
    assert T.max_level(276) == 2 and T.check_level("max", 96) == 5
    for bad in (0, 3, "most"):
        with pytest.raises(ValueError):
            T.check_level(bad, 276)
    with pytest.raises(ValueError):
        T.filters_of("none")


def test_gp_meets_exact_points():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.sort(rng.uniform(0, 50, 30)), rng.choice([3685.0, 6231.0], 30)])
    y = np.sin(x[:, 0] / 8) * 30
    gp, _ = G.condition(G.kernel_2d(np.log(900.0), np.log(400.0)), x, y, np.full(30, 1e-3))
    mean, var = gp.predict(x)
    assert np.allclose(mean, y, atol=0.05) and (var > -1e-6).all()
    k = G.kernel_2d(1.0, 3.0)(x, x)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9


def test_gp_fit_improves_on_its_start():
    rng = np.random.default_rng(2)
    t, w = np.sort(rng.uniform(0, 60, 40)), np.full(40, 6231.0)
    y = 80 * np.exp(-(((t - 30) / 9) ** 2)) + rng.normal(0, 1, 40)
    params, gp, ok = G.fit_2d(t, w, y, np.ones(40))
    assert ok and ((gp.predict(np.column_stack([t, w]))[0] - y) ** 2).mean() < 2


def test_parametric_fit_finds_its_curve():
    t = np.linspace(0, 80, 60)
    true = np.array([4.0, 10.0, 2.0, 1.0, 0.5])
    y = P.CURVES["newling"](t, true)
    low, high, start = (np.array([b[i] for b in P.MODELS["newling"][0].values()]) for i in range(3))
    _, chi = P._least_squares(P.CURVES["newling"], t, y, np.ones(60), start, low, high, 6, 0)
    assert chi / 60 < 2


@pytest.mark.parametrize("sampler", sorted(P.SAMPLERS))
def test_samplers_stay_in_the_box(sampler):
    t = np.linspace(0, 60, 30)
    y = P.CURVES["karpenka"](t, np.array([4.0, -8.0, 15.0, 20.0, 3.0, 12.0]))
    low, high, start = (np.array([b[i] for b in P.MODELS["karpenka"][0].values()]) for i in range(3))
    p, chi = P.SAMPLERS[sampler](P.CURVES["karpenka"], t, y, np.full(30, 2.0), start, low, high, 2, 1)
    assert (p >= low - 1e-9).all() and (p <= high + 1e-9).all() and np.isfinite(chi)


def test_pca_both_ways(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "object_id long, features array<double>")
    model = C.fit_pca(df, "features")
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 39
    assert np.allclose(model.eigenvalues, values) and np.allclose(model.vectors @ model.vectors.T, np.eye(6), atol=1e-9)
    wide = rng.standard_normal((8, 50))
    tall = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "object_id long, features array<double>")
    dual = C.fit_pca(tall, "features", normalise=True)
    reduced = np.array([r.reduced for r in dual.transform(tall, "features", wanted="all").orderBy("object_id").collect()])
    assert np.allclose(dual.reconstruct(reduced), wide)


def test_pca_saves(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)], "object_id long, features array<double>")
    model = C.fit_pca(df, "features")
    model.save(df, str(tmp_path / "m"))
    again = C.PcaModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.vectors, model.vectors) and again.scales is None


def _blobs(spark, n=60):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.standard_normal(4) * 0.5 + np.eye(4)[i % 3] * 4).tolist()) for i in range(n * 3)]
    return spark.createDataFrame(rows, "object_id long, label int, features array<double>")


@pytest.mark.parametrize("name", ["nb", "knn", "random_forest", "decision_tree", "svm", "neural_network"])
def test_classifiers_separate_blobs(spark, name):
    rows = _blobs(spark)
    fitted = K.CLASSIFIERS[name]().fit(rows.where("object_id % 2 = 0"))
    told = fitted.predict(rows.where("object_id % 2 = 1")).select("label", "y_pred", "probability").collect()
    assert np.mean([r.label == r.y_pred for r in told]) > 0.9 and all(abs(sum(r.probability) - 1) < 1e-6 for r in told)


def test_boosting_and_search(spark):
    rows = _blobs(spark, 30)
    boosted = K.AdaBoost(rounds=2, maxDepth=2).fit(rows)
    assert K.score_accuracy(boosted.predict(rows), boosted.labels) > 0.9
    found = K.grid_search(K.DecisionTree, rows, {"maxDepth": (1, 4)}, folds=2, scoring="accuracy")
    assert found.best == {"maxDepth": 4}


def test_augmented_objects(spark, small):
    from fluxloom.sources.fixtures import objects, observations

    obs, obj = observations(spark, small), objects(spark, small)
    make = lambda n: A.augment(obs.repartition(n), obj, A.quota(obj, "all", each=1), seed=5)
    first, second = (sorted(map(tuple, make(n).collect()), key=str) for n in (1, 3))
    assert first == second and first
    seen = {}
    for r in make(2).collect():
        seen.setdefault(r.object_id, []).append(r)
    assert all(len(v) >= 3 and sum(x.detected for x in v) >= 2 and min(x.mjd for x in v) == 0 for v in seen.values())
    with pytest.raises(ValueError):
        A.augment(obs, obj, A.quota(obj, "all"), max_duration=1.0)
    assert A.quota(obj, None).count() == 0


def test_redshifts_and_distance():
    rng = np.random.default_rng(6)
    for rule in ("wfd", "ddf", "base-v2"):
        z = np.array([A.new_redshift(rng, 0.3, rule) for _ in range(500)])
        low, high = 1.3 / (2 - 8690 / 9736) - 1, (1.3 / (2 - 4802 / 3685) - 1) * (1.4 if rule == "ddf" else 1)
        assert (z >= low - 1e-9).all() and (z <= high + 1e-9).all()
    assert abs(A.luminosity_distance(1.0) - 6607) < 15


def test_smote_fills_classes(spark):
    rows = _blobs(spark, 20).where("label <> 1 OR object_id < 24")
    made = A.smote(rows).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in made} == {1: 12}


def test_tsne_parts_blobs():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.standard_normal((25, 5)), rng.standard_normal((25, 5)) + 12])
    y = embed(x, 10)
    inside = np.linalg.norm(y[:25] - y[:25].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:25].mean(0) - y[25:].mean(0)) > 2 * inside


@pytest.mark.parametrize("name", sorted(K.CLASSIFIERS))
def test_classifiers_are_saved(spark, tmp_path, name):
    rows = _blobs(spark, 15)
    params = {"boosted_trees": {"maxIter": 2}, "boost_dt": {"rounds": 2, "maxDepth": 2}, "boost_rf": {"rounds": 2, "numTrees": 3}, "random_forest": {"numTrees": 5}, "knn": {"k": 3}, "bagged_forest": {"numTrees": 3}, "leafwise_trees": {"n_estimators": 2, "min_child_samples": 3}, "tanh_network": {"epochs": 3}}.get(name, {})
    fitted = K.CLASSIFIERS[name](**params).fit(rows)
    fitted.save(spark, str(tmp_path / name))
    again = K.Classifier.load(spark, str(tmp_path / name))
    assert sorted(map(str, again.predict(rows).collect())) == sorted(map(str, fitted.predict(rows).collect()))


def test_optimised_once(spark):
    rows = _blobs(spark, 20)
    tree = K.DecisionTree()
    assert tree.optimise(rows, {"maxDepth": (1, 3)}, folds=2, scoring="accuracy").best == {"maxDepth": 3} and tree.params["maxDepth"] == 3
    with pytest.raises(ValueError):
        tree.optimise(rows)


def test_features_are_combined(spark):
    a = spark.createDataFrame([(1, 2.0)], "object_id long, x double")
    assert T.combine_features(a, a.withColumnRenamed("x", "y")).first().asDict() == {"object_id": 1, "x": 2.0, "y": 2.0}
    with pytest.raises(ValueError):
        T.combine_features(a, a)


def test_runs_report_every_classifier(spark, tmp_path):
    found = K.run_classifiers(_blobs(spark, 40), ["nb", "decision_tree"], 0.5, output=str(tmp_path))
    assert all(v["accuracy"] > 0.9 and v["auc"] > 0.9 for v in found.values())
    assert spark.read.parquet(str(tmp_path / "nb" / "roc")).count() == 50
