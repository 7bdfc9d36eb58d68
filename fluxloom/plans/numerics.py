"""Queries that SQL cannot express: fits, synthesis, learning. Their tests are closed forms and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import augment as A
from fluxloom.operators import chisq as X
from fluxloom.operators import classify as K
from fluxloom.operators import features as T
from fluxloom.operators import fit as P
from fluxloom.operators import gp as G
from fluxloom.operators import metrics as M
from fluxloom.operators import pca as C
from fluxloom.operators import tsne as V
from fluxloom.plans.registry import query, r6
from fluxloom.runtime import Scratch, materialised, table
from fluxloom.sources.fixtures import grid_models, objects, observations
from fluxloom.streaming import sessions

BANDS = ("lsstu", "lsstg", "lsstr", "lssti", "lsstz")


def _spread(obs: DataFrame) -> DataFrame:
    """Only the columns that fits need."""
    return obs.select("object_id", "event_id", "mjd", "filter", "flux", "flux_error")


@query()
def gp_1d_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = G.fit_gps(_spread(observations(spark, sf_dir)), 32, 0, 31, gp_dim=1, filters=BANDS)
    return fits.where("grid_ix = 0").select("object_id", "filter", "kernel", "converged", "status")


@query()
def gp_2d_fit(spark, sf_dir):
    fits = G.fit_gps(_spread(observations(spark, sf_dir)), 32, 0, 31, filters=BANDS)
    return G.models_of(fits).select("object_id", "filter", "grid_ix", "mjd", r6("flux", 4), r6("flux_error", 4))


@query()
def gp_predict_grid(spark, sf_dir):
    """Predictions at other times from saved parameters."""
    obs = _spread(observations(spark, sf_dir))
    params = G.params_of(materialised(G.fit_gps(obs, 2, 0, 31, filters=BANDS)))
    return G.predict_2d(obs, params, [0.5, 10.5, 20.5], BANDS).select("object_id", "filter", "mjd", r6("flux", 4), r6("flux_error", 4))


@query()
def t_peak_gp(spark, sf_dir):
    """The day of each object's highest modelled flux, from saved parameters."""
    obs = observations(spark, sf_dir)
    params = G.params_of(materialised(G.fit_gps(_spread(obs), 2, 0, 31, filters=BANDS)))
    return G.peak_times(obs.select("object_id", "filter", "mjd", "flux", "flux_error", "detected"), params, BANDS).select("object_id", r6("peak_mjd"))


@query()
def chisq_cubic_interp(spark, sf_dir):
    rows = X.on_model_cubic(observations(spark, sf_dir), grid_models(spark, sf_dir))
    return X.chisq(rows, ["object_id"]).select("object_id", r6("chisq", 4), "n_points")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query()
def pca_svd(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return C.fit_pca(rows, "features").transform(rows, "features", wanted=5).select("object_id", "reduced")


def _wavelets(spark, sf_dir, levels=2):
    packed = T.swt(T.pack_models(grid_models(spark, sf_dir)), "flux", levels)
    return materialised(T.feature_vector(packed, levels, BANDS))


@query()
def wavelet_features_pipeline(spark, sf_dir):
    """Models to wavelets to principal components."""
    rows = _wavelets(spark, sf_dir)
    model = C.fit_pca(rows, "features")
    return model.transform(rows, "features", wanted=10).select("object_id", "reduced")


@query()
def reconstruct_error(spark, sf_dir):
    """Chi-square of models restored from all components: next to nothing."""
    rows, levels, n = _wavelets(spark, sf_dir), 2, 32
    model = C.fit_pca(rows, "features")
    back = model.reconstructed(model.transform(rows, "features", wanted="all"), "reduced", "features")
    parts = back.select("object_id", F.posexplode(F.array(*[F.struct(F.lit(b).alias("filter"), *[F.slice("features", i * 2 * levels * n + k * n + 1, n).alias(f"{c}_{level}") for k, (level, c) in enumerate((v, c) for v in range(levels, 0, -1) for c in ("cA", "cD"))]) for i, b in enumerate(BANDS)])).alias("_i", "s")).select("object_id", "s.*")
    restored = T.iswt(parts, levels, "again").select("object_id", "filter", F.posexplode("again").alias("grid_ix", "flux"))
    return G.reconstruction_error(grid_models(spark, sf_dir), restored).select("object_id", r6("error"))


def _parametric(spark, sf_dir, sampler, model="newling"):
    fits = P.fit_parametric(_spread(observations(spark, sf_dir)), model, sampler, attempts=2)
    return fits.select("object_id", "filter", "params", "chisq", "n_points", "status")


@query()
def parametric_leastsq(spark, sf_dir):
    return P.fit_table(_parametric(spark, sf_dir, "leastsq"), BANDS)


@query()
def parametric_karpenka(spark, sf_dir):
    return P.fit_table(_parametric(spark, sf_dir, "leastsq", "karpenka"), BANDS, "karpenka")


@query()
def parametric_mcmc(spark, sf_dir):
    return _parametric(spark, sf_dir, "mcmc")


@query()
def parametric_nested(spark, sf_dir):
    return _parametric(spark, sf_dir, "nested")


@query()
def parametric_chains(spark, sf_dir):
    """The sampled points of all fits, in the order in which they were drawn; 20 rounds."""
    return P.sample_chains(_spread(observations(spark, sf_dir)), rounds=20).select("object_id", "filter", "step", "walker", "params", "log_likelihood")


@query()
def nested_posterior(spark, sf_dir):
    """Weighted points and evidence of every object and band; made smaller than the library's defaults: 24 live points."""
    found = P.nested_posterior(_spread(observations(spark, sf_dir)), live=24, steps=8)
    return found.select("object_id", "filter", "point", "params", "log_likelihood", "weight", "log_evidence", "log_evidence_error")


def _templates(spark):
    names = spark.range(2).select(F.when(F.col("id") == 0, "slow").otherwise("fast").alias("name"), F.when(F.col("id") == 0, 12.0).otherwise(4.0).alias("w"))
    points = names.withColumn("filter", F.explode(F.array(*[F.lit(b) for b in BANDS]))).withColumn("phase", F.explode(F.sequence(F.lit(-10), F.lit(30))))
    return points.select("name", "filter", F.col("phase").cast("double").alias("phase"), F.exp(-F.pow(F.col("phase") / F.col("w"), F.lit(2.0))).alias("flux"))


@query()
def template_fit(spark, sf_dir):
    return P.fit_template(_spread(observations(spark, sf_dir)), _templates(spark))


@query()
def template_reconstruct(spark, sf_dir):
    """The fitted templates read at 20 times over each object's own span in each band."""
    obs = _spread(observations(spark, sf_dir))
    fits = materialised(P.fit_template(obs, _templates(spark), bounds={"stretch": (0.5, 2.0)}))
    return P.reconstruct_template(obs, fits, _templates(spark), points=20).select("object_id", "filter", "grid_ix", r6("mjd"), r6("flux"))


def _augmented(spark, sf_dir, survey, wanted="all", each=2):
    obj = objects(spark, sf_dir)
    return A.augment(_spread(observations(spark, sf_dir)), obj, A.quota(obj, wanted, each=each), survey, seed=4)


@query()
def augment_wfd(spark, sf_dir):
    return _augmented(spark, sf_dir, "plasticc_wfd")


@query()
def augment_ddf(spark, sf_dir):
    return _augmented(spark, sf_dir, "plasticc_ddf")


@query()
def augment_survey_variants(spark, sf_dir):
    obj = objects(spark, sf_dir)
    made = A.augment_surveys(_spread(observations(spark, sf_dir)), obj, A.quota(obj, "all", each=1), list(A.SURVEYS), seed=4)
    return made.groupBy("object_id", "original_event", "survey").agg(F.count("*").alias("n_obs"), F.first("hostgal_specz").alias("z")).select("object_id", "original_event", "n_obs", "z", "survey")


@query()
def augment_refit_gps(spark, sf_dir):
    """Synthesised objects and the processes fitted to them anew, on 16 times (one copy each)."""
    made = materialised(_augmented(spark, sf_dir, "plasticc_wfd", each=1))
    return A.refit_gps(made, number_gp=16, t_min=0, t_max=60, filters=BANDS).select("object_id", "filter", "grid_ix", "mjd", "flux", "flux_error", "status")


@query()
def smote(spark, sf_dir):
    return A.smote(_vectors(spark, sf_dir))


def _resampled(spark, sf_dir, method):
    """The classes of the vectors made uneven, then brought to one size."""
    rows = _vectors(spark, sf_dir).where("label % 3 = 0 OR object_id % 3 > 0")
    return A.resample(rows, method).select("object_id", "label", "original_event")


@query()
def resample_adasyn(spark, sf_dir):
    return _resampled(spark, sf_dir, "ADASYN")


@query()
def resample_svmsmote(spark, sf_dir):
    return _resampled(spark, sf_dir, "SVMSMOTE")


@query()
def resample_smoteenn(spark, sf_dir):
    return _resampled(spark, sf_dir, "SMOTEENN")


@query()
def resample_smotetomek(spark, sf_dir):
    return _resampled(spark, sf_dir, "SMOTETomek")


@query()
def tsne_embed(spark, sf_dir):
    return V.tsne(_vectors(spark, sf_dir))


def _classified(spark, sf_dir, make, **params):
    """Trained on the rows whose id ends in 0, 1 or 2 and applied to the others."""
    rows = K.standardised(_vectors(spark, sf_dir))
    fitted = make(**params).fit(rows.where("object_id % 10 < 3"))
    return fitted.predict(rows.where("object_id % 10 >= 3")).select("object_id", "label", "y_pred", "probability")


@query()
def clf_rf(spark, sf_dir):
    """Made smaller than the library's defaults: 40 trees."""
    return _classified(spark, sf_dir, K.RandomForest, numTrees=40)


@query()
def clf_dt(spark, sf_dir):
    return _classified(spark, sf_dir, K.DecisionTree)


@query()
def clf_gbt_ovr(spark, sf_dir):
    """Made smaller than the library's defaults: 4 rounds of depth 3."""
    return _classified(spark, sf_dir, K.BoostedTrees, maxIter=4, maxDepth=3)


@query()
def clf_leafwise(spark, sf_dir):
    """Made smaller than the library's defaults: 3 rounds of 8 leaves."""
    return _classified(spark, sf_dir, K.LeafwiseTrees, n_estimators=3, num_leaves=8)


@query()
def clf_tanh_adam(spark, sf_dir):
    """Made smaller than the library's defaults: 20 units, 5 epochs."""
    return _classified(spark, sf_dir, K.TanhPerceptron, hidden=(20,), epochs=5, rate=0.01)


@query()
def forest_out_of_bag(spark, sf_dir):
    """The votes of trees that did not see a row, for all rows; made smaller than the library's defaults: 12 trees of depth 5."""
    rows = _vectors(spark, sf_dir)
    forest = K.BaggedForest(numTrees=12, maxDepth=5).fit(rows)
    return forest.out_of_bag(rows)


@query()
def clf_adaboost_dt(spark, sf_dir):
    """Made smaller than the library's defaults: 3 rounds of depth 3."""
    return _classified(spark, sf_dir, K.AdaBoost, rounds=3, maxDepth=3)


@query()
def clf_adaboost_rf(spark, sf_dir):
    """Made smaller than the library's defaults: 2 rounds of 10 trees of depth 4."""
    return _classified(spark, sf_dir, lambda **p: K.AdaBoost(K.RandomForest, **p), rounds=2, numTrees=10, maxDepth=4)


@query()
def clf_mlp(spark, sf_dir):
    """Made smaller than the library's defaults: 20 units, 40 iterations."""
    return _classified(spark, sf_dir, K.Perceptron, hidden=20, maxIter=40)


@query()
def clf_svm_rff(spark, sf_dir):
    return _classified(spark, sf_dir, K.KernelSvm)


@query()
def grid_search_cv(spark, sf_dir):
    found = K.grid_search(K.DecisionTree, _vectors(spark, sf_dir), {"minInstancesPerNode": (1, 20)}, folds=3, scoring="accuracy")
    return spark.createDataFrame([(str(p), s, p == found.best) for s, p in found.scores], "params string, score double, best boolean")


@query()
def bootstrap_recall_ci(spark, sf_dir):
    from fluxloom.plans.models import _EDGE, _pred

    return M.bootstrap_interval(_pred(spark, sf_dir), "value", _EDGE, "y_true")


_SESSIONS = """WITH e AS MATERIALIZED (SELECT user_id, ts, value, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS MATERIALIZED (SELECT *, sum(CASE WHEN g IS NULL OR g >= INTERVAL 36 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)"""


@query(f"{_SESSIONS} SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 36 HOUR)::TIMESTAMP AS \"end\", count(*) AS n_obs, max(value) AS peak FROM s GROUP BY user_id, k")
def stream_gap_sessions(spark, sf_dir):
    """Light curves cut at gaps of 36 hours from a stream over the event table; an extension."""
    scratch = Scratch(spark, "gap_sessions")
    found = materialised(sessions.drain_sessions(sessions.read_events(spark, sf_dir), scratch.folder))
    scratch.remove()
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""WITH e AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS (SELECT *, sum(CASE WHEN g IS NULL OR g >= INTERVAL 36 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*) AS n_obs, max(value) AS peak FROM s GROUP BY user_id, k""")
def gap_sessions_batch(spark, sf_dir):
    """The same sessions over the table at rest."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.gap_sessions(events).select("user_id", "n_obs", "peak")
