"""Queries that put data through sinks and sources and back, and joins of features, labels and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import augment as A
from fluxloom.operators import chisq as X
from fluxloom.operators import classify as K
from fluxloom.operators import features as T
from fluxloom.operators import subset as U
from fluxloom.plans.models import BANDS, _swt_sql
from fluxloom.plans.registry import query, r6
from fluxloom.runtime import Scratch, materialised, table
from fluxloom.schema import LightCurves
from fluxloom.sources import sdss, sinks, snana, spcc
from fluxloom.sources.fixtures import GRID_SQL, OBJ_SQL, OBS_SQL, grid_models, light_curves, objects, observations


def _kept(scratch: Scratch, df: DataFrame) -> DataFrame:
    """The rows read back, written once more, so that the folder can go."""
    rows = materialised(df)
    scratch.remove()
    return rows


# --- sinks and sources ------------------------------------------------------------------------------------------------


@query(f"WITH {OBS_SQL} SELECT object_id || '.DAT' AS object_id, round(mjd - min(mjd) OVER (PARTITION BY object_id), 6) AS mjd, 'des' || substr(filter, 5) AS filter, round(flux, 6) AS flux, round(flux_error, 6) AS flux_error FROM obs")
def object_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object as a text file with a list of them, read back by the list."""
    scratch = Scratch(spark, "object_files")
    sinks.save_list(light_curves(spark, sf_dir), scratch.folder, "ALL")
    back = spcc.read(spark, scratch.folder, spcc.names_in_list(spark, f"{scratch.folder}/ALL.LIST"))
    return _kept(scratch, back.observations.select("object_id", r6("mjd"), "filter", r6("flux"), r6("flux_error")))


@query(f"WITH {OBS_SQL}, {OBJ_SQL} SELECT object_id, target, count(*) AS n_obs, round(sum(flux), 4) AS flux FROM obs JOIN objs USING (object_id) GROUP BY ALL")
def dataset_roundtrip(spark, sf_dir):
    """Observations and objects saved as a dataset and loaded again."""
    scratch = Scratch(spark, "dataset")
    sinks.save_dataset(light_curves(spark, sf_dir), scratch.folder)
    back = sinks.load_dataset(spark, scratch.folder)
    found = back.observations.join(back.objects.select("object_id", "target"), "object_id").groupBy("object_id", "target")
    return _kept(scratch, found.agg(F.count("*").alias("n_obs"), r6(F.sum("flux"), 4).alias("flux")))


_ORDER = f"CASE filter {' '.join(f'WHEN {b!r} THEN {i}' for i, b in enumerate(BANDS))} END"
_LEVELS = f"WITH {GRID_SQL}, l1 AS MATERIALIZED ({_swt_sql('grid', 'flux', 1)}), l2 AS MATERIALIZED ({_swt_sql('l1', 'ca', 2)})"
_FLAT = f"""{_LEVELS} SELECT object_id, ({_ORDER} * 128 + k * 32 + grid_ix)::INT AS place, round(x, 6) AS x FROM (
SELECT object_id, filter, grid_ix, 0 AS k, ca AS x FROM l2 UNION ALL SELECT object_id, filter, grid_ix, 1, cd FROM l2 UNION ALL SELECT object_id, filter, grid_ix, 2, ca FROM l1 UNION ALL SELECT object_id, filter, grid_ix, 3, cd FROM l1)"""


@query(_FLAT)
def wavelet_flatten(spark, sf_dir):
    """Coefficients of two levels as one vector an object, place by place."""
    vectors = T.feature_vector(T.swt(T.pack_models(grid_models(spark, sf_dir)), "flux", 2), 2, BANDS)
    return vectors.select("object_id", F.posexplode("features").alias("place", "x")).select("object_id", "place", r6("x"))


@query(_FLAT)
def saved_wavelets_to_space(spark, sf_dir):
    """The same from coefficients that were saved as a table."""
    scratch = Scratch(spark, "coefficients")
    sinks.save_coefficients(T.swt(T.pack_models(grid_models(spark, sf_dir)), "flux", 2), 2, scratch.folder)
    vectors = sinks.load_feature_space(spark, scratch.folder, BANDS)
    return _kept(scratch, vectors.select("object_id", F.posexplode("features").alias("place", "x")).select("object_id", "place", r6("x")))


@query("SELECT split, bucket, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM (SELECT s_suppkey, CASE WHEN s_nationkey * 10 < 100 THEN 'train' ELSE 'test' END AS split, ((row_number() OVER (PARTITION BY s_nationkey * 10 < 100 ORDER BY s_suppkey) - 1) % 4)::INT AS bucket FROM supplier) GROUP BY ALL")
def buckets_roundtrip(spark, sf_dir):
    """Train and test buckets saved in folders and read back."""
    scratch = Scratch(spark, "buckets")
    rows = table(spark, sf_dir, "supplier").withColumn("sntype", F.col("s_nationkey") * 10)
    sinks.save_buckets(U.train_test_bucket(rows, 4, "s_suppkey").select("s_suppkey", "split", "bucket"), scratch.folder)
    back = spark.read.parquet(scratch.folder).groupBy("split", F.col("bucket").cast("int").alias("bucket"))
    return _kept(scratch, back.agg(F.count("*").alias("n"), F.sum("s_suppkey").cast("long").alias("keys")))


@query(f"WITH {OBS_SQL} SELECT object_id, count(*) AS n_obs, round(max(flux), 6) AS peak, target FROM obs JOIN ({'WITH ' + OBJ_SQL} SELECT object_id, target FROM objs) USING (object_id) GROUP BY ALL")
def feature_sink_roundtrip(spark, sf_dir):
    """Two feature tables and the labels saved by name and taken up together."""
    scratch = Scratch(spark, "features")
    obs = observations(spark, sf_dir).groupBy("object_id")
    sinks.save_features(obs.agg(F.count("*").alias("n_obs")), scratch.folder, "counts")
    sinks.save_features(obs.agg(r6(F.max("flux")).alias("peak")), scratch.folder, "peaks")
    sinks.save_features(objects(spark, sf_dir).select("object_id", "target"), scratch.folder, "labels")
    both = sinks.load_features(spark, scratch.folder, ["counts", "peaks", "labels"])
    part = lambda i: F.get("features", F.lit(i))
    return _kept(scratch, both.select("object_id", part(0).cast("long").alias("n_obs"), part(1).alias("peak"), part(2).cast("int").alias("target")))


@query(f"""WITH {OBS_SQL} SELECT object_id::VARCHAR AS object_id, event_id, round(mjd, 6) AS mjd, filter, round(flux, 6) AS flux, round(flux_error, 6) AS flux_error, event_id % 3 = 1 AS detected FROM obs""")
def survey_photometry_clean(spark, sf_dir):
    """Photometry under a survey's own names, bands and flags, cleaned to the library's."""
    raw = observations(spark, sf_dir).select(F.concat(F.lit(" "), F.col("object_id").cast("string"), F.lit("  ")).alias("SNID"), "event_id", F.col("mjd").alias("MJD"), F.concat(F.upper(F.expr("substring(filter, 5)")), F.lit(" ")).alias("FLT"), F.col("flux").alias("FLUXCAL"), F.col("flux_error").alias("FLUXCALERR"), F.when(F.col("event_id") % 3 == 1, 4096 + 2).otherwise(2).alias("PHOTFLAG"))
    names = {v: k for k, v in snana.PHOTOMETRY.items()}
    raw = raw.withColumnsRenamed({own: names[n] for own, n in (("SNID", "object_id"), ("MJD", "mjd"), ("FLT", "filter"), ("FLUXCAL", "flux"), ("FLUXCALERR", "flux_error"), ("PHOTFLAG", "photflag")) if n in names})
    return snana.clean_photometry(raw).select("object_id", "event_id", r6("mjd"), "filter", r6("flux"), r6("flux_error"), "detected")


_CLASSES = ("SNIa", "SNII", "SNIb", "pSNIa", "Unknown", "zSNIbc")
_HELIO = "s_nationkey % 3 <> 0"


@query(f"""WITH s AS (SELECT *, CASE s_suppkey % 6 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES))} END AS class FROM supplier)
SELECT 'SMP_' || lpad(s_suppkey::VARCHAR, 6, '0') || '.dat' AS name, CASE WHEN class LIKE '%Ia%' THEN 1 WHEN class LIKE '%Ib%' THEN 3 WHEN class LIKE '%II%' THEN 2 END::INT AS target,
CASE WHEN {_HELIO} THEN s_nationkey / 100::DOUBLE ELSE s_nationkey / 50::DOUBLE END AS z, CASE WHEN {_HELIO} THEN 0.001::DOUBLE ELSE 0.02::DOUBLE END AS z_err FROM s WHERE class IN ('SNIa', 'SNII', 'SNIb')""")
def sdss_master_list(spark, sf_dir):
    """Suppliers as lines of a master list: the confirmed ones with class and redshift."""
    scratch = Scratch(spark, "master_list")
    rows = table(spark, sf_dir, "supplier").withColumn("class", F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("s_suppkey") % 6 + 1).cast("int")))
    helio, n = F.expr(_HELIO), F.col("s_nationkey")
    known = {0: F.col("s_suppkey").cast("string"), 5: F.col("class"), 11: F.when(helio, (n / 100).cast("string")).otherwise("\\N"), 12: F.when(helio, "0.001").otherwise("\\N"), 103: (n / 50).cast("string"), 104: F.lit("0.02")}
    lines = rows.select(F.concat_ws(" ", *[known.get(i, F.lit("x")) for i in range(105)]).alias("value"))
    lines.write.text(scratch.folder)
    return _kept(scratch, sdss.info(sdss.master_list(spark, scratch.folder, "spectro")))


# --- joins -------------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS_SQL} SELECT passband, count(*) AS n, round(avg(flux), 6) AS mean FROM (SELECT filter AS passband, flux FROM obs) GROUP BY passband")
def passband_column(spark, sf_dir):
    """The passband column found under the name that the table has for it."""
    return X.passband_column(observations(spark, sf_dir)).groupBy("passband").agg(F.count("*").alias("n"), r6(F.avg("flux")).alias("mean"))


@query(f"""WITH {OBS_SQL}, {OBJ_SQL} SELECT object_id, count(*) AS n_obs, coalesce(max(flux) FILTER (filter = 'lsstr'), -9)::DOUBLE AS peak_flux, round(any_value(hostgal_photoz), 6) AS hostgal_photoz, any_value(target) AS target
FROM obs JOIN objs USING (object_id) GROUP BY object_id""")
def features_with_redshift_and_labels(spark, sf_dir):
    """Feature tables joined by object, with photometric redshifts and labels."""
    obs, about = observations(spark, sf_dir), objects(spark, sf_dir)
    counts = obs.groupBy("object_id").agg(F.count("*").alias("n_obs"))
    return T.combine_features(counts, snana.band_peak(obs, "lsstr"), about.select("object_id", r6("hostgal_photoz")), about.select("object_id", "target"))


@query(f"WITH {OBJ_SQL} SELECT object_id, target, CASE WHEN object_id % 7 IN (0, 3) THEN 'train' ELSE 'test' END AS side FROM objs")
def split_by_list(spark, sf_dir):
    """Train and test objects by a list of ids."""
    about = objects(spark, sf_dir).select("object_id", "target")
    train, test = K.split(about, train_ids=about.where("object_id % 7 IN (0, 3)"))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(f"WITH {OBJ_SQL} SELECT object_id, (object_id % 4)::INT AS n_copies FROM objs WHERE ddf")
def quota_of_a_table(spark, sf_dir):
    """Copies asked for by a table whose ids must all exist."""
    about = objects(spark, sf_dir)
    return A.quota(about, about.where("ddf").select("object_id", (F.col("object_id") % 4).alias("n_copies")))


@query(f"WITH {OBJ_SQL} SELECT round(hostgal_photoz - hostgal_specz, 6) AS z_diff, round(hostgal_photoz_err, 6) AS hostgal_photoz_err, count(*) AS n FROM objs WHERE hostgal_specz > 0 GROUP BY ALL")
def redshift_differences(spark, sf_dir):
    """The table from which photometric redshifts are drawn."""
    found = A.standardised_redshifts(objects(spark, sf_dir).where("hostgal_specz > 0")).select(r6("z_diff"), r6("hostgal_photoz_err"))
    return found.groupBy("z_diff", "hostgal_photoz_err").agg(F.count("*").alias("n"))


@query(f"WITH {OBS_SQL}, {OBJ_SQL}, late AS (SELECT object_id + 1000000 AS object_id, mjd, filter, flux FROM obs JOIN objs USING (object_id) WHERE ddf) SELECT object_id, round(mjd, 6) AS mjd, filter, flux FROM obs UNION ALL SELECT object_id, round(mjd - min(mjd) OVER (PARTITION BY object_id), 6), filter, flux FROM late")
def objects_inserted(spark, sf_dir):
    """Further objects put into a dataset, their times counted from their first observation."""
    data = light_curves(spark, sf_dir)
    about = data.objects.where("ddf").withColumn("object_id", F.col("object_id") + 1_000_000)
    obs = data.observations.withColumn("object_id", F.col("object_id") + 1_000_000).join(about.select("object_id"), "object_id", "left_semi")
    both: LightCurves = sinks.append_objects(data, obs, about)
    return both.observations.select("object_id", r6("mjd"), "filter", "flux")
