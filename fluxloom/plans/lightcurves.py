"""Queries over light curves: ingest, cleaning, subsets and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import preprocess as P
from fluxloom.operators import stats as S
from fluxloom.operators import subset as U
from fluxloom.plans.registry import query, r6
from fluxloom.runtime import table
from fluxloom.schema import LightCurves, passbands, wavelength
from fluxloom.sources import snana
from fluxloom.sources import spcc
from fluxloom.sources.fixtures import OBJ_SQL, OBS_SQL, light_curves, objects, observations

_COLUMNS = ("object_id", "event_id", "mjd", "filter")


def _shown(obs: DataFrame) -> DataFrame:
    return obs.select("object_id", "event_id", r6("mjd"), "filter")


# --- ingest ---------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS_SQL} SELECT object_id, event_id, round(mjd - min(mjd) OVER (PARTITION BY object_id), 6) AS mjd, filter, flux, flux_error, detected FROM obs")
def lc_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rezero(observations(spark, sf_dir)).select("object_id", "event_id", r6("mjd"), "filter", "flux", "flux_error", "detected")


@query(f"WITH {OBS_SQL}, w(filter, wavelength) AS (VALUES ('lsstu', 3685.0), ('lsstg', 4802.0), ('lsstr', 6231.0), ('lssti', 7542.0), ('lsstz', 8690.0)) SELECT filter, wavelength::DOUBLE AS wavelength, count(*) AS n_obs FROM obs JOIN w USING (filter) GROUP BY ALL")
def filter_remap_join(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("wavelength", wavelength(F.col("filter"))).groupBy("filter", "wavelength").agg(F.count("*").alias("n_obs"))


@query(f"WITH {OBJ_SQL} SELECT object_id, round(CASE WHEN hostgal_specz <> -9 THEN hostgal_specz ELSE hostgal_photoz END, 6) AS z FROM objs")
def redshift_choice(spark, sf_dir):
    return objects(spark, sf_dir).select("object_id", r6(P.redshift(F.col("hostgal_specz"), F.col("hostgal_photoz"))).alias("z"))


@query("SELECT l_orderkey, l_linenumber, ((l_orderkey * 37 + l_partkey) % 8192) AS photflag, (((l_orderkey * 37 + l_partkey) % 8192) // 4096) % 2 = 1 AS detected FROM lineitem")
def photflag_detected_bit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("photflag", (F.col("l_orderkey") * 37 + F.col("l_partkey")) % 8192)
    return rows.select("l_orderkey", "l_linenumber", "photflag", P.detected_bit(F.col("photflag")).alias("detected"))


@query("SELECT p_partkey, p_size * 5 AS sntype, CASE WHEN p_size * 5 > 100 THEN p_size * 5 - 100 ELSE p_size * 5 END AS target FROM part")
def sntype_fold_target(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("sntype", F.col("p_size") * 5).select("p_partkey", "sntype", P.plain_target(F.col("sntype")).alias("target"))


@query("SELECT p_partkey, p_size AS code, CASE p_size // 10 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE p_size END AS sn_class FROM part")
def subtype_collapse(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("code"), P.fold_type(F.col("p_size")).alias("sn_class"))


@query("SELECT event_id, round((value - 50) * power(10, -1.44::DOUBLE), 6) AS flux FROM events WHERE value - 50 > 0")
def positive_flux_scaled(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("fluxcal", F.col("value") - 50)
    return snana.scaled_positive_flux(rows).select("event_id", r6("flux"))


@query(f"WITH {OBS_SQL} SELECT object_id, coalesce(max(flux) FILTER (filter = 'lsstr'), -9)::DOUBLE AS peak_flux FROM obs GROUP BY object_id")
def rband_peak_flux(spark, sf_dir):
    return snana.band_peak(observations(spark, sf_dir), "lsstr")


@query(f"""WITH {OBS_SQL} SELECT object_id, event_id, round(mjd, 6) AS mjd, filter, round(flux, 3) AS flux, round(flux_error, 3) AS flux_error FROM obs""")
def text_obs_parse(spark, sf_dir):
    """Observations written as keyed text lines and read back."""
    obs = observations(spark, sf_dir)
    fields = [F.lit("OBS:"), F.format_string("%.12f", "mjd"), F.expr("substring(filter, 5)"), F.col("event_id").cast("string"), F.format_string("%.4f", "flux"), F.format_string("%.4f", "flux_error")]
    lines = obs.select(F.col("object_id").cast("string").alias("name"), F.concat_ws("  ", *fields).alias("value"))
    parsed = spcc.parse_observations(lines, prefix="lsst")
    return parsed.select(F.col("object_id").cast("long").alias("object_id"), F.col("field").cast("long").alias("event_id"), r6("mjd"), "filter", F.round("flux", 3).alias("flux"), F.round("flux_error", 3).alias("flux_error"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey * 10 < 100 THEN 'train' ELSE 'test' END AS split, ((row_number() OVER (PARTITION BY s_nationkey * 10 < 100 ORDER BY s_suppkey) - 1) % 4)::INT AS bucket FROM supplier")
def train_test_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("sntype", F.col("s_nationkey") * 10)
    return U.train_test_bucket(rows, 4, "s_suppkey").select("s_suppkey", "split", "bucket")


# --- subsets and unions -----------------------------------------------------------------------------------------------


@query(f"WITH {OBS_SQL}, {OBJ_SQL} SELECT object_id, count(*) AS n_obs FROM obs WHERE object_id IN (SELECT object_id FROM objs WHERE target = 42) GROUP BY object_id")
def update_dataset_semi(spark, sf_dir):
    data = light_curves(spark, sf_dir)
    kept = U.update_to_subset(data, data.objects.where("target = 42"))
    return kept.observations.groupBy("object_id").agg(F.count("*").alias("n_obs"))


@query(f"WITH {OBJ_SQL} SELECT object_id FROM objs WHERE object_id NOT IN (SELECT object_id FROM objs WHERE target = 62)")
def disjointness_anti(spark, sf_dir):
    o = objects(spark, sf_dir)
    return U.missing_ids(o, o.where("target = 62"))


@query(f"WITH {OBS_SQL}, {OBJ_SQL} SELECT object_id, ddf, count(*) AS n_obs, round(sum(flux), 4) AS flux FROM obs JOIN objs USING (object_id) GROUP BY ALL")
def merge_datasets_union(spark, sf_dir):
    """The deep-field objects and the others, as two datasets, merged."""
    data = light_curves(spark, sf_dir)

    def part(deep: str) -> LightCurves:
        own = data.objects.where(deep)
        return LightCurves(data.observations.join(own, "object_id", "left_semi"), own, None, data.filters)

    both = U.merge(part("ddf"), part("NOT ddf"))
    rows = both.observations.join(both.objects.select("object_id", "ddf"), "object_id")
    return rows.groupBy("object_id", "ddf").agg(F.count("*").alias("n_obs"), F.round(F.sum("flux"), 4).alias("flux"))


@query(f"WITH {OBJ_SQL} SELECT object_id, target, false AS augmented FROM objs UNION ALL SELECT object_id + 1000000, target, true FROM objs WHERE target = 42")
def append_augmented_flag(spark, sf_dir):
    o = objects(spark, sf_dir).select("object_id", "target")
    return U.append_augmented(o, o.where("target = 42").withColumn("object_id", F.col("object_id") + 1000000))


@query(f"WITH {OBS_SQL} SELECT filter, (CASE filter WHEN 'lsstu' THEN 0 WHEN 'lsstg' THEN 1 WHEN 'lsstr' THEN 2 WHEN 'lssti' THEN 3 ELSE 4 END)::INT AS ordinal FROM obs WHERE flux > 200 GROUP BY filter")
def filters_ordered_intersection(spark, sf_dir):
    return U.ordered_filters(observations(spark, sf_dir).where("flux > 200"), passbands(spark))


@query(f"WITH {OBJ_SQL} SELECT object_id FROM objs ORDER BY md5('7:' || object_id::VARCHAR), object_id LIMIT 10")
def random_subset_hash(spark, sf_dir):
    return U.random_subset(objects(spark, sf_dir), 10, 7).select("object_id")


@query(f"WITH {OBJ_SQL} SELECT object_id, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('5:' || object_id::VARCHAR), object_id) AS r FROM objs) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM objs GROUP BY target))")
def class_balance_rownumber(spark, sf_dir):
    return U.balanced(objects(spark, sf_dir), 5).select("object_id", "target")


@query(f"""WITH {OBJ_SQL}, few AS (SELECT * FROM objs WHERE target <> 90 OR ddf), sizes AS (SELECT target, count(*) AS n FROM few GROUP BY target),
needs AS (SELECT target, n, greatest((2 * (SELECT sum(n) FROM sizes)) // (SELECT count(*) FROM sizes) - n, 0)::BIGINT AS need FROM sizes),
ranked AS (SELECT object_id, target, n, need, row_number() OVER (PARTITION BY target ORDER BY md5('3:' || object_id::VARCHAR), object_id) AS r FROM few JOIN needs USING (target))
SELECT object_id, target, (need // n + CASE WHEN r <= need % n THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM ranked""")
def augment_quota(spark, sf_dir):
    return U.augmentation_quota(objects(spark, sf_dir).where("target <> 90 OR ddf"), 3)


# --- cleaning ---------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS_SQL} SELECT object_id, event_id, round(mjd - min(mjd) OVER (PARTITION BY object_id), 6) AS mjd, filter FROM obs")
def rezero_mjd(spark, sf_dir):
    return _shown(P.rezero(observations(spark, sf_dir)))


@query(f"WITH {OBS_SQL} SELECT object_id, event_id, round(mjd, 6) AS mjd, filter FROM obs WHERE mjd > 5 AND mjd < 20")
def time_window_select(spark, sf_dir):
    return _shown(P.select_window(observations(spark, sf_dir), 5, 20))


@query(f"""WITH {OBS_SQL}, m AS (SELECT *, count(*) FILTER (detected) OVER w AS n, min(mjd) FILTER (detected) OVER w AS a, max(mjd) FILTER (detected) OVER w AS b FROM obs WINDOW w AS (PARTITION BY object_id)),
k AS (SELECT * FROM m WHERE n < 2 OR (mjd > a - 2 AND mjd < b + 2)) SELECT object_id, event_id, round(mjd - min(mjd) OVER (PARTITION BY object_id), 6) AS mjd, filter FROM k""")
def select_transients(spark, sf_dir):
    return _shown(P.select_transients(observations(spark, sf_dir), 2.0))


def _gap_sql(source: str, name: str, g: float) -> str:
    return f"""{name}_a AS (SELECT *, lead(mjd) OVER (PARTITION BY object_id ORDER BY mjd, event_id) - mjd AS gap FROM {source}),
{name}_b AS (SELECT *, max(gap) OVER (PARTITION BY object_id) AS most, min(CASE WHEN gap >= {g} THEN mjd END) OVER (PARTITION BY object_id) AS cut FROM {name}_a),
{name}_c AS (SELECT *, count(*) FILTER (mjd <= cut AND detected) OVER w AS db, count(*) FILTER (mjd > cut AND detected) OVER w AS da, count(*) FILTER (mjd <= cut) OVER w AS nb, count(*) FILTER (mjd > cut) OVER w AS na FROM {name}_b WINDOW w AS (PARTITION BY object_id)),
{name}_d AS (SELECT * FROM {name}_c WHERE coalesce(most <= {g}, true) OR ((mjd <= cut) = (db > da OR (db = da AND nb >= na)))),
{name} AS (SELECT event_id, object_id, mjd - min(mjd) OVER (PARTITION BY object_id) AS mjd, filter, flux, flux_error, detected FROM {name}_d)"""


@query(f"WITH {OBS_SQL}, {_gap_sql('obs', 'g1', 1.5)} SELECT object_id, event_id, round(mjd, 6) AS mjd, filter FROM g1")
def remove_gaps_once(spark, sf_dir):
    return _shown(P.remove_gap(observations(spark, sf_dir), 1.5))


_FIVE = (2.0, 2.0, 1.0, 1.0, 1.0)
_FIVE_SQL = ", ".join(_gap_sql("obs" if i == 0 else f"g{i}", f"g{i + 1}", g) for i, g in enumerate(_FIVE))


@query(f"WITH {OBS_SQL}, {_FIVE_SQL} SELECT object_id, event_id, round(mjd, 6) AS mjd, filter FROM g5")
def remove_gaps_5x(spark, sf_dir):
    return _shown(P.remove_gaps(observations(spark, sf_dir), _FIVE))


@query(f"WITH {OBS_SQL} SELECT bool_and(mjd BETWEEN 0 AND 30) AS in_range FROM obs")
def range_check_all(spark, sf_dir):
    return P.in_time_range(observations(spark, sf_dir), 0, 30)


# --- statistics -------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS_SQL} SELECT round(max(l), 6) AS max_length FROM (SELECT max(mjd) - min(mjd) AS l FROM obs GROUP BY object_id)")
def max_length(spark, sf_dir):
    return S.longest(observations(spark, sf_dir)).select(r6("max_length"))


@query(f"WITH {OBJ_SQL} SELECT target, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM objs GROUP BY target")
def class_counts_pct(spark, sf_dir):
    return S.class_counts(objects(spark, sf_dir)).select("target", "n", r6("percent"))


@query(f"WITH {OBS_SQL} SELECT object_id, round(max(mjd) - min(mjd), 6) AS length FROM obs GROUP BY object_id")
def lc_length(spark, sf_dir):
    return S.lengths(observations(spark, sf_dir)).select("object_id", r6("length"))


_GAPS = "gaps AS (SELECT object_id, mjd - lag(mjd) OVER (PARTITION BY object_id ORDER BY mjd, event_id) AS gap FROM obs)"


@query(f"WITH {OBS_SQL}, {_GAPS} SELECT object_id, round(median(CASE WHEN gap >= 0.5 THEN gap END), 6) AS median_gap FROM gaps GROUP BY object_id")
def median_internight_gap(spark, sf_dir):
    return S.median_night_gap(observations(spark, sf_dir)).select("object_id", r6("median_gap"))


@query(f"WITH {OBS_SQL}, {_GAPS} SELECT object_id, round(max(gap), 6) AS max_gap, CASE WHEN max(gap) IS NOT NULL THEN count(*) FILTER (gap > 1.0) END AS n_gaps FROM gaps GROUP BY object_id")
def max_and_threshold_gaps(spark, sf_dir):
    return S.gap_counts(observations(spark, sf_dir), 1.0).select("object_id", r6("max_gap"), "n_gaps")


@query(f"""WITH {OBS_SQL}, {OBJ_SQL}, p AS (SELECT object_id, mjd AS peak FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY flux DESC, mjd) AS r FROM obs) WHERE r = 1),
t AS (SELECT object_id, mjd - peak AS s, (mjd - peak) / (1 + CASE WHEN hostgal_specz >= 0 THEN hostgal_specz ELSE hostgal_photoz END) AS o FROM obs JOIN p USING (object_id) JOIN objs USING (object_id))
SELECT object_id, count(*) FILTER (s >= -10 AND s < 0) AS n_before, count(*) FILTER (s >= 0 AND s < 10) AS n_after, count(*) FILTER (o >= -10 AND o < 0) AS n_before_rest, count(*) FILTER (o >= 0 AND o < 10) AS n_after_rest FROM t GROUP BY object_id""")
def n_obs_around_peak(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return S.counts_around_peak(obs, S.peak_times(obs), objects(spark, sf_dir))


@query(f"WITH {OBS_SQL} SELECT object_id, round(mjd, 6) AS peak_mjd FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY flux DESC, mjd) AS r FROM obs) WHERE r = 1")
def t_peak_argmax(spark, sf_dir):
    return S.peak_times(observations(spark, sf_dir)).select("object_id", r6("peak_mjd"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT object_id, filter, median(flux) AS m FROM obs GROUP BY ALL), d AS (SELECT *, abs(flux - m) AS d FROM obs JOIN m USING (object_id, filter)),
s AS (SELECT object_id, filter, median(d) AS s FROM d GROUP BY ALL), u AS (SELECT *, (flux - m) / nullif(6 * s, 0) AS u FROM d JOIN s USING (object_id, filter)),
w AS (SELECT *, CASE WHEN s > 0 THEN CASE WHEN abs(u) < 1 THEN power(1 - u * u, 2) ELSE 0 END ELSE (d = 0)::INT END::DOUBLE AS w FROM u)
SELECT object_id, filter, round(any_value(m) + sum(w * (flux - m)) / sum(w), 6) AS background FROM w GROUP BY ALL""")
def background_biweight(spark, sf_dir):
    return S.biweight_step(observations(spark, sf_dir)).select("object_id", "filter", r6("background"))


@query(f"WITH {OBS_SQL}, {OBJ_SQL} SELECT count(*) AS n_invalid FROM objs WHERE object_id NOT IN (SELECT object_id FROM obs WHERE flux > 300)")
def invalid_object_count(spark, sf_dir):
    return S.invalid_count(objects(spark, sf_dir), observations(spark, sf_dir).where("flux > 300"))


@query(f"WITH {OBS_SQL} SELECT DISTINCT filter FROM obs")
def distinct_filters(spark, sf_dir):
    return S.distinct_values(observations(spark, sf_dir), "filter")


@query(f"""WITH {OBS_SQL}, {OBJ_SQL}, {_gap_sql('obs', 'g1', 1.5)}, s AS (SELECT object_id, round(max(mjd) - min(mjd), 6) AS length, count(*) AS n_obs, count(*) FILTER (detected) AS n_detected, max(flux) FILTER (filter = 'lsstr') AS max_flux_lsstr, max(flux) FILTER (filter = 'lsstz') AS max_flux_lsstz FROM g1 GROUP BY object_id)
SELECT * FROM s JOIN (SELECT object_id, target, ddf FROM objs) USING (object_id)""")
def clean_and_summarise(spark, sf_dir):
    """The flagship: clean light curves, summarise them and join the objects."""
    obs = P.remove_gap(observations(spark, sf_dir), 1.5)
    band = lambda b: F.max(F.when(F.col("filter") == b, F.col("flux"))).alias(f"max_flux_{b}")
    found = obs.groupBy("object_id").agg(F.round(F.max("mjd") - F.min("mjd"), 6).alias("length"), F.count("*").alias("n_obs"), F.count_if("detected").alias("n_detected"), band("lsstr"), band("lsstz"))
    return found.join(objects(spark, sf_dir).select("object_id", "target", "ddf"), "object_id")


@query(f"""WITH {OBJ_SQL}, placed AS MATERIALIZED (SELECT object_id, target, row_number() OVER (ORDER BY object_id) - 1 AS slot FROM objs),
draws AS MATERIALIZED (SELECT j AS draw, ('0x' || substr(md5('7:' || j), 1, 15))::BIGINT % (SELECT count(*) FROM objs) AS slot FROM range(0, (SELECT 2 * count(*) FROM objs)) r(j))
SELECT draw, row_number() OVER (PARTITION BY slot ORDER BY draw) - 1 AS copy, object_id, target FROM draws JOIN placed USING (slot)""")
def sample_with_replacement(spark, sf_dir):
    """Twice as many draws as there are objects."""
    rows = objects(spark, sf_dir).select("object_id", "target")
    return U.sample_with_replacement(rows, 2 * rows.count(), 7).select("draw", F.col("copy").cast("long").alias("copy"), "object_id", "target")
