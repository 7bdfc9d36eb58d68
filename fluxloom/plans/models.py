"""Queries over models, features, metrics and the deterministic parts of augmentation and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions import curves as C
from fluxloom.operators import chisq as X
from fluxloom.operators import classify as K
from fluxloom.operators import features as T
from fluxloom.operators import metrics as M
from fluxloom.operators import stats as S
from fluxloom.operators import subset as U
from fluxloom.plans.registry import query, r6
from fluxloom.runtime import table
from fluxloom.sources.fixtures import GRID_SQL, OBJ_SQL, OBS_SQL, grid_models, objects, observations

BANDS = ("lsstu", "lsstg", "lsstr", "lssti", "lsstz")

# --- chi-square -------------------------------------------------------------------------------------------------------

_ON_MODEL = f"""{OBS_SQL}, {GRID_SQL}, fitted AS MATERIALIZED (SELECT o.*, a.flux + (b.flux - a.flux) * (o.mjd - a.mjd) / (b.mjd - a.mjd) AS model_flux
  FROM obs o JOIN grid a ON a.object_id = o.object_id AND a.filter = o.filter AND a.grid_ix = least(floor(o.mjd)::INT, 30)
  JOIN grid b ON b.object_id = o.object_id AND b.filter = o.filter AND b.grid_ix = a.grid_ix + 1)"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.on_model_linear(observations(spark, sf_dir), grid_models(spark, sf_dir))


@query(f"WITH {_ON_MODEL} SELECT object_id, event_id, round(model_flux, 6) AS model_flux FROM fitted")
def chisq_linear_interp(spark, sf_dir):
    return _fitted(spark, sf_dir).select("object_id", "event_id", r6("model_flux"))


_CHISQ = "c AS (SELECT object_id, sum(power((flux - model_flux) / flux_error, 2)) AS chisq, count(*) AS n_points FROM fitted GROUP BY object_id)"


@query(f"WITH {_ON_MODEL}, {_CHISQ} SELECT object_id, round(chisq, 4) AS chisq, n_points, round(chisq / n_points, 5) AS chisq_over_pts FROM c")
def chisq_per_object_over_pts(spark, sf_dir):
    return X.chisq(_fitted(spark, sf_dir), ["object_id"]).select("object_id", r6("chisq", 4), "n_points", r6("chisq_over_pts", 5))


@query(f"WITH {_ON_MODEL} SELECT object_id, filter, round(sum(power((flux - model_flux) / flux_error, 2)) / nullif(count(*) - 1, 0), 5) AS reduced FROM fitted GROUP BY ALL")
def chisq_reduced_per_band(spark, sf_dir):
    found = X.chisq(_fitted(spark, sf_dir), ["object_id", "filter"])
    return found.select("object_id", "filter", r6(F.col("chisq") / F.nullif(F.col("n_points") - 1, F.lit(0)), 5).alias("reduced"))


@query(f"WITH {_ON_MODEL}, {_CHISQ}, {OBJ_SQL} SELECT target, round(min(chisq / n_points), 4) AS least, round(max(chisq / n_points), 4) AS greatest, round(avg(chisq / n_points), 4) AS mean, count(*) AS n_objects FROM c JOIN objs USING (object_id) GROUP BY target")
def chisq_per_label_summary(spark, sf_dir):
    found = X.chisq_per_label(X.chisq(_fitted(spark, sf_dir), ["object_id"]), objects(spark, sf_dir))
    return found.select("target", r6("least", 4), r6("greatest", 4), r6("mean", 4), "n_objects")


@query(f"WITH {_ON_MODEL}, {_CHISQ} SELECT least(floor((log10(chisq / n_points) - 0) / (5 - 0) * 49), 48)::INT AS bin, count(*) AS n FROM c WHERE chisq / n_points BETWEEN 1 AND 100000 GROUP BY bin")
def chisq_log_hist(spark, sf_dir):
    return X.log_histogram(X.chisq(_fitted(spark, sf_dir), ["object_id"]), "chisq_over_pts", 1, 100000)


@query(f"""WITH {_ON_MODEL}, k AS (SELECT object_id, filter, sum(power((flux - model_flux) / flux_error, 2)) / count(*) AS x FROM fitted GROUP BY ALL)
SELECT object_id, filter AS best FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY x, filter) AS r FROM k) WHERE r = 1""")
def best_kernel_min_by(spark, sf_dir):
    """The candidate with the least chi-square, here the passband."""
    found = X.chisq(_fitted(spark, sf_dir), ["object_id", "filter"])
    return found.groupBy("object_id").agg(F.min_by("filter", F.struct("chisq_over_pts", "filter")).alias("best"))


# --- parametric models ------------------------------------------------------------------------------------------------

_NEWLING_AT = {"logA": 4.0, "phi": 5.0, "logsigma": 1.0, "logk": 0.5, "logpsi": 1.0}
_KARPENKA_AT = {"logA": 4.0, "logB": -6.0, "t0": 8.0, "t1": 10.0, "T_rise": 2.0, "T_fall": 12.0}
_N = "(SELECT *, exp(4.0::DOUBLE) AS a, exp(0.5::DOUBLE) AS k, exp(1.0::DOUBLE) AS s, exp(1.0::DOUBLE) AS psi, 5.0::DOUBLE AS phi FROM {})"


def _newling_sql(source: str, t: str) -> str:
    u = f"(({t} - phi) / (k * s))"
    tail = f"CASE WHEN {t} <= k * s + phi THEN psi * {u} * {u} * (3 - 2 * {u}) ELSE psi END"
    pulse = f"a * exp(k * ln(({t} - phi) / s) - ({t} - phi) / s - k * ln(k) + k)"
    return f"CASE WHEN {t} > phi THEN {pulse} + {tail} ELSE 0 END"


@query(f"WITH {OBS_SQL} SELECT object_id, event_id, round({_newling_sql('obs', 'mjd')}, 6) AS model FROM {_N.format('obs')}")
def newling_evaluate(spark, sf_dir):
    p = {k: F.lit(v) for k, v in _NEWLING_AT.items()}
    return observations(spark, sf_dir).select("object_id", "event_id", r6(C.newling(F.col("mjd"), p)).alias("model"))


@query(f"WITH {OBS_SQL} SELECT object_id, event_id, round(exp(4.0::DOUBLE) * (1 + exp(-6.0::DOUBLE) * (mjd - 10) * (mjd - 10)) * exp(-(mjd - 8) / 12.0::DOUBLE) / (1 + exp(-(mjd - 8) / 2.0::DOUBLE)), 6) AS model FROM obs")
def karpenka_evaluate(spark, sf_dir):
    p = {k: F.lit(v) for k, v in _KARPENKA_AT.items()}
    return observations(spark, sf_dir).select("object_id", "event_id", r6(C.karpenka(F.col("mjd"), p)).alias("model"))


@query(f"""WITH {OBS_SQL}, spans AS (SELECT object_id, filter, max(mjd) - min(mjd) AS l FROM obs GROUP BY ALL), pts AS (SELECT object_id, filter, i AS grid_ix, i * l / 99.0::DOUBLE AS t FROM spans, range(0, 100) r(i))
SELECT object_id, filter, grid_ix::INT AS grid_ix, round(t, 6) AS mjd, round({_newling_sql('pts', 't')}, 6) AS flux FROM {_N.format('pts')}""")
def parametric_reconstruct_grid(spark, sf_dir):
    from fluxloom.operators.fit import reconstruct

    p = {k: F.lit(v) for k, v in _NEWLING_AT.items()}
    return reconstruct(observations(spark, sf_dir), "newling", p).select("object_id", "filter", "grid_ix", r6("mjd"), r6("flux"))


# --- features ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {OBS_SQL}, s AS (SELECT *, flux / flux_error AS s FROM obs) SELECT object_id, {', '.join(f'count(*) FILTER (s {"<" if t < 0 else ">"} {t}) AS "count_s2n_{t}"' for t in (-20, -10, -5, -3, 3, 5, 10, 20))}, round(count(*) FILTER (abs(s) < 3) / count(*)::DOUBLE, 6) AS frac_background,
{', '.join(f'round(CASE WHEN count(*) FILTER (abs(s) > {t}) < 2 THEN -1 ELSE max(mjd) FILTER (abs(s) > {t}) - min(mjd) FILTER (abs(s) > {t}) END, 6) AS time_width_s2n_{t}' for t in (5, 10, 20))} FROM s GROUP BY object_id""")
def s2n_features(spark, sf_dir):
    obs = observations(spark, sf_dir)
    found = T.observed_features(obs, S.peak_times(obs).withColumnRenamed("peak_mjd", "max_time"))
    return found.select("object_id", *[f"`count_s2n_{t}`" for t in (-20, -10, -5, -3, 3, 5, 10, 20)], r6("frac_background"), *[r6(f"time_width_s2n_{t}") for t in (5, 10, 20)])


_PEAK = "p AS (SELECT object_id, mjd AS peak FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY flux DESC, mjd) AS r FROM obs) WHERE r = 1)"


@query(f"WITH {OBS_SQL}, {_PEAK}, d AS (SELECT object_id, mjd - peak AS d FROM obs JOIN p USING (object_id)) SELECT object_id, {', '.join(f'count(*) FILTER (d > {a} AND d < {b}) AS count_max_{n}' for a, b, n in T.TIME_BINS)} FROM d GROUP BY object_id")
def time_bins_21(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return T.observed_features(obs, S.peak_times(obs).withColumnRenamed("peak_mjd", "max_time")).select("object_id", *[f"count_max_{n}" for _, _, n in T.TIME_BINS])


def _bands(spark, sf_dir):
    return T.band_features(T.pack_models(grid_models(spark, sf_dir)))


@query(f"WITH {GRID_SQL} SELECT object_id, filter, {', '.join(f'round(quantile_cont(flux, {p / 100}), 6) AS percentile_{p}' for p in (10, 30, 50, 70, 90))} FROM grid GROUP BY ALL")
def percentiles_per_band(spark, sf_dir):
    return _bands(spark, sf_dir).select("object_id", "filter", *[r6(f"percentile_{p}") for p in (10, 30, 50, 70, 90)])


@query(f"WITH {GRID_SQL}, g AS (SELECT object_id, filter, mjd, flux - 50 AS flux FROM grid) SELECT object_id, filter, max(flux) AS max_flux, min(flux) AS min_flux, round(sum(greatest(flux, 0)) / nullif(max(flux), 0), 6) AS positive_width, round(sum(least(flux, 0)) / nullif(min(flux), 0), 6) AS negative_width, round(sqrt(sum(flux * flux)), 6) AS total_s2n FROM g GROUP BY ALL")
def pos_neg_width(spark, sf_dir):
    shifted = grid_models(spark, sf_dir).withColumn("flux", F.col("flux") - 50)
    return T.band_features(T.pack_models(shifted)).select("object_id", "filter", "max_flux", "min_flux", r6("positive_width"), r6("negative_width"), r6("total_s2n"))


@query(f"WITH {GRID_SQL}, d AS (SELECT object_id, filter, abs(flux - lag(flux) OVER (PARTITION BY object_id, filter ORDER BY mjd)) AS d FROM grid) SELECT object_id, filter, round(sum(d), 6) AS abs_diff FROM d GROUP BY ALL")
def abs_diff(spark, sf_dir):
    return _bands(spark, sf_dir).select("object_id", "filter", r6("abs_diff"))


_TOP = "t AS (SELECT object_id, filter, max(flux) AS m, arg_max(grid_ix, struct_pack(f := flux, g := -grid_ix)) AS ix FROM grid GROUP BY ALL)"


@query(f"""WITH {GRID_SQL}, {_TOP} SELECT object_id, filter, {', '.join(f'min(grid_ix - ix) FILTER (grid_ix > ix AND flux < m * {f})::DOUBLE AS "time_fwd_max_{str(f).replace('.', '_')}", min(ix - grid_ix) FILTER (grid_ix < ix AND flux < m * {f})::DOUBLE AS "time_bwd_max_{str(f).replace('.', '_')}"' for f in (0.8, 0.5, 0.2))} FROM grid JOIN t USING (object_id, filter) GROUP BY ALL""")
def time_to_fraction(spark, sf_dir):
    return _bands(spark, sf_dir).select("object_id", "filter", *[f"time_{w}_max_0_{f}" for f in (8, 5, 2) for w in ("fwd", "bwd")])


@query(f"""WITH {GRID_SQL}, n AS (SELECT *, lag(flux) OVER w AS a, lead(flux) OVER w AS b, max(abs(flux)) OVER (PARTITION BY object_id, filter) / 5 AS h FROM grid WINDOW w AS (PARTITION BY object_id, filter ORDER BY grid_ix)),
k AS (SELECT object_id, filter, flux, row_number() OVER (PARTITION BY object_id, filter ORDER BY flux DESC) AS r FROM n WHERE flux > a AND flux > b AND flux >= h),
q AS (SELECT object_id, filter, count(*) AS c, max(flux) FILTER (r = 1) AS p1, max(flux) FILTER (r = 2) AS p2, max(flux) FILTER (r = 3) AS p3 FROM k GROUP BY ALL)
SELECT object_id, filter, coalesce(c, 0)::INT AS peaks_pos_count, round(p2 / p1, 6) AS peaks_pos_frac_2, round(p3 / p1, 6) AS peaks_pos_frac_3 FROM (SELECT DISTINCT object_id, filter FROM grid) LEFT JOIN q USING (object_id, filter)""")
def peaks_top3(spark, sf_dir):
    return _bands(spark, sf_dir).select("object_id", "filter", "peaks_pos_count", r6("peaks_pos_frac_2"), r6("peaks_pos_frac_3"))


@query(f"""WITH {OBS_SQL}, {GRID_SQL}, {OBJ_SQL}, {_TOP}, mt AS (SELECT object_id, median(ix)::DOUBLE AS max_time FROM t GROUP BY object_id),
b AS (SELECT object_id, filter, max(flux) AS mx, min(flux) AS mn, sum(flux * flux) AS s2, quantile_cont(flux, 0.1) AS p10, quantile_cont(flux, 0.5) AS p50 FROM grid GROUP BY ALL),
w AS (SELECT object_id, max(mx) FILTER (filter = 'lssti') AS mi, max(mn) FILTER (filter = 'lssti') AS ni, max(mx) FILTER (filter = 'lsstz') AS mz, max(mx) FILTER (filter = 'lsstg') AS mg, sqrt(sum(s2)) AS total_s2n, median((p10 - mn) / (mx - mn)) - median((p50 - mn) / (mx - mn)) AS d FROM b GROUP BY object_id),
o AS (SELECT object_id, count(*) AS n, count(*) FILTER (flux / flux_error > 5) AS c5, count(*) FILTER (mjd - max_time > -5 AND mjd - max_time < 5) AS cc, count(*) FILTER (mjd - max_time > -20 AND mjd - max_time < -5) AS r20 FROM obs JOIN mt USING (object_id) GROUP BY object_id)
SELECT object_id, round(hostgal_photoz, 6) AS host_photoz, round(-2.5 * log10(abs(mi)), 6) AS max_mag, round(mi / (mi - ni), 6) AS pos_flux_ratio, round(mz / (mz + mi), 6) AS max_flux_ratio_red, round(mg / (mg + mi), 6) AS max_flux_ratio_blue, round(c5 / n::DOUBLE, 6) AS frac_s2n_5, cc::DOUBLE AS count_max_center, (cc + r20)::DOUBLE AS count_max_rise_20, round(total_s2n, 6) AS total_s2n, round(d, 6) AS percentile_diff_10_50
FROM w JOIN o USING (object_id) JOIN objs USING (object_id)""")
def classification_features(spark, sf_dir):
    raw = T.raw_features(observations(spark, sf_dir), grid_models(spark, sf_dir), objects(spark, sf_dir), BANDS)
    found = T.classification_features(raw, BANDS, red="lsstz")
    names = ("host_photoz", "max_mag", "pos_flux_ratio", "max_flux_ratio_red", "max_flux_ratio_blue", "frac_s2n_5", "total_s2n", "percentile_diff_10_50")
    return found.select("object_id", *[r6(n) for n in names], "count_max_center", "count_max_rise_20")


def _classification_sql() -> str:
    """All columns by name, from one row per band (b), the peaks (k), the times to a fraction (f) and the observations (o)."""
    of = lambda name, band: f"max({name}) FILTER (filter = '{band}')"
    wide = {"mi": of("mx", "lssti"), "ni": of("mn", "lssti"), "mr": of("mx", "lsstz"), "nr": of("mn", "lsstz"), "mb": of("mx", "lsstg"), "nb": of("mn", "lsstg"), "xr": of("ix", "lsstz"), "xb": of("ix", "lsstg"), "pw": of("pw", "lssti"), "nw": of("nw", "lssti"), "s2n": "sqrt(sum(s2))", "second": "median(second)"}
    times = [(way, share) for way in ("fwd", "bwd") for share in ("0_5", "0_2")]
    for way, share in times:
        for side, band in (("i", "lssti"), ("r", "lsstz"), ("b", "lsstg")):
            wide[f"{way}_{share}_{side}"] = of(f"{way}_{share}", band)
    wide |= {f"d{p}": f"median((p{p} - mn) / nullif(mx - mn, 0)) - median((p50 - mn) / nullif(mx - mn, 0))" for p in (10, 30, 70, 90)}
    out = {"host_photoz": "hostgal_photoz", "host_photoz_error": "hostgal_photoz_err", "length_scale": "NULL::DOUBLE", "max_mag": "-2.5 * log10(nullif(abs(mi), 0))", "pos_flux_ratio": "mi / nullif(mi - ni, 0)"}
    for side, i in (("max", "m"), ("min", "n")):
        for colour in ("red", "blue"):
            out[f"{side}_flux_ratio_{colour}"] = f"abs({i}{colour[0]}) / nullif(abs({i}{colour[0]}) + abs({i}i), 0)"
    out |= {"max_dt": "xr - xb", "positive_width": "pw", "negative_width": "nw"}
    for way, share in times:
        name = f"{way}_{share}"
        out[f"time_{way}_max_{share}"] = f"{name}_i"
        for colour in ("red", "blue"):
            out[f"time_{way}_max_{share}_ratio_{colour}"] = f"{name}_{colour[0]} / nullif({name}_{colour[0]} + {name}_i, 0)"
    out |= {"frac_s2n_5": "c5 / n", "frac_s2n_-5": "cm5 / n", "frac_background": "c3 / n", "time_width_s2n_5": "tw", "count_max_center": "cc"}
    for way in ("rise", "fall"):
        total = "cc"
        for edge in (20, 50, 100):
            total += f" + {way}_{edge}"
            out[f"count_max_{way}_{edge}"] = total
    out |= {"peak_frac_2": "second", "total_s2n": "s2n"} | {f"percentile_diff_{p}_50": f"d{p}" for p in (10, 30, 70, 90)}
    bins = ", ".join(f"count(*) FILTER (d > {a} AND d < {b})::DOUBLE AS {'cc' if n == 'center' else n}" for a, b, n in T.TIME_BINS if n == "center" or n.split("_")[0] in ("rise", "fall") and n.split("_")[1] in ("20", "50", "100"))
    near = ", ".join(f"min({'grid_ix - ix' if w == 'fwd' else 'ix - grid_ix'}) FILTER (grid_ix {'>' if w == 'fwd' else '<'} ix AND flux < m * {s.replace('_', '.')})::DOUBLE AS {w}_{s}" for w, s in times)
    return f"""WITH {OBS_SQL}, {GRID_SQL}, {OBJ_SQL}, {_TOP.replace('t AS (', 't AS MATERIALIZED (', 1)}, mt AS MATERIALIZED (SELECT object_id, median(ix)::DOUBLE AS max_time FROM t GROUP BY object_id),
b AS MATERIALIZED (SELECT object_id, filter, max(flux) AS mx, min(flux) AS mn, sum(flux * flux) AS s2, sum(greatest(flux, 0)) / nullif(max(flux), 0) AS pw, sum(least(flux, 0)) / nullif(min(flux), 0) AS nw, {', '.join(f'quantile_cont(flux, {p / 100}) AS p{p}' for p in (10, 30, 50, 70, 90))} FROM grid GROUP BY ALL),
f AS MATERIALIZED (SELECT object_id, filter, any_value(ix)::DOUBLE AS ix, {near} FROM grid JOIN t USING (object_id, filter) GROUP BY ALL),
g AS MATERIALIZED (SELECT *, lag(flux) OVER w AS a, lead(flux) OVER w AS z, max(abs(flux)) OVER (PARTITION BY object_id, filter) / 5 AS h FROM grid WINDOW w AS (PARTITION BY object_id, filter ORDER BY grid_ix)),
k AS MATERIALIZED (SELECT object_id, filter, max(flux) FILTER (r = 2) / max(flux) FILTER (r = 1) AS second FROM (SELECT *, row_number() OVER (PARTITION BY object_id, filter ORDER BY flux DESC) AS r FROM g WHERE flux > a AND flux > z AND flux >= h) GROUP BY ALL),
w AS MATERIALIZED (SELECT object_id, {', '.join(f'{v} AS "{n}"' for n, v in wide.items())} FROM b JOIN f USING (object_id, filter) LEFT JOIN k USING (object_id, filter) GROUP BY object_id),
o AS MATERIALIZED (SELECT object_id, count(*)::DOUBLE AS n, count(*) FILTER (s > 5)::DOUBLE AS c5, count(*) FILTER (s < -5)::DOUBLE AS cm5, count(*) FILTER (abs(s) < 3)::DOUBLE AS c3, CASE WHEN count(*) FILTER (abs(s) > 5) < 2 THEN -1 ELSE max(mjd) FILTER (abs(s) > 5) - min(mjd) FILTER (abs(s) > 5) END AS tw, {bins}
  FROM (SELECT *, flux / flux_error AS s, mjd - max_time AS d FROM obs JOIN mt USING (object_id)) GROUP BY object_id)
SELECT object_id, {', '.join(f'round({v}, 9) AS "{n}"' for n, v in out.items())} FROM w JOIN o USING (object_id) JOIN objs USING (object_id)"""


@query(_classification_sql())
def classification_features_full(spark, sf_dir):
    """All 41 columns."""
    raw = T.raw_features(observations(spark, sf_dir), grid_models(spark, sf_dir), objects(spark, sf_dir), BANDS)
    found = T.classification_features(raw, BANDS, red="lsstz")
    return found.select("object_id", *[F.round(F.col(f"`{n}`"), 9).alias(n) for n in found.columns if n != "object_id"])


def _raw_sql() -> str:
    """All raw features by name: one row per band (b, f, k), the bins of the model (r) and the observations (o)."""
    low = "lower(filter)"
    bands = {"max_flux": "mx", "min_flux": "mn", "positive_width": "pw", "negative_width": "nw", "abs_diff": "ad", "total_s2n": "sqrt(s2)"} | {f"time_{w}_max_{s}": f"{w}_{s}" for w in ("fwd", "bwd") for s in ("0_8", "0_5", "0_2")}
    out = {f"{n}_{f}": f"round(max({v}) FILTER ({low} = '{f}'), 9)" for f in BANDS for n, v in bands.items()}
    out |= {f"percentile_{f}_{p}": f"round(max(p{p}) FILTER ({low} = '{f}'), 9)" for f in BANDS for p in (10, 30, 50, 70, 90)}
    out |= {f"max_dt_{f}": f"round(max(ix) FILTER ({low} = '{f}') - any_value(max_time), 9)" for f in BANDS}
    for f in BANDS:
        for sign, name in ((1, "pos"), (-1, "neg")):
            out[f"peaks_{name}_{f}_count"] = f"max(coalesce({name}_c, 0)) FILTER ({low} = '{f}')::INT"
            out |= {f"peaks_{name}_{f}_frac_{i}": f"round(max({name}_{i}) FILTER ({low} = '{f}'), 9)" for i in (2, 3)}
    near = ", ".join(f"min({'grid_ix - ix' if w == 'fwd' else 'ix - grid_ix'}) FILTER (grid_ix {'>' if w == 'fwd' else '<'} ix AND flux < m * {s.replace('_', '.')})::DOUBLE AS {w}_{s}" for w in ("fwd", "bwd") for s in ("0_8", "0_5", "0_2"))
    tops = ", ".join(f"max(c) FILTER (sign = {sign}) AS {name}_c, max(p2 / p1) FILTER (sign = {sign}) AS {name}_2, max(p3 / p1) FILTER (sign = {sign}) AS {name}_3" for sign, name in ((1, "pos"), (-1, "neg")))
    means = ", ".join(f'avg(rel) FILTER (d >= {a} AND d < {b}) AS "mean_max_{n}", stddev_pop(rel) FILTER (d >= {a} AND d < {b}) AS "std_max_{n}"' for a, b, n in T.TIME_BINS)
    counts = ", ".join(f'count(*) FILTER (s {"<" if t < 0 else ">"} {t}) AS "count_s2n_{t}"' for t in (-20, -10, -5, -3, 3, 5, 10, 20))
    widths = ", ".join(f'round(CASE WHEN count(*) FILTER (abs(s) > {t}) < 2 THEN -1 ELSE max(mjd) FILTER (abs(s) > {t}) - min(mjd) FILTER (abs(s) > {t}) END, 9) AS time_width_s2n_{t}' for t in (5, 10, 20))
    bins = ", ".join(f'count(*) FILTER (d > {a} AND d < {b}) AS "count_max_{n}"' for a, b, n in T.TIME_BINS)
    kept = ", ".join(f'CASE WHEN "count_max_{n}" > 0 THEN round("{w}_max_{n}", 9) END AS "{w}_max_{n}"' for _, _, n in T.TIME_BINS for w in ("mean", "std"))
    return f"""WITH {OBS_SQL}, {GRID_SQL}, {OBJ_SQL}, {_TOP.replace('t AS (', 't AS MATERIALIZED (', 1)}, mt AS MATERIALIZED (SELECT object_id, median(ix)::DOUBLE AS max_time FROM t GROUP BY object_id),
g AS MATERIALIZED (SELECT *, lag(flux) OVER w AS a, lead(flux) OVER w AS z, max(abs(flux)) OVER (PARTITION BY object_id, filter) / 5 AS h FROM grid WINDOW w AS (PARTITION BY object_id, filter ORDER BY grid_ix)),
b AS MATERIALIZED (SELECT object_id, filter, max(flux) AS mx, min(flux) AS mn, sum(flux * flux) AS s2, sum(abs(flux - a)) AS ad, sum(greatest(flux, 0)) / nullif(max(flux), 0) AS pw, sum(least(flux, 0)) / nullif(min(flux), 0) AS nw, {', '.join(f'quantile_cont(flux, {p / 100}) AS p{p}' for p in (10, 30, 50, 70, 90))} FROM g GROUP BY ALL),
f AS MATERIALIZED (SELECT object_id, filter, any_value(ix)::DOUBLE AS ix, {near} FROM grid JOIN t USING (object_id, filter) GROUP BY ALL),
j AS MATERIALIZED (SELECT object_id, filter, sign, sign * flux AS top, row_number() OVER (PARTITION BY object_id, filter, sign ORDER BY sign * flux DESC) AS r FROM g, (VALUES (1), (-1)) v(sign) WHERE sign * flux > sign * a AND sign * flux > sign * z AND sign * flux >= h),
q AS MATERIALIZED (SELECT object_id, filter, sign, count(*) AS c, max(top) FILTER (r = 1) AS p1, max(top) FILTER (r = 2) AS p2, max(top) FILTER (r = 3) AS p3 FROM j GROUP BY ALL),
k AS MATERIALIZED (SELECT object_id, filter, {tops} FROM q GROUP BY ALL),
w AS MATERIALIZED (SELECT object_id, {', '.join(f'{v} AS "{n}"' for n, v in out.items())} FROM b JOIN f USING (object_id, filter) JOIN mt USING (object_id) LEFT JOIN k USING (object_id, filter) GROUP BY object_id),
r AS MATERIALIZED (SELECT object_id, {means} FROM (SELECT object_id, flux / nullif(mx, 0) AS rel, mjd - max_time AS d FROM grid JOIN b USING (object_id, filter) JOIN mt USING (object_id)) GROUP BY object_id),
o AS MATERIALIZED (SELECT object_id, any_value(max_time) AS max_time, count(*) AS count, {counts}, round(count(*) FILTER (abs(s) < 3) / count(*)::DOUBLE, 9) AS frac_background, {widths}, {bins}
  FROM (SELECT *, flux / nullif(flux_error, 0) AS s, mjd - max_time AS d FROM obs JOIN mt USING (object_id)) GROUP BY object_id)
SELECT o.*, w.* EXCLUDE (object_id), {kept}, hostgal_specz AS host_specz, round(hostgal_photoz, 9) AS host_photoz, round(hostgal_photoz_err, 9) AS host_photoz_error, ddf
FROM o JOIN w USING (object_id) JOIN r USING (object_id) JOIN objs USING (object_id)"""


@query(_raw_sql())
def avocado_raw_full(spark, sf_dir):
    """All raw features."""
    found = T.raw_features(observations(spark, sf_dir), grid_models(spark, sf_dir), objects(spark, sf_dir), BANDS)
    return found.select(*[F.round(F.col(f"`{n}`"), 9).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in found.dtypes])


def _swt_sql(source: str, value: str, step: int) -> str:
    low, high = T.filters_of("sym2")
    part = lambda taps: " + ".join(f"({t!r})::DOUBLE * x{k}.{value}" for k, t in enumerate(taps))
    joins = " ".join(f"JOIN {source} x{k} ON x{k}.object_id = x0.object_id AND x{k}.filter = x0.filter AND x{k}.grid_ix = (x0.grid_ix + {k * step}) % 32" for k in (1, 2, 3))
    return f"SELECT x0.object_id, x0.filter, x0.grid_ix, {part(low)} AS ca, {part(high)} AS cd FROM {source} x0 {joins}"


def _coefficients(spark, sf_dir, level):
    packed = T.swt(T.pack_models(grid_models(spark, sf_dir)), "flux", level)
    found = T.coefficient_table(packed, level)
    return found.select("object_id", "filter", F.col("place").alias("grid_ix"), r6(f"cA_{level}").alias("ca"), r6(f"cD_{level}").alias("cd"))


@query(f"WITH {GRID_SQL}, l1 AS MATERIALIZED ({_swt_sql('grid', 'flux', 1)}) SELECT object_id, filter, grid_ix::INT AS grid_ix, round(ca, 6) AS ca, round(cd, 6) AS cd FROM l1")
def swt_level1_circular(spark, sf_dir):
    return _coefficients(spark, sf_dir, 1)


@query(f"WITH {GRID_SQL}, l1 AS MATERIALIZED ({_swt_sql('grid', 'flux', 1)}), l2 AS MATERIALIZED ({_swt_sql('l1', 'ca', 2)}) SELECT object_id, filter, grid_ix::INT AS grid_ix, round(ca, 6) AS ca, round(cd, 6) AS cd FROM l2")
def swt_level2_circular(spark, sf_dir):
    return _coefficients(spark, sf_dir, 2)


@query(f"WITH {GRID_SQL} SELECT object_id, filter, grid_ix::INT AS grid_ix, round(flux, 6) AS flux FROM grid")
def iswt_roundtrip(spark, sf_dir):
    """Five levels down and up again."""
    packed = T.pack_models(grid_models(spark, sf_dir))
    back = T.iswt(T.swt(packed, "flux", 5), 5, "again")
    return back.select("object_id", "filter", F.posexplode("again").alias("grid_ix", "flux")).select("object_id", "filter", "grid_ix", r6("flux"))


_LONG = "long AS (SELECT vec_id, label, unnest(range(0, 64))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query(f"WITH {_LONG}, m AS (SELECT i, avg(x) AS m FROM long GROUP BY i) SELECT i, round(any_value(m), 8) AS mean, round(sqrt(sum((x - m) * (x - m))), 6) AS scale FROM long JOIN m USING (i) GROUP BY i")
def feature_vector_means_scales(spark, sf_dir):
    from fluxloom.operators.pca import means_scales

    return means_scales(_vectors(spark, sf_dir), "features").select("i", r6("mean", 8), r6("scale"))


@query(f"WITH {_LONG}, p AS (SELECT row_number() OVER (ORDER BY v DESC, i) AS place, v FROM (SELECT i, var_pop(x) AS v FROM long GROUP BY i)) SELECT min(place) AS n_components FROM (SELECT place, sum(v) OVER (ORDER BY place) / sum(v) OVER () AS c FROM p) WHERE c >= 0.9 - 1e-12")
def explained_variance_cutoff(spark, sf_dir):
    """How many places of the vectors, the most varied first, hold nine tenths of the variance."""
    places = _vectors(spark, sf_dir).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("value"))
    return T.explained_components(places.select(F.row_number().over(W.orderBy(F.desc("value"), "i")).alias("place"), "value"), 0.9)  # a row a place


@query(f"WITH {_LONG}, m AS (SELECT i, avg(x) AS m FROM long GROUP BY i) SELECT vec_id, round(sum((x - m) * cos(i * 1.0::DOUBLE)), 6) AS c0, round(sum((x - m) * sin(i * 2.0::DOUBLE)), 6) AS c1 FROM long JOIN m USING (i) GROUP BY vec_id")
def project_to_fixed_basis(spark, sf_dir):
    import math

    from fluxloom.operators.pca import collected_means, project

    rows = _vectors(spark, sf_dir)
    basis = [[math.cos(i * 1.0) for i in range(64)], [math.sin(i * 2.0) for i in range(64)]]
    found = project(rows, "features", collected_means(rows, "features"), None, basis, "c")
    return found.select("vec_id", r6(F.col("c")[0]).alias("c0"), r6(F.col("c")[1]).alias("c1"))


# --- deterministic parts of augmentation --------------------------------------------------------------------------------

_W = (3685.0, 4802.0, 6231.0, 7542.0, 8690.0, 9736.0)
_ZL = """lims AS (SELECT object_id, hostgal_photoz AS z, greatest(1e-4::DOUBLE, (1 + hostgal_photoz) / (2 - 8690.0::DOUBLE / 9736.0::DOUBLE) - 1) AS lo, (1 + hostgal_photoz) / (2 - 4802.0::DOUBLE / 3685.0::DOUBLE) - 1 AS hi FROM objs),
u AS (SELECT *, ((object_id * 37) % 100 + 0.5) / 100.0::DOUBLE AS u FROM lims)"""


def _limits(spark, sf_dir):
    low, high = C.redshift_limits(F.col("hostgal_photoz"), _W)
    o = objects(spark, sf_dir).withColumns({"lo": low, "hi": high})
    return o.withColumn("u", ((F.col("object_id") * 37) % 100 + F.lit(0.5)) / F.lit(100.0))


@query(f"WITH {OBJ_SQL}, {_ZL} SELECT object_id, round(lo, 8) AS z_min, round(hi, 8) AS z_max_wfd, round(hi * 1.4, 8) AS z_max_ddf, round(-exp(ln(hi) - (ln(hi) - ln(lo)) * sqrt(1 - u)) + lo + hi, 6) AS z_new FROM u")
def redshift_limits_wfd_ddf(spark, sf_dir):
    z = C.log_triangular_redshift(F.col("u"), F.col("lo"), F.col("hi"))
    return _limits(spark, sf_dir).select("object_id", r6("lo", 8).alias("z_min"), r6("hi", 8).alias("z_max_wfd"), r6(F.col("hi") * 1.4, 8).alias("z_max_ddf"), r6(z).alias("z_new"))


@query(f"""WITH {OBJ_SQL}, {_ZL}, d AS (SELECT *, ln(lo) AS a, ln(hi) AS b, 0.2::DOUBLE / (ln(hi) - ln(lo)) AS r FROM u), e AS (SELECT *, 2 / (b - a) - r AS l FROM d)
SELECT object_id, round(a + (sqrt(l * l + 2 * ((r - l) / (b - a)) * u) - l) / ((r - l) / (b - a)), 6) AS x FROM e""")
def trapezoid_inverse_cdf(spark, sf_dir):
    low, high = F.ln("lo"), F.ln("hi")
    return _limits(spark, sf_dir).select("object_id", r6(C.trapezoid(F.col("u"), low, high, F.lit(0.2) / (high - low))).alias("x"))


@query(f"WITH {OBJ_SQL}, w(filter, l) AS (VALUES ('lsstu', 3685.0::DOUBLE), ('lsstg', 4802.0), ('lsstr', 6231.0), ('lssti', 7542.0), ('lsstz', 8690.0), ('lssty', 9736.0)) SELECT object_id, filter, round(l * (1 + hostgal_photoz) / (1 + hostgal_photoz + 0.1::DOUBLE), 6) AS wavelength FROM objs, w")
def wavelength_shift(spark, sf_dir):
    from fluxloom.schema import LSST, wavelength

    rows = objects(spark, sf_dir).withColumn("filter", F.explode(F.array(*[F.lit(f) for f in LSST])))
    z = F.col("hostgal_photoz")
    return rows.select("object_id", "filter", r6(C.shifted_wavelength(wavelength(F.col("filter")), z, z + 0.1)).alias("wavelength"))


@query(f"WITH {OBS_SQL}, {OBJ_SQL}, {_PEAK} SELECT object_id, event_id, round(peak + (mjd - peak) * (1 + hostgal_photoz + 0.2::DOUBLE) / (1 + hostgal_photoz), 6) AS mjd FROM obs JOIN p USING (object_id) JOIN objs USING (object_id)")
def time_stretch(spark, sf_dir):
    obs = observations(spark, sf_dir)
    rows = obs.join(S.peak_times(obs), "object_id").join(objects(spark, sf_dir), "object_id")
    z = F.col("hostgal_photoz")
    return rows.select("object_id", "event_id", r6(C.stretched_time(F.col("mjd"), F.col("peak_mjd"), z, z + 0.2)).alias("mjd"))


_ERF = "(1 - (t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE))))) * exp(-x * x))"


@query(f"WITH {OBS_SQL}, a AS (SELECT object_id, event_id, (flux / flux_error - 5.5) / 2 AS x FROM obs), b AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t FROM a) SELECT object_id, event_id, round((sign(x) * {_ERF} + 1) / 2, 6) AS p FROM b")
def detection_probability(spark, sf_dir):
    s = F.col("flux") / F.col("flux_error")
    return observations(spark, sf_dir).select("object_id", "event_id", r6(C.detection_probability(s)).alias("p"))


@query(f"""WITH {OBJ_SQL}, tries AS (SELECT object_id, i, hostgal_photoz, hostgal_photoz + (('0x' || substr(md5(object_id::VARCHAR || ':' || i::VARCHAR), 1, 6))::BIGINT / 16777216.0::DOUBLE - 0.7) AS z FROM objs, range(0, 100) r(i)),
good AS (SELECT object_id, min(i) AS i FROM tries WHERE z > 0 GROUP BY object_id) SELECT object_id, i::INT AS attempt, round(z, 6) AS photoz FROM tries JOIN good USING (object_id, i)""")
def photoz_first_positive(spark, sf_dir):
    """The first positive draw of up to a hundred."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("object_id").cast("string"), F.lit(":"), i.cast("string"))), 1, 6), 16, 10).cast("double") / 16777216.0
    tries = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(i.alias("i"), (F.col("hostgal_photoz") + (draw(i) - 0.7)).alias("z")))
    rows = objects(spark, sf_dir).withColumn("_g", F.get(F.filter(tries, lambda t: t["z"] > 0), F.lit(0))).where("_g IS NOT NULL")
    return rows.select("object_id", F.col("_g.i").alias("attempt"), r6(F.col("_g.z")).alias("photoz"))


# --- classification ---------------------------------------------------------------------------------------------------

_TRAIN = f"{_LONG}, train AS (SELECT * FROM long WHERE vec_id % 10 < 3), test AS (SELECT * FROM long WHERE vec_id % 10 >= 3)"


@query(f"""WITH {_TRAIN}, s AS (SELECT label, i, avg(x) AS m, var_pop(x) AS v FROM train GROUP BY ALL), e AS (SELECT 1e-9::DOUBLE * max(v) AS e FROM (SELECT i, var_pop(x) AS v FROM train GROUP BY i)),
pr AS (SELECT label, ln(count(DISTINCT vec_id)::DOUBLE / (SELECT count(DISTINCT vec_id) FROM train)) AS p FROM train GROUP BY label),
ll AS (SELECT vec_id, s.label, sum(-0.5 * ln(2 * pi() * (v + e)) - (x - m) * (x - m) / (2 * (v + e))) + any_value(p) AS l FROM test JOIN s USING (i) JOIN pr ON pr.label = s.label, e GROUP BY vec_id, s.label)
SELECT vec_id, label AS y_pred, round(l, 4) AS log_likelihood FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, label) AS r FROM ll) WHERE r = 1""")
def gaussian_nb_predict(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = K.fit_gaussian_nb(rows.where("vec_id % 10 < 3"))
    return K.predict_gaussian_nb(rows.where("vec_id % 10 >= 3"), model, "vec_id").select("vec_id", "y_pred", r6("log_likelihood", 4))


@query(f"""WITH {_TRAIN}, d AS (SELECT t.vec_id, r.vec_id AS other, any_value(r.label) AS label, sqrt(sum((t.x - r.x) * (t.x - r.x))) AS d FROM test t JOIN train r USING (i) GROUP BY t.vec_id, r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM d), v AS (SELECT vec_id, label, sum(1 / greatest(d, 1e-12)) AS w FROM k WHERE r <= 6 GROUP BY ALL)
SELECT vec_id, label AS y_pred, round(w / t, 6) AS probability FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) AS r FROM v) WHERE r = 1""")
def knn_distance_weighted(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = K.knn_predict(rows.where("vec_id % 10 < 3"), rows.where("vec_id % 10 >= 3"), 6, "vec_id")
    return found.select("vec_id", "y_pred", r6(F.array_max("probability")).alias("probability"))


@query(f"""WITH {_TRAIN.replace(' AS (', ' AS MATERIALIZED (')}, d AS MATERIALIZED (SELECT t.vec_id, any_value(t.label) AS label, r.vec_id AS other, any_value(r.label) AS voted, sqrt(sum((t.x - r.x) * (t.x - r.x))) AS d FROM test t JOIN train r USING (i) GROUP BY t.vec_id, r.vec_id),
k AS MATERIALIZED (SELECT *, 1 / greatest(d, 1e-12) AS w, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM d), v AS MATERIALIZED (SELECT vec_id, voted, sum(w) / any_value(t) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t FROM k WHERE r <= 6) GROUP BY vec_id, voted),
classes AS MATERIALIZED (SELECT DISTINCT label AS class FROM train), scored AS MATERIALIZED (SELECT c.class, coalesce(v.p, 0) AS p, d.label = c.class AS y FROM (SELECT DISTINCT vec_id, label FROM d) d JOIN classes c ON true LEFT JOIN v ON v.vec_id = d.vec_id AND v.voted = c.class),
th AS MATERIALIZED (SELECT unnest(range(0, 20))::INT AS t, unnest([{', '.join(f'{float(x)!r}::DOUBLE' for x in __import__('numpy').linspace(0, 1, 20))}]) AS threshold),
tl AS MATERIALIZED (SELECT class, t, threshold, count(*) FILTER (y AND p >= threshold) AS tp, count(*) FILTER (NOT y AND p >= threshold) AS fp, count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn FROM scored, th GROUP BY ALL)
SELECT class, t, round(threshold, 6) AS threshold, round(coalesce(fp / nullif(nn, 0)::DOUBLE, 0), 6) AS fpr, round(coalesce(tp / nullif(np, 0)::DOUBLE, 0), 6) AS tpr FROM tl""")
def roc_one_vs_rest(spark, sf_dir):
    """A curve of 20 thresholds for each class against the others, by the votes of the nearest rows."""
    rows = _vectors(spark, sf_dir)
    train, test = rows.where("vec_id % 10 < 3"), rows.where("vec_id % 10 >= 3")
    labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    told = K.knn_predict(train, test, 6, "vec_id").join(test.select("vec_id", "label"), "vec_id")
    each = told.select("label", F.posexplode("probability").alias("i", "probability"))
    each = each.select(F.get(F.array(*[F.lit(y) for y in labels]), F.col("i")).alias("class"), "probability", "label")
    curve = M.roc(each.select("class", "probability", (F.col("label") == F.col("class")).alias("positive")), 20, by=["class"])
    return curve.select("class", "t", r6("threshold"), r6("fpr"), r6("tpr"))


@query(f"WITH {_LONG}, s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i) SELECT vec_id, round(sum(abs((x - m) / s)), 5) AS l1, round(max((x - m) / s), 6) AS top FROM long JOIN s USING (i) GROUP BY vec_id")
def standardise_union(spark, sf_dir):
    rows = K.standardised(_vectors(spark, sf_dir))
    return rows.select("vec_id", r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("l1"), r6(F.array_max("features")).alias("top"))


@query(f"WITH {OBJ_SQL} SELECT object_id, target, ((row_number() OVER (PARTITION BY target ORDER BY md5('11:' || object_id::VARCHAR), object_id) - 1) % 5)::INT AS fold FROM objs")
def stratified_folds(spark, sf_dir):
    return U.stratified_folds(objects(spark, sf_dir), 5, 11).select("object_id", "target", "fold")


@query(f"""WITH {OBJ_SQL}, alls AS (SELECT object_id, target, NULL::BIGINT AS original_event FROM objs UNION ALL SELECT object_id + 1000000, target, object_id FROM objs WHERE ddf),
f AS (SELECT object_id AS o, ((row_number() OVER (PARTITION BY target ORDER BY md5('11:' || object_id::VARCHAR), object_id) - 1) % 5)::INT AS fold FROM objs) SELECT object_id, target, fold FROM alls JOIN f ON o = coalesce(original_event, object_id)""")
def grouped_folds_inherit(spark, sf_dir):
    o = objects(spark, sf_dir).select("object_id", "target", F.lit(None).cast("long").alias("original_event"))
    made = objects(spark, sf_dir).where("ddf").select((F.col("object_id") + 1000000).alias("object_id"), "target", F.col("object_id").alias("original_event"))
    return U.grouped_folds(o.unionByName(made), 5, 11).select("object_id", "target", "fold")


# --- metrics ----------------------------------------------------------------------------------------------------------

_SCORED = "scored AS (SELECT event_id, json_extract_string(props, '$.k')::INT / 100.0::DOUBLE AS p, event_type = 'purchase' AS y FROM events)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("probability"), (F.col("event_type") == "purchase").alias("positive"))


_LADDER = [i * (1 / 49) for i in range(50)]
_ROC = f"""{_SCORED}, th AS (SELECT unnest(range(0, 50))::INT AS t, unnest([{', '.join(f'{float(x)!r}::DOUBLE' for x in __import__('numpy').linspace(0, 1, 50))}]) AS threshold),
tl AS (SELECT t, threshold, count(*) FILTER (y AND p >= threshold) AS tp, count(*) FILTER (NOT y AND p >= threshold) AS fp, count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn FROM scored, th GROUP BY ALL),
curve AS (SELECT t, threshold, fp / nn::DOUBLE AS fpr, tp / np::DOUBLE AS tpr FROM tl)"""


@query(f"WITH {_ROC} SELECT t, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve")
def roc_50_thresholds(spark, sf_dir):
    return M.roc(_scored(spark, sf_dir)).select("t", r6("threshold"), r6("fpr"), r6("tpr"))


@query(f"WITH {_ROC} SELECT round(sum(a), 6) AS auc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY t DESC)) * (tpr + lag(tpr) OVER (ORDER BY t DESC)) / 2 AS a FROM curve)")
def auc_trapezoid(spark, sf_dir):
    return M.auc(M.roc(_scored(spark, sf_dir))).select(r6("auc"))


_F = f"""{_SCORED}, th AS (SELECT i AS t, i / 100.0::DOUBLE AS threshold FROM range(0, 100) r(i)),
tl AS (SELECT t, threshold, count(*) FILTER (y AND p > threshold)::DOUBLE AS tp, count(*) FILTER (NOT y AND p > threshold)::DOUBLE AS fp, count(*) FILTER (y AND p <= threshold)::DOUBLE AS fn FROM scored, th GROUP BY ALL)"""


@query(f"WITH {_F}, s AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM tl) SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM s ORDER BY s.f1 DESC, t LIMIT 1")
def best_f1(spark, sf_dir):
    return M.best_f1(_scored(spark, sf_dir)).select(r6("threshold"), r6("f1"))


@query(f"WITH {_F}, s AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE tp * tp / (tp + fn) / (tp + 3 * fp) END AS fom FROM tl) SELECT round(threshold, 6) AS threshold, round(fom, 6) AS fom FROM s ORDER BY s.fom DESC, t LIMIT 1")
def kessler_fom(spark, sf_dir):
    return M.figure_of_merit(_scored(spark, sf_dir)).select(r6("threshold"), r6("fom"))


_PRED = "pred AS (SELECT user_id, event_id, value, [42, 62, 90][(user_id % 3 + 1)::INT] AS y_true, [42, 62, 90][((user_id + (event_id % 7 = 0)::INT) % 3 + 1)::INT] AS y_pred, [0.2 + (event_id % 5) * 0.1, 0.3, 0.5 - (event_id % 5) * 0.1]::DOUBLE[] AS pr FROM events)"


def _pred(spark, sf_dir):
    pick = lambda i: F.element_at(F.array(F.lit(42), F.lit(62), F.lit(90)), i.cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", pick(u % 3 + 1).alias("y_true"), pick((u + (e % 7 == 0).cast("int")) % 3 + 1).alias("y_pred"), F.array(F.lit(0.2) + (e % 5) * 0.1, F.lit(0.3), F.lit(0.5) - (e % 5) * 0.1).alias("probability"))


@query(f"""WITH {_PRED}, c AS (SELECT y_true, list_transform(pr, lambda x: greatest(least(x, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) AS p FROM pred),
l AS (SELECT y_true, avg(ln(p[CASE y_true WHEN 42 THEN 1 WHEN 62 THEN 2 ELSE 3 END] / list_sum(p))) AS m FROM c GROUP BY y_true) SELECT round(-sum(m * (1 / 18.0::DOUBLE)) / sum(1 / 18.0::DOUBLE), 6) AS log_loss FROM l""")
def plasticc_logloss(spark, sf_dir):
    return M.weighted_log_loss(_pred(spark, sf_dir), [42, 62, 90]).select(r6("log_loss"))


@query(f"WITH {_PRED} SELECT y_true, y_pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y_true)::DOUBLE, 6) AS share FROM pred GROUP BY y_true, y_pred")
def confusion_normalised(spark, sf_dir):
    return M.confusion(_pred(spark, sf_dir), "true").select("y_true", "y_pred", "n", r6("share"))


_EDGE = (0.0, 10.0, 50.0, 100.0, 300.0)
_BIN = "CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 50 THEN 1 WHEN value >= 50 AND value < 100 THEN 2 WHEN value >= 100 AND value < 300 THEN 3 END::INT AS bin"


@query(f"WITH {_PRED} SELECT bin, y_true AS label, round(avg((y_true = y_pred)::INT), 6) AS recall, count(*) AS n FROM (SELECT *, {_BIN} FROM pred) WHERE bin IS NOT NULL GROUP BY bin, y_true")
def recall_by_bin(spark, sf_dir):
    return M.recall_by_bin(_pred(spark, sf_dir), "value", _EDGE).select("bin", "label", r6("recall"), "n")


@query(f"WITH {_PRED} SELECT bin, y_pred AS label, round(avg((y_true = y_pred)::INT), 6) AS precision, count(*) AS n FROM (SELECT *, {_BIN} FROM pred) WHERE bin IS NOT NULL GROUP BY bin, y_pred")
def precision_by_bin(spark, sf_dir):
    return M.precision_by_bin(_pred(spark, sf_dir), "value", _EDGE).select("bin", "label", r6("precision"), "n")


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def percentile_ci(spark, sf_dir):
    return M.percentile_interval(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", r6("low"), r6("high"))
