"""Queries of template surfaces seen through passbands."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import surfaces as S
from fluxloom.plans.registry import query, r6
from fluxloom.schema import PASSBANDS
from fluxloom.sources.fixtures import OBJ_SQL, OBS_SQL, objects, observations

_USED = ("lsstu", "lsstg", "lsstr", "lssti", "lsstz")


def _bands(spark: SparkSession):
    """A triangle of half width 600 around each passband's wavelength."""
    return spark.createDataFrame([(f, PASSBANDS[f] + d, t) for f in _USED for d, t in ((-600.0, 0.0), (0.0, 0.9), (600.0, 0.0))], "filter string, wavelength double, transmission double")


def _surface(spark: SparkSession):
    """Phases -10, -5 ... 40 and wavelengths 1500, 1600 ... 12000 of a rising and falling, reddening flux."""
    rows = spark.range(11).select((F.col("id") * 5 - 10).cast("double").alias("phase"), F.explode(F.sequence(F.lit(1500), F.lit(12000), F.lit(100)).cast("array<double>")).alias("wavelength"))
    flux = F.greatest(F.lit(0.0), 30 - F.abs(F.col("phase") - 8)) * (1 + F.col("phase") * (F.col("wavelength") - 5000) / 500000) * 1e-18
    return rows.select(F.lit("rise").alias("template"), "phase", "wavelength", flux.alias("flux"))


def _asked(spark, sf_dir):
    obs = observations(spark, sf_dir).select("event_id", "object_id", "filter", "mjd")
    return obs.join(objects(spark, sf_dir).select("object_id", F.col("hostgal_photoz").alias("z")), "object_id").withColumns({"template": F.lit("rise"), "t0": F.lit(4.0) + F.col("object_id") % 7, "amplitude": F.lit(2.0)})


# each observation by itself: its two phases, then every grid wavelength between two of the surface
_BAND_FLUX = f"""WITH {OBS_SQL}, {OBJ_SQL}, centres(filter, c) AS (VALUES {', '.join(f"('{f}', {PASSBANDS[f]}::DOUBLE)" for f in _USED)}),
grid AS MATERIALIZED (SELECT filter, j * 5.0::DOUBLE AS w, 0.9::DOUBLE * (1 - abs(j * 5.0::DOUBLE - c) / 600) AS t FROM centres, range(400, 2200) r(j) WHERE j * 5.0::DOUBLE >= c - 600 AND j * 5.0::DOUBLE < c + 600),
whole AS MATERIALIZED (SELECT filter, sum(t / w) * {S.AB_FLUX!r}::DOUBLE * {S.LIGHT!r}::DOUBLE AS s FROM grid GROUP BY filter),
asked AS MATERIALIZED (SELECT event_id, filter, hostgal_photoz AS z, (mjd - (4.0::DOUBLE + object_id % 7)) / (1 + hostgal_photoz) AS p FROM obs JOIN objs USING (object_id)),
inside AS MATERIALIZED (SELECT *, least(floor((p + 10) / 5), 9) AS i FROM asked WHERE p BETWEEN -10 AND 40),
knots AS MATERIALIZED (SELECT e.event_id, e.filter, e.z, e.p, e.i, i + k AS at, k FROM inside e, (VALUES (0), (1)) q(k)),
lit AS (SELECT n.event_id, n.k, n.p, n.i, sum(g.t * g.w * (
    (1500 + 100 * (floor((g.w / (1 + n.z) - 1500) / 100) + 1) - g.w / (1 + n.z)) / 100 * greatest(0, 30 - abs(n.at * 5 - 10 - 8)) * (1 + (n.at * 5 - 10) * (1500 + 100 * floor((g.w / (1 + n.z) - 1500) / 100) - 5000) / 500000)
    + (g.w / (1 + n.z) - 1500 - 100 * floor((g.w / (1 + n.z) - 1500) / 100)) / 100 * greatest(0, 30 - abs(n.at * 5 - 10 - 8)) * (1 + (n.at * 5 - 10) * (1500 + 100 * (floor((g.w / (1 + n.z) - 1500) / 100) + 1) - 5000) / 500000)
  ) * 1e-18::DOUBLE / (1 + n.z)) * 1e11::DOUBLE / any_value(h.s) AS f FROM knots n JOIN grid g ON g.filter = n.filter JOIN whole h ON h.filter = n.filter GROUP BY ALL),
read AS (SELECT event_id, 2 * sum(f * CASE k WHEN 0 THEN 1 - (p + 10 - 5 * i) / 5 ELSE (p + 10 - 5 * i) / 5 END) AS f FROM lit GROUP BY event_id)
SELECT o.event_id, round(coalesce(r.f, 0), 4) AS model_flux FROM obs o LEFT JOIN read r ON r.event_id = o.event_id"""


@query(_BAND_FLUX)
def template_band_flux(spark, sf_dir):
    """A surface read at every observation, through its band and at its object's redshift."""
    return S.band_flux(_asked(spark, sf_dir), _surface(spark), _bands(spark)).select("event_id", r6("model_flux", 4))


@query()
def template_surface_fit(spark, sf_dir):
    """The best start and amplitude of the surface for every object at its photometric redshift."""
    return S.fit_surfaces(observations(spark, sf_dir), _surface(spark), _bands(spark), objects(spark, sf_dir).select("object_id", F.col("hostgal_photoz").alias("z")), days=4.0, rounds=2)
