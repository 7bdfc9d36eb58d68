"""The driver's event table seen as light curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.runtime import table
from fluxloom.schema import LightCurves

_BANDS = {"click": "lsstu", "error": "lsstg", "purchase": "lsstr", "signup": "lssti", "view": "lsstz"}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, object_id, mjd (days since 2024-01-01), filter, flux, flux_error, detected."""
    events = table(spark, sf_dir, "events")
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts"))
    band = F.element_at(F.create_map(*[F.lit(x) for pair in _BANDS.items() for x in pair]), F.col("event_type"))
    return events.select(
        "event_id",
        F.col("user_id").alias("object_id"),
        (micros / F.lit(86400000000.0)).alias("mjd"),
        band.alias("filter"),
        F.col("value").alias("flux"),
        (1 + F.get_json_object("props", "$.k").cast("double") / 10).alias("flux_error"),
        (F.col("value") >= 100).alias("detected"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object with its class, field and host redshifts, all functions of the id."""
    o = F.col("object_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id")).distinct().select(
        "object_id",
        F.element_at(F.array(F.lit(42), F.lit(62), F.lit(90)), (o % 3 + 1).cast("int")).alias("target"),
        (o % 10 == 0).alias("ddf"),
        F.when(o % 4 == 0, F.lit(-9.0)).otherwise(F.lit(0.05) + (o % 20) * F.lit(0.05)).alias("hostgal_specz"),
        (F.lit(0.05) + (o % 20) * F.lit(0.05) + ((o * 7) % 11 - 5) * F.lit(0.01)).alias("hostgal_photoz"),
        (F.lit(0.02) + (o % 5) * F.lit(0.01)).alias("hostgal_photoz_err"),
    )


def light_curves(spark: SparkSession, sf_dir: str) -> LightCurves:
    return LightCurves(observations(spark, sf_dir), objects(spark, sf_dir), None, tuple(_BANDS.values()))


def grid_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed-form model per object and band on a grid of whole days 0 to 31: object_id, filter, grid_ix, mjd, flux, flux_error."""
    o = F.col("object_id")
    bands = F.array(*[F.lit(b) for b in _BANDS.values()])
    rows = objects(spark, sf_dir).select("object_id", F.posexplode(bands).alias("b", "filter"))
    rows = rows.select("object_id", "filter", "b", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("grid_ix"))
    flux = F.lit(20.0) + (o % 7) * 5.0 + F.col("b") * 3.0 + ((F.col("grid_ix") * 13 + o * 5 + F.col("b") * 7) % 17) * 4.0
    return rows.select("object_id", "filter", "grid_ix", F.col("grid_ix").cast("double").alias("mjd"), flux.alias("flux"), F.lit(1.0).alias("flux_error"))


#: The same tables as DuckDB common table expressions. They are materialised: under a LIMIT, DuckDB may else plan a table's
#: join with itself as one that does not end.
OBS_SQL = """obs AS MATERIALIZED (
  SELECT event_id, user_id AS object_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS mjd,
    CASE event_type WHEN 'click' THEN 'lsstu' WHEN 'error' THEN 'lsstg' WHEN 'purchase' THEN 'lsstr' WHEN 'signup' THEN 'lssti' WHEN 'view' THEN 'lsstz' END AS filter,
    value AS flux, 1 + json_extract_string(props, '$.k')::DOUBLE / 10 AS flux_error, value >= 100 AS detected
  FROM events
)"""
OBJ_SQL = """objs AS MATERIALIZED (
  SELECT o AS object_id, CASE o % 3 WHEN 0 THEN 42 WHEN 1 THEN 62 ELSE 90 END AS target, o % 10 = 0 AS ddf,
    CASE WHEN o % 4 = 0 THEN -9.0::DOUBLE ELSE 0.05::DOUBLE + (o % 20) * 0.05::DOUBLE END AS hostgal_specz,
    0.05::DOUBLE + (o % 20) * 0.05::DOUBLE + ((o * 7) % 11 - 5) * 0.01::DOUBLE AS hostgal_photoz,
    0.02::DOUBLE + (o % 5) * 0.01::DOUBLE AS hostgal_photoz_err
  FROM (SELECT DISTINCT user_id AS o FROM events)
)"""
GRID_SQL = """bands(b, filter) AS (VALUES (0, 'lsstu'), (1, 'lsstg'), (2, 'lsstr'), (3, 'lssti'), (4, 'lsstz')
), grid AS MATERIALIZED (
  SELECT object_id, filter, i AS grid_ix, i::DOUBLE AS mjd,
    20.0::DOUBLE + (object_id % 7) * 5.0::DOUBLE + b * 3.0::DOUBLE + ((i * 13 + object_id * 5 + b * 7) % 17) * 4.0::DOUBLE AS flux
  FROM (SELECT DISTINCT user_id AS object_id FROM events), bands, range(0, 32) t(i)
)"""
