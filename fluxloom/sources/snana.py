"""Survey simulation tables: column clean-up, redshifts, classes, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.preprocess import detected_bit, plain_target, redshift, rezero
from fluxloom.schema import LightCurves, present

#: Column names of the photometry files and their names here.
PHOTOMETRY = {"FLUXCAL": "flux", "FLUXCALERR": "flux_error", "MJD": "mjd", "BAND": "filter", "PHOTFLAG": "photflag", "SNID": "object_id"}

#: Type codes of the survey's simulations, as (class, has a spectrum).
SIMULATED_TYPES = {
    120: (1, True),
    106: (1, False),
    32: (3, True),
    33: (3, True),
    132: (3, False),
    133: (3, False),
    22: (2, True),
    122: (2, False),
}

#: Type codes of the generic simulation files and their classes.
SNANA_TYPES = {101: 1, 20: 2, 21: 2, 22: 2, 23: 2, 120: 2, 121: 2, 122: 2, 123: 2, 32: 3, 33: 3, 132: 3, 133: 3, 42: 4, 142: 4}


def clean_photometry(rows: DataFrame, survey: str = "lsst") -> DataFrame:
    """Observations from a photometry table: vocabulary, ``survey`` + band as filter, the detection bit."""
    rows = rows.withColumnsRenamed({k: v for k, v in PHOTOMETRY.items() if k in rows.columns})
    rows = rows.withColumn("object_id", F.trim(F.col("object_id").cast("string")))
    rows = rows.withColumn("filter", F.concat(F.lit(survey), F.lower(F.trim("filter"))))
    if "photflag" in rows.columns:
        rows = rows.withColumn("detected", detected_bit(F.col("photflag").cast("long"))).drop("photflag")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("mjd", "flux", "flux_error")})


def clean_metadata(rows: DataFrame) -> DataFrame:
    """Objects from a header table: lower-case names, string ids, plain targets, one redshift."""
    rows = rows.toDF(*[c.lower() for c in rows.columns]).withColumnsRenamed({"snid": "object_id", "sntype": "target", "ddf_bool": "ddf"})
    rows = rows.withColumn("object_id", F.trim(F.col("object_id").cast("string")))
    if "target" in rows.columns:
        rows = rows.withColumn("target", plain_target(F.col("target")))
    if "redshift_final" in rows.columns:
        photo = F.col("hostgal_photoz").cast("double") if "hostgal_photoz" in rows.columns else F.lit(None).cast("double")
        rows = rows.withColumn("z", redshift(F.col("redshift_final").cast("double"), photo, None))
    return rows


def read_csv(spark: SparkSession, photometry: str, metadata: str, survey: str = "lsst") -> LightCurves:
    """Two CSV files with headers."""
    load = lambda path: spark.read.csv(path, header=True, inferSchema=True)
    return LightCurves(rezero(clean_photometry(load(photometry), survey)), clean_metadata(load(metadata)))


def read_parquet(spark: SparkSession, photometry: str, metadata: str, survey: str = "lsst") -> LightCurves:
    """The same tables as parquet, the form in which table lists of single objects are kept here."""
    return LightCurves(rezero(clean_photometry(spark.read.parquet(photometry), survey)), clean_metadata(spark.read.parquet(metadata)))


def scaled_positive_flux(rows: DataFrame, power: float = -1.44, flux_col: str = "fluxcal") -> DataFrame:
    """Positive fluxes only, on the scale of ``10 ** power``."""
    return rows.where(F.col(flux_col) > 0).withColumn("flux", F.col(flux_col) * F.lit(10.0**power))


def band_peak(obs: DataFrame, band: str, key: str = "object_id") -> DataFrame:
    """The highest flux in one band, -9 where there is none."""
    return obs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("filter") == band, F.col("flux"))), F.lit(-9.0)).alias("peak_flux"))


def heliocentric_or_simulated(head: DataFrame) -> DataFrame:
    """z and z_err: the heliocentric pair where both are known, else the simulated redshift."""
    known = present(F.col("redshift_helio")).isNotNull() & present(F.col("redshift_helio_err")).isNotNull()
    return head.withColumns({"z": F.when(known, F.col("redshift_helio")).otherwise(F.col("sim_redshift_helio")), "z_err": F.when(known, F.col("redshift_helio_err"))})


def simulated_class(head: DataFrame, classes: Sequence[int] | None = None, spectra: bool | None = None) -> DataFrame:
    """The class and kind of simulated type codes, optionally only some of them."""
    pairs = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in SIMULATED_TYPES.items() for x in (k, v[i])]), F.col("sntype"))
    head = head.withColumns({"target": pairs(0), "spectroscopic": pairs(1)}).where("target IS NOT NULL")
    head = head if classes is None else head.where(F.col("target").isin(*classes))
    return head if spectra is None else head.where(F.col("spectroscopic") == spectra)


def generic_class(head: DataFrame, type_col: str = "sntype") -> DataFrame:
    """``target`` from the type codes of generic simulation files, null for an unknown one."""
    names = F.create_map(*[F.lit(x) for pair in SNANA_TYPES.items() for x in pair])
    return head.withColumn("target", F.element_at(names, F.col(type_col).cast("int")))
