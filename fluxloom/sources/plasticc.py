"""The photometric challenge's CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.preprocess import redshift, rezero
from fluxloom.schema import LSST, LightCurves

#: Names in the files and names here.
_NAMES = {"flux_err": "flux_error", "detected_bool": "detected", "passband": "filter", "ddf_bool": "ddf", "true_target": "target"}


def _renamed(df: DataFrame) -> DataFrame:
    names = {k: v for k, v in _NAMES.items() if k in df.columns and v not in df.columns}
    ids = [c for c in df.columns if "id" in c.lower() and c.lower().startswith("obj")]
    times = [c for c in df.columns if c.lower() in ("mjd", "time")]
    if ids:
        names[ids[0]] = "object_id"
    if times:
        names[times[0]] = "mjd"
    return df.withColumnsRenamed(names)


def remap_filters(df: DataFrame, column: str = "filter") -> DataFrame:
    """Numbers 0 to 5 to the six passbands; names stay."""
    place = F.expr(f"try_cast({column} AS INT)")
    return df.withColumn(column, F.coalesce(F.get(F.array(*[F.lit(f) for f in LSST]), place), F.col(column).cast("string")))


def clean_observations(df: DataFrame) -> DataFrame:
    rows = remap_filters(_renamed(df)).withColumn("object_id", F.col("object_id").cast("string"))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("mjd", "flux", "flux_error")})
    return rows.withColumn("detected", F.col("detected").cast("int") == 1) if "detected" in rows.columns else rows


def clean_metadata(df: DataFrame) -> DataFrame:
    rows = _renamed(df).withColumn("object_id", F.col("object_id").cast("string"))
    spec = [c for c in rows.columns if "specz" in c]
    photo = [c for c in rows.columns if "photoz" in c and "err" not in c]
    number = lambda names: F.col(names[-1]).cast("double") if names else F.lit(None).cast("double")
    rows = rows.withColumn("z", redshift(number(spec), number(photo)))
    return rows.withColumn("ddf", F.col("ddf").cast("int") == 1) if "ddf" in rows.columns else rows


def read_csv(spark: SparkSession, observations: str, metadata: str | None = None) -> LightCurves:
    """Observations and metadata; the latter beside the former with ``_metadata`` in its name unless given."""
    metadata = metadata or observations.replace(".csv", "_metadata.csv")
    load = lambda path: spark.read.csv(path, header=True)
    return LightCurves(rezero(clean_observations(load(observations)), "object_id"), clean_metadata(load(metadata)), None, LSST)
