"""Keyed text files, one per object, with a list file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.preprocess import rezero
from fluxloom.schema import DES, TYPE_NAMES, LightCurves


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.DAT") -> DataFrame:
    """(name, value): every line with the name of its file."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")


def parse_observations(lines: DataFrame, prefix: str = "des") -> DataFrame:
    """The ``OBS:`` lines: object_id, mjd, filter, field, flux, flux_error, zp, zpsys."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("value").startswith("OBS:")).withColumn("_p", part)
    number = lambda i: F.col("_p")[i].cast("double")
    return rows.select(
        F.col("name").alias("object_id"), number(1).alias("mjd"), F.concat(F.lit(prefix), F.col("_p")[2]).alias("filter"),
        F.col("_p")[3].alias("field"), number(4).alias("flux"), number(5).alias("flux_error"), F.lit(27.5).alias("zp"), F.lit("ab").alias("zpsys"),
    )


def parse_objects(lines: DataFrame) -> DataFrame:
    """The header lines: object_id, z, z_err (``HOST_GALAXY_PHOTO-Z:``) and target (``SIM_COMMENT:``).

    Of several type names in a comment the last by the order of the table of types counts.
    """
    part = F.split(F.trim("value"), r"\s+")
    host = F.when(F.col("value").startswith("HOST_GALAXY_PHOTO-Z:"), part)
    told = F.when(F.col("value").startswith("SIM_COMMENT:"), part)
    named = F.lit(None).cast("int")
    for code, name in TYPE_NAMES.items():
        named = F.when(F.array_contains(told, name), F.lit(code)).otherwise(named)
    rows = lines.select(F.col("name").alias("object_id"), host.alias("h"), named.alias("t"))
    first = lambda i: F.max(F.get("h", F.lit(i)).cast("double"))
    return rows.groupBy("object_id").agg(first(1).alias("z"), first(3).alias("z_err"), F.max("t").alias("target"))


def names_in_list(spark: SparkSession, list_file: str, subset: str | Sequence[str | int] | None = None, spectro_file: str | None = None) -> DataFrame:
    """The object names of a list file, sorted; ``'spectro'`` reads another list, names or places choose some."""
    path = spectro_file if subset == "spectro" else list_file
    names = spark.read.text(path).select(F.trim("value").alias("object_id")).where("object_id <> ''").orderBy("object_id")
    if subset is None or isinstance(subset, str):
        return names
    chosen = list(subset)
    if all(isinstance(x, str) for x in chosen):
        return names.where(F.col("object_id").isin(*chosen))
    from pyspark.sql import Window as W

    placed = names.withColumn("_i", F.row_number().over(W.orderBy("object_id")) - 1)
    return placed.where(F.col("_i").isin(*chosen)).drop("_i")


def read(spark: SparkSession, folder: str, names: DataFrame | None = None, pattern: str = "*.DAT") -> LightCurves:
    """A folder of object files; objects without observations are left out."""
    lines = read_lines(spark, folder, pattern)
    if names is not None:
        lines = lines.join(names.select(F.col("object_id").alias("name")), "name", "left_semi")
    obs = parse_observations(lines)
    starts = obs.groupBy("object_id").agg(F.min("mjd").alias("initial_observation_time"))
    return LightCurves(rezero(obs), parse_objects(lines).join(starts, "object_id"), None, DES)
