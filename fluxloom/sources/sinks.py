"""Writers and readers of datasets, models and runs."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.schema import LSST, LightCurves


def save_folder(data: LightCurves, path: str, key: str = "object_id") -> None:
    """A list of names and one folder of CSV per object."""
    data.observations.select(key).distinct().orderBy(key).select(F.col(key).cast("string")).coalesce(1).write.mode("overwrite").text(f"{path}/list")
    data.observations.repartition(key).write.mode("overwrite").partitionBy(key).option("header", True).csv(f"{path}/objects")


def save_list(data: LightCurves, path: str, name: str, key: str = "object_id") -> None:
    """One text file per object, ``<id>.DAT``, and the list file ``<name>.LIST`` of their names; ``spcc.read`` reads them back."""
    from fluxloom.sources.object_files import save_objects

    save_objects(data, path, name, key)


def load_folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(f"{path}/objects")


def save_dataset(data: LightCurves, path: str) -> None:
    """Observations, objects and models as parquet."""
    for name in ("observations", "objects", "models"):
        if (df := getattr(data, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_dataset(spark: SparkSession, path: str, filters: tuple[str, ...] = LSST) -> LightCurves:
    """A parquet folder, or a CSV file with its metadata beside it; the latter is kept as parquet for the next time."""
    from fluxloom.sources import plasticc

    if not path.endswith(".csv"):
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/models")
        models = read("models") if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs) else None
        return LightCurves(read("observations"), read("objects"), models, filters)
    cache = path[: -len(".csv")] + ".parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/objects/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        save_dataset(plasticc.read_csv(spark, path), cache)
    return load_dataset(spark, cache, filters)


def save_models(fits: DataFrame, path: str) -> None:
    """Grids and parameters of fitted processes."""
    from fluxloom.operators.gp import models_of, params_of

    models_of(fits).write.mode("overwrite").parquet(f"{path}/models")
    params_of(fits).write.mode("overwrite").parquet(f"{path}/gp_params")


def load_models(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "object_id") -> DataFrame:
    models = spark.read.parquet(f"{path}/models")
    return models if ids is None else models.join(ids.select(key).distinct(), key, "left_semi")


def save_coefficients(packed: DataFrame, levels: int, path: str, key: str = "object_id") -> None:
    """Wavelet coefficients as (key, filter, level, kind, coeffs)."""
    parts = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(c).alias("kind"), F.col(f"{c}_{level}").alias("coeffs")) for level in range(1, levels + 1) for c in ("cA", "cD")])
    packed.select(key, "filter", F.explode(parts).alias("c")).select(key, "filter", "c.*").write.mode("overwrite").parquet(path)


def load_feature_space(spark: SparkSession, path: str, filters: tuple[str, ...] = LSST, key: str = "object_id") -> DataFrame:
    """(key, features) from saved coefficients: bands in order, deepest level first, cA before cD."""
    place = F.array_position(F.array(*[F.lit(f) for f in filters]), F.col("filter"))
    rows = spark.read.parquet(path).select(key, F.struct(place.alias("p"), (-F.col("level")).alias("l"), "kind", "coeffs").alias("s")).where(F.col("s.p") > 0)
    return rows.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["coeffs"])).alias("features"))


def save_buckets(rows: DataFrame, path: str) -> None:
    """Rows with split and bucket, in folders by both."""
    rows.repartition("split", "bucket").write.mode("overwrite").partitionBy("split", "bucket").parquet(path)


def save_run(spark: SparkSession, config: dict, path: str) -> None:
    """A run's parameters and time as one line of JSON."""
    line = json.dumps(config | {"saved_at": datetime.now(UTC).isoformat()}, default=str, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_run(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def append_objects(data: LightCurves, observations: DataFrame, objects: DataFrame, subtract_min: bool = True) -> LightCurves:
    """A dataset with further objects, their times counted from their first observation unless said otherwise."""
    from fluxloom.operators.preprocess import rezero

    new = rezero(observations) if subtract_min else observations
    more = [r[0] for r in new.select("filter").distinct().collect()]  # the filters of a survey are few
    filters = tuple(dict.fromkeys((*data.filters, *sorted(more))))
    return LightCurves(data.observations.unionByName(new, allowMissingColumns=True), data.objects.unionByName(objects, allowMissingColumns=True), data.models, filters)


def save_features(rows: DataFrame, path: str, name: str, key: str = "object_id") -> None:
    """A table of features, reduced or raw, under its name; ``load_features`` and ``features.combine`` take it up again.

    A column ``features`` of arrays and plain columns are kept as they are. Saving a name again replaces it.
    """
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{name}: an object has several rows of features")
    rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_features(spark: SparkSession, path: str, names: list[str], key: str = "object_id") -> DataFrame:
    """Saved tables of features side by side, for the objects that all of them have; plain columns keep their names, of arrays the elements follow each other."""
    out = None
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}")
        plain = [c for c in rows.columns if c not in (key, "features")]
        part = F.array(*[F.col(c).cast("double") for c in plain]) if plain else F.array().cast("array<double>")
        part = F.concat(F.col("features").cast("array<double>"), part) if "features" in rows.columns else part
        part = rows.select(key, part.alias("_part"))
        out = part.withColumnRenamed("_part", "features") if out is None else out.join(part, key).select(key, F.concat("features", "_part").alias("features"))
    return out
