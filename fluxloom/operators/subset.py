"""Subsets, unions, quotas and folds of objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.ordering import ranked
from fluxloom.schema import LightCurves


def seeded_order(key: str | Column, seed: int) -> Column:
    """A random order that every engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def missing_ids(ids: DataFrame, objects: DataFrame, key: str = "object_id") -> DataFrame:
    return ids.select(key).distinct().join(objects.select(key), key, "left_anti")


def update_to_subset(data: LightCurves, ids: DataFrame, key: str = "object_id") -> LightCurves:
    """The dataset restricted to ``ids``; a ValueError if one of them is not in it."""
    lost = [r[0] for r in missing_ids(ids, data.objects, key).limit(5).collect()]
    if lost:
        raise ValueError(f"not in the dataset: {lost}")
    wanted = ids.select(key).distinct()
    return LightCurves(data.observations.join(wanted, key, "left_semi"), data.objects.join(wanted, key, "left_semi"), None if data.models is None else data.models.join(wanted, key, "left_semi"), data.filters)


def overlap(a: DataFrame, b: DataFrame, key: str = "object_id") -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_semi")


def merge(a: LightCurves, b: LightCurves, key: str = "object_id", suffix: str | None = None) -> LightCurves:
    """The union of two datasets. Shared ids are an error unless ``suffix`` tells those of the second apart."""
    first, second = a, b
    if suffix is not None:
        renamed = lambda df: df.withColumn(key, F.concat(F.col(key).cast("string"), F.lit(suffix)))
        plain = lambda df: df.withColumn(key, F.col(key).cast("string"))
        first, second = LightCurves(plain(a.observations), plain(a.objects), None, a.filters), LightCurves(renamed(b.observations), renamed(b.objects), None, b.filters)
    elif not overlap(a.objects, b.objects, key).isEmpty():
        raise ValueError("the datasets share objects")
    union = lambda x, y: x.unionByName(y, allowMissingColumns=True)
    models = union(first.models, second.models) if first.models is not None and second.models is not None else first.models or second.models
    return LightCurves(union(first.observations, second.observations), union(first.objects, second.objects), models, tuple(dict.fromkeys(a.filters + b.filters)))


def append_augmented(objects: DataFrame, made: DataFrame) -> DataFrame:
    """Originals and synthesised objects, told apart by ``augmented``."""
    both = objects.unionByName(made.withColumn("augmented", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("augmented", F.coalesce("augmented", F.lit(False)))


def ordered_filters(obs: DataFrame, passbands: DataFrame) -> DataFrame:
    """The passbands that occur, with their place in the declared order."""
    return passbands.join(obs.select("filter").distinct(), "filter", "left_semi").select("filter", "ordinal")


def random_subset(objects: DataFrame, n: int, seed: int, key: str = "object_id") -> DataFrame:
    """``n`` objects drawn without replacement."""
    return objects.orderBy(seeded_order(key, seed), key).limit(n)


def kept_subset(objects: DataFrame, n: int, seed: int, path: str, key: str = "object_id") -> DataFrame:
    """``random_subset``, drawn once: its keys are kept at ``path`` and taken from there the next time, whatever ``n`` and ``seed`` say then.

    Kept keys that ``objects`` no longer has are left out.
    """
    spark = objects.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        random_subset(objects, n, seed, key).select(key).write.mode("overwrite").parquet(path)
    return objects.join(spark.read.parquet(path), key, "left_semi")


def sample_with_replacement(rows: DataFrame, n: int, seed: int, key: str = "object_id") -> DataFrame:
    """``n`` draws of rows, each of any row: (draw from 0, copy of that row from 0, and the row).

    Rows stand in the order of ``key`` (then of all columns) and are numbered through all partitions by the sizes of those before;
    draw j takes the row whose number is the first 60 bits of md5("seed:j") modulo the rows. Draws meet rows by number, so a row
    drawn often is repeated by the join; which rows are drawn depends on nothing but key order, ``n`` and ``seed``.
    """
    placed = ranked(rows, [], [F.col(key), F.to_json(F.struct(*[rows[c] for c in rows.columns]))], "_at")
    total = rows.count()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"))
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    draws = draws.withColumn("_at", first % max(1, total))
    copies = F.row_number().over(W.partitionBy("_at").orderBy("draw")) - 1
    return draws.withColumn("copy", copies).join(placed, "_at").drop("_at")


def balanced(objects: DataFrame, seed: int, key: str = "object_id", label: str = "target") -> DataFrame:
    """Every class cut at random to the size of the smallest."""
    sizes = objects.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    least = sizes.first()[0] or 0
    return ranked(objects, [label], [seeded_order(key, seed), F.col(key)]).where(F.col("_r") < least).drop("_r")


def augmentation_quota(objects: DataFrame, seed: int, key: str = "object_id", label: str = "target") -> DataFrame:
    """(key, label, n_copies): copies that bring all classes to an equal share of twice the number of objects.

    Each object of a class gets the whole quotient and the remainder goes to randomly chosen objects.
    """
    sizes = objects.groupBy(label).agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    sizes = sizes.join(F.broadcast(whole)).withColumn("_need", F.greatest(F.expr("(2 * _all) div _classes - _n"), F.lit(0)))
    rows = ranked(objects.select(key, label), [label], [seeded_order(key, seed), F.col(key)]).join(sizes, label)
    return rows.select(key, label, (F.expr("_need div _n") + (F.col("_r") < F.col("_need") % F.col("_n")).cast("long")).alias("n_copies"))


def train_test_bucket(objects: DataFrame, n: int, key: str = "object_id", type_col: str = "sntype") -> DataFrame:
    """split (train below type 100) and the bucket of each object's place in its split."""
    split = F.when(F.col(type_col) < 100, "train").otherwise("test")
    return ranked(objects.withColumn("split", split), ["split"], [F.col(key)]).withColumn("bucket", (F.col("_r") % n).cast("int")).drop("_r")


def stratified_folds(objects: DataFrame, k: int, seed: int, key: str = "object_id", label: str = "target") -> DataFrame:
    """(…, fold): objects of each class dealt at random over ``k`` folds."""
    return ranked(objects, [label], [seeded_order(key, seed), F.col(key)]).withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r")


def grouped_folds(objects: DataFrame, k: int, seed: int, key: str = "object_id", label: str = "target", parent: str = "original_event") -> DataFrame:
    """Folds of the originals, inherited by the objects made from them."""
    origin = F.coalesce(F.col(parent), F.col(key))
    heads = objects.select(origin.alias("_origin"), label).groupBy("_origin").agg(F.min(label).alias(label))
    folds = stratified_folds(heads, k, seed, "_origin", label).select(F.col("_origin").alias("_head"), "fold")
    return objects.join(folds, origin == F.col("_head")).drop("_head")


def shuffled(objects: DataFrame, seed: int, key: str = "object_id") -> DataFrame:
    return objects.orderBy(seeded_order(key, seed), key)


def chosen_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*columns)
