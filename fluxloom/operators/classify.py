"""Classifiers over (id, label, features array), their tuning, evaluation and persistence.

Forests, trees, boosted trees and perceptrons are those of ``pyspark.ml``. The support-vector machine with a Gaussian
kernel is a logistic regression over random Fourier features of that kernel. Neighbours and naive Bayes are DataFrame
operations.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import classification
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators import boosting, perceptron
from fluxloom.operators import metrics as M
from fluxloom.operators.neighbours import nearest_rows
from fluxloom.operators.subset import stratified_folds
from fluxloom.runtime import materialised


def _width(df: DataFrame, column: str = "features") -> int:
    return df.select(F.max(F.size(column))).first()[0] or 0


def standardised(df: DataFrame, column: str = "features", fit_on: DataFrame | None = None) -> DataFrame:
    """Every place centred and divided by its population deviation over ``fit_on`` (all rows unless given)."""
    source = fit_on if fit_on is not None else df
    places = source.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = places.orderBy("i").collect()
    means, scales = F.lit([float(r.m) for r in rows]), F.lit([float(r.s) or 1.0 for r in rows])
    return df.withColumn(column, F.transform(column, lambda x, i: (x - F.get(means, i)) / F.get(scales, i)))


def split(df: DataFrame, fraction: float | None = None, train_ids: DataFrame | None = None, key: str = "object_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, by the hash of the key or by a list of keys."""
    if train_ids is not None:
        ids = train_ids.select(key)
        return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000.0
    return df.where(draw < fraction), df.where(draw >= fraction)


# --- naive Bayes and neighbours ----------------------------------------------------------------------------------------


def fit_gaussian_nb(train: DataFrame, label: str = "label", column: str = "features", smoothing: float = 1e-9) -> DataFrame:
    """(label, prior, means, variances): one row per class."""
    long = train.select(label, F.posexplode(column).alias("i", "x"))
    floor = long.groupBy("i").agg(F.var_pop("x").alias("v")).agg((F.max("v") * smoothing).alias("e"))
    places = long.groupBy(label, "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).join(F.broadcast(floor))
    packed = places.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m", (F.col("v") + F.col("e")).alias("v")))).alias("_p"))
    priors = train.groupBy(label).agg(F.count("*").alias("n")).withColumn("prior", F.ln(F.col("n") / F.sum("n").over(W.partitionBy())))
    return packed.join(priors, label).select(label, "prior", F.col("_p.m").alias("means"), F.col("_p.v").alias("variances"))


def predict_gaussian_nb(rows: DataFrame, model: DataFrame, key: str = "object_id", label: str = "label", column: str = "features", max_classes: int = 10_000) -> DataFrame:
    """(key, y_pred, log_likelihood, probability): probabilities in the order of the labels.

    The model, one row per class, is gathered if it has at most ``max_classes`` rows, else refused.
    """
    classes = model.orderBy(label).limit(max_classes + 1).collect()
    if len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    joint = []
    for c in classes:
        m, v = F.lit(list(c["means"])), F.lit(list(c["variances"]))
        term = _gaussian_terms(column, m, v)
        joint.append(F.struct((F.aggregate(term, F.lit(0.0), lambda a, t: a + t) + float(c["prior"])).alias("l"), F.lit(c[label]).alias("y")))
    return _decided(rows.withColumn("_j", F.array(*joint)), key)


def _gaussian_terms(column: str, m: Column, v: Column) -> Column:
    def term(x: Column, i: Column) -> Column:
        off = x - F.get(m, i)
        return -0.5 * F.ln(F.get(v, i) * (2 * math.pi)) - off * off / (2 * F.get(v, i))

    return F.transform(column, term)


def _decided(rows: DataFrame, key: str) -> DataFrame:
    top = F.array_max(F.transform("_j", lambda s: s["l"]))
    best = F.get(F.filter("_j", lambda s: s["l"] == top), F.lit(0))
    parts = F.transform("_j", lambda s: F.exp(s["l"] - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return rows.select(key, best["y"].alias("y_pred"), best["l"].alias("log_likelihood"), F.transform(parts, lambda p: p / total).alias("probability"))


def knn_predict(train: DataFrame, test: DataFrame, k: int, key: str = "object_id", label: str = "label", column: str = "features", block: int = 4096) -> DataFrame:
    """(key, y_pred, probability) by the ``k`` nearest training rows, each voting one over its distance."""
    labels = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    ranked = nearest_rows(train, test, k, key, label, column, block)
    weight = 1 / F.greatest("d", F.lit(1e-12))
    votes = ranked.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("y") == y, weight)), F.lit(0.0)).alias(f"_v{i}") for i, y in enumerate(labels)])
    array = F.array(*[F.col(f"_v{i}") for i in range(len(labels))])
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    votes = votes.withColumn("probability", F.transform(array, lambda x: x / total))
    place = F.array_position("probability", F.array_max("probability")).cast("int")
    return votes.select(key, F.element_at(F.array(*[F.lit(y) for y in labels]), place).alias("y_pred"), "probability")


# --- estimators of pyspark.ml behind one interface ----------------------------------------------------------------------


class Classifier:
    """``fit`` on (label, features); ``predict`` gives (key, y_pred, probability) in the order of ``labels``."""

    grid: Mapping[str, Sequence[Any]] = {}

    def __init__(self, **params: Any):
        self.params, self.labels, self.model = params, None, None

    def _prepared(self, train: DataFrame, weight: str | None) -> DataFrame:
        self.labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
        place = F.array_position(F.array(*[F.lit(y) for y in self.labels]), F.col("label")) - 1
        rows = train.select(place.cast("double").alias("label"), array_to_vector("features").alias("features"), *([F.col(weight)] if weight else []))
        return rows

    def fit(self, train: DataFrame, weight: str | None = None) -> Classifier:
        rows = self._prepared(train, weight)
        self.model = self._fit(rows, weight)
        return self

    def _fit(self, rows: DataFrame, weight: str | None) -> Any:
        raise NotImplementedError

    def _probability(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumn("probability", vector_to_array("probability"))

    def predict(self, rows: DataFrame, key: str = "object_id") -> DataFrame:
        kept = [c for c in rows.columns if c not in ("features", "probability")]
        told = self._probability(rows.select(*kept, array_to_vector("features").alias("features")))
        place = F.array_position("probability", F.array_max("probability")).cast("int")
        return told.select(*kept, F.element_at(F.array(*[F.lit(y) for y in self.labels]), place).alias("y_pred"), "probability")

    def save(self, spark: SparkSession, path: str) -> None:
        """What was learned, in Spark's formats, with labels and parameters beside it."""
        about = {"class": type(self).__name__, "labels": self.labels, "params": self.params} | self._save(path)
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    def _save(self, path: str) -> dict:
        parts = self.model if isinstance(self.model, list) else [self.model]
        for i, m in enumerate(parts):
            m.write().overwrite().save(f"{path}/model{i}")
        about = {"models": [type(m).__name__ for m in parts], "list": isinstance(self.model, list)}
        return about | ({"lift": [x.tolist() for x in self.lift]} if hasattr(self, "lift") else {})

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        found = {c.__name__: c for c in Classifier.__subclasses__()}[about["class"]](**about["params"])
        found.labels = about["labels"]
        found._load(spark, path, about)
        return found

    def _load(self, spark: SparkSession, path: str, about: dict) -> None:
        parts = [getattr(classification, name).load(f"{path}/model{i}") for i, name in enumerate(about["models"])]
        self.model = parts if about["list"] else parts[0]
        if "lift" in about:
            self.lift = tuple(np.array(x) for x in about["lift"])

    def optimise(self, rows: DataFrame, grid: Mapping[str, Sequence[Any]] | None = None, **options: Any) -> Search:
        """Search this classifier's grid once and take the best parameters; a second call is an error."""
        if getattr(self, "searched", None) is not None:
            raise ValueError("this classifier has been optimised")
        self.searched = grid_search(type(self), rows, grid or self.grid, **options)
        self.params = self.params | self.searched.best
        return self.searched


class RandomForest(Classifier):
    grid = {"numTrees": tuple(range(200, 900, 100)), "impurity": ("gini", "entropy")}

    def _fit(self, rows, weight):
        args = {"numTrees": 200, "maxDepth": 10, "seed": 1} | self.params
        return RandomForestClassifier(**args, **({"weightCol": weight} if weight else {})).fit(rows)


class DecisionTree(Classifier):
    grid = {"impurity": ("gini", "entropy"), "minInstancesPerNode": tuple(range(1, 400, 25))}

    def _fit(self, rows, weight):
        args = {"maxDepth": 10, "seed": 1} | self.params
        return DecisionTreeClassifier(**args, **({"weightCol": weight} if weight else {})).fit(rows)


class Perceptron(Classifier):
    """One hidden layer; the activation is the logistic one and the solver L-BFGS."""

    grid = {"hidden": tuple(range(80, 120, 5))}

    def _fit(self, rows, weight):
        args = {"hidden": 80, "maxIter": 200, "seed": 1} | self.params
        hidden = args.pop("hidden")
        width = len(rows.first()["features"])
        return MultilayerPerceptronClassifier(layers=[width, hidden, max(2, len(self.labels))], **args).fit(rows)


class TanhPerceptron(Classifier):
    """Hidden layers of tanh units, trained by Adam on seeded mini-batches (see ``perceptron``)."""

    grid = {"hidden": tuple((n,) for n in range(80, 120, 5))}

    def fit(self, train: DataFrame, weight: str | None = None, key: str = "object_id") -> TanhPerceptron:
        rows = self._prepared(train.withColumn("_key", F.col(key).cast("string")), "_key")
        data = rows.select("label", vector_to_array("features").alias("x"), F.col("_key").alias("key"))
        self.sizes, self.model, self.losses = perceptron.fit(data, len(self.labels), **self.params)
        return self

    def _probability(self, rows):
        weights, classes = self.model, len(self.labels)

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            return pd.Series(list(perceptron.forward(np.nan_to_num(np.stack(x.to_numpy())), weights)[-1][:, :classes]) if len(x) else [])

        return rows.withColumn("probability", told(vector_to_array("features")))

    def _save(self, path: str) -> dict:
        return {"sizes": self.sizes, "flat": perceptron.flattened(self.model).tolist()}

    def _load(self, spark: SparkSession, path: str, about: dict) -> None:
        self.sizes, self.model = about["sizes"], perceptron.unflattened(np.array(about["flat"]), about["sizes"])


class BaggedForest(Classifier):
    """A forest whose bags can be made again, and so its out-of-bag score.

    A row stands in a tree's bag as often as a Poisson draw of mean 1 says, which is a hash of seed, tree and key. Trees are
    fitted side by side, ``parallelism`` at a time, each node on a random share of the features.
    """

    grid = {"numTrees": tuple(range(200, 900, 100)), "impurity": ("gini", "entropy")}

    def _bag(self, tree: int, key: str) -> Column:
        return bag_count(tree, key, self.params.get("seed", 1))

    def fit(self, train: DataFrame, weight: str | None = None, key: str = "object_id") -> BaggedForest:
        args = {"numTrees": 200, "maxDepth": 10, "impurity": "entropy", "seed": 1, "parallelism": 4} | self.params
        rows = materialised(self._prepared(train.withColumn("_key", F.col(key)), "_key"))
        trees, parallel = args.pop("numTrees"), args.pop("parallelism")

        def one(tree: int) -> Any:
            bag = rows.withColumn("_w", self._bag(tree, "_key").cast("double")).where("_w > 0")
            return RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", weightCol="_w", **(args | {"seed": args["seed"] + tree})).fit(bag)

        with ThreadPool(parallel) as pool:
            self.model = pool.map(one, range(trees))
        return self

    def _each(self, rows: DataFrame) -> DataFrame:
        """``rows`` with each tree's probabilities as _p0, _p1 and so on."""
        for i, tree in enumerate(self.model):
            told = tree.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"_v{i}")
            rows = told.transform(rows).withColumn(f"_p{i}", vector_to_array(f"_v{i}")).drop(f"_v{i}")
        return rows

    def _mean(self, parts: Column) -> Column:
        classes = len(self.labels)
        total = F.aggregate(parts, F.array(*[F.lit(0.0)] * classes), lambda a, p: F.zip_with(a, p, lambda x, y: x + F.coalesce(y, F.lit(0.0))))
        return F.when(F.size(parts) > 0, F.transform(total, lambda x: x / F.size(parts)))

    def _probability(self, rows):
        kept = rows.columns
        return self._each(rows).select(*kept, self._mean(F.array(*[F.col(f"_p{i}") for i in range(len(self.model))])).alias("probability"))

    def out_of_bag(self, train: DataFrame, key: str = "object_id") -> DataFrame:
        """(key, label, votes, y_pred, probability): each row of the training table by the trees whose bags lack it.

        Rows that stand in every bag have no vote, and null.
        """
        rows = self._each(train.select(key, "label", array_to_vector("features").alias("features")))
        voters = F.filter(F.array(*[F.when(self._bag(i, key) == 0, F.col(f"_p{i}")) for i in range(len(self.model))]), lambda p: p.isNotNull())
        rows = rows.select(key, "label", voters.alias("_votes")).withColumn("probability", self._mean(F.col("_votes")))
        place = F.array_position("probability", F.array_max("probability")).cast("int")
        told = F.when(F.size("_votes") > 0, F.element_at(F.array(*[F.lit(y) for y in self.labels]), F.coalesce(place, F.lit(1))))
        return rows.select(key, "label", F.size("_votes").alias("votes"), told.alias("y_pred"), "probability")

    def out_of_bag_score(self, train: DataFrame, key: str = "object_id") -> float:
        """The share of rows with a vote whose class the vote gives."""
        told = self.out_of_bag(train, key).where("votes > 0")
        return told.agg(F.avg((F.col("y_pred") == F.col("label")).cast("double"))).first()[0] or 0.0


def bag_count(tree: int, key: str, seed: int) -> Column:
    """How often a row stands in a tree's bag: a Poisson draw of mean 1 from a hash."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), F.col(key).cast("string")), 11) / float(1 << 53)
    count, below = F.lit(0), 0.0
    for n in range(12):
        below += math.exp(-1) / math.factorial(n)
        count = F.when(chance >= below, F.lit(n + 1)).otherwise(count)
    return count


class KernelSvm(Classifier):
    """A Gaussian kernel by random Fourier features under a logistic loss, so that it gives probabilities."""

    grid = {"C": tuple(10.0**x for x in np.linspace(-2, 5, 5)), "gamma": tuple(10.0**x for x in np.linspace(-8, 3, 5))}

    def _lifted(self, rows: DataFrame) -> DataFrame:
        w, b = self.lift

        @F.pandas_udf("array<double>")
        def up(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.sqrt(2.0 / len(b)) * np.cos(np.stack(x.to_numpy()) @ w + b)) if len(x) else [])

        return rows.withColumn("features", array_to_vector(up(vector_to_array("features"))))

    def _fit(self, rows, weight):
        args = {"gamma": 0.02, "C": 1.0, "dimensions": 256, "seed": 1} | self.params
        rng, width = np.random.default_rng(args["seed"]), len(rows.first()["features"])
        self.lift = rng.standard_normal((width, args["dimensions"])) * math.sqrt(2 * args["gamma"]), rng.uniform(0, 2 * math.pi, args["dimensions"])
        lr = LogisticRegression(regParam=1e-3 / args["C"], maxIter=100, **({"weightCol": weight} if weight else {}))
        return lr.fit(self._lifted(rows))

    def _probability(self, rows):
        return super()._probability(self._lifted(rows))


class BoostedTrees(Classifier):
    """Gradient boosting, one model for each class against the others; their probabilities are scaled to one.

    Trees grow by depth, not by leaves: a depth stands for the leaves that it allows. The grid is meant for ``coordinate_search``.
    """

    grid = {"maxDepth": (3, 4, 5, 6), "stepSize": tuple(10.0**x for x in np.linspace(-3, -0.01, 50)), "maxIter": tuple(range(25, 120, 10)), "minInstancesPerNode": tuple(range(10, 70, 5))}

    def _fit(self, rows, weight):
        args = {"maxIter": 25, "maxDepth": 4, "seed": 1} | self.params
        models = []
        for i in range(len(self.labels) if len(self.labels) > 2 else 1):
            one = rows.withColumn("label", (F.col("label") == (i if len(self.labels) > 2 else 1)).cast("double"))
            models.append(GBTClassifier(**args, **({"weightCol": weight} if weight else {})).fit(one))
        return models

    def _probability(self, rows):
        for i, model in enumerate(self.model):
            kept = rows.columns
            rows = model.transform(rows).select(*kept, vector_to_array("probability")[1].alias(f"_p{i}"))
        if len(self.model) == 1:
            return rows.withColumn("probability", F.array(1 - F.col("_p0"), F.col("_p0")))
        parts = F.array(*[F.col(f"_p{i}") for i in range(len(self.model))])
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("probability", F.transform(parts, lambda p: p / total))


class LeafwiseTrees(Classifier):
    """Gradient boosting with trees grown best leaf first, one softmax model for all classes (see ``boosting``).

    The grid is meant for ``coordinate_search`` with ``at_defaults``.
    """

    grid = {"num_leaves": tuple(range(10, 55, 5)), "learning_rate": tuple(10.0**x for x in np.linspace(-3, -0.01, 50)), "n_estimators": tuple(range(25, 120, 10)), "min_child_samples": tuple(range(20, 80, 10)), "max_depth": tuple(range(1, 20, 3)), "min_split_gain": tuple(np.linspace(0.0, 2.0, 21))}

    def _fit(self, rows, weight):
        data = rows.select("label", vector_to_array("features").alias("x"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
        return boosting.fit(data, len(self.labels), boosting.Growth(**self.params))[0]

    def _probability(self, rows):
        model, classes = self.model, len(self.labels)

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(np.stack(x.to_numpy()))[:, :classes]) if len(x) else [])

        return rows.withColumn("probability", told(vector_to_array("features")))

    def _save(self, path: str) -> dict:
        return {"boosted": self.model.plain()}

    def _load(self, spark: SparkSession, path: str, about: dict) -> None:
        self.model = boosting.Boosted.of(about["boosted"])


class AdaBoost(Classifier):
    """SAMME over weighted trees or forests."""

    grid = {"rounds": tuple(range(5, 85, 10)), "minInstancesPerNode": tuple(range(5, 55, 10))}

    def __init__(self, base: type[Classifier] = DecisionTree, **params: Any):
        super().__init__(**params)
        self.base = base

    def fit(self, train: DataFrame, weight: str | None = None) -> AdaBoost:
        args = {"rounds": 5} | self.params
        inner = {k: v for k, v in args.items() if k != "rounds"}
        self.labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
        rows, self.model = materialised(train.select("label", "features").withColumn("_w", F.lit(1.0))), []
        for _ in range(args["rounds"]):
            stage = self.base(**inner).fit(rows, "_w")
            told = stage.predict(rows.withColumn("_f", F.col("features"))).withColumnRenamed("_f", "features")
            wrong = F.col("y_pred") != F.col("label")
            missed, total = told.agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)), F.sum("_w")).first()
            error = missed / total
            if error >= 1 - 1 / len(self.labels):
                break
            alpha = math.log((1 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(max(1, len(self.labels) - 1))
            self.model.append((alpha, stage))
            if error <= 1e-10:
                break
            rows = materialised(told.select("label", "features", (F.col("_w") * F.when(wrong, F.lit(math.exp(min(alpha, 30.0)))).otherwise(1.0) / total).alias("_w")))
        if not self.model:
            self.model = [(1.0, stage)]
        return self

    def _save(self, path: str) -> dict:
        """Each stage is a classifier saved by itself."""
        spark = SparkSession.getActiveSession()
        for i, (_, stage) in enumerate(self.model):
            stage.save(spark, f"{path}/stage{i}")
        return {"alphas": [a for a, _ in self.model], "base": self.base.__name__}

    def _load(self, spark: SparkSession, path: str, about: dict) -> None:
        self.base = {c.__name__: c for c in Classifier.__subclasses__()}[about["base"]]
        self.model = [(a, Classifier.load(spark, f"{path}/stage{i}")) for i, a in enumerate(about["alphas"])]

    def predict(self, rows: DataFrame, key: str = "object_id") -> DataFrame:
        kept = [c for c in rows.columns if c not in ("features", "probability")]
        score = F.array(*[F.lit(0.0) for _ in self.labels])
        for i, (alpha, stage) in enumerate(self.model):
            told = stage.predict(rows.withColumn("_f", F.col("features")))
            rows = told.select(*[c for c in told.columns if c not in ("y_pred", "probability", "_f")], F.col("y_pred").alias(f"_y{i}"), F.col("_f").alias("features"))
            vote = F.array(*[F.when(F.col(f"_y{i}") == y, F.lit(alpha)).otherwise(0.0) for y in self.labels])
            score = F.zip_with(score, vote, lambda a, b: a + b)
        total = sum(a for a, _ in self.model)
        rows = rows.withColumn("_s", score)
        place = F.array_position("_s", F.array_max("_s")).cast("int")
        return rows.select(*kept, F.element_at(F.array(*[F.lit(y) for y in self.labels]), place).alias("y_pred"), F.transform("_s", lambda s: s / total).alias("probability"))


class Neighbours(Classifier):
    grid = {"k": tuple(range(1, 180, 5))}

    def fit(self, train, weight=None):
        self.labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
        self.model = train
        return self

    def _save(self, path: str) -> dict:
        self.model.write.mode("overwrite").parquet(f"{path}/rows")
        return {}

    def _load(self, spark: SparkSession, path: str, about: dict) -> None:
        self.model = spark.read.parquet(f"{path}/rows")

    def predict(self, rows, key="object_id"):
        found = knn_predict(self.model, rows, self.params.get("k", 11), key)
        return rows.drop("features").join(found, key)


class NaiveBayes(Classifier):
    def fit(self, train, weight=None):
        self.labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
        self.model = fit_gaussian_nb(train)
        return self

    def _save(self, path: str) -> dict:
        self.model.write.mode("overwrite").parquet(f"{path}/rows")
        return {}

    def _load(self, spark: SparkSession, path: str, about: dict) -> None:
        self.model = spark.read.parquet(f"{path}/rows")

    def predict(self, rows, key="object_id"):
        return rows.drop("features").join(predict_gaussian_nb(rows, self.model, key), key)


CLASSIFIERS: dict[str, Callable[..., Classifier]] = {
    "svm": KernelSvm, "knn": Neighbours, "neural_network": Perceptron, "random_forest": RandomForest, "decision_tree": DecisionTree,
    "boost_dt": AdaBoost, "boost_rf": lambda **p: AdaBoost(RandomForest, **p), "nb": NaiveBayes, "boosted_trees": BoostedTrees, "leafwise_trees": LeafwiseTrees,
    "tanh_network": TanhPerceptron, "bagged_forest": BaggedForest,
}


# --- tuning and runs ----------------------------------------------------------------------------------------------------


def score_auc(predictions: DataFrame, labels: Sequence, which: int = 0) -> float:
    rows = predictions.select(F.col("probability")[which].alias("probability"), (F.col("label") == labels[which]).alias("positive"))
    return M.auc(M.roc(rows)).first()[0] or 0.0


def score_log_loss(predictions: DataFrame, labels: Sequence, which: int = 0) -> float:
    weights = {y: M.CLASS_WEIGHTS.get(y, 1 / 18) for y in labels}
    return -(M.weighted_log_loss(predictions.withColumnRenamed("label", "y_true"), labels, weights).first()[0] or 0.0)


def score_accuracy(predictions: DataFrame, labels: Sequence, which: int = 0) -> float:
    return predictions.select(F.avg((F.col("y_pred") == F.col("label")).cast("double"))).first()[0] or 0.0


SCORES: dict[str, Callable[..., float]] = {"auc": score_auc, "logloss": score_log_loss, "accuracy": score_accuracy}


class Search(NamedTuple):
    best: dict
    scores: list
    warnings: list


def grid_search(make: Callable[..., Classifier], rows: DataFrame, grid: Mapping[str, Sequence[Any]], folds: int = 5, scoring: str | Callable[..., float] = "auc", key: str = "object_id", seed: int = 0, fold_col: str | None = None) -> Search:
    """Every combination of ``grid`` by cross-validation over stratified folds, or over those of ``fold_col``.

    ``warnings`` names the parameters whose best value lies at an end of its range.
    """
    from itertools import product

    score = SCORES[scoring] if isinstance(scoring, str) else scoring
    if fold_col is None:
        rows, fold_col = stratified_folds(rows, folds, seed, key, "label"), "fold"
    rows = rows.cache()
    found = []
    for values in product(*grid.values()):
        params, scores = dict(zip(grid, values, strict=True)), []
        for k in range(folds):
            train, test = rows.where(F.col(fold_col) != k).drop(fold_col), rows.where(F.col(fold_col) == k).drop(fold_col)
            fitted = make(**params).fit(train)
            scores.append(score(fitted.predict(test, key), fitted.labels))
        found.append((float(np.mean(scores)), params))
    rows.unpersist()
    best = max(found, key=lambda x: x[0])[1]
    edges = [n for n, v in grid.items() if len(v) > 2 and best[n] in (v[0], v[-1])]
    return Search(best, found, edges)


def coordinate_search(make: Callable[..., Classifier], rows: DataFrame, grid: Mapping[str, Sequence[Any]], at_defaults: bool = False, **options: Any) -> Search:
    """One parameter after the other, then the neighbourhood of what was found, all parameters together.

    Each is searched at the best values of those before or, with ``at_defaults``, with all others at their defaults.
    """
    best: dict[str, Any] = {}
    scores: list = []
    for name, values in grid.items():
        fixed = {} if at_defaults else dict(best)
        found = grid_search(lambda fixed=fixed, **p: make(**fixed, **p), rows, {name: values}, **options)
        best[name] = found.best[name]
        scores += found.scores
    around = {n: [v[i] for i in range(max(0, list(v).index(best[n]) - 1), min(len(v), list(v).index(best[n]) + 2))] for n, v in grid.items()}
    last = grid_search(make, rows, around, **options)
    return Search(last.best, scores + last.scores, last.warnings)


def run_classifiers(rows: DataFrame, names: Sequence[str], fraction: float = 0.3, train_ids: DataFrame | None = None, scale: bool = True, which: int = 0, tune: bool = False, output: str | None = None, key: str = "object_id", seed: int = 0) -> dict[str, dict]:
    """Split, scale, fit and evaluate: per classifier its AUC, figure of merit, accuracy and confusion.

    ``output`` receives probabilities, curves and figures as parquet.
    """
    data = standardised(rows) if scale else rows
    train, test = split(data.select(key, "label", "features"), fraction, train_ids, key, seed)
    train, test = train.cache(), test.cache()
    out: dict[str, dict] = {}
    for name in names:
        make = CLASSIFIERS[name]
        grid = make().grid if tune else {}
        params = grid_search(make, train, grid, key=key).best if grid else {}
        fitted = make(**params).fit(train)
        told = fitted.predict(test, key).cache()
        scored = told.select(F.col("probability")[which].alias("probability"), (F.col("label") == fitted.labels[which]).alias("positive"))
        curve = M.roc(scored)
        named = told.withColumnRenamed("label", "y_true")
        out[name] = {"auc": score_auc(told, fitted.labels, which), "fom": M.figure_of_merit(scored).first()["fom"], "accuracy": score_accuracy(told, fitted.labels), "params": params, "confusion": M.confusion(named.select("y_true", "y_pred"), "true").collect()}
        if output:
            told.write.mode("overwrite").parquet(f"{output}/{name}/probabilities")
            curve.write.mode("overwrite").parquet(f"{output}/{name}/roc")
        told.unpersist()
    return out
