"""Metrics of classifiers as aggregations over predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.ordering import ranked
from fluxloom.runtime import broadcast_if_small, materialised

def _tallies(rows: DataFrame, thresholds: Sequence[float], strict: bool, by: Sequence[str]) -> DataFrame:
    """(by, t, threshold, tp, fp, fn, tn) for every threshold, from one pass.

    Each row falls into the step of the ladder of thresholds that it just passes; running sums from the top give the
    counts at every threshold.
    """
    ladder = F.array(*[F.lit(float(t)) for t in thresholds])
    # the probability is bound once for a row; inside the inner lambda its expression would run for every threshold
    passed = F.transform(F.array("probability"), lambda p: F.size(F.filter(ladder, lambda t: (p > t) if strict else (p >= t))))[0]
    steps = rows.groupBy(*by, passed.alias("_step")).agg(F.count_if("positive").alias("_p"), F.count_if(~F.col("positive")).alias("_n"))
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    spine = groups.select(*by, F.posexplode(ladder).alias("t", "threshold"))
    spine, steps = spine.alias("g"), steps.alias("s")
    # steps has at most one row for each group and threshold
    same = [F.col(f"g.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by] or F.lit(True)
    joined = spine.join(steps, same, "left")
    above = F.col("s._step") > F.col("g.t")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(f"s.{c}"))), F.lit(0))
    keys = [F.col(f"g.{b}").alias(b) for b in by]
    return joined.groupBy(*keys, F.col("g.t").alias("t"), F.col("g.threshold").alias("threshold")).agg(total(above, "_p").alias("tp"), total(above, "_n").alias("fp"), total(~above, "_p").alias("fn"), total(~above, "_n").alias("tn"))


def roc(rows: DataFrame, n_thresholds: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, threshold, fpr, tpr) of rows with probability and positive; a row is called if it reaches the threshold."""
    found = _tallies(rows, np.linspace(0, 1, n_thresholds), False, by)
    rate = lambda a, b: F.when(F.col(a) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return found.select(*by, "t", "threshold", rate("fp", "tn").alias("fpr"), rate("tp", "fn").alias("tpr"))


def auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The trapezoid area under ``roc``."""
    w = W.partitionBy(*by).orderBy(F.col("t").desc())
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    parts = curve.select(*by, area.alias("_a"))
    return (parts.groupBy(*by) if by else parts).agg(F.sum("_a").alias("auc"))


def _best(scored: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    top = F.min_by(F.struct("threshold", value), F.struct(-F.col(value), F.col("t"))).alias("_b")
    return (scored.groupBy(*by) if by else scored).agg(top).select(*by, "_b.threshold", f"_b.{value}")


def best_f1(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The highest F1 over the thresholds 0 to 0.99, and the first threshold that gives it; calls are strict."""
    found = _tallies(rows, [i / 100 for i in range(100)], True, by)
    return _best(found.withColumn("f1", F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))), "f1", by)


def figure_of_merit(rows: DataFrame, penalty: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """The highest efficiency times purity with false positives weighted by ``penalty``."""
    found = _tallies(rows, [i / 100 for i in range(100)], True, by)
    tp = F.col("tp").cast("double")
    return _best(found.withColumn("fom", F.when(F.col("tp") == 0, 0.0).otherwise(tp * tp / (F.col("tp") + F.col("fn")) / (F.col("tp") + penalty * F.col("fp")))), "fom", by)


#: Weights of the photometric challenge's classes.
CLASS_WEIGHTS = {
    6: 1 / 18, 15: 1 / 9, 16: 1 / 18, 42: 1 / 18, 52: 1 / 18, 53: 1 / 18, 62: 1 / 18, 64: 1 / 9, 65: 1 / 18,
    67: 1 / 18, 88: 1 / 18, 90: 1 / 18, 92: 1 / 18, 95: 1 / 18, 99: 1 / 19, 1: 1 / 18, 2: 1 / 18, 3: 1 / 18,
}


def weighted_log_loss(rows: DataFrame, labels: Sequence[int], weights: Mapping[int, float] = CLASS_WEIGHTS, eps: float = 2.0**-52) -> DataFrame:
    """One row: the log-loss of (y_true, probability array in the order of ``labels``), each class weighing its weight."""
    clipped = F.transform("probability", lambda p: F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("y_true")).cast("int")
    rows = rows.withColumn("_p", clipped).withColumn("_l", F.ln(F.element_at("_p", place) / total(F.col("_p"))))
    means = rows.groupBy("y_true").agg(F.avg("_l").alias("_m"))
    weight = F.element_at(F.create_map(*[F.lit(x) for k in labels for x in (k, float(weights[k]))]), F.col("y_true"))
    return means.agg((-F.sum(F.col("_m") * weight) / F.sum(weight)).alias("log_loss"))


def confusion(rows: DataFrame, normalise: str | None = None) -> DataFrame:
    """(y_true, y_pred, n, share): ``share`` of the true class ('true'), of the predicted ('pred') or of all."""
    counted = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    over = {"true": W.partitionBy("y_true"), "pred": W.partitionBy("y_pred"), None: W.partitionBy()}[normalise]
    return counted.withColumn("share", F.col("n") / F.sum("n").over(over))


def confusion_matrix(rows: DataFrame, labels: Sequence) -> DataFrame:
    """The confusion counts with one column for each predicted label."""
    return rows.groupBy("y_true").pivot("y_pred", list(labels)).count().na.fill(0)


def in_bin(value: Column, edges: Sequence[float]) -> Column:
    """The place of the half-open bin that holds a value, null outside."""
    place = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        place = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(place)
    return place


def _share_by_bin(rows: DataFrame, value: str, edges: Sequence[float], label: str, name: str) -> DataFrame:
    binned = rows.withColumn("bin", in_bin(F.col(value), edges)).where("bin IS NOT NULL")
    return binned.groupBy("bin", F.col(label).alias("label")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias(name), F.count("*").alias("n"))


def recall_by_bin(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    return _share_by_bin(rows, value, edges, "y_true", "recall")


def precision_by_bin(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    return _share_by_bin(rows, value, edges, "y_pred", "precision")


def percentile_interval(rows: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(by, low, high): the central interval of a value, interpolated linearly.

    Values are ranked over all partitions and those beside the two places are read, so no task holds a group's values.
    """
    tail, keys = (1 - level) / 2, list(by)
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # equal values may stand in any order: a lot spreads them over partitions
    held = ranked(values.withColumn("_lot", F.xxhash64(F.monotonically_increasing_id())), keys, [F.col("_v"), F.col("_lot")]).drop("_lot")
    sizes = held.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))

    def end(share: float) -> Column:
        """Each value's weight is how near it is to the place, within one."""
        near = F.greatest(1 - F.abs(F.col("_r") - (F.col("_n") - 1) * share), F.lit(0.0))
        return F.sum(F.when(near > 0, near * F.col("_v")))

    joined = held.join(broadcast_if_small(materialised(sizes)), same)
    return (joined.groupBy(*keys) if keys else joined).agg(end(tail).alias("low"), end(1 - tail).alias("high"))


def bootstrap_interval(rows: DataFrame, value: str, edges: Sequence[float], label: str, resamples: int = 300, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(bin, label, share, low, high): the share of right calls by bin with its bootstrap interval.

    A resample of n right-or-wrong flags is a binomial count of n draws at the observed share, so only the two counts of
    each bin reach the resampler, whatever the number of rows. A bin without rows does not appear.
    """
    binned = rows.withColumn("bin", in_bin(F.col(value), edges)).where("bin IS NOT NULL")
    right = F.sum((F.col("y_true") == F.col("y_pred")).cast("long"))
    counted = binned.groupBy("bin", F.col(label).cast("long").alias("label")).agg(right.alias("right"), F.count("*").alias("n"))

    def resampled(batches):
        for pdf in batches:
            low, high = [], []
            for b, lab, r, n in pdf[["bin", "label", "right", "n"]].itertuples(index=False):
                draws = np.random.default_rng([seed, int(b), int(lab) & 0x7FFFFFFF]).binomial(n, r / n, resamples) / n
                ends = np.percentile(draws, [50 - 50 * level, 50 + 50 * level])
                low.append(ends[0])
                high.append(ends[1])
            yield pd.DataFrame({"bin": pdf["bin"], "label": pdf["label"], "share": pdf["right"] / pdf["n"], "low": low, "high": high})

    return counted.mapInPandas(resampled, "bin int, label long, share double, low double, high double")
