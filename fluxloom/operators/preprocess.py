"""Cleaning light curves in time. All windows share the object key, so a chain of these costs one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _object(key: str) -> W:
    return W.partitionBy(key)


def in_time(key: str = "object_id", tie: Sequence[str] = ("event_id",)):
    """An object's observations by time; equal times by ``tie``."""
    return W.partitionBy(key).orderBy("mjd", *tie)


def rezero(obs: DataFrame, key: str = "object_id") -> DataFrame:
    """Times counted from each object's first observation."""
    return obs.withColumn("mjd", F.col("mjd") - F.min("mjd").over(_object(key)))


def select_window(obs: DataFrame, t_min: float | None = None, t_max: float | None = None) -> DataFrame:
    """Observations strictly after ``t_min`` and strictly before ``t_max``; at least one of them is needed."""
    if t_min is None and t_max is None:
        raise ValueError("a window needs a start or an end")
    for limit, keep in ((t_min, lambda v: F.col("mjd") > v), (t_max, lambda v: F.col("mjd") < v)):
        obs = obs if limit is None else obs.where(keep(limit))
    return obs


def select_transients(obs: DataFrame, max_distance: float, key: str = "object_id") -> DataFrame:
    """Observations strictly within ``max_distance`` days of the span of detections, counted anew from the first.

    Objects with fewer than two detections keep all observations.
    """
    w = _object(key)
    seen = F.when(F.col("detected"), F.col("mjd"))
    marked = obs.withColumns({"_n": F.count(seen).over(w), "_a": F.min(seen).over(w), "_b": F.max(seen).over(w)})
    near = (F.col("mjd") > F.col("_a") - max_distance) & (F.col("mjd") < F.col("_b") + max_distance)
    return rezero(marked.where((F.col("_n") < 2) | near).drop("_n", "_a", "_b"), key)


def remove_gap(obs: DataFrame, max_gap: float, key: str = "object_id", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Cut each object at its first gap of ``max_gap`` days or more and keep one side, counted anew from its first.

    Only objects with a gap above ``max_gap`` are cut. The side with more detections stays; on a tie the one with more
    observations; on a further tie the earlier one.
    """
    w = _object(key)
    gap = F.lead("mjd").over(in_time(key, tie)) - F.col("mjd")
    marked = obs.withColumn("_gap", gap).withColumns({"_most": F.max("_gap").over(w), "_cut": F.min(F.when(F.col("_gap") >= max_gap, F.col("mjd"))).over(w)})
    early = F.col("mjd") <= F.col("_cut")
    tally = lambda side: F.struct(F.count(F.when(side & F.col("detected"), 1)).over(w), F.count(F.when(side, 1)).over(w))
    marked = marked.withColumn("_early", tally(early) >= tally(~early))
    kept = F.coalesce(F.col("_most") <= max_gap, F.lit(True)) | (early == F.col("_early"))
    return rezero(marked.where(kept).drop("_gap", "_most", "_cut", "_early"), key)


def remove_gaps(obs: DataFrame, gaps: Sequence[float], key: str = "object_id", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """One ``remove_gap`` for each threshold in turn; a usual choice is twice 2g and three times g."""
    for gap in gaps:
        obs = remove_gap(obs, gap, key, tie)
    return obs


def in_time_range(obs: DataFrame, t_min: float, t_max: float) -> DataFrame:
    """One row: whether every observation lies in the closed range."""
    return obs.agg(F.coalesce(F.bool_and(F.col("mjd").between(t_min, t_max)), F.lit(True)).alias("in_range"))


def detected_bit(photflag: Column, bit: int = 12) -> Column:
    """The detection bit of a photometry flag."""
    return F.shiftright(photflag, bit).bitwiseAND(F.lit(1)) == 1


def redshift(specz: Column, photoz: Column, missing: float | None = -9.0) -> Column:
    """The spectroscopic redshift where there is one, else the photometric one."""
    good = F.when(~F.isnan(specz), specz)
    return F.coalesce(good if missing is None else F.when(good != missing, good), photoz)


def fold_type(code: Column) -> Column:
    """Sub-types collapsed to their class: 20 to 29 are 2, 30 to 39 are 3."""
    tens = F.floor(code / 10)
    return F.when(tens == 2, 2).when(tens == 3, 3).otherwise(code).cast("int")


def plain_target(target: Column) -> Column:
    """Codes above 100 mark photometric copies of the class below."""
    return F.when(target > 100, target - 100).otherwise(target)
