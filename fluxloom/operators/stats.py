"""Statistics of light curves: lengths, gaps, counts around the peak, backgrounds, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.preprocess import in_time, redshift


def lengths(obs: DataFrame, key: str = "object_id") -> DataFrame:
    return obs.groupBy(key).agg((F.max("mjd") - F.min("mjd")).alias("length"))


def longest(obs: DataFrame, key: str = "object_id") -> DataFrame:
    return lengths(obs, key).agg(F.max("length").alias("max_length"))


def class_counts(objects: DataFrame, label: str = "target") -> DataFrame:
    counted = objects.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def _gaps(obs: DataFrame, key: str, tie: tuple) -> DataFrame:
    return obs.select(key, (F.col("mjd") - F.lag("mjd").over(in_time(key, tie))).alias("gap"))


def median_night_gap(obs: DataFrame, key: str = "object_id", shortest: float = 0.5, tie: tuple = ("event_id",)) -> DataFrame:
    """The median of an object's gaps of at least ``shortest`` days, null where it has none."""
    return _gaps(obs, key, tie).groupBy(key).agg(F.median(F.when(F.col("gap") >= shortest, F.col("gap"))).alias("median_gap"))


def gap_counts(obs: DataFrame, threshold: float, key: str = "object_id", tie: tuple = ("event_id",)) -> DataFrame:
    """Each object's longest gap and its number of gaps above ``threshold``; null for a single observation."""
    found = _gaps(obs, key, tie).groupBy(key).agg(F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > threshold).alias("_n"))
    return found.select(key, "max_gap", F.when(F.col("max_gap").isNotNull(), F.col("_n")).alias("n_gaps"))


def peak_times(rows: DataFrame, key: str = "object_id") -> DataFrame:
    """The time of the highest flux over all bands, the earliest on ties."""
    return rows.groupBy(key).agg(F.min_by("mjd", F.struct(-F.col("flux"), F.col("mjd"))).alias("peak_mjd"))


def counts_around_peak(obs: DataFrame, peaks: DataFrame, objects: DataFrame, days: float = 10.0, key: str = "object_id") -> DataFrame:
    """Observations within ``days`` before and after the peak, in the observer's time and in the object's own."""
    z = redshift(F.when(F.col("hostgal_specz") >= 0, F.col("hostgal_specz")), F.col("hostgal_photoz"), None)
    rows = obs.select(key, "mjd").join(peaks, key).join(objects.select(key, z.alias("z")), key)
    since = F.col("mjd") - F.col("peak_mjd")
    own = since / (1 + F.col("z"))
    before = lambda t: F.count_if((t >= -days) & (t < 0))
    after = lambda t: F.count_if((t >= 0) & (t < days))
    return rows.groupBy(key).agg(before(since).alias("n_before"), after(since).alias("n_after"), before(own).alias("n_before_rest"), after(own).alias("n_after_rest"))


def biweight_step(obs: DataFrame, key: str = "object_id", tuning: float = 6.0) -> DataFrame:
    """(key, filter, background): one step of the biweight location of the flux from its median."""
    by = [key, "filter"]
    middle = obs.groupBy(*by).agg(F.median("flux").alias("_m"))
    off = obs.join(middle, by).withColumn("_d", F.abs(F.col("flux") - F.col("_m")))
    spread = off.groupBy(*by).agg(F.median("_d").alias("_s"))
    u = (F.col("flux") - F.col("_m")) / (tuning * F.col("_s"))
    weight = F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
    rows = off.join(spread, by).withColumn("_w", F.when(F.col("_s") > 0, weight).otherwise((F.col("_d") == 0).cast("double")))
    return rows.groupBy(*by).agg((F.first("_m") + F.sum(F.col("_w") * (F.col("flux") - F.col("_m"))) / F.sum("_w")).alias("background"))


def subtract_background(obs: DataFrame, key: str = "object_id") -> DataFrame:
    levels = biweight_step(obs, key)
    return obs.join(levels, [key, "filter"]).withColumn("flux", F.col("flux") - F.col("background")).drop("background")


def invalid_count(objects: DataFrame, obs: DataFrame, key: str = "object_id") -> DataFrame:
    """One row: how many objects have no observation."""
    return objects.join(obs.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_invalid"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
