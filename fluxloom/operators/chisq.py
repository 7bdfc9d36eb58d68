"""Goodness of fit of models on a grid to observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names under which a passband column is accepted.
PASSBAND_NAMES = ("passband", "pb", "filter")


def passband_column(df: DataFrame, name: str | None = None) -> DataFrame:
    """``df`` with its passband column called ``passband``."""
    for c in (name,) if name else PASSBAND_NAMES:
        if c in df.columns:
            return df.withColumnRenamed(c, "passband")
    raise ValueError("no passband column")


def on_model_linear(obs: DataFrame, models: DataFrame, key: str = "object_id") -> DataFrame:
    """``obs`` with model_flux, linear between the two grid points around it; rows outside the grid are left out.

    The grid of an object's band is regular, so a row's interval is found by division and the join is an equi-join.
    """
    by = [key, "filter"]
    span = W.partitionBy(*by)
    grid = models.select(*by, F.col("mjd").alias("_x"), F.col("flux").alias("_y"))
    along = span.orderBy("_x")
    steps = grid.withColumns({"_i": F.row_number().over(along) - 1, "_x1": F.lead("_x").over(along), "_y1": F.lead("_y").over(along)}).where("_x1 IS NOT NULL")
    frame = grid.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (F.count("*") - 1).alias("_n"))
    at = F.least(F.floor((F.col("mjd") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.col("_n"))), F.col("_n") - 1).cast("int")
    placed = obs.join(frame, by).where((F.col("mjd") >= F.col("_lo")) & (F.col("mjd") <= F.col("_hi")) & (F.col("_n") > 0)).withColumn("_i", at)
    flux = F.col("_y") + (F.col("_y1") - F.col("_y")) * (F.col("mjd") - F.col("_x")) / (F.col("_x1") - F.col("_x"))
    return placed.join(steps, [*by, "_i"]).withColumn("model_flux", flux).drop("_lo", "_hi", "_n", "_i", "_x", "_y", "_x1", "_y1")


def spline_not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y) whose first and last two pieces are one polynomial each, at ``at``.

    Two points give a line and three a parabola.
    """
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, max(0, n - 1)), at)
    return splines_not_a_knot(x[None], y[None], at, np.zeros(len(at), int))


def splines_not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The splines through the rows of ``x`` and ``y``, of at least four points each: at ``at``, each by the spline ``row``, in order."""
    h = np.diff(x)
    d, (g, n) = np.diff(y) / h, x.shape
    a, b, i = np.zeros((g, n, n)), np.zeros((g, n)), np.arange(1, n - 1)
    a[:, i, i - 1], a[:, i, i], a[:, i, i + 1] = h[:, :-1], 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:]
    b[:, 1:-1] = 6 * (d[:, 1:] - d[:, :-1])
    a[:, 0, 0], a[:, 0, 1], a[:, 0, 2] = h[:, 1], -(h[:, 0] + h[:, 1]), h[:, 0]
    a[:, -1, -3], a[:, -1, -2], a[:, -1, -1] = h[:, -1], -(h[:, -2] + h[:, -1]), h[:, -2]
    m = np.linalg.solve(a, b[..., None])[..., 0]
    ends = np.cumsum(np.bincount(row, minlength=g))[:-1]
    piece = np.clip(np.concatenate([np.searchsorted(own, t, "right") for own, t in zip(x, np.split(at, ends), strict=True)]) - 1, 0, n - 2)
    low, high, h = (row, piece), (row, piece + 1), h[row, piece]
    t = at - x[low]
    return y[low] + t * (d[low] - h * (2 * m[low] + m[high]) / 6) + t**2 * m[low] / 2 + t**3 * (m[high] - m[low]) / (6 * h)


def on_model_cubic(obs: DataFrame, models: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, filter, mjd, flux, flux_error, model_flux) by the cubic interpolant, null outside the grid.

    A band's grid and times are one row of arrays, and many bands are solved at once.
    """
    by, values = [key, "filter"], ["mjd", "flux", "flux_error"]
    packed = obs.groupBy(*by).agg(F.collect_list(F.struct(*values)).alias("rows"))
    grid = models.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sort_array(F.collect_list(F.struct(F.col("mjd").alias("x"), F.col("flux").alias("y")))).alias("grid"))
    same = packed[key].eqNullSafe(grid[f"_{key}"]) & packed["filter"].eqNullSafe(grid["_filter"])
    each = packed.join(grid.hint("merge"), same, "left")

    @F.pandas_udf("array<double>")
    def on_grid(times: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = np.array([np.full(len(t), np.nan) for t in times] + [None], object)[:-1]
        lengths = np.array([0 if x is None else len(x) for x in xs], int)
        for n in np.unique(lengths[lengths > 1]):
            places = np.flatnonzero(lengths == n)
            for at in np.array_split(places, 1 + len(places) * n * n // 2_000_000):
                x, y = (np.stack(c.to_numpy()[at]).astype(float) for c in (xs, ys))
                row, t = np.repeat(np.arange(len(at)), [len(times[i]) for i in at]), np.concatenate([np.asarray(times[i], float) for i in at])
                found = splines_not_a_knot(x, y, t, row) if n > 3 else np.concatenate([spline_not_a_knot(a, b, t[row == i]) for i, (a, b) in enumerate(zip(x, y, strict=True))])
                found = np.where((t >= x[row, 0]) & (t <= x[row, -1]), found, np.nan)
                for i, part in zip(at, np.split(found, np.flatnonzero(np.diff(row)) + 1), strict=True):
                    out[i] = part
        return pd.Series(out)

    told = each.select(*by, "rows", on_grid("rows.mjd", "grid.x", "grid.y").alias("model"))
    rows = told.select(*by, F.explode(F.arrays_zip("rows", "model")).alias("r"))
    model = F.col("r.model")
    return rows.select(*by, *[F.col(f"r.rows.{v}").alias(v) for v in values], F.when(~F.isnan(model), model).alias("model_flux"))


def chisq(rows: DataFrame, by: list[str], key_error: str = "flux_error") -> DataFrame:
    """(by, chisq, n_points, chisq_over_pts) of rows with flux, an error other than zero and model_flux."""
    part = (F.col("flux") - F.col("model_flux")) / F.nullif(F.col(key_error), F.lit(0.0))
    found = rows.where(F.col("model_flux").isNotNull() & (F.col(key_error) != 0)).groupBy(*by).agg(F.sum(part * part).alias("chisq"), F.count("*").alias("n_points"))
    return found.withColumn("chisq_over_pts", F.col("chisq") / F.col("n_points"))


def chisq_per_label(per_object: DataFrame, objects: DataFrame, key: str = "object_id", label: str = "target") -> DataFrame:
    """Least, greatest and mean chi-square over points of each class."""
    c = F.col("chisq_over_pts")
    return per_object.join(objects.select(key, label), key).groupBy(label).agg(F.min(c).alias("least"), F.max(c).alias("greatest"), F.avg(c).alias("mean"), F.count("*").alias("n_objects"))


def log_histogram(rows: DataFrame, value: str, low: float, high: float, edges: int = 50) -> DataFrame:
    """(bin, n): counts between ``edges`` log-spaced edges, the last bin closed."""
    place = (F.log10(F.col(value)) - F.lit(float(np.log10(low)))) / F.lit(float(np.log10(high) - np.log10(low))) * (edges - 1)
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    return inside.groupBy(F.least(F.floor(place), F.lit(edges - 2)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


