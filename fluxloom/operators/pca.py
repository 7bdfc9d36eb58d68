"""Principal components of array columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def means_scales(df: DataFrame, column: str) -> DataFrame:
    """(i, mean, scale): each place's mean and the length of its centred column."""
    long = df.select(F.posexplode(column).alias("i", "x"))
    return long.groupBy("i").agg(F.avg("x").alias("mean"), F.sqrt(F.var_pop("x") * F.count("x")).alias("scale"))


def collected_means(df: DataFrame, column: str) -> list[float]:
    return [r[0] for r in means_scales(df, column).orderBy("i").select("mean").collect()]


def project(df: DataFrame, column: str, means: Sequence[float], scales: Sequence[float] | None, basis: Sequence[Sequence[float]], name: str) -> DataFrame:
    """``df`` with ``name``: (x - mean) / scale on each vector of the basis."""
    m, b = np.asarray(means, float), np.asarray(basis, float)
    s = np.ones_like(m) if scales is None else np.where(np.asarray(scales, float) > 0, np.asarray(scales, float), 1.0)

    @F.pandas_udf("array<double>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list((((np.stack(x.to_numpy()) - m) / s) @ b.T)) if len(x) else [])

    return df.withColumn(name, placed(F.col(column)))


class PcaModel(NamedTuple):
    means: np.ndarray
    scales: np.ndarray | None
    eigenvalues: np.ndarray
    vectors: np.ndarray

    def components(self, wanted: int | str | float | None = None) -> int:
        """A number, all of them, or (None) as many as explain 95 % of the variance."""
        if wanted == "all":
            return len(self.eigenvalues)
        if isinstance(wanted, int):
            return min(wanted, len(self.eigenvalues))
        running = np.cumsum(self.eigenvalues) / self.eigenvalues.sum()
        return int(np.searchsorted(running, (wanted or 0.95) - 1e-12) + 1)

    def transform(self, df: DataFrame, column: str, name: str = "reduced", wanted: int | str | None = None) -> DataFrame:
        return project(df, column, self.means, self.scales, self.vectors[: self.components(wanted)], name)

    def reconstruct(self, reduced: np.ndarray) -> np.ndarray:
        """Feature vectors from their projections: scales first, means last."""
        back = reduced @ self.vectors[: reduced.shape[1]]
        return back * (1.0 if self.scales is None else self.scales) + self.means

    def reconstructed(self, df: DataFrame, column: str, name: str) -> DataFrame:
        model = self

        @F.pandas_udf("array<double>")
        def back(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.reconstruct(np.stack(x.to_numpy()))) if len(x) else [])

        return df.withColumn(name, back(F.col(column)))

    def save(self, df: DataFrame, path: str) -> None:
        """The model as one row of JSON in the warehouse's file system."""
        row = json.dumps([self.means.tolist(), None if self.scales is None else self.scales.tolist(), self.eigenvalues.tolist(), self.vectors.tolist()])
        df.sparkSession.createDataFrame([(row,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> PcaModel:
        m, s, e, v = json.loads(spark.read.text(path).first()[0])
        return PcaModel(np.array(m), None if s is None else np.array(s), np.array(e), np.array(v))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """The largest component of every vector made positive."""
    at = np.abs(vectors).argmax(axis=1)
    return vectors * np.where(vectors[np.arange(len(vectors)), at] < 0, -1.0, 1.0)[:, None]


def fit_pca(df: DataFrame, column: str, normalise: bool = False, max_rows: int = 4096, max_width: int = 8192) -> PcaModel:
    """Fit on all rows.

    With fewer rows than places, and at most ``max_rows``, the matrix of inner products of the rows is solved; with at most
    ``max_width`` places partition sums of the products of places are. A matrix too large both ways is refused.
    """
    n, width = df.select(F.count(column), F.max(F.size(column))).first()
    if not n:
        raise ValueError("no rows")
    means = scales = None
    if n <= min(width, max_rows):
        x = np.array([r[0] for r in df.select(column).collect()])
        means = x.mean(axis=0)
        x = x - means
        if normalise:
            scales = np.sqrt((x * x).sum(axis=0))
            x = x / np.where(scales > 0, scales, 1.0)
        values, left = np.linalg.eigh(x @ x.T)
        order = np.argsort(values)[::-1][: max(1, n - 1)]
        values, left = np.maximum(values[order], 0), left[:, order]
        good = values > values[0] * 1e-12 if values[0] > 0 else np.ones(len(values), bool)
        values, left = values[good], left[:, good]
        vectors = (left.T @ x) / np.maximum(np.sqrt(values), 1e-300)[:, None]
        return PcaModel(means, scales, values / max(1, n - 1), _signed(vectors))
    if width > max_width:
        raise ValueError(f"{n} rows of {width} places: reduce one of them")
    means = np.array(collected_means(df, column))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column].to_numpy()) - means
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "v": list(total)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"][:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    kind = "i long, v array<double>"
    sums = df.select(column).mapInPandas(summed, kind).groupBy("i").applyInPandas(merge, kind)
    product = np.zeros((width, width))
    for i, v in sums.toLocalIterator():
        product[i] = v
    if normalise:
        scales = np.sqrt(np.diag(product))
        d = np.where(scales > 0, scales, 1.0)
        product = product / d[:, None] / d[None, :]
    values, vectors = np.linalg.eigh(product)
    order = np.argsort(values)[::-1]
    return PcaModel(means, scales, np.maximum(values[order], 0) / max(1, n - 1), _signed(vectors[:, order].T))
