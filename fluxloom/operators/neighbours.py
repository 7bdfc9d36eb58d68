"""Exact nearest rows by a metric index.

Up to ``max_pivots`` pivots are picked far apart in a bounded sample of the rows; every row belongs to the cell of its nearest
pivot. For each cell and each pivot the index holds the least and the greatest distance of the cell's rows to the pivot. By the
triangle inequality no row of a cell is nearer to a query than the query's distance to a pivot lies outside that range, so each
query visits the first cell by this bound, and then all cells whose bounds are not above its k-th distance.

Rows with one vector are one entry that holds its k least keys, which is exact since ties go by key; so copies are compared
once. Cells lie on shelves of some sixteen times ``block`` entries, and a query is sent once to a shelf, however many of its cells it
must see; queries of a shelf are cut into as many at most, so a task holds two such parts. Rounds are written as Parquet: a checkpoint keeps
the size estimated for its plan, and products of estimates from round to round fill the driver.
With ``group`` a query sees rows of its own group only. Rows without a vector are not found and find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.runtime import Scratch, broadcast_if_small, materialised

_CHUNK, _COLUMNS = 256, 1024


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of a sample, each as far as can be from those before; fewer where rows are equal."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of the rows of ``a`` and ``b``, by inner products: right to about 1e-7 of the lengths."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def nearest_of(asked: np.ndarray, known: np.ndarray, k: int, most: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``asked`` the places of its ``k`` nearest of ``known``, with ties, and their distances.

    One product of the rows with a last column of 1 and of squared lengths gives squared distances but for the query's length. It is
    made in blocks that stay near the processor; what is within a query's bound, with room for rounding, is a candidate. ``most``
    bounds the distances that matter, and a block with many candidates lowers the bound to its own k-th distance. Distances
    of the candidates that are left are then taken exactly.
    """
    square = (known**2).sum(axis=1)
    size, wide = np.sqrt(square.max(initial=0.0)), np.column_stack([-2 * known, square])
    products, close = np.empty(_CHUNK * _COLUMNS), np.empty(_CHUNK * _COLUMNS, bool)
    for start in range(0, len(asked), _CHUNK):
        part = asked[start : start + _CHUNK]
        own = (part**2).sum(axis=1)
        room = 1e-6 * (1.0 + size + np.sqrt(own))
        limit = np.full(len(part), np.inf) if most is None else (most[start : start + _CHUNK] + room) ** 2 - own
        left, found = np.column_stack([part, np.ones(len(part))]), []

        def lowered(rows: np.ndarray, kth: np.ndarray, own=own, room=room, limit=limit) -> None:
            limit[rows] = np.minimum(limit[rows], (np.sqrt(np.maximum(kth + own[rows], 0.0)) + room[rows]) ** 2 - own[rows])

        for first in range(0, len(known), _COLUMNS):
            block = wide[first : first + _COLUMNS]
            shape = len(part), len(block)
            rough, near = (v[: shape[0] * shape[1]].reshape(shape) for v in (products, close))
            np.matmul(left, block.T, out=rough)
            if rough.shape[1] > k and len(open_ := np.flatnonzero(np.isinf(limit))):
                lowered(open_, np.partition(rough[open_], k - 1, axis=1)[:, k - 1])
            at = np.flatnonzero(np.less_equal(rough, limit[:, None], out=near))
            row = at // rough.shape[1]
            many = np.flatnonzero(np.bincount(row, minlength=len(part)) > 8 * k)
            if len(many):
                lowered(many, np.partition(rough[many], k - 1, axis=1)[:, k - 1])
            value = rough.ravel()[at]
            kept = value <= limit[row]
            found.append((row[kept], at[kept] % rough.shape[1] + first, value[kept]))
        row, place, value = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        order = np.argsort(row, kind="stable")
        row, place, value = row[order], place[order], value[order]
        ends = np.searchsorted(row, np.arange(len(part) + 1))
        for i in range(len(part)):
            at, rough = place[ends[i] : ends[i + 1]], value[ends[i] : ends[i + 1]]
            if len(at) > k:
                kth = np.partition(rough, k - 1)[k - 1]
                at = at[rough <= (np.sqrt(max(kth + own[i], 0.0)) + room[i]) ** 2 - own[i]]
            yield start + i, at, np.sqrt(((known[at] - part[i]) ** 2).sum(axis=1))


def queries_of_part(visits: int, room: int, partitions: int) -> int:
    """How many queries of a shelf are one part: few enough for all partitions to have work, from ``room`` / 8 to ``room``."""
    return max(1, room // 8, min(room, math.ceil(visits / max(1, partitions))))


class MetricIndex:
    """The rows of ``train`` (key, label, features) by cells; ``keep`` is the greatest k that will be asked for."""

    def __init__(self, train: DataFrame, keep: int, key: str = "object_id", label: str = "label", column: str = "features", group: str | None = None, block: int = 4096, cell_rows: int = 1024, max_pivots: int = 256, sample: int = 4096):
        self.keep, self.room, self.scratch = keep, 16 * block, Scratch(train.sparkSession, "neighbours")
        rows = train.where(F.col(column).isNotNull()).select(F.col(key).alias("other"), F.col(label).alias("y"), F.col(column).cast("array<double>").alias("x"), (F.col(group) if group else F.lit(0)).alias("g"))
        self.kinds = dict(rows.dtypes)
        # the least keys of each vector: the limit is taken in the tasks before the shuffle too
        first = F.row_number().over(W.partitionBy("g", "x").orderBy("other"))
        held = self.scratch.written(rows.withColumn("_r", first).where(F.col("_r") <= keep).drop("_r"))
        count = held.count()
        drawn = held.orderBy(F.xxhash64("x")).limit(sample).select("x").collect()  # at most ``sample`` rows
        self.pivots = spread_pivots(np.array([r.x for r in drawn], float).reshape(len(drawn), -1 if drawn else 0), max(1, min(max_pivots, math.ceil(count / cell_rows))))
        pivots = self.pivots

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = np.concatenate([_distances(x, pivots) for x in np.array_split(np.stack(pdf["x"].to_numpy()), 1 + len(pdf) // 1024)])
                    yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), away=list(d))

        schema = ", ".join(f"`{n}` {t}" for n, t in self.kinds.items())
        cells = self.scratch.written(held.mapInPandas(placed, f"{schema}, cell int, away array<double>"))
        ranges = cells.select("cell", F.posexplode("away").alias("pivot", "d")).groupBy("cell", "pivot").agg(F.min("d").alias("low"), F.max("d").alias("high")).collect()  # pivots squared
        self.low, self.high = np.full((len(pivots), len(pivots)), np.inf), np.full((len(pivots), len(pivots)), -np.inf)
        for r in ranges:
            self.low[r.cell, r.pivot], self.high[r.cell, r.pivot] = r.low, r.high
        # cells side by side, one for each pivot and group at most, share a shelf of some ``room`` entries; a larger cell is cut
        ahead = F.sum("size").over(W.partitionBy("g").orderBy("cell")) - F.col("size")
        sizes = cells.groupBy("g", "cell").agg(F.count("*").alias("size")).withColumns({"blocks": F.ceil(F.col("size") / self.room).cast("int"), "shelf": F.floor(ahead / self.room).cast("int")})
        self.sizes = sizes = self.scratch.written(sizes)
        near = cells.drop("away").join(broadcast_if_small(sizes), ["g", "cell"])
        self.entries = self.scratch.written(near.withColumn("b", F.pmod(F.xxhash64("other", F.lit(3)), F.col("blocks")).cast("int")).select("g", "cell", "shelf", "b", "other", "y", "x"))
        self.evaluated = 0

    def _next(self, queries: DataFrame, seen: int, more: int, schema: str) -> DataFrame:
        """Queries with the cells that they visit next, in the order of the bounds, from place ``seen`` on."""
        pivots, low, high = self.pivots, self.low, self.high
        slack = 1e-6 * (1.0 + float(np.sqrt((pivots**2).sum(axis=1).max(initial=0.0))))

        def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(pivots):
                    continue
                q, most, cells = np.stack(pdf["q"].to_numpy()), pdf["most"].to_numpy(float), []
                away = _distances(q, pivots)
                room = slack + 1e-6 * np.sqrt((q**2).sum(axis=1))
                for a, limit, r in zip(away, most, room, strict=True):
                    bound = np.maximum(a[None] - high, low - a[None]).max(axis=1)
                    order = np.lexsort((a, bound))[seen : seen + more]
                    cells.append(order[bound[order] <= limit + r].tolist())
                yield pdf.assign(cells=cells)

        return queries.mapInPandas(visited, f"{schema}, cells array<int>").select("*", F.explode("cells").alias("cell")).drop("cells")

    def nearest(self, test: DataFrame, k: int, key: str = "object_id", column: str = "features", group: str | None = None) -> DataFrame:
        """(key, other, y, d): the ``k`` nearest rows of every row of ``test``, of equal distances those of the least keys."""
        if k > self.keep:
            raise ValueError(f"the index keeps {self.keep} rows of a vector")
        kind = dict(test.dtypes)[key]
        asked = test.where(F.col(column).isNotNull()).select(F.col(key).alias("name"), F.col(column).cast("array<double>").alias("q"), (F.col(group) if group else F.lit(0)).alias("g"))
        queries = self.scratch.written(asked.withColumn("most", F.lit(float("inf"))))
        schema = f"name {kind}, q array<double>, g {self.kinds['g']}, most double"
        out = f"name {kind}, other {self.kinds['other']}, y {self.kinds['y']}, d double"

        def meet(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            found = {c: [] for c in ("name", "other", "y", "d")}
            if len(asked) and len(known):
                known = known.sort_values("other", kind="stable")
                ids, y, names = known["other"].to_numpy(), known["y"].to_numpy(), asked["name"].to_numpy()
                q, x, most = np.stack(asked["q"].to_numpy()), np.stack(known["x"].to_numpy()), asked["most"].to_numpy(float)
                where = known["cell"].to_numpy()
                wanted, of = np.concatenate(asked["cells"].to_numpy()), np.repeat(np.arange(len(asked)), [len(c) for c in asked["cells"]])
                near: list[list] = [[] for _ in names]
                if 2 * len(wanted) > len(names) * len(np.unique(where)):  # most of the cells are wanted: all of them at once
                    parts = [(np.arange(len(names)), np.arange(len(ids)))]
                else:
                    parts = [(of[wanted == c], np.flatnonzero(where == c)) for c in np.unique(where)]
                for rows, places in parts:
                    for i, at, d in nearest_of(q[rows], x[places], k, most[rows]):
                        best = np.argsort(d, kind="stable")[:k]
                        near[rows[i]].append((places[at[best]], d[best]))
                for name, met_ in zip(names, near, strict=True):
                    if met_:
                        at, d = (np.concatenate(c) for c in zip(*met_, strict=True))
                        best = np.lexsort((at, d))[:k]
                        found["name"] += [name] * len(best)
                        found["other"] += ids[at[best]].tolist()
                        found["y"] += y[at[best]].tolist()
                        found["d"] += d[best].tolist()
            return pd.DataFrame({c: pd.Series(v, dtype=float if c == "d" else object) for c, v in found.items()})

        by = ["g", "shelf", "b"]
        # the first cell bounds the distances that matter; all that are within reach, the first again, then give the nearest
        for last, more in ((False, 1), (True, max(1, len(self.pivots)))):
            visits = self._next(queries, 0, more, schema).select("name", "g", "cell").join(self.sizes, ["g", "cell"])
            visits = self.scratch.written(visits.select("name", "g", "cell", "size", "blocks", "shelf"))
            self.evaluated += visits.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            sent = visits.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy("name", *by).agg(F.collect_list("cell").alias("cells"))
            sent = self.scratch.written(sent)
            share = queries_of_part(sent.count(), self.room, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            crowd = materialised(sent.groupBy(*by).agg(F.ceil(F.count("*") / share).cast("int").alias("salts")))
            ask = sent.join(queries, ["name", "g"]).join(broadcast_if_small(crowd), by).withColumn("s", F.pmod(F.xxhash64("name", F.lit(5)), F.col("salts")).cast("int"))
            ask = ask.select("name", "q", "most", *by, "s", "cells")
            fit = self.entries.join(broadcast_if_small(crowd), by).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
            met = ask.groupBy(*by, "s").cogroup(fit.groupBy(*by, "s")).applyInPandas(meet, out)
            ranked = met.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("d", "other"))).where(F.col("_r") <= k).drop("_r")
            best = self.scratch.written(ranked)
            if last:
                break
            kth = best.groupBy("name").agg(F.count("*").alias("n"), F.max("d").alias("far")).where(F.col("n") >= k).select(F.col("name").alias("_n"), "far")
            told = queries.drop("most").join(kth, F.col("name") == F.col("_n"), "left")
            queries = self.scratch.written(told.select("name", "q", "g", F.coalesce("far", F.lit(float("inf"))).alias("most")))
        return best.withColumnRenamed("name", key)


def nearest_rows(train: DataFrame, test: DataFrame, k: int, key: str = "object_id", label: str = "label", column: str = "features", block: int = 4096, group: str | None = None, **index: int) -> DataFrame:
    """(key, other, y, d): the ``k`` nearest training rows of every test row, exactly; with ``group``, of the same group.

    ``index``: cell_rows, max_pivots, sample (see ``MetricIndex``).
    """
    made = MetricIndex(train, k, key, label, column, group, block, **index)
    found = materialised(made.nearest(test, k, key, column, group))
    made.scratch.remove()
    return found
