"""Ranks and running sums in a global order, made without gathering rows in one task.

Rows are range-sorted, written, and numbered inside their partitions; counts and sums of the partitions before lift these
to the whole order. Windows span the rows of one partition, or one row for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.runtime import broadcast_if_small, materialised

_LOW33 = (1 << 33) - 1


def in_order(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` range-sorted and written, with part and place: the partition and the place in it."""
    at = F.monotonically_increasing_id()
    ordered = materialised(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    return ordered.withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit(_LOW33))}).drop("at")


def running_sums(rows: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """``rows`` with the sum of each of ``values`` over the rows before in ``order``."""
    ordered = in_order(rows, order).withColumns({f"_{n}": v for n, v in values.items()})
    parts = ordered.groupBy("part").agg(*[F.sum(f"_{n}").alias(f"all_{n}") for n in values])
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(f"all_{n}").over(every), F.lit(0)).alias(f"ahead_{n}") for n in values])
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    held = ordered.withColumns({f"_{n}": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in values}).join(parts, "part")
    return held.withColumns({n: F.col(f"_{n}") + F.col(f"ahead_{n}") for n in values}).drop("part", "place", *[f"{x}_{n}" for n in values for x in ("", "ahead")])


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "_r") -> DataFrame:
    """``rows`` with their place, from 0, in ``order`` among those of equal ``by``; null is a value of its own.

    A group of any size is spread over partitions; of a group only one count for each partition meets.
    """
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), *[F.col(b).alias(f"by{i}") for i, b in enumerate(by)], *[_plain(o).alias(f"o{i}") for i, o in enumerate(order)])
    keys, ways = [f"by{i}" for i in range(len(by))], [F.col(f"o{i}") for i in range(len(order))]
    ordered = in_order(packed, [F.col(k).asc_nulls_last() for k in keys] + ways)
    parts = ordered.groupBy(*keys, "part").agg(F.count("*").alias("held"), F.min("place").alias("first"))
    ahead = F.sum("held").over(W.partitionBy(*keys).orderBy("part")) - F.col("held")
    parts = materialised(parts.select(*[F.col(k).alias(f"at_{k}") for k in keys], F.col("part").alias("at_part"), (ahead - F.col("first")).alias("lift")))
    same = F.col("part") == F.col("at_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"at_{k}"))
    return ordered.join(broadcast_if_small(parts), same).select("row.*", (F.col("place") + F.col("lift")).alias(name))


def _plain(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order
