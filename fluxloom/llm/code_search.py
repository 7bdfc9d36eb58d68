"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments. A round searches all segments for values at one more bit's distance from the
query's. After the rounds for 0 to r bits, every code within ``segments * (r + 1) - 1`` bits of a query has been met in
some segment, so a query whose k-th verified distance is at most that is done; the others go on. Segments are
nearly as long as the logarithm of the number of distinct codes, so a value holds few codes. A query's k-th distance
so far bounds what later rounds bring it. Queries that are far from nearly all codes would ask for more values than there are
codes: once a quarter as many are due, those still open are held against all codes in blocks, which is exact too.

Rows with one code are one entry of the index. It holds their ``k + 1`` smallest ids, which is exact: of rows at one
distance the smaller ids come first, and one more is enough where the query itself is passed over. Queries with one code are
searched once; only those whose id stands on several codes are searched by themselves, so that the rows of their own id are
passed over as they are met. So an id on very many codes lengthens no list. Codes of very many rows, and queries of very many
candidates, are reduced in salted steps.

Defined cases: rows with a null vector have no code, are not found and find nothing; null elements count as not
positive; vectors of fewer elements than the code's bits are filled with zero bits and longer ones refused; of equal distances the smaller id
comes first; a row is never its own neighbour, nor are rows that repeat its id; rows that repeat an id and a code are one;
null ids are passed over; with fewer than ``k`` other rows all are returned; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.runtime import materialised, table

_BITS, _SALTS, _ABOVE = 64, 64, 40


def sign_code(vector: Column) -> Column:
    """The signs of a vector's elements as the bits of a long, the first element lowest. A vector of over 64 elements is an error."""
    vector = F.when(F.size(vector) <= _BITS, vector).otherwise(F.when(vector.isNotNull(), F.raise_error(F.lit(f"a code has {_BITS} bits")).cast("array<float>")))
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(_BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return F.when(vector.isNotNull(), code)


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for ``count`` distinct codes."""
    width = min(32, max(4, round(math.log2(max(2, count))) - 2))
    pieces = math.ceil(_BITS / width)
    edges = [_BITS * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(code: Column, segments: list[tuple[int, int]]) -> list[Column]:
    """One number for each segment: its value with its place above."""
    return [F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) + F.lit(i << _ABOVE).cast("long") for i, (shift, width) in enumerate(segments)]


def _first(rows: DataFrame, by: str, order: list[str], keep: int) -> DataFrame:
    """The first ``keep`` rows of each value of ``by``, taken by salt first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    few = salted.withColumn("n", F.row_number().over(W.partitionBy(by, "salt").orderBy(*order))).where(F.col("n") <= keep).drop("n", "salt")
    return few.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("n") <= keep).drop("n")


def top_k_codes(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(id, code) rows and queries to (query_id, rank, neighbor_id, distance), ``k`` per query."""
    pairs = materialised(rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct())
    keep = k + 1
    index = materialised(_first(pairs, "code", ["id"], keep).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    count, total = index.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    segments = _segments(count)
    entries = materialised(index.select("code", "ids", F.explode(F.array(*_keys(F.col("code"), segments))).alias("key")))
    asked = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    # a query that shares its code with others is one with them, unless its id stands on several codes
    several = pairs.groupBy(F.col("id").alias("own")).agg(F.count("*").alias("codes")).where("codes > 1").select("own")
    asked = materialised(asked.join(several, asked["query_id"] == several["own"], "left"))
    units = materialised(asked.select("q", "own").distinct().withColumn("unit", F.monotonically_increasing_id()))
    active, best, done = materialised(units.withColumn("bound", F.lit(_BITS))), None, []
    apart = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    for radius in range(max(w for _, w in segments) + 1):
        due = sum(math.comb(width, radius) for _, width in segments)
        last = 4 * due > count and radius > 0
        if last:
            blocks = max(1, math.ceil(count / block))
            held = index.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"))
            asks = active.select("unit", "q", "own", "bound", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
            met = asks.join(held, "block").where(apart <= F.col("bound"))
        else:
            probes = []
            for (_, width), key in zip(segments, _keys(F.col("q"), segments), strict=True):
                masks = [sum(1 << b for b in c) for c in combinations(range(width), radius)]
                if masks:
                    probes.append(F.transform(F.lit(masks).cast("array<long>"), key.bitwiseXOR))
            asks = active.select("unit", "q", "own", "bound", F.explode(F.flatten(F.array(*probes))).alias("ask"))
            met = asks.join(entries, (F.col("ask") == F.col("key")) & (apart <= F.col("bound")))
        met = met.select("unit", apart.alias("distance"), F.explode("ids").alias("id"), "code", "own").where(~F.col("id").eqNullSafe(F.col("own"))).drop("own")
        met = met if best is None else met.unionByName(best)
        ranked = materialised(_first(met.distinct(), "unit", ["distance", "id", "code"], keep))
        kth = active.join(ranked.groupBy("unit").agg(F.count("*").alias("found"), F.max("distance").alias("worst")), "unit", "left")
        covered = len(segments) * (radius + 1) - 1
        full = F.coalesce("found", F.lit(0)) >= min(keep, total)
        closed = F.lit(True) if last else full & ((F.col("worst") <= covered) | F.lit(total <= keep or covered >= _BITS))
        active = materialised(kth.where(~closed).select("unit", "q", "own", F.when(full, F.col("worst")).otherwise(F.lit(_BITS)).alias("bound")))
        best = ranked.join(active.select("unit"), "unit", "left_semi").select("unit", "distance", "id", "code")
        done.append(ranked.join(active.select("unit"), "unit", "left_anti").select("unit", "distance", "id", "code"))
        if last or active.isEmpty():
            break
    found = best  # of queries that are still open after the last radius
    for more in done:
        found = found.unionByName(more)
    units = units.select(F.col("q").alias("_q"), F.col("own").alias("_own"), "unit")
    joined = asked.join(units, (F.col("q") == F.col("_q")) & F.col("own").eqNullSafe(F.col("_own"))).select("query_id", "unit").join(found, "unit").where("id <> query_id")
    ranked = joined.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id", "code"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"))


def op7_code_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The nearest rows, by the signs of their vectors, of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k_codes(rows, rows.where("id % 20 = 0"), k)


OP7_SQL = r"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: (coalesce(x, 0) > 0)::INT) AS b FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, list_sum(list_transform(list_zip(q.b, r.b), lambda z: (z[1] <> z[2])::INT))::INT AS distance
  FROM codes q JOIN codes r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM pairs
) WHERE rank <= 10
"""
