"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words. Its rate (target over size) is the number of copies that one of its
documents is expected to give. The documents of a source stand in one order, largest first; the expected copies are
summed along it, one random offset per source is added, and a document is emitted once for each integer boundary
that the running sum crosses at it. The order by size bounds the gap between the words taken and the target by the
size of the largest document.

No source is gathered in one task: rows are range-sorted by (source, size, tie key), numbered inside their
partitions, and lifted to ranks in the source by the row counts of the partitions before. Where there are very many
sources they are ranked in the same way; windows span the rows of one partition or one row per partition, never all rows.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents of size 0 and
sources without words are emitted like others of the rate 0, that is never; rows that repeat the same id, source and
size are one document counted as often as it occurs, so they share the number of copies; rows without an id are told apart
by their text; an empty table gives an empty result; extra columns are kept with their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.llm.words import word_count
from fluxloom.ordering import in_order, running_sums
from fluxloom.runtime import broadcast_if_small, materialised, table

def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A share above ``cap``
    times the source's size stops there and the excess is shared again by weight. In the order of cap over weight the
    capped sources come first, so one pass over the running sums finds the level at which the others stand.
    """
    by_name = F.col("source").asc_nulls_last()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = running_sums(sizes, [by_name], rank=F.lit(1))
    rows = rows.withColumns({"weight": F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")), "ceiling": F.lit(float(cap)) * F.col("source_size")})
    steep = F.col("ceiling") / F.col("weight")
    rows = materialised(running_sums(rows.drop("rank"), [steep, by_name], shut=F.col("ceiling"), passed=F.col("weight")))
    words, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rows = rows.withColumn("level", (F.lit(words) - F.col("shut")) / (F.lit(all_weights) - F.col("passed"))).withColumn("open", F.col("level") * F.col("weight") <= F.col("ceiling"))
    found = rows.agg(F.min(F.struct((~F.col("open")).alias("shut"), steep.alias("steep"), F.col("source").isNull().alias("nameless"), "source", F.col("level").alias("level"))).alias("first")).first()["first"]
    shared = F.lit(found["level"] if found else None).cast("double")
    return rows.select("source", "source_size", F.when(F.col("open"), F.col("weight") * shared).otherwise(F.col("ceiling")).alias("target"))


def _offset(seed: str) -> Column:
    """A number in [0, 1) drawn from the source's name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("<null>")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key, _row): a document's words, a key where it has no id, and its row as one struct."""
    key = F.when(docs[id_col].isNull(), F.md5(F.coalesce(docs[text_col], F.lit(""))))
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, key) to one row per distinct document: these, rows, source_size, target, copies.

    ``key`` tells rows without an id apart. ``rows`` counts the input rows that repeat the document; each of them is emitted
    ``copies`` times.
    """
    docs = docs if "key" in docs.columns else docs.withColumn("key", F.lit(None).cast("string"))
    units = docs.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows"))
    words = F.col("rows") * F.col("size")
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("<null>"))))
    order = [F.col("source").asc_nulls_last(), F.col("words").desc(), F.col("tie"), F.col("doc_id"), F.col("size"), F.col("key")]
    ordered = in_order(units.withColumns({"words": words, "tie": tie}), order).drop("tie")
    parts = ordered.groupBy("source", "part").agg(F.count("*").alias("held"), F.min("place").alias("first"), F.sum("words").alias("part_words"))
    parts = materialised(parts.withColumn("ahead", F.sum("held").over(W.partitionBy("source").orderBy("part")) - F.col("held")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_words").alias("source_size")), weights, cap)
    lookup = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    lookup = materialised(lookup.select(F.col("p.source").alias("source_"), F.col("p.part").alias("part_"), "first", "ahead", "source_size", "target"))
    ranked = ordered.join(broadcast_if_small(lookup), F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
    rank = F.col("ahead") + F.col("place") - F.col("first") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    ranked = ranked.withColumns({"rank": rank, "rate": rate, "offset": _offset(seed)})
    return ranked.select("doc_id", "source", "size", "key", "rows", "source_size", "target", (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as often as it is emitted."""
    rows = sized(docs, id_col, text_col, source_col)
    taken = plan_mix(rows.drop("_row"), weights, cap, seed).where("copies > 0").select("copies", *[F.col(c).alias(f"taken_{c}") for c in ("doc_id", "source", "size", "key")])
    same = (F.col("size") == F.col("taken_size")) & F.col("doc_id").eqNullSafe(F.col("taken_doc_id")) & F.col("source").eqNullSafe(F.col("taken_source")) & F.col("key").eqNullSafe(F.col("taken_key"))
    emitted = rows.join(taken, same).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return emitted.select("_row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: one row per document with the words the mix takes of it."""
    rows = sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    plan = plan_mix(rows.drop("_row")).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS key FROM documents
), units AS (
  SELECT doc_id, source, size, key, n, n * size AS words FROM (SELECT doc_id, source, size, key, count(*) AS n FROM sized GROUP BY doc_id, source, size, key)
), sizes AS (
  SELECT source, sum(words)::BIGINT AS source_size FROM units GROUP BY source
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS ceiling,
    ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT source, source_size, CASE WHEN level * weight <= ceiling
    THEN weight * (SELECT level FROM levels ORDER BY (level * weight > ceiling), ceiling / weight, source NULLS LAST LIMIT 1)
    ELSE ceiling END AS target FROM levels
), ranked AS (
  SELECT u.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(u.source, '<null>')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off,
    row_number() OVER (PARTITION BY u.source ORDER BY words DESC, md5('mix:' || coalesce(doc_id::VARCHAR, '<null>')), doc_id NULLS FIRST, size, key NULLS FIRST) AS k
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies
FROM (SELECT *, (floor(k * rate + off) - floor((k - 1) * rate + off))::BIGINT AS copies, unnest(range(n)) AS row FROM ranked)
"""
