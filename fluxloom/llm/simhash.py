"""Near-duplicate detection by SimHash with a segment-popcount embedding.

A fingerprint has a bit for each of the 64 bits of the shingles' hashes, set where over half of the hashes set it.
Its embedding counts the bits of two-bit segments, in two segmentations: the 32 that begin at even bits and the 31 that
begin at odd ones. In either the Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, so
it may prune but never loses a link.

The grid range-join works on these counts alone. The even segments are dealt into ``m`` parts of consecutive bits; the odd segments
inside a part belong to it. Where two fingerprints are within ``d`` bits, at least ``m - d`` parts have equal counts. So every
fingerprint enters one cell of the grid for each choice of ``m - d`` parts, named by their counts. Fingerprints that meet in a
cell and whose embeddings are within ``d`` in both segmentations are candidates, and the exact Hamming distance decides. Counts
of overlapping segments tell nearly as much as the bits: among runs of one length only the two that alternate are taken for each
other. ``m`` follows the number of fingerprints: one of random bits enters ``C(m, d)`` cells and meets about
``C(m, d) * 2 ** -(64 * (m - d) / m) * n`` others in them. ``m`` is the least for which that is at most 4, so candidates stay
flat (``d = 4``: 15 cells up to 7e5 fingerprints, 35 up to 2e7, 70 up to 2e8, 330 up to 2e10). The choice of ``m`` changes the
work, never the links.

Documents with one fingerprint are one node from the start, so copies are never paired. Links are shrunk to spanning
forests in the tasks that find them and joined into components by alternating star contractions, distributed.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any other; texts with
fewer words than a shingle are one shingle; null ids are passed over when the smallest id is sought, and a component
of null ids only has a null id; repeated rows are copies of each other, and rows that repeat an id with other texts are
judged text by text; an empty table gives an empty result; extra columns are ignored by ``near_duplicates`` and kept,
with their values, by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.arrow import add_columns, map_batches
from fluxloom.llm.words import byte_blocks, row_of, utf8
from fluxloom.runtime import Scratch, broadcast_if_small, materialised, table


def simhash(text: str | None, width: int = 4) -> int:
    """The fingerprint of a text's shingles of ``width`` words, repeats included."""
    hash64, counts, total, words = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for block in byte_blocks(utf8(text).lower()):
        words += block.split()
        n = len(words) - width + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            hashes = np.fromiter((hash64(s, 42) for s in shingles), np.uint64, n)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
            words = words[n:]
    if not total:
        return hash64(b" ".join(words), 42) if words else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            values = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield {"doc_id": batch.column(0), "fp": values.view(np.int64)}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), hashed, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """The counts of the 32 two-bit segments from bit 0 on, each as its number of low bits set: 00, 01 or 11.

    The Manhattan distance of two embeddings is the number of bits in which these longs differ.
    """
    even, next_ = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(next_).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(even), 1))


def embedded_odd(fp: Column) -> Column:
    """The counts of the 31 two-bit segments from bit 1 on."""
    return embedded(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit((1 << 62) - 1).cast("long"))


def part_masks(parts: int) -> list[tuple[int, int]]:
    """The counts of each part in either embedding, as signed longs: whole segments, as even as they come."""
    edges = [2 * (32 * i // parts) for i in range(parts + 1)]
    return [(_signed((1 << b) - (1 << a)), _signed((1 << max(a, b - 2)) - (1 << a))) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_parts(count: int, max_distance: int, candidates: float = 4.0) -> int:
    """The least number of parts at which ``count`` random fingerprints meet ``candidates`` others each at most."""
    for parts in range(max_distance + 1, 16):
        if math.comb(parts, max_distance) * count * 2.0 ** (-64 * (parts - max_distance) / parts) <= candidates:
            return parts
    return 16


def grid_cells(fp: Column, parts: int, max_distance: int) -> Column:
    """The cells that a fingerprint enters, one for each choice of the parts whose counts agree."""
    chosen = [tuple(_signed(sum(m[i] & (1 << 64) - 1 for m in c)) for i in (0, 1)) for c in combinations(part_masks(parts), parts - max_distance)]
    masks = (F.lit([c[i] for c in chosen]).cast("array<long>") for i in (0, 1))
    even, odd = embedded(fp), embedded_odd(fp)
    return F.zip_with(*masks, lambda m, o: F.xxhash64(m, even.bitwiseAND(m), odd.bitwiseAND(o)))


def _told_cell(a: Column, b: Column, parts: int, max_distance: int) -> Column:
    """The one cell in which a close pair is told: that of the first parts whose counts agree."""
    even, odd = embedded(a), embedded_odd(a)
    differ, apart = even.bitwiseXOR(embedded(b)), odd.bitwiseXOR(embedded_odd(b))
    none = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("odd"), F.lit(0).alias("n"))

    def add(held: Column, m: Column) -> Column:
        agrees = (differ.bitwiseAND(m["even"]) == 0) & (apart.bitwiseAND(m["odd"]) == 0) & (held["n"] < parts - max_distance)
        more = lambda name, mask: F.when(agrees, held[name].bitwiseOR(mask)).otherwise(held[name]).alias(name)
        return F.struct(more("mask", m["even"]), more("odd", m["odd"]), (held["n"] + agrees.cast("int")).alias("n"))

    masks = F.array(*[F.struct(F.lit(e).cast("long").alias("even"), F.lit(o).cast("long").alias("odd")) for e, o in part_masks(parts)])
    return F.aggregate(masks, none, add, lambda held: F.xxhash64(held["mask"], even.bitwiseAND(held["mask"]), odd.bitwiseAND(held["odd"])))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Links of one task to the links of each node with the least node that they connect it to."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(above.setdefault(a, a)), top(above.setdefault(b, b))
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for start in range(0, len(nodes), 10_000):
        pairs = [(x, r) for x in nodes[start : start + 10_000] if (r := top(x)) != x]
        yield {"u": [x for x, _ in pairs], "v": [r for _, r in pairs]}


def linked_pairs(nodes: DataFrame, max_distance: int) -> DataFrame:
    """All pairs (u, v) of distinct fingerprints, the column fp of ``nodes``, at most ``max_distance`` bits apart."""
    if not 0 <= max_distance <= 5:
        raise ValueError("the cells cover distances up to 5")
    parts = grid_parts(nodes.count(), max_distance)
    entered = nodes.select("fp", F.explode(grid_cells(F.col("fp"), parts, max_distance)).alias("cell"))
    a, b = F.col("a.fp"), F.col("b.fp")
    bound = (F.bit_count(embedded(a).bitwiseXOR(embedded(b))) <= max_distance) & (F.bit_count(embedded_odd(a).bitwiseXOR(embedded_odd(b))) <= max_distance)
    near = F.bit_count(a.bitwiseXOR(b)) <= max_distance
    told = (F.col("a.cell") == F.col("b.cell")) & (a < b) & F.when(bound & near, _told_cell(a, b, parts, max_distance) == F.col("a.cell")).otherwise(F.lit(False))
    return entered.alias("a").join(entered.alias("b"), told).select(a.alias("u"), b.alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one node at most and to none that points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of longs to (node, root): every linked node with the least node of its component."""
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch.written(map_batches(links.select("u", "v"), _forest, "u long, v long"))
    while not _settled(edges):
        # each node's greater neighbours move to the least of its neighbourhood, then its smaller ones do; the least ones
        # are written first, so that the joins shuffle both sides and a node with very many neighbours can be split
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = scratch.written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        edges = scratch.written(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        scratch.remove(but_last=True)
    found = materialised(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v"), F.col("v")).distinct()))
    scratch.remove()
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable by links)."""
    return shown(_grouped(docs, id_col, text_col, width, max_distance))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, max_distance: int) -> DataFrame:
    marked = materialised(fingerprints(docs, id_col, text_col, width))
    return grouped(marked, linked_pairs(materialised(marked.select("fp").distinct()), max_distance))


def grouped(marked: DataFrame, links: DataFrame) -> DataFrame:
    """Documents (doc_id, fp) with component_id, the smallest id that links (u, v) of fingerprints reach, and leads.

    ``leads`` marks the document that stands for its group: of the smallest id and, where that has several texts, of the
    least fingerprint. Rows that repeat it all lead.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("fp").alias("of"))).alias("first")
    nodes = materialised(marked.groupBy("fp").agg(first))
    groups = components(links)
    members = groups.join(nodes, groups["node"] == nodes["fp"]).select("fp", "root", "first")
    least = members.groupBy("root").agg(F.min("first").alias("lead"))
    told = nodes.join(members.join(least, "root").select("fp", "lead"), "fp", "left").select("fp", F.coalesce("lead", "first").alias("lead"))
    told = materialised(told)  # a fresh side for the join, whose fingerprints of many copies can then be split
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("fp") == F.col("lead.of"))
    return marked.join(told, "fp").select("doc_id", "fp", F.col("lead.doc_id").alias("component_id"), leads.alias("leads"))


def shown(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` without all but one row of each group: one of the smallest id stays, without an id only if none has one."""
    return drop_all_but_first(docs, _grouped(docs, id_col, text_col, width, max_distance), lambda t: simhash(t, width), id_col, text_col)


def drop_all_but_first(docs: DataFrame, groups: DataFrame, fingerprint: Callable[[str | None], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each of ``groups`` (see ``grouped``); ``fingerprint`` gives a text its fingerprint there.

    Rows go by id, so their texts are not shuffled. Only ids that stand on several rows, or on none, are told apart by
    fingerprint; of the rows that lead a group the first by all its columns stays.
    """
    by_id = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("leads").alias("led"))
    told = materialised(by_id.where("rows > led OR rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_told"), (F.col("led") > 0).alias("_some")))
    rows, same = row_of(docs, id_col, text_col), F.col("_id").eqNullSafe(F.col("_told"))
    kept = rows.join(broadcast_if_small(told), same, "left_anti").select("_row.*")
    some = materialised(told.where("_some").select("_told"))
    if some.isEmpty():
        return kept

    def marked(batches: Iterator[list[list]]) -> Iterator[dict]:
        for (texts,) in batches:
            yield {"_fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    again = add_columns(rows.join(broadcast_if_small(some), same, "left_semi"), ["_text"], marked, "_fp long")
    leading = materialised(groups.where("leads").select(F.col("doc_id").alias("_lead"), F.col("fp").alias("_of")).distinct())
    again = again.join(leading, F.col("_id").eqNullSafe(F.col("_lead")) & (F.col("_fp") == F.col("_of")), "left_semi")
    one = again.groupBy("_id", "_fp").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.unionByName(one.select("_row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
