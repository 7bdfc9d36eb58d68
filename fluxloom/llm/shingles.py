"""Near-duplicate groups by the exact Jaccard similarity of shingle sets, on top of SimHash links.

Two texts are linked where their sets of shingles of ``width`` words have a similarity of at least ``percent``; no
such pair is lost and no other is linked. Shingles are told apart by 64-bit hashes, as are whole sets.

Candidates come in rounds. The first takes the pairs of SimHash fingerprints of the sets that the segment-popcount grid of
``simhash`` finds within 5 bits, and sets of one fingerprint; this links most near copies. But a similarity of 0.8 leaves
fingerprints about 10 bits apart, where a grid over 64 bits meets nearly everything, so further rounds complete the links.

If two sets are that similar, the first ``n - ceil(percent * n / 100) + 1`` shingles of either, in one order for all sets,
have a shingle in common. The order puts rare shingles first: those that a sample of the texts finds in several come
last, by how many it finds. The sample decides what is compared, not what is linked. Sets that share such a shingle are a
bucket. Round by round some sets of each bucket, first four, then many more, are candidates with those after them that sizes
and places do not exclude, unless links already connect the two. So a large group of near copies costs one comparison a
copy, and a bucket is left when it is connected or all its pairs are compared.

Before two sets are fetched, their parities are compared: bits, two to four for a shingle of the set, of which each shingle
turns one over. Sets that differ in ``d`` shingles differ in at most ``d`` of these bits, so this too loses no pair. Sets are
then made again from the texts.

Defined cases: null and empty texts and those without words have the empty set and are copies of each other; shorter texts
are one shingle; null ids are passed over when the smallest id is sought; rows that repeat an id are judged text by
text; very long texts are one row each; an empty table gives an empty result; extra columns are ignored by
``similar_groups`` and kept, with their values, by ``drop_similar``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.llm.arrow import map_batches
from fluxloom.llm.simhash import components, drop_all_but_first, grouped, linked_pairs, shown
from fluxloom.llm.substring import rolling
from fluxloom.llm.words import utf8
from fluxloom.runtime import broadcast_if_small, materialised, released

_SAMPLED, _SEEN, _LISTED = 16, 4, 1 << 20


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle and an empty one has none."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    return np.unique(rolling(hashes, min(width, len(words))))


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest shingles of a sample of the texts, ascending, and their counts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield {"token": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)}

    tokens = map_batches(docs.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLED)) == 0).select("text"), hashed, "token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= _SEEN).orderBy(F.desc("n"), "token").limit(_LISTED).toPandas()
    hashes, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Bits by the low bits of the hashes; their number is a power of two, at least twice that of the shingles."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _apart(x: Column, y: Column) -> Column:
    """In how many bits parities differ, those of more bits folded to the number of the others.

    Sets whose sizes let them be similar differ in size by less than half, so one fold is enough.
    """

    def folded(a: Column, b: Column) -> Column:
        half = (F.size(a) / 2).cast("int")
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    bits = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda n, d: n + d).cast("long")


def _simhash(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes; the empty set's is 0."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 1 << 16):
        part = shingles[start : start + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def _sets(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(fp, shingles): the sets of the hashes in ``asked`` (fp, doc_id), made from a document that has each."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield {"fp": np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64), "shingles": [s.view(np.int64) for s in sets]}

    ids = broadcast_if_small(materialised(asked.select(F.col("doc_id").alias("_id")).distinct()))
    wanted = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return map_batches(wanted.select("text"), hashed, "fp long, shingles array<long>").join(broadcast_if_small(asked), "fp", "left_semi").dropDuplicates(["fp"])


def _verified(docs: DataFrame, known: DataFrame, met: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the candidates (u, v) that are similar: by their parities first, then by their sets."""
    met = met.join(known.select(F.col("fp").alias("u"), F.col("n").alias("m"), F.col("bits").alias("x")), "u").join(known.select(F.col("fp").alias("v"), "n", F.col("bits").alias("y")), "v")
    # the sizes alone may tell: the smaller set holds percent of the larger at least
    sized = F.least("m", "n").cast("long") * 100 >= F.greatest("m", "n").cast("long") * percent
    few = _apart(F.col("x"), F.col("y")) * (100 + percent) <= (F.col("m") + F.col("n")).cast("long") * (100 - percent)
    pairs = materialised(met.where(F.when(sized, few).otherwise(F.lit(False))).select("u", "v"))
    asked = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(known, "fp").select("fp", "doc_id")
    sets = materialised(_sets(docs, materialised(asked), width))
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(shared * (100 + percent) >= (F.size("x") + F.size("y")).cast("long") * percent).select("u", "v")


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, fp, n, sim, bits, first): a set's hash, size, SimHash and parities, and the shingles it cannot be similar without."""
    spread = docs.sparkSession.sparkContext.broadcast(_common(docs, width))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, counts = spread.value
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            prints = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            first = []
            for s in sets:
                seen = np.zeros(len(s), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    seen = np.where(hashes[at] == s, counts[at], 0)
                order = np.argsort(seen, kind="stable")
                first.append(s[order[: len(s) + (-percent * len(s)) // 100 + 1]].view(np.int64) if len(s) else s.view(np.int64))
            yield {"doc_id": batch.column(0), "fp": prints.view(np.int64), "n": [len(s) for s in sets], "sim": [_simhash(s) for s in sets], "bits": [_parities(s) for s in sets], "first": first}

    return map_batches(docs, marked, "doc_id long, fp long, n int, sim long, bits array<long>, first array<long>")


def _buckets(marked: DataFrame) -> DataFrame:
    """(token, fp, n, place, ix): the sets that share an early shingle with another, numbered in each bucket."""
    entered = marked.select("fp", "n", F.posexplode("first").alias("place", "token"))
    held = entered.select("token", "fp", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("at"))
    order = W.partitionBy("token").orderBy("fp")
    single = held.withColumn("again", F.lag("fp").over(order).eqNullSafe(F.col("fp"))).where(~F.col("again")).drop("again")
    met = single.withColumn("ix", F.row_number().over(order)).withColumn("more", F.lead("fp").over(order)).where("ix > 1 OR more IS NOT NULL")
    return met.select("token", "fp", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int").alias("place"), "ix")


def _seeds(known: DataFrame) -> DataFrame:
    """Candidates (u, v) by SimHash: sets of one fingerprint, and one set each of fingerprints within 5 bits."""
    prints = materialised(known.groupBy("sim").agg(F.min("fp").alias("least")))
    same = known.join(prints, "sim").where("fp > least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    near = linked_pairs(prints.select(F.col("sim").alias("fp")), 5)
    near = near.join(prints.select(F.col("sim").alias("u"), F.col("least").alias("a")), "u").join(prints.select(F.col("sim").alias("v"), F.col("least").alias("b")), "v")
    return same.unionAll(near.select("a", "b"))


def similar_links(docs: DataFrame, marked: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links of set hashes at least ``percent`` similar that connect all such pairs."""
    known = materialised(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bits").alias("bits")))
    links = materialised(_verified(docs, known, _seeds(known), width, percent))
    members, start, step = materialised(_buckets(marked)), 1, 4
    # a similar pair passes in the bucket of its first common shingle: what stands after it bounds the intersection
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")).cast("long")
    near = rest * (100 + percent) >= (F.col("a.n") + F.col("b.n")).cast("long") * percent
    while not members.isEmpty():
        groups = components(links)
        members = members.join(groups, members["fp"] == groups["node"], "left").select("token", "fp", "n", "place", "ix", F.coalesce("root", "fp").alias("root"))
        mixed = members.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        members = materialised(members.join(mixed, "token", "left_semi"))
        released(docs.sparkSession)
        some, after = members.where(F.col("ix").between(start, start + step - 1)), members.where(F.col("ix") > start)
        apart = (F.col("a.token") == F.col("b.token")) & (F.col("a.ix") < F.col("b.ix")) & (F.col("a.root") != F.col("b.root")) & near
        met = some.alias("a").join(after.alias("b"), apart).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
        links = materialised(links.unionAll(_verified(docs, known, met, width, percent)))
        start, step = start + step, step * 128
        open_ = members.groupBy("token").agg(F.max("ix").alias("last")).where(F.col("last") > start).select("token")
        members = materialised(members.where(F.col("ix") >= start).join(open_, "token", "left_semi").drop("root"))
    return links


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    if not 50 <= percent <= 100:
        raise ValueError("the similarity is 50 to 100 per cent")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialised(_marked(docs, width, percent))
    return grouped(marked.select("doc_id", "fp"), similar_links(docs, marked, width, percent))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, fingerprint of its shingle set (16 hex digits), component_id (the smallest id reachable)."""
    return shown(_groups(docs, id_col, text_col, width, percent))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one row of each group: one of the smallest id stays, without an id only if none has one."""
    return drop_all_but_first(docs, _groups(docs, id_col, text_col, width, percent), lambda t: set_print(t, width), id_col, text_col)


def set_print(text: str | None, width: int = 5) -> int:
    """The hash that a text's set has in ``similar_groups``."""
    return xxhash.xxh3_64_intdigest(shingle_set(text, width).tobytes())
