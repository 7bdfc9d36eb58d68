"""Exact top-k lexical search by variable-block-max WAND.

Documents are dealt into shards of about ``shard_bytes`` of text as they are read; nothing is shuffled but counts. A shard is one
row: its documents and, for each term, the postings (document, frequency) in document order. Sums over shards give the number
of documents, their length and each term's document frequency, and with them the part of a score that a posting brings.

Posting lists are then cut into blocks of up to ``max_block`` postings. Dynamic programming chooses the boundaries: of all cuts
of a list it takes the one with the least sum, over its blocks, of greatest part times postings, plus ``block_cost`` mean parts
a block. So a block's maximum lies as little above its postings as the number of blocks allows. A block spans the documents
from its first to its last posting; elsewhere its list adds nothing.

WAND tests a document by the maxima of the blocks that span it. That test has one outcome from one block boundary to the next,
so a shard's tests are made at once, from the blocks alone: sums of weighted maxima, stretch by stretch. Documents whose bound is
below the k-th score so far are skipped with their postings; the others are scored, highest bound first, in steps that grow
fourfold, and each step raises the k-th score. Documents whose bound equals it are scored too, since ties go by id. A task
keeps its queries' best documents from shard to shard and tells the driver's plan k for each query.

Queries are searched in blocks of ``query_bytes`` of text, which also bounds what is broadcast. Where all queries are one block,
the index holds their terms only.

Defined cases: a null text, or one without a term, is no document and no query; null ids are documents and come last among equal
scores; rows that repeat an id, documents or queries, are told apart and ranked each; very long texts are read in blocks; with
fewer than k documents that score, all of these are returned; an empty table on either side gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.llm.arrow import map_batches
from fluxloom.llm.words import byte_blocks
from fluxloom.ordering import running_sums
from fluxloom.runtime import materialised, table

#: Bytes of a text to those of its terms: every other ASCII character than letters and digits is a blank, A-Z are lower-cased.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists."""
    for block in byte_blocks(text.translate(_FOLD)):
        yield block.split()


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class _Postings:
    """The postings of one shard as it grows."""

    def __init__(self, known: dict[bytes, int] | None):
        self.known, self.names = known, defaultdict(count().__next__)
        self.doc_ids, self.lengths, self.found, self.size = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        length, found = 0, []
        for words in terms_in(text):
            length += len(words)
            if self.known is None:
                found.append(np.fromiter(map(self.names.__getitem__, words), np.int32, len(words)))
            else:
                get = self.known.get
                found.append(np.array([i for i in map(get, words) if i is not None], np.int32))
        self.size += len(text)
        if length:
            self.doc_ids.append(doc_id)
            self.lengths.append(length)
            self.found.append(np.concatenate(found))

    def columns(self) -> dict:
        at = np.repeat(np.arange(len(self.found), dtype=np.int64), [len(x) for x in self.found])
        keys, tf = np.unique((np.concatenate(self.found).astype(np.int64) << 32) | at, return_counts=True)
        terms, counts = np.unique(keys >> 32, return_counts=True)
        names = list(self.names if self.known is None else self.known)
        return {
            "doc_ids": [self.doc_ids], "lengths": [_packed(np.array(self.lengths, "<i8"))], "n_docs": [len(self.lengths)], "n_terms": [sum(self.lengths)],
            "terms": [[names[i] for i in terms]], "counts": [counts.astype(np.int32)], "docs": [_packed((keys & 0xFFFFFFFF).astype("<u4"))], "parts": [_packed(tf.astype("<u4"))],
        }


_SHARD = "doc_ids array<long>, lengths binary, n_docs long, n_terms long, terms array<binary>, counts array<int>, docs binary, parts binary"


def cut_blocks(parts: np.ndarray, counts: np.ndarray, max_block: int, block_cost: float) -> np.ndarray:
    """Which postings end a block: the cut of each list with the least bound error plus cost of blocks.

    ``parts`` holds the lists one behind the other, ``counts`` their lengths. All lists are worked on side by side, posting by posting.
    """
    order = np.argsort(-counts, kind="stable")
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    mean = np.add.reduceat(parts.astype(np.float64), np.cumsum(counts) - counts)[order] / lengths if len(counts) else np.zeros(0)
    scaled = np.maximum(mean, 1e-9)
    run = np.arange(1, max_block + 1, dtype=np.float64)
    tops, costs = np.zeros((len(order), max_block)), np.full((len(order), max_block), np.inf)
    least, taken = np.zeros(len(order)), np.zeros(len(parts), np.int32)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # lists with more than i postings
    for i in range(longest):
        n = active[i]
        now = parts[starts[:n] + i] / scaled[:n]
        tops[:n, 1:] = tops[:n, :-1]
        tops[:n, 0] = 0
        np.maximum(tops[:n], now[:, None], out=tops[:n])
        costs[:n, 1:] = costs[:n, :-1]
        costs[:n, 0] = least[:n]
        whole = tops[:n] * run + costs[:n]
        best = whole.argmin(axis=1)
        least[:n] = whole[np.arange(n), best] + block_cost
        taken[starts[:n] + i] = best + 1
    ends, at = np.zeros(len(parts), bool), starts + lengths - 1
    first = starts.copy()
    while len(at):
        ends[at] = True
        at = at - taken[at]
        going = at >= first
        at, first = at[going], first[going]
    return ends


def _blocked(index: DataFrame, docs: int, total: int, max_block: int, block_cost: float) -> DataFrame:
    """Shards with each posting's part of a score in place of its frequency, and blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in ("doc_ids", "lengths", "terms", "counts", "docs", "parts")}
                at, tf = _unpacked(row["docs"].as_py()), _unpacked(row["parts"].as_py()).astype(np.int64)
                norm = 25 + (75 * _unpacked(row["lengths"].as_py(), "<i8") * docs) // total
                parts = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[at])
                counts = np.array(row["counts"].as_py(), np.int64)
                ends = np.flatnonzero(cut_blocks(parts, counts, max_block, block_cost))
                begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
                tops = np.maximum.reduceat(parts, begins) if len(ends) else parts
                blocks = np.diff(np.searchsorted(ends, np.concatenate([[0], np.cumsum(counts)])))
                yield {
                    "doc_ids": pa.array([row["doc_ids"].as_py()], pa.list_(pa.int64())), "terms": [row["terms"].as_py()], "counts": [counts.astype(np.int32)], "blocks": [blocks.astype(np.int32)],
                    "docs": [row["docs"].as_py()], "parts": [_packed(parts.astype("<u4"))], "firsts": [_packed(at[begins])], "lasts": [_packed(at[ends])], "tops": [_packed(tops.astype("<u4"))],
                }

    schema = "doc_ids array<long>, terms array<binary>, counts array<int>, blocks array<int>, docs binary, parts binary, firsts binary, lasts binary, tops binary"
    return map_batches(index.select("doc_ids", "lengths", "terms", "counts", "docs", "parts"), cut, schema)


class Index:
    """The shards of a table of documents and the counts over all of them.

    ``terms``: the only terms that will be asked for; None for all.
    """

    def __init__(self, docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, max_block: int = 64, block_cost: float = 4.0):
        spark = docs.sparkSession
        known = None if terms is None else spark.sparkContext.broadcast({t: i for i, t in enumerate(sorted(terms))})

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held = None if known is None else known.value
            shard = _Postings(held)
            for batch in batches:
                texts = batch.column(1).cast(pa.binary())
                for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    shard.add(doc_id, text.as_py() or b"")
                    if shard.size >= shard_bytes and shard.lengths:
                        yield shard.columns()
                        shard = _Postings(held)
            if shard.lengths:
                yield shard.columns()

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        counted = materialised(map_batches(rows, built, _SHARD))
        self.docs, self.total = (x or 0 for x in counted.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        each = counted.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("n"))
        self.frequencies = materialised(each.groupBy("term").agg(F.sum("n").alias("df")))
        self.shards = materialised(_blocked(counted, self.docs, self.total, max_block, block_cost))

    def weights(self, terms: set[bytes]) -> dict[bytes, int]:
        """The weight of each of ``terms`` that a document holds."""
        spark = self.frequencies.sparkSession
        asked = spark.createDataFrame(pa.table({"term": pa.array(sorted(terms), pa.binary())}))
        found = self.frequencies.join(F.broadcast(asked), "term", "left_semi").collect()  # as many rows as ``terms`` at most
        return {bytes(r.term): math.floor(1000 * math.log((2 * self.docs + 2) / (2 * r.df + 1))) for r in found}


class Shard:
    """One shard of an index, ready for search. ``scored`` counts the documents that were scored."""

    def __init__(self, doc_ids: list, terms: list[bytes], counts: list, blocks: list, docs: bytes, parts: bytes, firsts: bytes, lasts: bytes, tops: bytes):
        self.doc_ids, self.place, self.scored = doc_ids, {t: i for i, t in enumerate(terms)}, 0
        self.ends, self.block_ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        self.docs, self.parts, self.firsts, self.lasts, self.tops = (_unpacked(x).astype(np.int64) for x in (docs, parts, firsts, lasts, tops))

    def bounds(self, lists: list[tuple[int, int]]) -> np.ndarray:
        """For each document the sum of weighted maxima of the blocks that span it."""
        cuts = [slice(self.block_ends[i], self.block_ends[i + 1]) for i, _ in lists]
        rise = np.concatenate([self.tops[c] * w for c, (_, w) in zip(cuts, lists, strict=True)]).astype(np.float64)
        n = len(self.doc_ids) + 1
        up = np.bincount(np.concatenate([self.firsts[c] for c in cuts]), rise, n)
        down = np.bincount(np.concatenate([self.lasts[c] for c in cuts]) + 1, rise, n)
        return np.cumsum(up - down)[:-1]  # whole numbers below 2^53, so these sums are exact

    def scores(self, lists: list[tuple[int, int]], some: np.ndarray) -> np.ndarray:
        """The scores of documents, places in ascending order."""
        self.scored += len(some)
        if 8 * len(some) > len(self.doc_ids):
            every = np.zeros(len(self.doc_ids), np.int64)
            for i, w in lists:
                cut = slice(self.ends[i], self.ends[i + 1])
                every[self.docs[cut]] += w * self.parts[cut]
            return every[some]
        out = np.zeros(len(some), np.int64)
        for i, w in lists:
            cut = slice(self.ends[i], self.ends[i + 1])
            at = np.minimum(np.searchsorted(self.docs[cut], some), cut.stop - cut.start - 1)
            out += np.where(self.docs[cut][at] == some, w * self.parts[cut][at], 0)
        return out

    def search(self, query: list[tuple[bytes, int]], best: list[tuple], k: int) -> list[tuple]:
        """``best``, the sorted (-score, nameless, doc_id) so far, with this shard's documents."""
        lists = [(self.place[t], w) for t, w in query if t in self.place]
        if not lists:
            return best
        floor = -best[-1][0] if len(best) == k else 1
        bounds = self.bounds(lists)
        live = np.flatnonzero(bounds >= floor)
        live, at, step = live[np.argsort(-bounds[live], kind="stable")], 0, 64
        while at < len(live) and bounds[live[at]] >= floor:
            some = np.sort(live[at : at + step])
            scores = self.scores(lists, some)
            least = max(floor, int(np.partition(scores, -k)[-k]) if len(scores) > k else 1)
            more = [(-int(scores[j]), self.doc_ids[some[j]] is None, self.doc_ids[some[j]] or 0) for j in np.flatnonzero(scores >= least)]
            best = sorted(best + more)[:k]
            floor = -best[-1][0] if len(best) == k else 1
            at, step = at + step, step * 4
        return best


def _search(index: Index, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(q, score, doc_id) of the ``k`` best documents of (q, text) queries."""
    spark = index.shards.sparkSession
    counted = [(q, Counter(w for words in terms_in(text) for w in words)) for q, text in queries]
    weights = index.weights(set().union(*(c for _, c in counted)))
    asked = [(q, [(t, n * weights[t]) for t, n in sorted(c.items()) if weights.get(t)]) for q, c in counted]
    sent = spark.sparkContext.broadcast(asked)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        best: list[list] = [[] for _ in sent.value]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(*(batch.column(c)[row].as_py() for c in range(batch.num_columns)))
                for i, (_, query) in enumerate(sent.value):
                    best[i] = shard.search(query, best[i], k)
        rows = [(q, -score, None if nameless else doc_id) for (q, _), held in zip(sent.value, best, strict=True) for score, nameless, doc_id in held]
        yield {n: [r[i] for r in rows] for i, n in enumerate(("q", "score", "doc_id"))}

    merged = map_batches(index.shards, found, "q long, score long, doc_id long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", query_col: str = "text", query_bytes: int = 4 << 20, **index) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each row of ``items``.

    A term's weight is the whole part of 1000 ln((2N + 2) / (2 df + 1)); a posting's part is 10^9 tf div (1000 tf + 8 m), where m is
    25 + (75 n N) div L. ``index``: id_col, text_col, shard_bytes, max_block, block_cost (see ``Index``).
    """
    rows = items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text")).where(F.octet_length("text") > 0)
    rows = running_sums(rows, [F.col("item_id"), F.col("text")], ahead=F.octet_length("text").cast("long"))
    rows = materialised(rows.select("item_id", "text", F.floor(F.col("ahead") / query_bytes).alias("block"), F.monotonically_increasing_id().alias("q")))
    blocks = [r.block for r in rows.select("block").distinct().orderBy("block").collect()]  # one row for ``query_bytes`` of queries
    texts = lambda b: [(r.q, r.text.encode()) for r in rows.where(F.col("block") == b).select("q", "text").collect()]
    some = texts(blocks[0]) if blocks else []
    held = Index(docs, {w for _, text in some for words in terms_in(text) for w in words} if len(blocks) < 2 else None, **index)
    found = None
    for b in blocks:
        part = _search(held, some if b == blocks[0] else texts(b), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select("q", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return found.join(rows.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS MATERIALIZED (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), totals AS MATERIALIZED (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths
), weights AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS MATERIALIZED (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
