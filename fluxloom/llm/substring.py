"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words. A window of a document goes if its words also start somewhere in a document
with a smaller id, and a word goes if a window that covers it goes.

Each window has an anchor: of the shorter grams of ``gram`` words inside it, the first with the least hash. Equal
windows have equal anchors, so a window is in at most as many documents as its anchor: what bounds anchors from above
bounds windows. Neighbouring windows mostly share one, so there are about twenty times fewer anchors than windows.

First pass: every partition builds a count-min sketch of the documents in which its anchors occur, each anchor once a
document, in ``rows`` rows of ``2 ** bits`` cells. The partitions' sketches are summed cell by cell. A merged cell is
at least the count of each anchor that falls into it, so anchors with a cell below 2 occur in one document only.
``bits`` follows the size of the texts, at least 8 cells a row for an anchor, so that about 1.4 % of the anchors of one
document pass, whatever the size of the texts. Only whether a cell reached 2 is kept, one bit each; that bitmap is broadcast up to
``broadcast_bytes``. Beyond, it stays a table of the cells that reached 2, row by row: anchors are joined to those of the first row,
and what is left to those of the next. Either way the same windows go.

Second pass: only windows whose anchor is estimated repeated are grouped, exactly. A run of windows that share an
anchor is one span, named by a 128-bit hash of its words. A span that a smaller document has too goes whole. Only the
smallest document of each span takes part further: its windows are compared, under their anchor, with those of other
spans. So a passage that thousands of documents share is compared once. A full sketch means more windows to group,
never a lost one. Documents are told apart by 128 bits of their id and text, so rows that repeat an id, or have none,
are judged text by text.

Defined cases: a null text has no words; texts of under ``width`` words lose none; windows that repeat only inside
their document stay; rows that repeat an id do not count as another document for each other; null ids come after all
others and not before one another; an empty table gives an empty result; extra columns are kept with their values by
``drop_repeated``, and by ``remove_repeated`` but for those named like its own; very long texts are held as arrays of word
hashes, document by document.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.arrow import add_columns, map_batches
from fluxloom.llm.words import row_of, utf8
from fluxloom.runtime import materialised, released, table

_BASE = 0x9E3779B97F4A7C15
_BLOCK_BITS = 16
_CELLS = 8
_BYTES = 64


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, ``n`` of each."""
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, int(n).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * down[:n], dtype=np.uint64)])
    return _mixed((sums[width:] - sums[:-width]) * up[: n - width + 1])


class Spans:
    """The windows of one text as spans: maximal runs of windows that have one anchor."""

    def __init__(self, text: str | None, width: int, gram: int):
        self.words = utf8(text).split()
        n = len(self.words) - width + 1
        if n <= 0:
            self.first = self.count = self.anchor = np.zeros(0, np.int64)
            return
        hash64 = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((hash64(w) for w in self.words), np.uint64, len(self.words))
        grams, reach = rolling(self.hashes, gram), width - gram + 1
        at = np.empty(n, np.int64)
        for start in range(0, n, 1 << 16):
            part = grams[start : start + (1 << 16) + reach - 1]
            view = np.lib.stride_tricks.sliding_window_view(part, reach)[: n - start]
            at[start : start + len(view)] = view.argmin(axis=1) + np.arange(start, start + len(view))
        self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.count = np.diff(np.append(self.first, n))
        self.anchor = grams[at[self.first]]
        self.width = width

    def name(self, k: int) -> bytes:
        """A 128-bit hash of the words of span ``k``."""
        start = self.first[k]
        return hashlib.blake2b(b" ".join(self.words[start : start + self.count[k] + self.width - 1]), digest_size=16).digest()


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mixed(anchors + np.uint64((row + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketches(rows: DataFrame, width: int, gram: int, sketch_rows: int, bits: int) -> DataFrame:
    """The merged sketch in blocks of 2^16 cells: (row, block, bitmap), the bit of a cell set where it reached 2."""
    size = 1 << min(bits, _BLOCK_BITS)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        anchors = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                anchors.append(np.unique(Spans(text, width, gram).anchor).astype(np.uint64))
        if not anchors:
            return
        anchors = np.concatenate(anchors)
        for row in range(sketch_rows):
            cells, counts = np.unique(_cells(anchors, row, bits), return_counts=True)
            blocks = cells >> _BLOCK_BITS
            starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(cells) else np.zeros(0, np.int64)
            held = zip(np.split(cells, starts[1:]), np.split(counts, starts[1:]), strict=True) if len(cells) else ()
            out = {"row": [row] * len(starts), "block": blocks[starts], "cells": [], "counts": []}
            for c, n in held:
                out["cells"].append((c & (size - 1)).astype("<u2").tobytes())
                out["counts"].append(np.minimum(n, 2).astype(np.uint8).tobytes())
            yield out

    parts = map_batches(rows.select("text"), built, "row int, block long, cells binary, counts binary")

    def merged(key, batches):
        total = np.zeros(size, np.uint8)
        for batch in batches:
            for cells, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = np.frombuffer(cells, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
        bitmap = zlib.compress(np.packbits(total >= 2).tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "bitmap": pa.array([bitmap], pa.binary())})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged(key, batches)

    return parts.groupBy("row", "block").applyInArrow(merge, "row int, block long, bitmap binary")


class RepeatSketch:
    """Which cells of a count-min sketch reached 2."""

    def __init__(self, sketch_rows: int, bits: int):
        self.bits, self.maps = bits, [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(sketch_rows)]

    def fill(self, row: int, block: int, bitmap: bytes) -> None:
        data = np.frombuffer(zlib.decompress(bitmap), np.uint8)
        start = block << (_BLOCK_BITS - 3)
        self.maps[row][start : start + len(data)] = data

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        found = np.ones(len(anchors), bool)
        for row, bitmap in enumerate(self.maps):
            c = _cells(anchors, row, self.bits)
            found &= (bitmap[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def sketch_bits(rows: DataFrame) -> int:
    """log2 of the cells that a row of the sketch needs: ``_CELLS`` for each ``_BYTES`` bytes of text.

    Prose has an anchor for about 145 bytes.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(_BLOCK_BITS, math.ceil(math.log2(max(1, _CELLS * size // _BYTES))))


def _by_table(rows: DataFrame, width: int, gram: int, sketch_rows: int, bits: int) -> DataFrame:
    """``rows`` that have flagged anchors, with these: the sketch's cells that reached 2 as a table, for texts beyond a broadcast."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, block, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)))
                yield {"row": np.full(len(at), row, np.int32), "cell": at + (block << _BLOCK_BITS)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            anchors = [np.unique(Spans(t, width, gram).anchor).astype(np.uint64) for t in batch.column(2).to_pylist()]
            n = [len(x) for x in anchors]
            all_ = np.concatenate([np.zeros(0, np.uint64), *anchors])
            yield {"a": np.repeat(batch.column(0).to_numpy(), n), "b": np.repeat(batch.column(1).to_numpy(), n), "anchor": all_.view(np.int64)} | {f"cell{i}": _cells(all_, i, bits) for i in range(sketch_rows)}

    full = materialised(map_batches(_sketches(rows, width, gram, sketch_rows, bits), cells, "row int, cell long"))
    names = ", ".join(f"cell{i} long" for i in range(sketch_rows))
    held = map_batches(rows.select("key_a", "key_b", "text"), found, f"a long, b long, anchor long, {names}")
    for i in range(sketch_rows):  # only what one row has flagged is shuffled for the next
        held = held.join(full.where(F.col("row") == i).select(F.col("cell").alias(f"cell{i}")), f"cell{i}").drop(f"cell{i}")
    flagged = held.groupBy("a", "b").agg(F.collect_set("anchor").alias("flagged"))
    return rows.join(flagged, (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b"))).drop("a", "b")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (see ``row_of``) with rank_id, the id, and key_a and key_b: 128 bits of id and text."""
    rows = row_of(docs, id_col, text_col)
    text = F.coalesce("_text", F.lit(""))
    return rows.select("_row", F.col("_id").alias("rank_id"), F.xxhash64("_id", text).alias("key_a"), F.xxhash64(F.lit(9), text, "_id").alias("key_b"), text.alias("text"))


def repeated_windows(rows: DataFrame, width: int = 50, gram: int = 12, sketch_rows: int = 2, bits: int | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Of rows (see ``keyed``): (key_a, key_b, gone), the runs (start, count) of window starts that go from a text."""
    if not 0 < gram <= width or bits is not None and bits < 3:
        raise ValueError("a gram has 1 to width words and a sketch 3 bits or more")
    spark = rows.sparkSession
    rows = rows.select("rank_id", "key_a", "key_b", "text")
    bits = sketch_bits(rows) if bits is None else bits
    if sketch_rows << bits > 8 * broadcast_bytes:
        shared, rows = None, _by_table(rows, width, gram, sketch_rows, bits)
    else:
        sketch = RepeatSketch(sketch_rows, bits)
        for row, block, bitmap in _sketches(rows, width, gram, sketch_rows, bits).toLocalIterator():
            sketch.fill(row, block, bytes(bitmap))
        shared, rows = spark.sparkContext.broadcast(sketch), rows.withColumn("flagged", F.lit(None).cast("array<long>"))

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        least: dict[bytes, tuple] = {}
        for whole in batches:
            for offset in range(0, whole.num_rows, 512):
                batch = whole.slice(offset, 512)
                out = {k: [] for k in ("rank_id", "key_a", "key_b", "anchor", "span_a", "span_b", "at", "count", "more", "windows")}
                for doc, a, b, text, told in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    spans = Spans(text, width, gram)
                    anchors = spans.anchor.astype(np.uint64)
                    flagged = np.flatnonzero(np.isin(anchors.view(np.int64), told) if shared is None else shared.value.repeated(anchors))
                    if not len(flagged):
                        continue
                    windows = rolling(spans.hashes, width).view(np.int64)
                    rank, seen = (doc is None, doc or 0), {}
                    for k in flagged:
                        name, start, count = spans.name(k), int(spans.first[k]), int(spans.count[k])
                        if name in seen:
                            row = seen[name]
                            out["more"][row] = [*(out["more"][row] or ()), start]
                            continue
                        seen[name] = len(out["at"])
                        front = rank <= least.get(name, rank)
                        if front:
                            least[name] = rank
                        out["rank_id"].append(doc)
                        out["key_a"].append(a)
                        out["key_b"].append(b)
                        out["anchor"].append(int(spans.anchor[k : k + 1].view(np.int64)[0]))
                        out["span_a"].append(int.from_bytes(name[:8], "little", signed=True))
                        out["span_b"].append(int.from_bytes(name[8:], "little", signed=True))
                        out["at"].append(start)
                        out["count"].append(count)
                        out["more"].append(None)
                        out["windows"].append(windows[start : start + count].tolist() if front else None)
                if out["at"]:
                    yield out

    key, span = ["key_a", "key_b"], ["anchor", "span_a", "span_b"]
    schema = "rank_id long, key_a long, key_b long, anchor long, span_a long, span_b long, at int, count int, more array<int>, windows array<long>"
    spans = materialised(map_batches(rows.select("rank_id", *key, "text", "flagged"), spanned, schema))
    # both are written before they are joined, so that the join shuffles both sides and a frequent anchor can be split;
    # a null rank is above all others: min and max pass it over, and nothing is below where all are null
    least = materialised(spans.groupBy(*span).agg(F.min("rank_id").alias("least")))
    varied = materialised(least.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select(F.col("anchor").alias("varied")))
    told = least.join(varied, least["anchor"] == varied["varied"], "left").select(*span, "least", F.col("varied").isNotNull().alias("varied"))
    later = F.col("least").isNotNull() & (F.col("rank_id").isNull() | (F.col("rank_id") > F.col("least")))
    starts = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<int>")))
    placed = spans.join(told, span).where(later | F.col("varied"))
    placed = placed.select("rank_id", *key, later.alias("later"), "anchor", starts.alias("starts"), "count", "windows")
    placed = materialised(placed.withColumn("ref", F.monotonically_increasing_id()))
    del spans, least, varied, told
    released(spark)
    covered = placed.where("later").select(*key, F.explode("starts").alias("start"), "count")
    # a window carries no more than a number for its span, whose document and places are looked up for those that go
    fronts = placed.where(~F.col("later")).select("rank_id", "ref", "anchor", F.posexplode("windows").alias("place", "window"))
    seen = fronts.groupBy("anchor", "window").agg(F.min("rank_id").alias("smallest"), F.max("rank_id").alias("largest"), F.count_if(F.col("rank_id").isNull()).alias("nameless"))
    seen = seen.where("smallest < largest OR nameless > 0 AND smallest IS NOT NULL").select("anchor", "window", "smallest")
    beaten = fronts.join(seen, ["anchor", "window"]).where("rank_id IS NULL OR rank_id > smallest").select("ref", "place")
    beaten = beaten.join(placed.select("ref", *key, "starts"), "ref").select(*key, "place", F.explode("starts").alias("start"))
    beaten = beaten.select(*key, (F.col("start") + F.col("place")).alias("start"), F.lit(1).alias("count"))
    gone = materialised(covered.unionByName(beaten).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "count"))).alias("gone")))
    del placed, covered, fronts, seen, beaten
    released(spark)
    return gone


def _kept(words: list, gone: list | None, width: int) -> list:
    """The words that no window of ``gone`` covers."""
    if not gone or len(words) < width:
        return words
    out, at = [], 0
    for run in gone:
        start, end = run["start"], run["start"] + run["count"] - 1 + width
        out += words[at:start]
        at = max(at, end)
    return out + words[at:]


def _cut(docs: DataFrame, width: int, gram: int, id_col: str, text_col: str, **sketch) -> DataFrame:
    """(_row, n_words, n_removed, kept_text)."""
    rows = keyed(docs, id_col, text_col)
    gone = repeated_windows(rows, width, gram, **sketch).withColumnsRenamed({"key_a": "a", "key_b": "b"})
    joined = rows.drop("text").join(gone, (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b")), "left")

    def cut(batches: Iterator[list[list]]) -> Iterator[dict]:
        for texts, runs in batches:
            out = {"n_words": [], "n_removed": [], "kept_text": []}
            for text, gone in zip(texts, runs, strict=True):
                words = utf8(text).split()
                kept = _kept(words, gone, width)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield out

    return add_columns(joined.select("_row", "gone"), [f"_row.{text_col}", "gone"], cut, "n_words long, n_removed long, kept_text string").drop("gone")


def remove_repeated(docs: DataFrame, width: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", **sketch) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, the kept words joined by one space.

    Columns with these names are replaced. ``sketch``: sketch_rows, bits, broadcast_bytes (see ``repeated_windows``).
    """
    added = ("n_words", "n_removed", "kept_text")
    cut = _cut(docs, width, gram, id_col, text_col, **sketch)
    return cut.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def drop_repeated(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without repeated passages. A text that loses none stays as written; a document that loses every word goes."""
    cut = _cut(docs, width, min(12, width), id_col, text_col).where("n_removed = 0 OR n_removed < n_words")
    lost = F.col("n_removed") > 0

    def value(c: str) -> Column:
        own = F.col("_row")[c]
        if c == text_col:
            return F.when(lost, F.col("kept_text")).otherwise(own)
        return F.when(lost, F.length("kept_text")).otherwise(own).cast(docs.schema[c].dataType) if c == chars_col else own

    return cut.select(*[value(c).alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document before and after repeated windows are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, s AS start, sha256(array_to_string(words[s:s + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM worded WHERE len(words) >= 50)
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(start, start + 50)) AS p FROM windows JOIN firsts USING (w) WHERE doc_id > first_id)
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM worded
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM worded w LEFT JOIN kept k USING (doc_id)
"""
