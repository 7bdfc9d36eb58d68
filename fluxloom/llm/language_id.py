"""Language identification by hyperdimensional profiles.

Letters have random vectors of +1 and -1. A trigram binds its letters' vectors, each rolled by its place, into their
product; a document bundles its trigrams' vectors into their sum, and a language's prototype bundles the documents
labelled with it, each scaled to length one. A document's language is the prototype of the largest cosine.

Text is lower-cased; a run of other characters than letters counts as one blank. Every letter has a vector of its own, drawn
from its code point when it is first met. Prototypes are sums of integers and do not depend on how rows are dealt out.
They are learned as a table and broadcast in blocks of ``block`` languages, of which the driver holds one at a time; a worker
holds 2 KB for each language. Scores are cosines, 0 at least.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be
learned; labels that are null, and texts that are ``und``, teach nothing; equal cosines go to the first language by
name; very long texts are read in blocks; repeated rows count each; an empty table gives an empty result; columns named
like those added are replaced by ``identify_language`` and kept with their values by ``tell_language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.arrow import add_columns, map_batches
from fluxloom.runtime import table

_BITS, _BLOCK, _UNIT = 21, 1 << 20, 1 << 20
_TABLED, _LETTERS = 1 << 15, 1 << 14
UNDETERMINED = "und"


@lru_cache(1)
def _letter_codes() -> np.ndarray:
    """The code of every code point: its own for a letter, 0 for others."""
    return np.fromiter((p if chr(p).isalpha() else 0 for p in range(0x110000)), np.int32, 0x110000)


def _counted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of a run of codes and their counts; where all are small, counted as shorter numbers."""
    if s.max() < 1 << 10:
        grams, counts = np.unique((s[:-2] << 20) | (s[1:-1] << 10) | s[2:], return_counts=True)
        s = grams.astype(np.int64)
        return (s >> 20 << 2 * _BITS) | ((s >> 10 & 1023) << _BITS) | (s & 1023), counts
    s = s.astype(np.int64)
    return np.unique((s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:], return_counts=True)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's trigrams; none where it has no letter."""
    codes, found, last = _letter_codes(), [], np.zeros(1, np.int32)
    text, letters = text or "", False
    for start in range(0, max(len(text), 1), _BLOCK):
        block = np.frombuffer(text[start : start + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.concatenate([last, codes[block], np.zeros(int(start + _BLOCK >= len(text)), np.int32)])
        letters = letters or bool(s.any())
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        if len(s) > 2:
            found.append(_counted(s))
        last = s[-2:]
    if not letters or not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


class Hypervectors:
    """Vectors of trigrams, made from the letters' when first met; the first 32768 of a process are kept."""

    def __init__(self, dimensions: int, seed: int):
        self.seed, self.dimensions = seed, dimensions
        self.turned = [np.roll(np.arange(dimensions), 2 - place) for place in range(3)]
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.kept = np.empty((1024, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        found = self.letters.get(point)
        if found is None:
            found = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, np.int8) * np.int8(2) - np.int8(1)
            if len(self.letters) < _LETTERS:
                self.letters[point] = found
        return found

    def bound(self, grams: np.ndarray) -> np.ndarray:
        mask, out = (1 << _BITS) - 1, None
        for place, shift in enumerate((2 * _BITS, _BITS, 0)):
            points, at = np.unique(grams >> shift & mask, return_inverse=True)
            placed = np.stack([self.letter(int(p)) for p in points])[:, self.turned[place]][at]
            out = placed if out is None else out * placed
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        grams = grams.astype(np.int64)
        look = self.row.get
        rows = np.fromiter((look(g, -1) for g in grams.tolist()), np.int64, len(grams))
        if (rows < 0).any() and len(self.row) < _TABLED:
            new, used = grams[rows < 0][: _TABLED - len(self.row)], len(self.row)
            if used + len(new) > len(self.kept):
                grown = np.empty((min(_TABLED, 2 * (used + len(new))), self.dimensions), np.int8)
                grown[:used] = self.kept[:used]
                self.kept = grown
            for start in range(0, len(new), 4096):
                self.kept[used + start : used + start + 4096][: len(new) - start] = self.bound(new[start : start + 4096])
            self.row.update(zip(new.tolist(), range(used, used + len(new)), strict=True))
            rows = np.fromiter((look(g, -1) for g in grams.tolist()), np.int64, len(grams))
        known = rows >= 0
        if known.all():
            return counts.astype(np.float32) @ self.kept[rows].astype(np.float32)
        total = counts[known].astype(np.float32) @ self.kept[rows[known]].astype(np.float32)
        rest, n = grams[~known], counts[~known].astype(np.float32)
        for start in range(0, len(rest), 4096):
            total += n[start : start + 4096] @ self.bound(rest[start : start + 4096]).astype(np.float32)
        return total


@lru_cache(4)
def _vectors(dimensions: int, seed: int) -> Hypervectors:
    return Hypervectors(dimensions, seed)


class Prototypes(NamedTuple):
    """Learned languages, by name, and their unit vectors in broadcast blocks of consecutive languages."""

    languages: tuple[str, ...]
    blocks: tuple[Broadcast, ...]
    dimensions: int
    seed: int


def learn_prototypes(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = 512, seed: int = 17, block: int = 4096) -> Prototypes:
    """Bundle all labelled rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vectors, sums = _vectors(dimensions, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = trigrams(text)
                if len(grams):
                    v = vectors.bundle(grams, counts)
                    if norm := float(np.sqrt(v @ v)):
                        sums[lang] = sums.get(lang, 0) + np.rint(v * (_UNIT / norm)).astype(np.int64)
                if len(sums) >= 512:
                    yield {"lang": list(sums), "total": [v.tolist() for v in sums.values()]}
                    sums = {}
        if sums:
            yield {"lang": list(sums), "total": [v.tolist() for v in sums.values()]}

    labelled = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = map_batches(labelled, partial, "lang string, total array<bigint>")
    summed = parts.select("lang", F.posexplode("total").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("total"))
    names, blocks, held = [], [], []

    def shared() -> None:
        if held:
            units = np.array([v / max(np.linalg.norm(v), 1e-12) for v in held], np.float32)
            blocks.append(rows.sparkSession.sparkContext.broadcast(units))
            held.clear()

    for lang, total in whole.orderBy("lang").toLocalIterator():
        names.append(lang)
        held.append(np.array(total, np.float64))
        if len(held) == block:
            shared()
    shared()
    return Prototypes(tuple(names), tuple(blocks), dimensions, seed)


def identify_language(docs: DataFrame, prototypes: Prototypes, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes.languages)
    blocks, dimensions, seed = prototypes.blocks, prototypes.dimensions, prototypes.seed

    def judged(batches: Iterator[list[list]]) -> Iterator[dict]:
        names, vectors = shared.value, _vectors(dimensions, seed)
        for (texts,) in batches:
            langs, scores = [], []
            for text in texts:
                grams, counts = trigrams(text)
                if not len(grams) or not names:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                v = vectors.bundle(grams, counts)
                best, score, start = 0, -2.0, 0
                for b in blocks:
                    cosines = b.value @ v / max(float(np.sqrt(v @ v)), 1e-12)
                    at = int(np.argmax(cosines))
                    if cosines[at] > score:
                        best, score = start + at, float(cosines[at])
                    start += len(cosines)
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, score)))
            yield {"lang_pred": langs, "score": scores}

    return add_columns(docs, [text_col], judged, "lang_pred string, score double")


def tell_language(docs: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that are ``und``; a null ``lang_col`` is filled with the prediction."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    told = identify_language(rows, prototypes, f"_row.{text_col}").where(F.col("lang_pred") != UNDETERMINED)
    value = lambda c: F.coalesce(F.col("_row")[c], "lang_pred") if c == lang_col else F.col("_row")[c]
    return told.select(*[value(c).alias(c) for c in docs.columns])


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    prototypes = learn_prototypes(docs.where(~held_out))
    return identify_language(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
