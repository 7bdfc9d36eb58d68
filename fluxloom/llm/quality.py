"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text gives 26 statistics of its characters, words and lines. Standardised, they are mapped to cosines and sines of
random projections, whose inner products approximate a Gaussian kernel. Every partition sums the normal equations of
its labelled rows; the sums of all partitions, a fixed number of small matrices, are solved on the driver. The rows
are summed in two halves: the model of one half scores the other, and these scores are calibrated by isotonic
regression over 2001 bins. The model of both halves then scores every document.

Statistics and cosines are rounded to whole numbers before they are summed, so models do not depend on how rows are
dealt out. All labelled rows teach; none is sampled.

Defined cases: a null text is empty and an empty text is scored by its statistics like others; labels that are null
or belong to no document teach nothing and a document labelled twice teaches twice; where nothing could be learned
every score is 0.5; very long texts are read in blocks; an empty table gives an empty result; columns named like those
added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.arrow import add_columns, map_batches
from fluxloom.llm.language_id import id_remainder
from fluxloom.llm.words import byte_blocks, utf8
from fluxloom.runtime import materialised, table

_GRID, _COSINE = 10_000, 1024
_BINS = 2001
STATISTICS = 26


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def _byte_class(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_UPPER = _byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _byte_class(b"abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_DIGIT = _byte_class(b"0123456789")
_SPACE = _byte_class(b" \t\n\x0b\x0c\r")
_STOP = _byte_class(b".,;:?'\"-()")
_SIGN = ~(_LETTER | _DIGIT | _SPACE | _STOP)


def statistics(text: str | None) -> list[int]:
    """The 26 statistics of a text, each at most a few tens, in ten-thousandths."""
    data = utf8(text)
    bytes_seen, lengths, codes, capitals, signed, ended = np.zeros(256, np.int64), [], [], 0, 0, 0
    for block in byte_blocks(data):
        bytes_seen += np.bincount(np.frombuffer(block, np.uint8), minlength=256)
        words = block.split()
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        codes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        capitals += sum(map(bytes.isupper, words))
        signed += sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!" for w in words)
        ended += sum(w[-1:] in b".?!" for w in words)
    length, code = np.concatenate(lengths), np.concatenate(codes)
    n, words, lines = len(data), len(length), data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    _, repeats = np.unique(code, return_counts=True)
    pairs = np.unique(code[1:] * np.int64(0x5851F42D4C957F2D) + code[:-1]).size
    share = bytes_seen / max(1, n)
    entropy = -float(np.sum(share[share > 0] * np.log2(share[share > 0])))
    tell = lambda kind: _share(int(bytes_seen[kind].sum()), n)
    letters = int(bytes_seen[_LETTER].sum())
    values = [
        np.log1p(n), np.log1p(words), np.log1p(len(filled)),
        float(length.mean()) if words else 0.0, float(length.std()) if words else 0.0, np.log1p(int(length.max())) if words else 0.0,
        tell(_LETTER), _share(int(bytes_seen[_UPPER].sum()), letters), tell(_DIGIT), tell(_SPACE), tell(_STOP), tell(_SIGN),
        _share(int(bytes_seen[ord("|")]), words), _share(int(bytes_seen[ord("!")]), words), _share(int(bytes_seen[10]), words), tell(slice(128, 256)),
        _share(len(repeats), words), _share(int(repeats.max()) if words else 0, words), _share(pairs, max(0, words - 1)),
        _share(len(set(filled)), len(filled)), np.log1p(_share(words, len(filled))), _share(sum(x.rstrip()[-1:] in b".?!" for x in filled), len(filled)),
        _share(capitals, words), _share(signed, words), np.log1p(_share(words, ended + 1)), entropy,
    ]
    return [int(round(min(40.0, float(v)) * _GRID)) for v in values]


class Fourier(NamedTuple):
    """Standardisation and random frequencies."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Cosines, sines and a constant, as whole numbers up to 1024."""
        x = np.clip((rows - self.mean) / self.scale, -5, 5) @ self.frequencies
        return np.rint(_COSINE * np.hstack([np.cos(x), np.sin(x), np.ones((len(x), 1))]))


class QualityModel(NamedTuple):
    """A fitted classifier; ``knots`` and ``values`` are the calibration."""

    fourier: Fourier | None
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.fourier is None or not len(rows):
            return np.full(len(rows), 0.5)
        return np.clip(np.interp(self.fourier.lifted(rows) @ self.weights, self.knots, self.values), 0.0, 1.0)


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` with an array of statistics."""

    def counted(batches: Iterator[list[list]]) -> Iterator[dict]:
        for (texts,) in batches:
            yield {name: [statistics(t) for t in texts]}

    return add_columns(docs, [text_col], counted, f"{name} array<long>")


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centres and means of the blocks of a non-decreasing fit."""
    blocks: list[list[float]] = []
    for centre, s, count in zip(x, total, n, strict=True):
        blocks.append([centre * count, float(s), float(count)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS).astype(np.float64)


def fit_quality(labelled: DataFrame, frequencies: int = 160, width: float = 3.0, ridge: float = 1e-4, seed: int = 31) -> QualityModel:
    """Fit on rows of (key, statistics, label): ``key`` puts rows into halves, ``label`` is 0 or 1."""
    labelled = materialised(labelled.where(F.col("label").isNotNull()).select((F.xxhash64("key") % 2 != 0).cast("int").alias("half"), "statistics", F.col("label").cast("double").alias("label")))
    each = [F.col("statistics")[i] for i in range(STATISTICS)]
    sums = labelled.agg(F.count("*"), *[F.sum(x) for x in each], *[F.sum((x * x).cast("decimal(38,0)")) for x in each]).first()
    count = sums[0]
    if not count:
        return QualityModel(None, np.zeros(0), np.zeros(0), np.zeros(0))
    mean = np.array([float(v) / count for v in sums[1 : 1 + STATISTICS]])
    spread = np.sqrt(np.maximum(np.array([float(v) / count for v in sums[1 + STATISTICS :]]) - mean**2, 0))
    drawn = np.random.default_rng(seed).standard_normal((STATISTICS, frequencies)) / width
    fourier = Fourier(mean, np.maximum(spread, 1.0), drawn)
    size = 2 * frequencies + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals = np.zeros((2, size, size + 2), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                z, half, y = fourier.lifted(_rows(batch.column(1))), batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for h in (0, 1):
                    own = z[half == h]
                    totals[h] += (own.T @ np.hstack([own, (y[half == h] * 1.0)[:, None], np.ones((len(own), 1))])).astype(np.int64)
        for h in (0, 1):
            yield {"half": [h] * size, "row": list(range(size)), "total": totals[h].tolist()}

    parts = map_batches(labelled, summed, "half int, row int, total array<long>")

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for values in batch.column(2):
                total += values.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"half": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([key[1].as_py()], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

    equations = np.zeros((2, size, size + 2))
    for half, row, total in parts.groupBy("half", "row").applyInArrow(merge, "half int, row int, total array<long>").collect():
        equations[half, row] = total

    def solved(e: np.ndarray) -> np.ndarray:
        n = max(1.0, e[-1, -1] / _COSINE)
        a, b = e[:, :size] / (n * _COSINE**2), e[:, size] / (n * _COSINE)
        penalty = ridge + 2.0 / n
        return np.linalg.solve(a + penalty * np.eye(size), b) / _COSINE

    crossed = [solved(equations[1]), solved(equations[0])]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            raw = np.einsum("ij,ij->i", fourier.lifted(_rows(batch.column(1))), np.array(crossed)[batch.column(0).to_numpy()])
            yield {"bin": np.rint((np.clip(raw, -0.5, 1.5) + 0.5) * (_BINS - 1) / 2).astype(np.int32), "label": batch.column(2)}

    bins = map_batches(labelled, judged, "bin int, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).orderBy("bin").collect()
    knots, values = isotonic(*(np.array(c, float) for c in zip(*[(b * 2 / (_BINS - 1) - 0.5, s, n) for b, s, n in bins], strict=True)))
    return QualityModel(fourier, solved(equations[0] + equations[1]), knots, values)


def score_quality(rows: DataFrame, model: QualityModel, statistics_col: str = "statistics") -> DataFrame:
    """``rows`` with score; the statistics are dropped."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[list[list]]) -> Iterator[dict]:
        for (values,) in batches:
            yield {"score": shared.value.scores(np.array(values, np.float64).reshape(len(values), STATISTICS)).tolist()}

    return add_columns(rows, [statistics_col], judged, "score double").drop(statistics_col)


def op9_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """A quality score for every document, learned from the labels that are not held out."""
    docs = with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    known = materialised(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    learn = labels.where(id_remainder(F.col("key"), 5) != 0)
    labelled = known.join(learn, known["doc_id"] == learn["key"]).select("key", "statistics", "label")
    scored = score_quality(known, fit_quality(labelled))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
