"""Packing documents into fixed-length sequences along a space-filling curve.

A document's bytes are hashed by trigram into a vector that is projected to three dimensions. The coordinates,
standardised over the corpus, are cut into 2^10 steps and become a place on a Hilbert curve; bits of a hash of the id
follow it, so copies, which share their place, still spread over partitions. Quantiles of these keys, twenty times finer
than a partition's share, cut the curve into one piece per partition. Each partition sorts its documents along the curve and lays their tokens end to end;
sequences are cut out of that stream, so neighbours on the curve share sequences. The last stretch of a partition is
cut into lengths that are powers of two, which need no padding.

A document is tokenized once and its tokens are shuffled once, as 16-bit numbers where the vocabulary allows it.
What the driver gathers are the three means and deviations and one key for each partition.

Defined cases: a null text is empty, and an empty text is the end token alone; very long texts are tokenized in
segments that end where a token must end; copies and repeated rows are packed each; a null id is kept as null, and such rows are spread by their number; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.arrow import map_batches
from fluxloom.llm.words import utf8
from fluxloom.runtime import materialised, table

_STEPS, _TIES, _HASHED, _DIMENSIONS = 10, 22, 4096, 3
_SEGMENT = 1 << 18


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a tokenizers file.

    A plain byte-level BPE whose ids follow its merges is run by tiktoken, which gives the same ids several times
    faster; any other file is run by tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow, self.fast = path, None, None
        ranks = self._ranks(spec)
        if ranks:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)
        top = max([*spec["model"].get("vocab", {"": 1 << 20}).values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = "<u2" if top < 1 << 16 else "<u4"

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex")
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        vocab, merges = model.get("vocab"), model.get("merges")
        if not (plain and level and vocab and merges) or spec.get("normalizer") or odd:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        return {bytes(letters[c] for c in token): rank for token, rank in vocab.items()}

    def _segments(self, text: str) -> Iterator[str]:
        """A blank after another character than white space begins a token, so texts may be cut there."""
        start = 0
        while len(text) - start > _SEGMENT:
            at = text.find(" ", start + _SEGMENT)
            while at > 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            parts = [self.fast.encode_to_numpy(s, allowed_special=self.special, disallowed_special=()) for s in self._segments(text)]
        else:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            parts = [np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(23).standard_normal((_HASHED, _DIMENSIONS))


def coordinates(text: str | None) -> np.ndarray:
    """The projected trigram vector of a text, scaled to its length."""
    data, counts = np.frombuffer(utf8(text), np.uint8), np.zeros(_HASHED)
    for start in range(0, len(data), 1 << 20):
        b = data[start : start + (1 << 20) + 2].astype(np.uint32)
        if len(b) > 2:
            mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            counts += np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=_HASHED)
    return (counts / max(1.0, np.sqrt(counts @ counts))) @ _projection()


def hilbert(steps: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of an (n, d) array of whole numbers below 2^bits (Skilling's method)."""
    x = steps.astype(np.int64).T.copy()
    d = len(x)
    for p in range(bits - 1, 0, -1):
        q, low = 1 << p, (1 << p) - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for p in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << p), turn ^ ((1 << p) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for p in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (x[i] >> p & 1)
    return key


def curve_keys(points: np.ndarray, ties: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sort keys below 2^52: the place on the curve and then bits of the ids' hashes."""
    cells = (1 << _STEPS) / (1 + np.exp(-1.702 * (points - mean) / scale))
    place = hilbert(np.clip(cells, 0, (1 << _STEPS) - 1).astype(np.int64), _STEPS)
    return (place << _TIES) | (ties & ((1 << _TIES) - 1))


def _tie(doc_id, row: int) -> int:
    """Bits of a hash of the id, or of the row's number where there is none, so that copies spread either way."""
    return xxhash.xxh64_intdigest(f"row {row}".encode() if doc_id is None else str(doc_id).encode(), 5) & ((1 << _TIES) - 1)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. ``length`` is a power of two. A
    sequence has ``length`` ids or, at the end of a partition, a smaller power of two.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = dict(rows.dtypes)["doc_id"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            points = np.array([coordinates(t) for t in batch.column(1).to_pylist()]).reshape(-1, _DIMENSIONS)
            ties = [_tie(i, r) for i, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sizes = [len(utf8(t)) for t in batch.column(1).to_pylist()]
            yield {f"x{k}": points[:, k] for k in range(_DIMENSIONS)} | {"tie": ties, "size": sizes}

    points = materialised(map_batches(rows, placed, "x0 double, x1 double, x2 double, tie long, size long"))
    found = points.agg(*[f(f"x{k}").alias(f"{n}{k}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for k in range(_DIMENSIONS)]).first()
    mean = np.array([found[f"m{k}"] or 0.0 for k in range(_DIMENSIONS)])
    scale = np.array([max(found[f"s{k}"] or 0.0, 1e-9) for k in range(_DIMENSIONS)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # a key for every 2 KB of its text, so that partitions have about the same length
        for b in batches:
            keys = curve_keys(np.stack([b.column(k).to_numpy() for k in range(_DIMENSIONS)], 1), b.column(_DIMENSIONS).to_numpy(), mean, scale)
            yield {"key": np.repeat(keys, 1 + b.column(_DIMENSIONS + 1).to_numpy() // 2048)}

    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / partitions for i in range(1, partitions)]
    cuts = map_batches(points, keyed, "key long").agg(F.percentile_approx("key", shares, max(10_000, 20 * partitions))).first()[0] if shares else []
    cuts = np.array(cuts or [], np.int64)

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                names, texts, at_row = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
                at = np.array([coordinates(t) for t in texts])
                keys = curve_keys(at, np.array([_tie(i, r) for i, r in zip(names, at_row, strict=True)]), mean, scale)
                ids = [np.append(encoder.encode(t), np.uint32(end_id)).astype(encoder.dtype).tobytes() for t in texts]
                yield {"doc_id": batch.column(0), "key": keys, "part": np.searchsorted(cuts, keys, "left").astype(np.int32), "wide": [encoder.dtype == "<u4"] * len(ids), "ids": ids}

    tokens = map_batches(rows, tokenized, f"doc_id {kind}, key long, part int, wide boolean, ids binary")
    along = tokens.repartitionById(partitions, F.col("part")).sortWithinPartitions("part", "key", "doc_id", "ids")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first, made, room, held, out = None, 0, length, [], []
        for batch in batches:
            columns = [batch.column(i) for i in (0, 2, 3, 4)]
            for doc_id, part, wide, data in zip(*(c.to_pylist() for c in columns), strict=True):
                ids, at = np.frombuffer(data, "<u4" if wide else "<u2"), 0
                first = part << 32 if first is None else first
                while at < len(ids):
                    piece = ids[at : at + room]
                    held.append((doc_id, at, len(ids), piece))
                    at, room = at + len(piece), room - len(piece)
                    if not room:
                        out += _laid(held, first + made)
                        made, room, held = made + 1, length, []
                if len(out) >= 512:
                    yield _columns(out)
                    out = []
        left, size = length - room, length
        while left:
            size >>= 1
            if left >= size:
                head, held, need = [], list(held), size
                while need:
                    doc_id, start, total, piece = held.pop(0)
                    head.append((doc_id, start, total, piece[:need]))
                    if len(piece) > need:
                        held.insert(0, (doc_id, start + need, total, piece[need:]))
                    need -= min(need, len(piece))
                out += _laid(head, first + made)
                made, left = made + 1, left - size
        yield _columns(out)

    return map_batches(along, packed, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _laid(pieces: list, sequence: int) -> list[tuple]:
    rows, offset = [], 0
    for doc_id, start, total, ids in pieces:
        rows.append((doc_id, start, len(ids), total, sequence, offset, ids.astype("<u4").tobytes()))
        offset += len(ids)
    return rows


def _columns(rows: list[tuple]) -> dict:
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, with a checksum of each piece's ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
