"""Token ids of documents in binary files that can be read document by document.

A file (a shard) is a row of independent zstandard frames, then an index of its documents, then a seek table, both in
skippable frames, so that any zstandard reader can unpack the whole. A document is one frame or, beyond ``frame_ids`` ids,
several; a frame never holds two documents. The seek table is that of zstandard's seekable format: compressed size, size and
the low half of the XXH64 of the plain bytes for each frame, the number of frames and a closing magic number. A reader
finds a document in the index and its frames' places in the seek table, unpacks only these frames and checks each.

Documents are range-sorted by id, ties by their row's number, and each task cuts its range into shards of about
``shard_bytes``. Spark's own text sink writes them, one value a file with the closing magic number as line separator, so
files are committed as any other output of a job: a lost or repeated task leaves neither a part of a file nor a second one,
on every file system that Spark knows. A manifest beside the files holds each shard's place in the order and the ids before it.

Ids are those of the ``tokenizers`` library. A file that ``Encoder`` (see packing) can run faster is run so, and each task holds
the first document of every batch against the library itself and stops if they differ.

Defined cases: a null text is empty, and an empty text is the end id alone; null ids come last and are kept as null; rows that
repeat an id are documents of their own, in the order of the table; very long texts are cut into frames of ``frame_ids`` ids;
an empty table gives files without documents or none, and an empty result; extra columns are ignored; a frame whose checksum
differs stops the read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.arrow import map_batches
from fluxloom.llm.packing import Encoder, tokenizer_path
from fluxloom.ordering import running_sums
from fluxloom.runtime import broadcast_if_small, ensure_checkpoint_dir, materialised, table

# fixed values of the zstandard and zstandard seekable formats: skippable frames, closing magic number, checksum flag
_INDEX_MAGIC, _SEEK_MAGIC, _CLOSING, _CHECKED = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80

_HEAD = "<QQQB"  # part, place among the part's shards, documents, bytes of an id


@lru_cache(2)
def _encoders(path: str):
    from tokenizers import Tokenizer

    return Encoder(path), Tokenizer.from_file(path)


def _low32(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Builds one shard in memory: ``add`` documents, ``size`` so far, ``finish`` for its bytes."""

    def __init__(self, part: int, place: int, dtype: str, frame_ids: int, level: int):
        self.head, self.dtype, self.frame_ids = (part, place), dtype, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames, self.entries, self.size = [], [], 0
        self.doc_ids, self.counts, self.parts = [], [], []

    def _frame(self, frame: bytes, plain: int, check: int) -> None:
        self.frames.append(frame)
        self.entries.append((len(frame), plain, check))
        self.size += len(frame) + 32

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        pieces = range(0, max(1, len(ids)), self.frame_ids)
        for start in pieces:
            plain = ids[start : start + self.frame_ids].astype(self.dtype).tobytes()
            self._frame(self.packer.compress(plain), len(plain), _low32(plain))
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.parts.append(len(pieces))

    def finish(self) -> bytes:
        named = np.array([i is not None for i in self.doc_ids], bool)
        columns = np.array([i or 0 for i in self.doc_ids], "<i8"), named, np.array(self.counts, "<u8"), np.array(self.parts, "<u4")
        head = struct.pack(_HEAD, *self.head, len(named), np.dtype(self.dtype).itemsize)
        index = self.packer.compress(head + b"".join(c.tobytes() for c in columns))
        self._frame(struct.pack("<II", _INDEX_MAGIC, len(index)) + index, 0, _low32(b""))
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), _CHECKED, _CLOSING)
        return b"".join([*self.frames, struct.pack("<II", _SEEK_MAGIC, len(table)), table])


class Shard:
    """Reads a shard by ranges: ``read(start, end)`` gives the bytes of a range, so that only what is asked for is fetched.

    ``unpacked`` counts the frames unpacked so far.
    """

    def __init__(self, read, size: int):
        self.read, self.unpacked, self.unpacker = read, 0, zstandard.ZstdDecompressor()
        n, flags, closing = struct.unpack("<IBI", read(size - 9, size))
        if closing != _CLOSING or not flags & _CHECKED:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n
        self.entries = np.frombuffer(read(start, size - 9), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(self.entries[:, 0])
        self.starts = ends - self.entries[:, 0]
        plain = self.unpacker.decompress(read(int(self.starts[-1]) + 8, int(ends[-1])))
        self.part, self.place, docs, width = struct.unpack_from(_HEAD, plain)
        at, columns = struct.calcsize(_HEAD), []
        for kind in ("<i8", "?", "<u8", "<u4"):
            columns.append(np.frombuffer(plain, kind, docs, at))
            at += columns[-1].nbytes
        self.named, self.counts, self.frames, self.dtype = columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), f"<u{width}"
        self.doc_ids = [int(i) if ok else None for i, ok in zip(columns[0], self.named, strict=True)]
        self.first_frame = np.cumsum(self.frames) - self.frames
        self.before = np.cumsum(self.counts) - self.counts

    @classmethod
    def of(cls, data: bytes) -> Shard:
        view = memoryview(data)
        return cls(lambda a, b: view[a:b], len(view))

    @classmethod
    def of_tail(cls, tail: bytes) -> Shard:
        """A shard of which only index and seek table are at hand."""
        n = struct.unpack_from("<I", tail, len(tail) - 9)[0]
        size = int(np.frombuffer(tail, "<u4", 3 * n, len(tail) - 9 - 12 * n)[::3].astype(np.int64).sum()) + 12 * n + 17
        return cls(lambda a, b: tail[a - size + len(tail) : b - size + len(tail)], size)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the shard."""
        out = []
        for k in range(self.first_frame[place], self.first_frame[place] + self.frames[place]):
            start, (size, plain, check) = int(self.starts[k]), self.entries[k]
            data = self.unpacker.decompress(self.read(start, start + int(size)), max_output_size=int(plain))
            self.unpacked += 1
            if len(data) != plain or _low32(data) != check:
                raise ValueError(f"frame {k} of shard {self.part}-{self.place} does not match its checksum")
            out.append(np.frombuffer(data, self.dtype))
        return out[0] if len(out) == 1 else np.concatenate(out)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, frame_ids: int = 1 << 18, level: int = 3) -> None:
    """Write the ids of ``docs``, each with ``end_id`` behind it, in ascending id order to ``folder``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        fast, library = _encoders(tokenizer)
        part, place, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = text.as_py() or ""
                ids = fast.encode(text)
                if not k and not np.array_equal(ids, np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)):
                    raise ValueError(f"the encoder and the tokenizers library differ on document {doc_id}")
                shard = shard or ShardWriter(part, place, fast.dtype, frame_ids, level)
                shard.add(doc_id, np.append(ids, np.uint32(end_id)))
                if shard.size >= shard_bytes:
                    yield {"shard": [shard.finish()[:-4]]}
                    place, shard = place + 1, None
        if shard:
            yield {"shard": [shard.finish()[:-4]]}

    made = map_batches(ordered.select("doc_id", "text"), shards, "shard binary")
    closing = struct.pack("<I", _CLOSING).decode("latin-1")
    made.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", closing).option("encoding", "ISO-8859-1").text(folder)
    spark = docs.sparkSession
    sizes = materialised(map_batches(_files(spark, folder).select(_tail(F.col("content"))), _sizes, "part long, place long, n_docs long, n_ids long"))
    sizes = sizes.withColumnsRenamed({"part": "of_part", "place": "of_place"})
    running_sums(sizes, [F.col("of_part"), F.col("of_place")], start=F.col("n_ids")).write.parquet(f"{folder}/_manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(folder).where("length > 0")


def _number(data: Column, before_end: int) -> Column:
    """The little-endian number of four bytes that begins so many bytes before the end."""
    one = lambda k: F.substring(data, k - before_end, 1)
    return F.conv(F.hex(F.concat(one(3), one(2), one(1), one(0))), 16, 10).cast("long")


def _tail(content: Column) -> Column:
    """Index and seek table: all that the manifest needs of a file."""
    size = _number(content, 21) + 12 * _number(content, 9) + 17
    return content.substr((F.length(content) - size + 1).cast("int"), size.cast("int")).alias("tail")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        out = {"part": [], "place": [], "n_docs": [], "n_ids": []}
        for tail in batch.column(0).to_pylist():
            shard = Shard.of_tail(tail)
            for name, x in zip(out, (shard.part, shard.place, len(shard.counts), int(shard.counts.sum())), strict=True):
                out[name].append(x)
        yield out


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of ``folder``, or of those whose id is in the column doc_id of ``wanted``.

    ``ids`` are little-endian unsigned 32-bit numbers, the end id last; ``start`` counts the ids of all documents before. Only
    frames of wanted documents are unpacked.
    """
    files = _files(spark, folder)
    if wanted is None:
        source = files.select("content", F.lit(None).cast("array<int>").alias("places"))
    else:
        held = map_batches(files.select("path", _tail(F.col("content"))), _places, "file string, place int, doc_id long")
        asked = held.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        places = materialised(asked.groupBy("file").agg(F.collect_list("place").alias("places")))
        source = files.join(broadcast_if_small(places), F.col("path") == F.col("file")).select("content", "places")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("of_part", "of_place", "doc_id", "at", "n_tokens", "ids")
        for batch in batches:
            for k in range(batch.num_rows):
                shard, places = Shard.of(batch.column(0)[k].as_buffer()), batch.column(1)[k].as_py()
                places = range(len(shard.counts)) if places is None else sorted(places)
                for start in range(0, len(places), 256):
                    rows = [(shard.part, shard.place, shard.doc_ids[p], int(shard.before[p]), int(shard.counts[p]), shard.ids(p).astype("<u4").tobytes()) for p in places[start : start + 256]]
                    yield dict(zip(names, zip(*rows, strict=True), strict=True))

    found = map_batches(source, unpacked, "of_part long, of_place long, doc_id long, at long, n_tokens long, ids binary")
    manifest = materialised(spark.read.parquet(f"{folder}/_manifest").select(F.col("of_part").alias("m_part"), F.col("of_place").alias("m_place"), F.col("start").alias("lift")))
    same = (F.col("of_part") == F.col("m_part")) & (F.col("of_place") == F.col("m_place"))
    return found.join(broadcast_if_small(manifest), same).select("doc_id", (F.col("lift") + F.col("at")).alias("start"), "n_tokens", "ids")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for path, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard.of_tail(tail)
            yield {"file": [path] * len(shard.counts), "place": list(range(len(shard.counts))), "doc_id": shard.doc_ids}


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized, written to files in the shared folder and read back, with a checksum of each document's ids.

    The files stay beside the checkpoints: the result is read from them.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
