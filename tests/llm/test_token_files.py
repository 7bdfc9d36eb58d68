"""Token files: round trips, the layout, reading of chosen documents, checksums and the defined cases."""

import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxloom.llm import token_files
from fluxloom.llm.packing import tokenizer_path
from fluxloom.runtime import table

TOKENIZER = tokenizer_path("byte_bpe_50k.json")


def _want(rows):
    """(doc_id, start, ids) by the library, in the order of the files."""
    library, at, out = Tokenizer.from_file(TOKENIZER), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, ids.tobytes()))
        at += len(ids)
    return out


def test_query_matches_the_library(spark, small):
    docs = table(spark, small, "documents")
    want = [(i, at, len(ids) // 4, zlib.crc32(ids)) for i, at, ids in _want([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])]
    assert sorted(map(tuple, token_files.op13_token_files(spark, small).collect())) == want


def test_round_trip_of_odd_rows(spark, docs, odd, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write_tokens(docs(odd), folder, TOKENIZER, shard_bytes=100, frame_ids=1000)
    assert len(list((tmp_path / "t").glob("part-*"))) > 3  # a shard that is full is closed
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    want = _want([(i, t) for i, t, _, _ in odd])
    assert [(r.doc_id, bytes(r.ids)) for r in found if r.doc_id not in (4, None)] == [(i, x) for i, _, x in want if i not in (4, None)]
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.doc_id, bytes(r.ids)) for r in found], key=key) == sorted([(i, x) for i, _, x in want], key=key)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in found[-2:]] == [None, None]  # rows without an id come last


def test_empty_table(spark, docs, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write_tokens(docs([]), folder, TOKENIZER)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_chosen_documents(spark, small, tmp_path):
    docs, folder = table(spark, small, "documents"), str(tmp_path / "t")
    token_files.write_tokens(docs, folder, TOKENIZER)
    every = token_files.read_tokens(spark, folder)
    wanted = docs.where("doc_id % 37 = 5 OR doc_id = 11").select("doc_id").unionByName(spark.range(10**9, 10**9 + 3).select(F.col("id").alias("doc_id")))
    some = token_files.read_tokens(spark, folder, wanted)
    key = lambda r: r.doc_id
    assert sorted(some.collect(), key=key) == sorted(every.where("doc_id % 37 = 5 OR doc_id = 11").collect(), key=key)


def _shard(texts, frame_ids=100):
    shard = token_files.ShardWriter(3, 1, "<u2", frame_ids, 3)
    for i, n in enumerate(texts):
        shard.add(None if i == 2 else i * 10, np.arange(n, dtype=np.uint32) % 50_000)
    return shard.finish()


def test_only_asked_frames_are_unpacked():
    shard = token_files.Shard.of(_shard([5, 250, 0, 99]))
    assert (shard.part, shard.place, shard.doc_ids) == (3, 1, [0, 10, None, 30])
    assert (shard.ids(1) == np.arange(250)).all() and shard.unpacked == 3
    assert len(shard.ids(2)) == 0 and shard.unpacked == 4
    assert [shard.ids(k).size for k in range(4)] == [5, 250, 0, 99] and list(shard.before) == [0, 5, 255, 255]


def test_layout_is_plain_zstandard():
    data = _shard([5, 250, 0, 99])
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
        assert r.read() == b"".join((np.arange(n) % 50_000).astype("<u2").tobytes() for n in (5, 250, 0, 99))
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    entries = np.frombuffer(data[-9 - 12 * n : -9], "<u4").reshape(n, 3)
    assert (n, flags, magic) == (7, 0x80, 0x8F92EAB1) and entries[:, 1].tolist() == [10, 200, 200, 100, 0, 198, 0]
    skip, size = struct.unpack_from("<II", data, int(entries[:, 0].sum()))
    assert (skip, size) == (0x184D2A5E, 12 * n + 9)


def test_a_damaged_frame_is_told():
    data = bytearray(_shard([5000], frame_ids=10_000))
    shard = token_files.Shard.of(bytes(data))
    assert len(shard.ids(0)) == 5000
    for at in range(12, 60, 7):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises((ValueError, zstandard.ZstdError)):
            token_files.Shard.of(bytes(bad)).ids(0)
    with pytest.raises(ValueError):
        token_files.Shard.of(bytes(data[:-4]) + b"\0\0\0\0")
