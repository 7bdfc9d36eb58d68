"""Binary tables of FITS files (a public standard) as DataFrames.

A file is blocks of 2880 bytes: headers of 80-character cards and big-endian data of fixed row length. So a row's place in its
file is known from the header, and the data source ``fits`` reads row ranges: planning reads a header a file, and each
partition is a range of rows of one table. Conditions on ``row`` narrow the ranges. Photometry that objects point to is read by
the objects' ranges, so that a list of objects costs the reading of their rows only.

Files are opened through ``pyarrow.fs``: local paths and the stores that it knows (``hdfs://``, ``s3://``, ``gs://`` ...).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from fluxloom.runtime import ship_package

_BLOCK, _CARD, _BATCH = 2880, 80, 8192
# fixed values of the standard: column codes with their numpy and Spark types
_CODES = {"L": ("u1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}

Read = Callable[[int, int], bytes]


class Field(NamedTuple):
    """A column: its code, numpy type and shape; stored numbers mean ``zero + scale * stored``, ``null`` means none."""

    name: str
    code: str
    kind: str
    shape: tuple[int, ...]
    scale: float | None
    zero: float | None
    null: int | None


class Layout(NamedTuple):
    """Where a table's rows lie in its file."""

    path: str
    start: int
    rows: int
    fields: tuple[Field, ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(f.name, f.kind, f.shape) if f.shape else (f.name, f.kind) for f in self.fields])


def _header(read: Read, at: int) -> tuple[dict, int]:
    """The cards of the header at a place, and where it ends."""
    cards: dict = {}
    while block := read(at, _BLOCK).decode("ascii", "replace"):
        at += _BLOCK
        for i in range(0, len(block), _CARD):
            card = block[i : i + _CARD]
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                text = card[10:].strip()
                cards[key] = re.match(r"'((?:[^']|'')*)'", text)[1].rstrip() if text.startswith("'") else text.split("/")[0].strip()
    return cards, at


def _fields(head: dict) -> tuple[Field, ...]:
    fields = []
    for i in range(1, int(head["TFIELDS"]) + 1):
        n, code = re.match(r"(\d*)([A-Z])", head[f"TFORM{i}"]).groups()
        count = int(n) if n else 1
        if code not in _CODES:
            raise ValueError(f"column format {head[f'TFORM{i}']}")
        number = lambda card, i=i: float(head[card + str(i)]) if card + str(i) in head else None
        null = int(head[f"TNULL{i}"]) if f"TNULL{i}" in head else None
        shape = (count,) if code != "A" and count != 1 else ()
        fields.append(Field(head.get(f"TTYPE{i}", f"col{i}").strip(), code, f"S{count}" if code == "A" else _CODES[code][0], shape, number("TSCAL"), number("TZERO"), null))
    return tuple(fields)


def layouts(read: Read, size: int, path: str = "") -> Iterator[Layout]:
    """The binary tables of a file, one after another; only headers are read."""
    at = 0
    while at < size:
        head, at = _header(read, at)
        axes = [int(head.get(f"NAXIS{i + 1}", 0)) for i in range(int(head.get("NAXIS", 0) or 0))]
        length = abs(int(head.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        if head.get("XTENSION") == "BINTABLE":
            length += int(head.get("PCOUNT", 0) or 0)
            yield Layout(path, at, axes[1], _fields(head))
        at += -(-length // _BLOCK) * _BLOCK


def _values(rows: np.ndarray, field: Field) -> list | np.ndarray:
    column = rows[field.name]
    if field.code == "A":
        return [v.decode("ascii", "replace").rstrip() for v in column]
    plain = column.astype(column.dtype.newbyteorder("="))
    if field.code == "L":
        return (plain == ord("T")).tolist() if field.shape else plain == ord("T")
    missing = plain == field.null if field.null is not None else None
    if field.scale is not None or field.zero is not None:
        scale, zero = field.scale if field.scale is not None else 1.0, field.zero or 0.0
        whole = plain.dtype.kind in "iu" and scale == int(scale) and zero == int(zero)
        plain = plain.astype(np.int64) * int(scale) + int(zero) if whole else plain * scale + zero
    if missing is not None and missing.any():
        plain = np.where(missing, None, plain)
    return plain.tolist() if field.shape else plain


def tables(data: bytes) -> Iterator[pd.DataFrame]:
    """The binary tables of a whole file in memory, one after another; columns of several numbers become lists."""
    for layout in layouts(lambda at, n: data[at : at + n], len(data)):
        rows = np.frombuffer(data, layout.dtype, layout.rows, layout.start)
        yield pd.DataFrame({f.name: _values(rows, f) for f in layout.fields})


# --- files ------------------------------------------------------------------------------------------------------------------


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _patterns(pattern: str) -> list[str]:
    """A glob pattern with its braces written out."""
    parts = [p[1:-1].split(",") if p.startswith("{") else [p] for p in re.split(r"(\{[^}]*\})", pattern)]
    return ["".join(c) for c in product(*parts)]


def _found(path: str, pattern: str) -> list[str]:
    """The files of a folder that match a pattern, or the file itself, sorted."""
    fs, local = _store(path)
    prefix = path[: len(path) - len(local)] if path.endswith(local) else ""
    if fs.get_file_info(local).type == pafs.FileType.File:
        return [path]
    files = [i for i in fs.get_file_info(pafs.FileSelector(local)) if i.type == pafs.FileType.File]
    return sorted(prefix + i.path for i in files if any(fnmatch(i.base_name, p) for p in _patterns(pattern)))


class RangeFile:
    """A file read by ranges; ``bytes_read`` counts what was fetched."""

    def __init__(self, path: str):
        fs, local = _store(path)
        self.file, self.bytes_read = fs.open_input_file(local), 0
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(min(n, max(0, self.size - at)), at)
        self.bytes_read += len(data)
        return data

    def layout(self, path: str, table: int) -> Layout:
        for i, layout in enumerate(layouts(self.read, self.size, path)):
            if i == table:
                return layout
        raise ValueError(f"{path} has no binary table {table}")

    def rows(self, layout: Layout, first: int, last: int) -> np.ndarray:
        """The rows from ``first`` up to ``last``, counted from 0."""
        width = layout.dtype.itemsize
        data = self.read(layout.start + first * width, (last - first) * width)
        if len(data) < (last - first) * width:
            raise ValueError(f"{layout.path} ends before row {last}")
        return np.frombuffer(data, layout.dtype)


def _layout(path: str, table: int) -> Layout:
    return RangeFile(path).layout(path, table)


def _batch(rows: np.ndarray, layout: Layout, arrow: pa.Schema, **more: object) -> pa.RecordBatch:
    """Rows as a batch of the columns of ``arrow``; columns that the table lacks are null."""
    fields, out = {f.name: f for f in layout.fields}, []
    for column in arrow:
        if column.name in more:
            value = more[column.name]
            values = pa.array(value) if isinstance(value, np.ndarray) else pa.array([value] * len(rows))
        elif column.name in fields:
            values = pa.array(_values(rows, fields[column.name]), from_pandas=False)
        else:
            values = pa.nulls(len(rows))
        out.append(values if values.type == column.type else values.cast(column.type))
    return pa.RecordBatch.from_arrays(out, schema=arrow)


# --- the data source ----------------------------------------------------------------------------------------------------------


class RowRange(InputPartition):
    """Rows ``first`` up to ``last``, from 0, of the table that ``layout`` describes; of ``head`` where objects are read."""

    def __init__(self, layout: Layout, first: int, last: int, head: Layout | None = None):
        self.layout, self.first, self.last, self.head = layout, first, last, head


class FitsReader(DataSourceReader):
    """Reads row ranges; see ``FitsTables`` for the options."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.options, self.arrow = dict(options), to_arrow_schema(schema)
        self.table, self.per_part = int(options.get("table", 0)), max(1, int(options.get("rows", 1 << 18)))
        self.low, self.high, self.only = 1, None, None
        self.wanted = set(json.loads(options["snid"])) if options.get("snid") else None
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on ``row`` and, where objects are read, on ``SNID``; gives back all others."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("row",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("row",) and isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)
            elif name == ("row",) and isinstance(f, (EqualTo, In)):
                rows = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = rows if self.only is None else self.only & rows
            elif name == ("SNID",) and "head" in self.options and isinstance(f, (EqualTo, In)):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = ids if self.wanted is None else self.wanted & ids
            else:
                yield f

    def partitions(self) -> Sequence[RowRange]:
        head, paths = self.options.get("head"), _found(self.options["path"], self.options.get("pattern", "*.FITS"))
        with ThreadPoolExecutor(16) as pool:
            plain = list(pool.map(lambda p: _layout(p, self.table), paths))
            heads = list(pool.map(lambda p: _layout("/".join([*p.split("/")[:-1], p.split("/")[-1].replace(self.options.get("body", "PHOT"), head)]), 0), paths)) if head else plain
        out: list[RowRange] = []
        for layout, objects in zip(plain, heads, strict=True):
            if head:  # as many objects as have about ``rows`` observations
                each = max(1, self.per_part * objects.rows // max(1, layout.rows))
                out += [RowRange(layout, at, min(objects.rows, at + each), objects) for at in range(0, objects.rows, each)]
                continue
            first, last = max(0, self.low - 1), layout.rows if self.high is None else min(layout.rows, self.high)
            if self.only is not None:
                rows = sorted(r - 1 for r in self.only if r is not None and first < r <= last)
                out += [RowRange(layout, a, b) for a, b in _runs(np.array(rows, np.int64), np.array(rows, np.int64) + 1)]
            else:
                out += [RowRange(layout, at, min(last, at + self.per_part)) for at in range(first, last, self.per_part)]
        return out

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        layout, file = part.layout, RangeFile(part.layout.path)
        name = layout.path.split("/")[-1]
        if part.head is None:
            for at in range(part.first, part.last, _BATCH):
                rows = file.rows(layout, at, min(part.last, at + _BATCH))
                yield _batch(rows, layout, self.arrow, file=name, row=np.arange(at + 1, at + 1 + len(rows)))
        else:
            about = RangeFile(part.head.path)
            found = about.rows(part.head, part.first, part.last)
            ids = np.array(_values(found, next(f for f in part.head.fields if f.name == "SNID")), object)
            ids = np.array([i.strip() if isinstance(i, str) else str(i) for i in ids], object)
            keep = np.array([self.wanted is None or i in self.wanted for i in ids], bool)
            spans = found["PTROBS_MIN"].astype(np.int64)[keep] - 1, found["PTROBS_MAX"].astype(np.int64)[keep]
            yield from _spans(file, layout, self.arrow, *spans, ids[keep], name)
            self.bytes_read += about.bytes_read
        self.bytes_read += file.bytes_read


def _runs(first: np.ndarray, last: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """Sorted spans joined to runs where at most ``gap`` rows lie between."""
    runs: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b <= a:
            continue
        if runs and a <= runs[-1][1] + gap:
            runs[-1] = runs[-1][0], max(runs[-1][1], b)
        else:
            runs.append((a, b))
    return runs


def _spans(file: RangeFile, layout: Layout, arrow: pa.Schema, first: np.ndarray, last: np.ndarray, ids: np.ndarray, name: str, gap: int = 16) -> Iterator[pa.RecordBatch]:
    """The rows of spans, each with its object's id. Spans that lie close together are fetched at once."""
    order = np.argsort(first, kind="stable")
    first, last, ids = first[order], last[order], ids[order]
    reach = np.maximum.accumulate(last) if len(last) else last
    for a, b in _runs(first, last, gap):
        for at in range(a, b, _BATCH):
            end = min(b, at + _BATCH)
            rows = file.rows(layout, at, end)
            # objects whose spans meet this stretch; spans may overlap, so each is cut out for itself
            met = np.arange(np.searchsorted(reach, at, "right"), np.searchsorted(first, end))
            met = met[last[met] > at]
            places = [np.arange(max(first[i], at), min(last[i], end)) for i in met]
            if places and sum(map(len, places)):
                owner, place = np.repeat(ids[met], [len(p) for p in places]), np.concatenate(places)
                yield _batch(rows[place - at], layout, arrow, file=name, row=place + 1, SNID=owner)


class FitsTables(DataSource):
    """The format ``fits``: one table of each file of a folder, by row ranges.

    Options: ``path`` (a folder or a file), ``pattern`` (names, default ``*.FITS``), ``table`` (which binary table, from 0), ``rows``
    (rows a partition). Beside the table's columns there are ``file``, its name, and ``row``, from 1. With ``head`` (and
    ``body``, default ``PHOT``) files are photometry that objects point to: the name with ``head`` in place of ``body`` is the
    table of objects, whose ``PTROBS_MIN`` and ``PTROBS_MAX`` bound an object's rows; partitions are ranges of objects, rows carry
    ``SNID``, and ``snid`` (a JSON list) reads the rows of these only. Conditions on ``row`` and ``SNID`` do the same. Columns of a given schema that a table lacks are null.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        paths = _found(self.options["path"], self.options.get("pattern", "*.FITS"))
        if not paths:
            raise ValueError(f"no file {self.options.get('pattern', '*.FITS')} in {self.options['path']}")
        kinds = [f"`{f.name}` {('array<' + _kind(f) + '>') if f.shape else _kind(f)}" for f in _layout(paths[0], int(self.options.get("table", 0))).fields]
        extra = ["SNID string"] if "head" in self.options and "SNID" not in {f.split("`")[1] for f in kinds} else []
        return ", ".join([*kinds, *extra, "file string", "row long"])

    def reader(self, schema: T.StructType) -> FitsReader:
        return FitsReader(self.options, schema)


def _kind(field: Field) -> str:
    if field.scale is None and field.zero is None:
        return _CODES[field.code][1]
    whole = _CODES[field.code][1] in ("int", "long") and all(x is None or x == int(x) for x in (field.scale, field.zero))
    return "long" if whole else "double"


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("fits")`` known to the session, which then hands Python sources their conditions."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses sources that take conditions without it
    spark.dataSource.register(FitsTables)


def read(spark: SparkSession, path: str, schema: str, pattern: str = "*.FITS", table: int = 0, rows: int = 1 << 18) -> DataFrame:
    """The columns of ``schema`` of one table in each file under ``path``, with the file's name as ``file``."""
    register(spark)
    return spark.read.format("fits").schema(f"{schema}, file string").option("pattern", pattern).option("table", table).option("rows", rows).load(path)


def read_spans(spans: DataFrame, schema: str, table: int = 0, rows: int = 1 << 18) -> DataFrame:
    """The rows of ``spans`` (path, SNID, first, last; from 1, inclusive) with their SNID: of any number of objects.

    Spans are dealt by file and stretch of ``rows`` rows, so each task fetches neighbouring rows.
    """
    ship_package(spans.sparkSession)
    kind = T.StructType.fromDDL(f"{schema}, SNID string")
    near = spans.select("path", "SNID", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.floor(F.col("first") / rows).alias("stretch"))
    dealt = near.repartition("path", "stretch").sortWithinPartitions("path", "first")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, path, file, layout = to_arrow_schema(kind), None, None, None
        for batch in batches:
            paths = np.array(batch.column(0).to_pylist(), object)
            ids, first, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for at in sorted({p for p in paths}):
                if at != path:
                    path, file = at, RangeFile(at)
                    layout = file.layout(at, table)
                mine = paths == at
                yield from _spans(file, layout, arrow, first[mine] - 1, last[mine], ids[mine], at.split("/")[-1])

    return dealt.mapInArrow(fetched, kind)


def head_and_phot(spark: SparkSession, path: str, head_schema: str, phot_schema: str, positive: bool = True, ids: DataFrame | None = None, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """The pairs of head and photometry files: objects, and observations with the id of the object they point to.

    A head row points to its observations by 1-based ``PTROBS_MIN`` and ``PTROBS_MAX``, which ``head_schema`` must hold. Only rows
    that objects point to are read. ``ids`` (SNID) keeps only these objects, ``prefix`` only files whose names begin so.
    """
    head = read(spark, path, head_schema, f"{prefix}*HEAD*")
    if ids is not None:
        wanted = ids.select(F.trim(F.col("SNID").cast("string")).alias("_wanted")).distinct()
        head = head.join(wanted, F.trim("SNID") == F.col("_wanted"), "left_semi")
    at = F.concat(F.lit(path.rstrip("/") + "/"), F.replace("file", F.lit("HEAD"), F.lit("PHOT")))
    spans = head.select(at.alias("path"), F.trim("SNID").alias("SNID"), F.col("PTROBS_MIN").alias("first"), F.col("PTROBS_MAX").alias("last"))
    rows = read_spans(spans, phot_schema)
    return head.drop("file"), rows.where("FLUXCAL > 0") if positive else rows


def opsim(spark: SparkSession, path: str, head_schema: str, phot_schema: str, subset: str | DataFrame = "all", positive: bool = False) -> tuple[DataFrame, DataFrame]:
    """The simulated Ia and non-Ia objects together; ``subset``: all, Ia, nIa, or a table of SNID."""
    kinds = {"all": "LSST_", "Ia": "LSST_Ia_", "nIa": "LSST_NONIa_"}
    if isinstance(subset, str):
        if subset not in kinds:
            raise ValueError(f"{subset}: one of {sorted(kinds)} or a table of SNID")
        return head_and_phot(spark, path, head_schema, phot_schema, positive, None, kinds[subset])
    return head_and_phot(spark, path, head_schema, phot_schema, positive, subset, kinds["all"])


def mapped(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """``column`` with its values renamed."""
    return df.withColumn(column, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.trim(column)), F.col(column)))


def chunks(spark: SparkSession, pattern: str, numbers: range, schema: str) -> DataFrame:
    """The union of numbered files, ``pattern`` holding ``{}`` for the number."""
    paths = [pattern.format(i).rpartition("/") for i in numbers]
    return read(spark, paths[0][0], schema, "{" + ",".join(name for _, _, name in paths) + "}")
