"""One text file per object, and a list of their names, as a sink that commits whole.

Lines come sorted by file, so a task has one file open at a time. Each try of a task writes into a folder of its own; committing
moves the files of the tries that count into place and merges their sorted names into the list file, name by name. A lost or
repeated try leaves nothing behind.

Files are written through ``pyarrow.fs``, as those of the source ``fits`` are read.
"""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from fluxloom.runtime import ship_package
from fluxloom.schema import TYPE_NAMES, LightCurves
from fluxloom.sources.fits import _store


@dataclass
class Written(WriterCommitMessage):
    """The folder of one try of a task."""

    folder: str


class ObjectFilesWriter(DataSourceWriter):
    def __init__(self, path: str, name: str, overwrite: bool):
        self.path, self.name, self.overwrite, self.work = path.rstrip("/"), name, overwrite, f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        fs, folder = _store(f"{self.work}/{context.partitionId()}-{context.taskAttemptId()}")
        fs.create_dir(folder)
        last, out = None, None
        with fs.open_output_stream(f"{folder}/_names") as names:
            for row in iterator:
                if row.file != last:
                    if out:
                        out.close()
                    last, out = row.file, fs.open_output_stream(f"{folder}/{row.file}")
                    names.write(f"{row.file}\n".encode())
                out.write(f"{row.line}\n".encode())
            if out:
                out.close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _store(self.path)
        if fs.get_file_info(f"{path}/{self.name}").type == pafs.FileType.File:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.path}/{self.name} is there already")
            with fs.open_input_stream(f"{path}/{self.name}") as old:
                for name in _lines(old):
                    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
                        fs.delete_file(f"{path}/{name}")
        folders = [m.folder for m in messages if m is not None]
        with fs.open_output_stream(f"{path}/{self.name}") as out:
            streams = [fs.open_input_stream(f"{folder}/_names") for folder in folders]
            for name, folder in heapq.merge(*[zip(_lines(s), itertools.repeat(folder)) for s, folder in zip(streams, folders, strict=True)]):
                fs.move(f"{folder}/{name}", f"{path}/{name}")
                out.write(f"{name}\n".encode())
            for s in streams:
                s.close()
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, work = _store(self.work)
        if fs.get_file_info(work).type == pafs.FileType.Directory:
            fs.delete_dir(work)


def _lines(stream: pafs.FileSystem, block: int = 1 << 16) -> Iterator[str]:
    rest = b""
    while data := stream.read(block):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield line.decode()
    if rest:
        yield rest.decode()


class ObjectFiles(DataSource):
    """The format ``object_files`` for rows (file, line) that are sorted by file. Options: path, and list, the list file's name."""

    @classmethod
    def name(cls) -> str:
        return "object_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectFilesWriter:
        return ObjectFilesWriter(self.options["path"], self.options.get("list", "objects.LIST"), overwrite)


def _number(value: Column) -> Column:
    """A number that reads back as the same double."""
    return value.cast("double").cast("string")


def save_objects(data: LightCurves, path: str, name: str, key: str = "object_id") -> None:
    """``<id>.DAT`` for each object and ``<name>.LIST``, in the form that ``spcc.read`` reads.

    An id that ends in .DAT is the file's name as it is. Times are those since the object's first observation plus
    ``initial_observation_time`` where ``objects`` has it. The object's z, z_err and target are header lines, where they are known.
    """
    spark = data.observations.sparkSession
    register(spark)
    file = F.when(F.col(key).cast("string").endswith(".DAT"), F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit(".DAT")))
    about = data.objects.withColumn("_file", file)
    has = set(about.columns)
    start = F.coalesce(F.col("initial_observation_time").cast("double"), F.lit(0.0)) if "initial_observation_time" in has else F.lit(0.0)
    obs = data.observations.withColumn("_file", file)
    obs = obs.join(about.select("_file", start.alias("_start")), "_file", "left")
    known = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in obs.columns else F.lit(default)
    band = F.regexp_extract("filter", r"([^a-z]*.)$", 1)
    words = [F.lit("OBS:"), _number(F.col("mjd") + F.coalesce("_start", F.lit(0.0))), band, known("field", "NULL"), _number(F.col("flux")), _number(F.col("flux_error"))]
    lines = obs.select(F.col("_file").alias("file"), F.lit(2).alias("part"), F.col("mjd").cast("double").alias("at"), F.concat_ws(" ", *words).alias("line"))
    heads = [F.when(F.lit(True), F.concat(F.lit("SNID: "), F.col(key).cast("string")))]
    if "z" in has:
        error = F.coalesce(_number(F.col("z_err")), F.lit("NULL")) if "z_err" in has else F.lit("NULL")
        heads.append(F.when(F.col("z").isNotNull(), F.concat_ws(" ", F.lit("HOST_GALAXY_PHOTO-Z:"), _number(F.col("z")), F.lit("+-"), error)))
    if "target" in has:
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair]), F.col("target").cast("int"))
        heads.append(F.when(kind.isNotNull(), F.concat(F.lit("SIM_COMMENT: SN Type = "), kind)))
    lead = about.join(obs.select("_file").distinct(), "_file", "left_semi")
    lead = lead.select(F.col("_file").alias("file"), F.posexplode(F.filter(F.array(*heads), lambda x: x.isNotNull())).alias("at", "line"))
    rows = lines.unionByName(lead.select("file", F.lit(1).alias("part"), F.col("at").cast("double").alias("at"), "line"))
    rows = rows.repartition("file").sortWithinPartitions("file", "part", "at", "line").select("file", "line")
    rows.write.format("object_files").option("list", f"{name}.LIST").mode("overwrite").save(path)


def register(spark: SparkSession) -> None:
    """Make the format ``object_files`` known to the session."""
    ship_package(spark)
    spark.dataSource.register(ObjectFiles)


def save_lines(rows: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Rows (file, line) as text files and a list, lines of a file in their own order."""
    register(rows.sparkSession)
    dealt = rows.select("file", "line").repartition("file").sortWithinPartitions("file", "line")
    dealt.write.format("object_files").option("list", f"{name}.LIST").mode(mode).save(path)
