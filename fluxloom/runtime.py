"""Helpers every module shares: tables, checkpoints and session settings."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once a session, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_fluxloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # else it runs from an archive that the workers have too
        archive = os.path.join(tempfile.mkdtemp(prefix="fluxloom-package-"), "fluxloom.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
    context._fluxloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fluxloom-checkpoint-")
    context.setCheckpointDir(folder)


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared checkpoint folder.

    Readers of the result see the same rows however often they come back and whichever executor is lost. Spark's
    cleaner removes the files once no plan refers to them, where the session allows it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Frames written as Parquet to a folder beside the checkpoints, for loops: ``remove`` drops the folder.

    A frame that is read back has the size of its files. One that is checkpointed keeps the size estimated for its plan, and
    in a loop of joins estimates multiply from round to round until planning itself is slow.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.count = spark, 0
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(f"{self.folder}/{self.count}")
        return self.spark.read.parquet(f"{self.folder}/{self.count}")

    def remove(self, but_last: bool = False) -> None:
        last = self.count if but_last else self.count + 1
        for path in [f"{self.folder}/{i}" for i in range(1, last)] + ([] if but_last else [self.folder]):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a frame of a few numbers each that may be broadcast: some tens of MB as Spark holds them.
BROADCAST_ROWS = 1 << 20


def broadcast_if_small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``written``, the result of ``materialised``, marked for broadcast where it has at most ``rows`` rows.

    Beyond that it is left to a shuffled join.
    """
    return F.broadcast(written) if written.count() <= rows else written.hint("merge")


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints of frames that are no longer referred to.

    For loops that write frames round by round; else they stay until the driver happens to collect garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over all shuffle partitions.

    For grouped functions that compute much on few bytes: left alone, adaptive execution would merge their small partitions
    into one task.
    """
    return df.repartition(_shuffle_partitions(df), *keys)


def _shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_groups(df: DataFrame, keys: Sequence[str], function: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str, order: Sequence[str] = (), rows: int = 100_000) -> DataFrame:
    """``function`` over tables of many whole groups, sorted by ``keys`` and ``order``, with the first row of each group.

    For numerics that are quick on many small groups at once and slow on one after another. A table has some ``rows`` rows, or
    one group that is larger.
    """
    keys = list(keys)

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            ids = table[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= ids[1:] != ids[:-1]
        return np.flatnonzero(new)

    def told(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for out in function(table, starts):
            yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, enough = [], 0, rows
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < enough:
                continue
            table = pa.Table.from_batches(held)
            starts = starts_of(table)
            if cut := int(starts[-1]):
                yield from told(table.slice(0, cut), starts[:-1])
            held, count = table.slice(cut).to_batches(), count - cut
            enough = max(rows, 2 * count)  # a group that is larger is looked at again once it has doubled
        if count:
            table = pa.Table.from_batches(held)
            yield from told(table, starts_of(table))

    # by a hash of the keys: where rows come from a join by the keys, adaptive execution would drop a shuffle by the keys
    # themselves, and all would be done by the few tasks that the join has left
    return df.repartition(_shuffle_partitions(df), F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def same_length(starts: np.ndarray, rows: int, most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, places): at most ``most`` groups of one length and the matrix of their rows."""
    lengths = np.diff(np.append(starts, rows))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, -(-len(at) // most)):
            yield part, starts[part][:, None] + np.arange(n)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))
