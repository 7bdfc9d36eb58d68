"""Column-wise Arrow mapping: functions over batches that keep the other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fluxloom.runtime import ship_package


#: Rows of an Arrow batch. A batch is held off the heap by the executor and again by its worker, and texts are long.
ROWS = 1000


def ready_workers(df: DataFrame) -> None:
    """Lower the session's rows of an Arrow batch to ``ROWS``, if they are more, and see that workers have the package."""
    ship_package(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for functions that yield dictionaries of columns."""
    ready_workers(df)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def add_columns(df: DataFrame, inputs: list[str], function: Callable[[Iterator[list[list]]], Iterator[dict]], added: str) -> DataFrame:
    """``df`` with columns computed batch by batch from the Python values of ``inputs``.

    ``function`` takes an iterator of lists of columns and yields a dictionary of columns for each. A column of
    ``df`` that has the name of an added one is replaced. An input is a column or, as ``row.field``, a field of a struct;
    what is kept anyway is sent to the workers once.
    """
    ready_workers(df)
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    place = {f.name: i for i, f in enumerate(kept)}
    lone = [c for c in dict.fromkeys(inputs) if c not in place and c.partition(".")[0] not in place]
    source = df.select(*[df[f.name] for f in kept], *[df[c].alias(f"_in{i}") for i, c in enumerate(lone)])
    at = place | {c: len(kept) + i for i, c in enumerate(lone)}

    def values(batch: pa.RecordBatch, name: str) -> list:
        if name in at:
            return batch.column(at[name]).to_pylist()
        row, _, field = name.partition(".")
        return pc.struct_field(batch.column(at[row]), field).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(new), []

        def columns() -> Iterator[list[list]]:
            for batch in batches:
                held.append(batch)
                yield [values(batch, c) for c in inputs]

        for out in function(columns()):
            batch = held.pop()
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(out[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + list(new.names))

    return source.mapInArrow(run, T.StructType(kept + new.fields))
