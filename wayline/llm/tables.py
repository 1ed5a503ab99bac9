"""What the operators share: table access, narrow inputs, and task functions over Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash."""
    return df.select(*[df[f"`{name}`"].alias(alias) for alias, name in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give free memory of this Python worker back to the system: Arrow's, and that of arrays if the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lighten() -> None:
    """Give back what an earlier task left in this Python worker: cached tokens, unused memory.

    A worker serves one task after another; what a packing left would count beside a block's arrays.
    """
    if (tokens := sys.modules.get("wayline.llm.tokens")) is not None:
        tokens.forget()
    release()


def map_batches(df: DataFrame, schema: str, each: Callable[[pa.Table], dict]) -> DataFrame:
    """mapInArrow with a function from a table to columns by name."""
    kinds = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = each(pa.Table.from_batches([batch]))
            yield from as_table(out, arrow).to_batches()

    return df.mapInArrow(run, kinds)


def as_table(columns: dict, arrow: pa.Schema) -> pa.Table:
    def column(field):
        x = columns[field.name]
        return x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, field.type)

    return pa.Table.from_arrays([column(field) for field in arrow], schema=arrow)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def plus(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with more fields, by their DDL types."""
    return T.StructType([*schema.fields, *[T.StructType.fromDDL(f"`{n}` {k}").fields[0] for n, k in kinds.items()]])
