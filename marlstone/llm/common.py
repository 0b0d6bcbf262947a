"""What the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

from marlstone.session import cut, written

__all__ = ["cut", "map_batches", "table", "written"]

SLICE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Memory that a task has freed goes back to the system, as Spark keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """`make()` runs once a task and returns a function from a batch's columns (lists) to the result's columns.

    Batches are cut into slices, so a task's Python memory doesn't follow its rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                out = step(columns)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        del step
        give_back()

    return df.mapInArrow(run, kind)
