"""Tables by name, and memory of Python workers; stored tables and connected components come from the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trekspark.graph import components, discard, shared_folder, stored  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple = ()) -> pa.RecordBatch:
    """A batch with more columns; those that were there stay as they are, so ids of any type keep their value."""
    kept = [c for c in batch.schema.names if c not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *new.values()], names=[*kept, *new])


def gives_memory_back(run: Callable) -> Callable:
    """A function for mapInPandas or mapInArrow after whose last batch free memory goes back to the system: Spark
    keeps the worker for later tasks, and what one stage's texts took would add to the next one's."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped
