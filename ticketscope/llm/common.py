"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.session import scratch_dir

#: A word: a longest run of characters other than space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, one object per row."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def batch_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass `limit` bytes, so that working memory follows the
    limit and the longest single text."""
    sizes = batch_of(batch, name).cast(pa.large_binary())
    lengths = [0 if v is None else v for v in pa.compute.binary_length(sizes).to_pylist()]
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def hands_back(run: Callable) -> Callable:
    """A function for mapInArrow that gives what it has freed back to the system when its task ends.
    Spark keeps Python workers for later tasks, and the allocators keep what was freed, so else
    every worker holds its largest task's memory beside all later stages."""
    @wraps(run)
    def call(batches, *args, **named):
        try:
            yield from run(batches, *args, **named)
        finally:
            _hand_back()
    return call


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character as it is."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch place and read back: cuts the lineage, and a lost executor
    costs only a re-read."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_keys(df: DataFrame, column: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """Two non-null join keys for a nullable id."""
    zero, flag = f"{prefix}_value", f"{prefix}_null"
    return (df.withColumn(zero, F.coalesce(F.col(column), F.lit(0)))
            .withColumn(flag, F.col(column).isNull()), [zero, flag])
