"""The way this subpackage cuts lineage: tables in the shared folder, gone when the application ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.storage import store

#: Whole texts that go to Python at once, at most, where a step asks for that: Spark's 10 000 take tens of MB on either side of every task.
TEXTS = 1000


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows, or fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """``df`` as a stored table; ``batch`` bounds the rows that go to Python at once while it is written."""
    if batch is None:
        return store(df, label)
    with batches_of(df.sparkSession, batch):
        return store(df, label)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; then the worker, which waits for its next task, gives back the memory that it no longer uses."""

    @wraps(run)
    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return lean_run


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``keys``, and all columns of ``df`` as one struct ``row``, so that no name of theirs can meet one of ours."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(name) for name, c in keys.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that :func:`packed` put away."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])
