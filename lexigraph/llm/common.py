"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, estimated_bytes, fewer, materialise

__all__ = ["LOWER", "UPPER", "WORD", "drop", "estimated_bytes", "fewer", "lean", "lower_ascii", "materialise", "sliced", "small_batches", "table", "trim"]

#: Rows whose texts are Python objects at one time.
SLICE = 256

#: Characters that separate words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python holds few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def trim() -> None:
    """Gives memory that is free back to the system: Python workers are kept for
    later tasks, and what they hold counts against their executor meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        return


def settle() -> None:
    """Large arrays get memory of their own, which goes back as soon as they do."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except AttributeError:  # another C library
        return
    mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def lean(make: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that trims when its task ends."""

    @wraps(make)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pa.default_memory_pool().backend_name != "system":
            pa.set_memory_pool(pa.system_memory_pool())
        settle()
        try:
            yield from make(batches)
        finally:
            trim()

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it at most so many rows pass between Spark and Python at once; the
    session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
