"""Arrow plumbing shared by the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import SparkSession

#: Rows and text characters of one slice of a batch; bounds a task's memory.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send tasks no more rows at once than a slice has: what it holds outside its
    heap for batches of long texts grows with the rows of a batch.  Sets the session's
    number of rows where it is greater; no result depends on it."""
    if not 0 < int(spark.conf.get(_ROWS)) <= SLICE_ROWS:
        spark.conf.set(_ROWS, str(SLICE_ROWS))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of the batches, of about ``size`` characters at most, with the texts of each
    piece; null texts come as ''."""
    try:
        yield from _slices(batches, text, size)
    finally:
        _give_back()


def _give_back() -> None:
    """Returns what a finished task has freed to the machine: Spark keeps its Python workers
    for further tasks, and several of them share a machine with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _slices(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > size or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start), [t or "" for t in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += n
        yield batch.slice(start), [t or "" for t in column.slice(start).to_pylist()]


def lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    """Consecutive runs of ``values`` as a list column."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
