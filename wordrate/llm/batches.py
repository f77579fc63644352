"""Bounded pieces of Arrow batches, and small tables against large ones."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at a time in a task (one longer text is a piece of its own).
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of ``batch`` with at most ``limit`` bytes of ``text`` each."""
    col = batch.column(batch.schema.get_field_index(text))
    size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size.astype(np.int64))
    at, rows = 0, batch.num_rows
    while at < rows:
        base = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


#: Bytes of rows that Spark gathers before it sends them to a Python task.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python tasks in batches of ``BATCH_BYTES`` at most; a session
    that asks for less keeps it.  Spark's own bound (64 MB) is held several times over, by the
    executor while the batch's buffers grow and by the Python task that reads it."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def let_go() -> None:
    """Gives what a task has freed back to the system.  Python workers serve one task after the
    other, and the allocators would keep a task's temporaries for as long as its worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


#: Rows up to which a side of fixed-width rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised, a few fixed-width columns) marked for broadcast if its
    measured row count is within ``rows``, and as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
