"""Shared helpers: Arrow text buffers, slices of them, a bounded cache, and memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..session import saved, shared_dir

__all__ = ["Generations", "bound_batches", "bound_reads", "fresh", "make_room", "saved", "shared_dir", "slices", "text_buffer"]

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: About a slice of the operators: a larger batch only lies in memory, on both sides.
BATCH_BYTES = 1 << 21
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: Rows that the Parquet reader unpacks at once: a few MB of long texts.
BATCH_ROWS = 512
#: What operators keep in a Python worker for its next tasks.
KEPT: list[dict] = []


def fresh(columns, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python end at BATCH_BYTES in this session, unless it has a limit of its own.
    Spark's is 64 MiB, and 10,000 long texts are one batch: a task holds it in the JVM and in
    Python, with what comes back. A frame's batches are cut when it is run, so the limit stays."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def bound_reads(spark: SparkSession) -> None:
    """Parquet is unpacked BATCH_ROWS rows at once in this session, unless it has a number of its
    own. Spark's 4,096 long texts lie in arrays of tens of MB that grow by doubling, anew in every
    task, and the JVM's heap grows with what they leave. As above, the limit stays."""
    if spark.conf.get(READ_ROWS, None) is None:
        spark.conf.set(READ_ROWS, str(BATCH_ROWS))


def make_room() -> None:
    """Drop what other operators keep in this Python worker, which Spark hands from stage to
    stage, and give freed memory back to the system, where it can be done."""
    for cache in KEPT:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int):
    """Ranges of rows whose texts together have about ``limit`` bytes; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Generations:
    """A bounded cache in two generations: what was used since the last turnover survives it."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def take(self, keys: set) -> dict:
        """What is known of ``keys``; it stays in the young generation."""
        found = {k: self.young[k] for k in keys & self.young.keys()}
        again = {k: self.old[k] for k in keys & self.old.keys() if k not in found}
        self.add(again)
        return found | again

    def add(self, fresh: dict) -> None:
        if len(self.young) + len(fresh) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(fresh)
