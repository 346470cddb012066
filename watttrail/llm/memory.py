"""Memory of Python workers, which Spark keeps between stages."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that go to Python at once; a batch also stays in buffers of the JVM.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on the bytes of an Arrow batch, for rows that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def released() -> Iterator[None]:
    """At the end of a partition the worker gives free memory back, as it waits for the next stage."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
