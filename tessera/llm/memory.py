"""What keeps Python workers small: Arrow batches bounded by bytes, and nothing held after a task."""

from __future__ import annotations

import ctypes
import contextlib
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from tessera.session import shuffles_deleted  # noqa: F401

#: Bytes of an Arrow batch, unless the session sets a bound of its own.
BATCH_BYTES = 8 << 20
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for texts, where the session has Spark's default; on both sides of the socket a batch is held whole."""
    if int(spark.conf.get(_SETTING).rstrip("bB")) == _DEFAULT:
        spark.conf.set(_SETTING, BATCH_BYTES)


def release() -> None:
    """Give free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(run: Callable[[Iterator], Iterator], *caches: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches; at its end caches are emptied and memory given back, for workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for clear in caches:
                clear()
            release()

    return wrapped
