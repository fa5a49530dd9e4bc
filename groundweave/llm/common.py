"""What the operators of this subpackage share: reading tables, cutting lineage, and the memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from groundweave.sources.shared import discard, shared_dir, written

__all__ = ["TEXT_BATCH", "discard", "hold", "let_go", "shared_dir", "table", "text_batches", "trim", "trimmed", "written"]

#: Rows of an Arrow batch for operators that hold whole texts in Python.
TEXT_BATCH = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bounds the rows of Arrow batches, and so the memory of Python workers that get whole texts. As frames run lazily,
    the session keeps the bound; a bound that is tighter already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


_held: dict[Hashable, Any] = {}


def hold(key: Hashable, make: Callable[[], Any]) -> Any:
    """A model that a Python worker keeps from task to task. It keeps one at a time, as workers serve all operators."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Frees what an earlier task of this worker (or the driver) has kept, and gives freed memory back to the system."""
    _held.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system (Arrow's pool and the C library keep it otherwise, at the cost of the executor's other
    worker and JVM)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose worker gives back at the task's end what the task has used, and doesn't hold it while it waits for the next."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return task
