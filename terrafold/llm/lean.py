"""Python workers that stay small.

Spark keeps its Python workers from task to task, and what a worker once took from the system it
tends to keep. Functions given to ``mapInArrow`` and ``applyInArrow`` are wrapped here, so that a
task or group gives back what it no longer needs, and batches are bounded by bytes, since rows of
one table may be a few bytes or many megabytes long.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch on its way to Python, unless the session asks for smaller ones.
BATCH_BYTES = 8 << 20
#: Groups of fewer bytes are not worth giving memory back for.
LEAST_BYTES = 4 << 20

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def as_bytes(told: str) -> int:
    """Bytes of a setting such as ``64m`` or ``67108864b``."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", told.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes."""
    if not 0 < as_bytes(spark.conf.get(_SETTING)) <= BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work``, with memory given back when a task's batches have ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def lean_group(work: Callable[[pa.Table], pa.Table]) -> Callable:
    """The same for a function of a group."""

    def run(group: pa.Table) -> pa.Table:
        large = group.nbytes >= LEAST_BYTES
        out = work(group)
        del group
        if large:
            give_back()
        return out

    return run
