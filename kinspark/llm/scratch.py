"""What the corpus operators take from the rest of the package, the number of shuffle partitions, and memory of tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

from ..sources.shared import passing, settled, shared_folder, ship

__all__ = ["partitions", "passing", "settled", "shared_folder", "ship", "tidy"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """A function over batches that gives memory back when its task ends: workers are kept for the next stages, and
    what a task freed would stay with them."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
