"""Intermediate tables in the folder that driver and executors share, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()
_ONCE = threading.Lock()
#: Paths of the tables made inside each open ``passing`` block of this thread or task, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder (local masters only)."""
    with _ONCE:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found:
            return found
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{made}")
        return f"file://{made}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: later jobs neither
    recompute it nor depend on any executor that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if blocks := _OPEN.get():
        blocks[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder, whatever file system it is on."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the table behind df, where ``settled`` made it: nothing reads it any more."""
    if path := getattr(df, "settled_at", None):
        delete(df.sparkSession, [path])


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables settled inside are deleted at the end, except those appended to the list that
    this gives: they pass to the enclosing block, and stay where there is none. Blocks belong to
    the thread that opened them, so queries that run at once in one session keep their own tables."""
    kept: list[DataFrame] = []
    outer, made = _OPEN.get(), []
    opened = _OPEN.set((*outer, made))
    try:
        yield kept
    finally:
        _OPEN.reset(opened)
        stay = [df.settled_at for df in kept]
        if outer:
            outer[-1].extend(p for p in made if p in stay)
        delete(spark, [p for p in made if p not in stay])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors; local ones share the driver's files and only need the path."""
    with _ONCE:
        _ship(spark)


def _ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or spark.sparkContext.master.startswith("local") and str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    package = Path(tempfile.mkdtemp()) / "kinspark.zip"
    with zipfile.ZipFile(package, "w") as z:
        for path in sorted((_ROOT / "kinspark").rglob("*.py")):
            z.write(path, path.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(package))
    atexit.register(shutil.rmtree, package.parent, ignore_errors=True)
    _SHIPPED.add(app)
