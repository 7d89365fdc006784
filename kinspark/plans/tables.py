"""The driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``part`` as two builds: even keys are the old one, odd keys the new one."""
    part = table(spark, sf_dir, "part")
    return part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1")


def year(name: str, y: int) -> Column:
    """Whether a timestamp falls into a year, as a range that is pushed down to the files."""
    return (F.col(name) >= F.lit(f"{y}-01-01").cast("timestamp")) & (F.col(name) < F.lit(f"{y + 1}-01-01").cast("timestamp"))


class Catalogue:
    """Queries by name and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
