"""Line logs as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.diffing import percent
from .shared import settled


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the lines that are not empty. Files are split by blocks like any text; a line's number
    is its place in the order of blocks, so files of any size do for it."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("__id"))
    kept = settled(read, "lines")  # ids rise within a block; they are settled before anything orders by them
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("__id"))
    sizes = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("__before"))
    return kept.withColumn("__place", place).join(shifts, ["file", "block"]).select("file", (F.col("__before") + F.col("__place") - 1).alias("line_no"), "line")


def compared(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, old_n, new_n, shared, resolved, introduced, percent_kept): two frontiers of diagnostics as multisets;
    nothing to keep counts as all kept."""
    n = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    both = n(old, "old_n").join(n(new, "new_n"), key, "full_outer").fillna(0, ["old_n", "new_n"])
    shared = F.least("old_n", "new_n")
    return both.select(*key, "old_n", "new_n", shared.alias("shared"), (F.col("old_n") - shared).alias("resolved"), (F.col("new_n") - shared).alias("introduced"), percent(shared, F.col("old_n"), 100.0).alias("percent_kept"))


def records(log: DataFrame, owner: str, order: str, line: str, header: Column) -> DataFrame:
    """(owner, record, header, n_lines, body): a header line with the lines up to the next one.
    Lines before the first header make record 0, without header."""
    own = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = log.withColumn("__head", header).withColumn("record", F.sum(F.col("__head").cast("int")).over(own).cast("long"))
    whole = numbered.groupBy(owner, "record").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.when(F.col("__head"), F.col(line))).alias("header"), F.array_sort(F.collect_list(F.struct(order, line))).alias("__all"))
    return whole.select(owner, "record", "header", "n_lines", F.array_join(F.transform("__all", lambda x: x[line]), "\n").alias("body"))
