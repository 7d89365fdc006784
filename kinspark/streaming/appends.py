"""Structured Streaming forms: counts in event time, and tables that new batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diffing import outer_diff


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n): late rows within the watermark still count."""
    timed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count()
    return timed.select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    timed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").count()
    return timed.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def diff_against(builds: DataFrame, known: DataFrame, key: str, digest: str, path: str, checkpoint: str, build: str | None = None) -> StreamingQuery:
    """Every arriving build is held against a known one, and its differences stand at ``path`` in a folder of its own.

    build: the column that names a row's build (none: all rows are one). A build may arrive in any number of batches: its
    rows so far are kept beside the checkpoint, and each batch judges the builds that it adds to as a whole and replaces
    their differences. A batch that runs again replaces its own rows, so nothing is counted twice."""
    columns = ["__build", key, digest]

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = F.col(build).cast("string") if build else F.lit("all")
        batch.select(named.alias("__build"), key, digest).write.mode("overwrite").parquet(f"{checkpoint}/builds/batch={number}")
        rows = spark.read.parquet(f"{checkpoint}/builds").select(*columns)
        touched = spark.read.parquet(f"{checkpoint}/builds/batch={number}").select("__build").distinct()
        own = rows.join(F.broadcast(touched), "__build", "left_semi").dropDuplicates(["__build", key])
        every = known.select(key, digest).join(F.broadcast(touched))  # a row for each build of this batch
        pair = F.struct("__build", key).alias("__key")
        found = outer_diff(every.select(pair, digest), own.select(pair, digest), "__key", digest)
        out = found.select(F.col("__key.__build").alias("build"), F.col(f"__key.{key}").alias(key), "old_digest", "new_digest", "status")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build").parquet(path)

    return builds.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
