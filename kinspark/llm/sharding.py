"""Rendezvous hashing of stable record keys over weighted shards, in SQL functions only.

Every shard draws a number u in (0, 1) from the MD5 of the key and its own number, and the key goes
to the shard of the least -ln(u) / weight (ties: the smaller number). A key's draws do not depend on how
many shards there are, so one more shard takes rows only into itself, as many as its share of all weights,
and a shard that goes gives its rows to the others in proportion to their weights.

Rows of a shard are placed by an MD5 of key and content, so a shard is read in a shuffled order that
does not change between runs. Places are counted in buckets, ranges of the leading bits of that MD5: rows that are
equal throughout are first counted, then every bucket is numbered alone and shifted by those before it,
and copies are written out again in chunks. No task holds a shard.

Defined results: null text has no bytes (size 1, the CRC of nothing); a row without doc_id is keyed by its text, and
by nothing where that is null too; rows that repeat are each placed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, passing, settled

#: Hex digits of an MD5 that make a number: 52 bits, which a double holds.
DIGITS = 13
ROWS_A_BUCKET = 250_000
COPIES = 100_000
LAW = "key"


def number(text: Column) -> Column:
    """52 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def draws(key: Column, weights: Sequence[float]) -> Column:
    """An array of (-ln(u) / weight, shard) of the key at every shard of positive weight."""
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights are not negative, and one is positive")
    shards = F.array(*(F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w))

    def drawn(s: Column) -> Column:
        u = (number(F.concat(key, F.lit("/"), s["shard"].cast("string"))) + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return F.struct((-F.log(u) / s["weight"]).alias("draw"), s["shard"].alias("shard"))

    return F.transform(shards, drawn)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; weights are those of shards 0, 1, ..."""
    return F.array_min(draws(key, weights))["shard"]


def assigned(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, place) of every row: its shard under both lists of weights
    (grown: those and one more of their mean weight), and the MD5 number by which its shard is ordered."""
    grown = [*weights, sum(weights) / len(weights)] if grown is None else grown
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.col("text").cast("binary"))), F.lit("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    place = number(F.concat_ws(" ", F.lit("place"), "key", F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    return rows.select("doc_id", "size", "text_crc32", shard_of(F.col("key"), weights).alias("shard"), shard_of(F.col("key"), grown).alias("grown_shard"), place.alias("place"))


def slotted(rows: DataFrame) -> DataFrame:
    """Rows of ``assigned`` with slot, gapless from 0 in each shard by (place, doc_id, text_crc32, size), in the place of place."""
    spark = rows.sparkSession
    own = rows.columns
    with passing(spark) as kept:
        counted = settled(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "shards")
        kept.append(counted)
    buckets = max(1, counted.count() // ROWS_A_BUCKET, partitions(spark) // 8)
    bits = F.lit(16**DIGITS // buckets + 1)
    counted = counted.withColumn("bucket", F.floor(F.col("place") / bits).cast("long"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    shift = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    order = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(shift, ["shard", "bucket"])
    first = F.col("shift") + F.col("before")
    own.remove("place")
    single = placed.where("n = 1").select(*own, first.alias("slot"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("chunk")
    several = placed.where("n > 1").select(*own, first.alias("first"), "n", chunks).repartition(partitions(spark), "shard", "first", "chunk")
    copies = F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + (COPIES - 1), F.col("n") - 1))).alias("copy")
    several = several.select(*own, "first", copies).select(*own, (F.col("first") + F.col("copy")).alias("slot"))
    return single.unionByName(several)


def sharded(docs: DataFrame, shards: int | Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, over so many shards of one weight or those of these weights."""
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    return slotted(assigned(docs, weights)).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def written(docs: DataFrame, shards: int | Sequence[float], path: str) -> None:
    """The documents with all their columns as Parquet, in a folder shard=N each, every file in the order of places.
    A shard is as many files as its rows ask for; a column named shard must not be among them."""
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.col("text").cast("binary"))), F.lit("none"))
    rows = docs.withColumn("shard", shard_of(key, weights)).withColumn("__place", number(F.concat(F.lit("place "), key)))
    parts = F.floor(F.col("__place") / F.lit(16**DIGITS // max(1, partitions(docs.sparkSession) // 8) + 1))
    rows = rows.repartition("shard", parts).sortWithinPartitions("shard", "__place")
    rows.drop("__place").write.partitionBy("shard").parquet(path)
