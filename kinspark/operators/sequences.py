"""Operators on ordered sequences within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import padded
from ..sources.shared import settled


def ordered(owner: str, *order: str):
    return Window.partitionBy(owner).orderBy(*order)


def frame_signature(value: str, reach: int, window, gap: str = "-") -> Column:
    """The values from ``reach`` rows before to as many after, joined; ``gap`` beyond either end."""
    steps = [F.coalesce(F.lag(value, -k).over(window), F.lit(gap)) for k in range(-reach, reach + 1)]
    return F.concat_ws(">", *steps)


def nearest(value: Column, window) -> tuple[Column, Column]:
    """The last value that isn't null before a row, and the first after it."""
    before = F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    return before, after


def running_ordinal(holds: Column, window) -> Column:
    """Which of the rows that hold this is, from 0; null on others."""
    n = F.sum(holds.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return F.when(holds, n.cast("long"))


def islands(df: DataFrame, breaks: Column, window, name: str) -> DataFrame:
    """Adds ``name``: the number of the island, which a row begins where ``breaks`` holds."""
    return df.withColumn("__break", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(name, F.sum("__break").over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__break")


def ends_pattern(value: str, pattern: Sequence[str], window) -> Column:
    """Whether a row and those before it spell the pattern."""
    out = F.lit(True)
    for back, word in enumerate(reversed(pattern)):
        out = out & F.coalesce((F.lag(value, back).over(window) if back else F.col(value)) == word, F.lit(False))
    return out


def positional_zip(left: DataFrame, right: DataFrame, owner: str, order: str) -> DataFrame:
    """Row i of each owner's left sequence beside row i of the right one, where both are as long.
    Sides carry ``order`` and ``item``; the result left_item, right_item and place."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        own = Window.partitionBy(owner)
        return df.select(owner, F.row_number().over(own.orderBy(order)).cast("long").alias("place"), F.count(F.lit(1)).over(own).alias("size"), F.col("item").alias(f"{side}_item"))

    return numbered(left, "left").join(numbered(right, "right"), [owner, "place", "size"]).drop("size")


def contiguous(df: DataFrame, owner: str, place: str) -> DataFrame:
    """(owner, n, contiguous): whether each place follows the one before by one."""
    step = F.lead(place).over(ordered(owner, place)) == F.col(place) + 1
    return df.withColumn("__step", F.coalesce(step, F.lit(True))).groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.bool_and("__step").alias("contiguous"))


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """df with ``name``: the place of each row, from 1, in an order that ends in a unique key. Rows are dealt by
    ranges and settled; each range is numbered alone and shifted by the sizes of those before (a row a range)."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt = settled(dealt, "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__place", place).join(F.broadcast(settled(shift, "shifts")), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def successors(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, a, b): each key and the next one of its group, whatever the size of a group: within ranges of (group, key) rows look at
    the next one, and the last row of a range at the first one of the next range (a row a range)."""
    dealt = settled(df.select(F.col(group).alias("__g"), F.col(key).alias("a")).repartitionByRange("__g", "a").withColumn("__range", F.spark_partition_id()), "ranges")
    after = F.lead(F.struct("__g", F.col("a").alias("b"))).over(Window.partitionBy("__range").orderBy("__g", "a"))
    firsts = dealt.groupBy("__range").agg(F.min(F.struct("__g", F.col("a").alias("b"))).alias("__first"))
    beyond = settled(firsts.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__beyond")), "heads")
    found = dealt.withColumn("__next", after).join(F.broadcast(beyond), "__range").withColumn("__next", F.coalesce("__next", "__beyond"))
    return found.where(F.col("__g").eqNullSafe(F.col("__next.__g"))).select(F.col("__g").alias(group), "a", F.col("__next.b").alias("b"))


def dense_ids(keys: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, id): ids by sorted order of the distinct keys, of six digits or more."""
    found = numbered(keys.select(key).distinct(), [key])
    return found.select(key, F.concat(F.lit(prefix), padded(F.col("number"), 6)).alias("id"))


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, alias): keys by their first row's place."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__at"))
    return numbered(firsts, ["__at", key], "alias").select(key, "alias")


def overlapping_pairs(spans: DataFrame, owner: str, begin: str, end: str) -> DataFrame:
    """(owner, overlaps): how many pairs of an owner's spans (begin < end) overlap. A span that begins overlaps those that are
    open then, so a running count of beginnings less ends does it; at one moment spans end before others begin."""
    moments = F.explode(F.array(F.struct(F.col(begin).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step"))))
    steps = spans.select(owner, moments.alias("m")).select(owner, "m.at", "m.step")
    open_ = F.sum("step").over(Window.partitionBy(owner).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("open", F.coalesce(open_, F.lit(0))).groupBy(owner).agg(F.sum(F.when(F.col("step") == 1, F.col("open")).otherwise(0)).alias("overlaps"))


def trailing(value: str, reach: int, window) -> Column:
    """The values of up to ``reach`` rows before, the oldest first."""
    return F.collect_list(value).over(window.rowsBetween(-reach, -1))


def kind_ordinal(owner: Sequence[str], kind: str, *order: str) -> Column:
    """Which of the rows of its kind in its owner a row is, from 0."""
    return F.row_number().over(Window.partitionBy(*owner, kind).orderBy(*order)) - 1


def anchored_blocks(old: DataFrame, new: DataFrame, owner: str, place: str, anchor: str, shape: str) -> DataFrame:
    """(owner, old_place, new_place, mode): rows of unanchored blocks that the two sides have alike.

    A block is a run of rows without an anchor. It is compared with the other side's block behind the same left
    anchor (mode prefix: the equal rows from its start) and before the same right anchor (suffix: those up to its end);
    a block of equal shapes throughout is whole, in an owner without any anchor too."""

    def blocks(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(owner).orderBy(place)
        left = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        right = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        free = df.withColumn("left", left).withColumn("right", right).where(F.col(anchor).isNull())
        own = Window.partitionBy(owner, "left", "right")
        free = free.withColumn("at", F.row_number().over(own.orderBy(place))).withColumn("size", F.count(F.lit(1)).over(own))
        return free.select(owner, F.coalesce(F.col("left").cast("string"), F.lit("^")).alias("left"), F.coalesce(F.col("right").cast("string"), F.lit("$")).alias("right"), "at", "size", F.col(place).alias(f"{side}_place"), F.col(shape).alias("shape"))

    def running(pairs: DataFrame, key: list[str], step: str, descending: bool = False) -> DataFrame:
        order = F.desc(step) if descending else F.col(step)
        rows = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        near = Window.partitionBy(*key).orderBy(order)
        return pairs.withColumn("__equal", F.min((F.col("shape") == F.col("other")).cast("int")).over(rows)).withColumn("__near", F.row_number().over(near)).where("__equal = 1 AND __near = __from")

    a, b = blocks(old, "old"), blocks(new, "new")
    other = b.withColumnRenamed("shape", "other").withColumnRenamed("size", "new_size")
    heads = a.drop("right").join(other.drop("right"), [owner, "left", "at"]).withColumn("__from", F.col("at"))
    heads = running(heads, [owner, "left"], "at").select(owner, "old_place", "new_place", F.lit("prefix").alias("mode"))
    back = lambda df, n: df.withColumn("back", F.col(n) - F.col("at")).drop("at", "left")
    tails = back(a, "size").join(back(other, "new_size"), [owner, "right", "back"]).withColumn("__from", F.col("back") + 1)
    tails = running(tails, [owner, "right"], "back").select(owner, "old_place", "new_place", F.lit("suffix").alias("mode"))
    found = heads.unionByName(tails).groupBy(owner, "old_place", "new_place").agg(F.count(F.lit(1)).alias("__n"), F.min("mode").alias("mode"))
    return found.withColumn("mode", F.when(F.col("__n") > 1, "whole").otherwise(F.col("mode"))).drop("__n")
