"""Range joins that return pairs: points in spans, and spans that overlap, as equi-joins.

A span of whole numbers [begin, end) is the disjoint union of at most two dyadic intervals a level, and a point lies in one
dyadic interval a level. So a point is in a span if and only if they share exactly one interval, and joining on it gives every pair
once. Rows that would meet in an interval with many points are salted: its points are dealt out, its spans repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import passing, settled

#: Points that one task may have in one interval.
POINTS = 20_000


def dyadic(begin: Column, end: Column, levels: int) -> Column:
    """The (level, at) of the dyadic intervals that make up [begin, end), for 0 <= begin, end <= 2 ** levels. None where end <= begin."""
    one = F.lit(1).cast("long")

    def at(k: Column) -> Column:
        step = F.lit(1).cast("long") * F.pow(F.lit(2.0), k).cast("long")
        low, high = F.ceil(begin / step).cast("long"), F.floor(end / step).cast("long")
        node = lambda n: F.struct(k.cast("int").alias("level"), n.alias("at"))
        return F.array(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), node(low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), node(high - one)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def points_in_spans(points: DataFrame, spans: DataFrame, on: list[str], point: str, begin: str, end: str) -> DataFrame:
    """Every pair of a point and a span with equal ``on`` and begin <= point < end, with the columns of both (names must differ
    but for ``on``). Positions are whole numbers; null ones and null keys are in no pair, and empty spans hold nothing."""
    spark = points.sparkSession
    with passing(spark) as kept:
        kept.append(where := settled(spans.where(F.col(begin) < F.col(end)), "spans"))
        low, high = where.agg(F.min(begin), F.max(end)).first()
        if low is None:
            low, high = 0, 1
        levels = max(1, int(high - low).bit_length())
        cut = where.select("*", F.explode(dyadic(F.col(begin).cast("long") - low, F.col(end).cast("long") - low, levels)).alias("__n")).select("*", "__n.*").drop("__n")
        kept.append(cut := settled(cut.withColumnsRenamed({"level": "__level", "at": "__at"}), "intervals"))
        used = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most a number for each bit
        own = points.where(F.col(point).between(low, high - 1))
        place = F.col(point).cast("long") - low
        nodes = F.array(*(F.struct(F.lit(k).alias("__level"), F.shiftright(place, k).alias("__at")) for k in used or [0]))
        own = own.select("*", F.explode(nodes).alias("__n")).select("*", "__n.*").drop("__n")
        key = [*on, "__level", "__at"]
        # On P partitions no more than 4 P intervals a level hold a 4 P-th of the points, so the salted ones can be broadcast.
        most = max(POINTS, points.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        met = own.groupBy(*key).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > most)
        hot = settled(met.select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(key)), F.ceil(F.col("__m") / most).cast("int").alias("__parts")), "hot")
        kept.append(hot)
    same = [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(key)]
    many = F.coalesce("__parts", F.lit(1))
    drop = ["__parts", *(f"__h{i}" for i in range(len(key)))]
    salted = own.join(F.broadcast(hot), same, "left").withColumn("__salt", F.pmod(F.xxhash64(*points.columns), many).cast("int")).drop(*drop)
    repeated = cut.join(F.broadcast(hot), same, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), many - 1))).drop(*drop)
    return salted.join(repeated, [*key, "__salt"]).drop("__level", "__at", "__salt")


def overlapping(spans: DataFrame, on: list[str], row_id: str, begin: str, end: str) -> DataFrame:
    """(on, left_id, right_id) of every two spans with equal ``on`` that have a position in common, the one that begins first
    (ties: the smaller id) on the left: its span holds the other's first position."""
    left = spans.select(*on, F.col(row_id).alias("left_id"), F.col(begin).alias("__b"), F.col(end).alias("__e"))
    right = spans.where(F.col(begin) < F.col(end)).select(*on, F.col(row_id).alias("right_id"), F.col(begin).alias("__p"))
    pairs = points_in_spans(right, left, on, "__p", "__b", "__e")
    first = (F.col("__b") < F.col("__p")) | (F.col("__b") == F.col("__p")) & (F.col("left_id") < F.col("right_id"))
    return pairs.where(first).select(*on, "left_id", "right_id")
