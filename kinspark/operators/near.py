"""Rows of two tables whose values are near, judged and assigned without making all their pairs.

A pair is a left and a right row of one key whose values differ by ``width`` at most; its score is 1 less that difference as a share
of ``width``, rounded to six places. Values are doubles; rows without key or value make no pairs. Rows of equal key and value are one
class. The best partners of a class are its neighbours in sorted order, so they are found in bins as wide as a pair may be, by
windows over the classes of both sides, and work grows with the rows, where the pairs grow with their square. Pairs themselves are made only
where ids repeat (or are null), as an id's pairs are then not one row's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing, settled
from . import assignment, matching

PLACES = 6
#: ``assigned`` makes the pairs once there are no more than so many a row, and no classes of so many rows meet.
FEW_PAIRS, FEW_EQUAL = 16, 8


def scored(left: DataFrame, right: DataFrame, on: str, left_value: str, right_value: str, width: float) -> DataFrame:
    """All pairs, with their score."""
    left, right = (df.where(F.abs(c) < float("inf")) for df, c in ((left, left_value), (right, right_value)))
    found = matching.within_band(left, right, on, left_value, right_value, width)
    return found.withColumn("score", _score(F.col(left_value), F.col(right_value), width)).drop(on, left_value, right_value)


def judged(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, left_value: str, right_value: str, width: float, margin: float, least: float = 0.0) -> DataFrame:
    """What ``matching.judged`` says of the pairs: (left_id, right_id, score, lead, outcome) of each left row that has any."""
    with passing(left.sparkSession) as kept:
        lefts, rights = _rows(left, on, left_id, left_value), _rows(right, on, right_id, right_value)
        if _repeats(lefts) or _repeats(rights):
            pairs = scored(left.select(on, left_id, left_value), right.select(on, right_id, right_value), on, left_value, right_value, width)
            out = settled(matching.judged(pairs, left_id, right_id, margin, least), "judged")
        else:
            lefts = settled(lefts, "lefts")
            own, other = settled(_classes(lefts), "classes"), settled(_classes(rights), "classes")
            best = _ties(settled(_best(own, other, width), "best"), other, width)
            tops = best.groupBy("k", "v").agg(F.first("s").alias("s"), F.first("near").alias("near"), F.sum("n").alias("n"), F.min(F.struct("m", "w")).alias("to"))
            after = F.when(F.col("n") > 1, F.col("s")).otherwise(F.array_max(F.transform(F.filter("near", lambda x: x["s"] < F.col("s")), lambda x: x["s"])))
            tops = tops.select("k", "v", "s", F.round(F.col("s") - F.coalesce(after, F.lit(0.0)), PLACES).alias("lead"), F.col("to.m").alias("r"), F.col("to.w").alias("w"))
            # Of all rights of a class the first left row is the same.
            firsts = _ties(settled(_best(other, own, width), "best"), own, width).groupBy("k", F.col("v").alias("w")).agg(F.min("m").alias("first"))
            found = lefts.join(tops.join(firsts, ["k", "w"]), ["k", "v"])
            outcome = F.when(F.col("s") < least, "low_score").when(F.col("lead") < margin, "thin_lead").when(F.col("first") != F.col("id"), "not_mutual").otherwise("matched")
            out = settled(found.select(F.col("id").alias(left_id), F.col("r").alias(right_id), F.col("s").alias("score"), "lead", outcome.alias("outcome")), "judged")
        kept.append(out)
    return out


def assigned(
    left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, left_value: str, right_value: str, width: float, few_pairs: int = FEW_PAIRS, few_equal: int = FEW_EQUAL
) -> DataFrame:
    """What ``assignment.greedy`` takes of the pairs: (left_id, right_id, score, round).

    In a round every class asks for its best classes of the other side. Classes that all ask for each other, and for no others, have one
    score and are best for all their rows: the walk gives the first of their left rows the first of their right ones, and so on, until
    one side ends. Of other classes that ask for each other, the first rows of both are taken where each is the other's first; so a
    round takes one pair at least. Rows without a partner that is open go for good. When few pairs are left, they are made."""
    spark = left.sparkSession
    with passing(spark) as kept:
        lefts, rights = _rows(left, on, left_id, left_value), _rows(right, on, right_id, right_value)
        taken, n = [], 0
        if _repeats(lefts) or _repeats(rights):
            pairs = scored(left.select(on, left_id, left_value), right.select(on, right_id, right_value), on, left_value, right_value, width)
            kept.append(found := settled(assignment.greedy(pairs, left_id, right_id), "assigned"))
            return found
        lefts, rights = settled(lefts, "lefts"), settled(rights, "rights")
        most = few_pairs * (lefts.count() + rights.count())
        while True:
            own, other = settled(_classes(lefts), "classes"), settled(_classes(rights), "classes")
            pairs, equal = _met(own, other, width)
            if pairs <= most and equal <= few_equal:
                break
            n += 1
            best, back = settled(_best(own, other, width), "best"), settled(_best(other, own, width), "best")
            asked, answers = _ties(best, other, width), _ties(back, own, width).select("k", F.col("w").alias("v"), F.col("v").alias("w"), "n", "m")
            hits = settled(_round(lefts, rights, asked, answers).withColumn("round", F.lit(n)), "assigned")
            taken.append(hits)
            lefts = settled(lefts.join(best.select("k", "v"), ["k", "v"], "left_semi").join(hits.select(F.col("l").alias("id")), "id", "left_anti"), "lefts")
            rights = settled(rights.join(back.select("k", "v"), ["k", "v"], "left_semi").join(hits.select(F.col("r").alias("id")), "id", "left_anti"), "rights")
            if len(taken) > 8:
                taken = [settled(_all(taken), "assigned")]
        rest = scored(lefts.select("k", F.col("id").alias("l"), "v"), rights.select("k", F.col("id").alias("r"), F.col("v").alias("w")), "k", "v", "w", width)
        rest = assignment.greedy(rest, "l", "r").select("l", "r", F.col("score").alias("s"), (F.col("round") + n).alias("round"))
        out = settled(_all([*taken, rest]), "assigned")
        kept.append(out)
    return out.select(F.col("l").alias(left_id), F.col("r").alias(right_id), F.col("s").alias("score"), "round")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _score(a: Column, b: Column, width: float) -> Column:
    return F.round(1 - F.abs(a - b) / width, PLACES)


def _rows(df: DataFrame, on: str, row_id: str, value: str) -> DataFrame:
    """(k, id, v) of the rows that can have pairs."""
    rows = df.select(F.col(on).alias("k"), F.col(row_id).alias("id"), F.col(value).cast("double").alias("v"))
    return rows.where(F.col("k").isNotNull() & (F.abs("v") < float("inf")))


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty()


def _classes(rows: DataFrame) -> DataFrame:
    """(k, v, n, m): how many rows a class has, and the first of them."""
    return rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))


def _around(own: DataFrame, other: DataFrame, width: float) -> DataFrame:
    """``own`` with the structs (v, n, m) of the two next classes of ``other`` below or at each (u1, u2) and above it (d1, d2), in its bin and those beside it."""
    place = F.floor(F.col("v") / width)
    mine = own.select("k", place.alias("bin"), "v", F.lit(0).alias("side"), F.lit(None).cast(other.select(F.struct("v", "n", "m")).schema[0].dataType).alias("there"))
    theirs = other.select("k", F.explode(F.array(*(place + i for i in (-1, 0, 1)))).alias("bin"), "v", F.lit(1).alias("side"), F.struct("v", "n", "m").alias("there"))
    x = mine.unionByName(theirs)
    bins = Window.partitionBy("k", "bin")
    for c, order in (("u", bins.orderBy("v", F.desc("side"))), ("d", bins.orderBy(F.desc("v"), "side"))):
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn(f"{c}1", F.last("there", True).over(before))
        x = x.withColumn(f"{c}2", F.last(F.when(F.col("side") == 1, F.struct(F.col(f"{c}1").alias("t"))), True).over(before)["t"])
    return x.where("side = 0").select("k", "v", "u1", "u2", "d1", "d2")


def _best(own: DataFrame, other: DataFrame, width: float) -> DataFrame:
    """(k, v, s, near, dense) of the classes of ``own`` with partners: the best score, the next classes (s, w, n, m) of ``other`` (two on each side), and whether more
    than these may have the best score, as two on one side do."""
    v = F.col("v")
    held = F.filter(F.array("u1", "u2", "d1", "d2"), lambda x: x.isNotNull() & (F.abs(v - x["v"]) <= width))
    x = _around(own, other, width).select("k", "v", F.transform(held, lambda x: F.struct(_score(v, x["v"], width).alias("s"), x["v"].alias("w"), x["n"].alias("n"), x["m"].alias("m"))).alias("near"))
    x = x.where(F.size("near") > 0).withColumn("s", F.array_max(F.transform("near", lambda x: x["s"])))
    tied = lambda below: F.size(F.filter("near", lambda x: (x["s"] == F.col("s")) & ((x["w"] <= v) == F.lit(below)))) > 1
    return x.select("k", "v", "s", "near", (tied(True) | tied(False)).alias("dense"))


def _ties(best: DataFrame, other: DataFrame, width: float) -> DataFrame:
    """(k, v, s, near, w, n, m): each class with all classes of ``other`` at its best score. Where there may be many they are joined by
    bins as wide as scores are rounded."""
    plain = best.where("NOT dense").select("k", "v", "s", "near", F.explode(F.filter("near", lambda x: x["s"] == F.col("s"))).alias("t")).select("k", "v", "s", "near", "t.w", "t.n", "t.m")
    many = best.where("dense")
    if many.isEmpty():
        return plain
    step = 2 * width * 10**-PLACES
    away = (1 - F.col("s")) * width
    places = F.array_distinct(F.array(*(F.floor((F.col("v") + sign * away) / step) + i for sign in (-1, 1) for i in (-1, 0, 1))))
    held = other.select("k", F.floor(F.col("v") / step).alias("at"), F.col("v").alias("w"), "n", "m")
    found = many.select("k", "v", "s", "near", F.explode(places).alias("at")).join(held, ["k", "at"])
    same = (F.abs(F.col("v") - F.col("w")) <= width) & (_score(F.col("v"), F.col("w"), width) == F.col("s"))
    return plain.unionByName(found.where(same).select("k", "v", "s", "near", "w", "n", "m"))


def _met(own: DataFrame, other: DataFrame, width: float) -> tuple[float, int]:
    """How many pairs are at most left, and the most rows of equal values that a class of either side can have to wait for."""
    place = F.floor(F.col("v") / width)
    count = lambda c: (F.sum(F.col("n").cast("double")).alias(c), F.max("n").alias(f"{c}_most"))
    a = own.groupBy("k", place.alias("bin")).agg(*count("a"))
    b = other.select("k", F.explode(F.array(*(place + i for i in (-1, 0, 1)))).alias("bin"), "n").groupBy("k", "bin").agg(*count("b"))
    found = a.join(b, ["k", "bin"]).agg(F.sum(F.col("a") * F.col("b")).alias("pairs"), F.max(F.least("a_most", "b_most")).alias("equal")).first()
    return found["pairs"] or 0.0, found["equal"] or 0


def _round(lefts: DataFrame, rights: DataFrame, asked: DataFrame, back: DataFrame) -> DataFrame:
    """(l, r, s) of the pairs that are taken now. asked and back: (k, v, w, n, m), which classes w of the right those v of the left ask for
    (with their score s) and the other way round; n and m are those of the class that is asked."""
    asking = asked.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n_w"), F.min("w").alias("low_w"), F.min(F.struct("m", "w")).alias("to"))
    answer = back.groupBy("k", "w").agg(F.count(F.lit(1)).alias("n_v"), F.min("v").alias("low_v"), F.min(F.struct("m", "v")).alias("by"))
    both = asked.select("k", "v", "w", "s").join(back.select("k", "v", "w"), ["k", "v", "w"]).join(asking, ["k", "v"]).join(answer, ["k", "w"])
    both = settled(both, "both")
    # In a group where all ask for each other all have the same least class of either side. Edges as many as left times right
    # ones, and none that leads out: the group is whole.
    group = ["k", "low_v", "low_w"]
    size = [F.count_distinct("v").alias("v"), F.count_distinct("w").alias("w"), F.count(F.lit(1)).alias("n")]
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("n_w", "n_v") for f in (F.min, F.max)]
    whole = both.groupBy(*group).agg(*size, *ends).where("n = v * w AND n_w_min = w AND n_w_max = w AND n_v_min = v AND n_v_max = v").select(*group)
    within = both.join(whole, group, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("id")).alias("rank")
    ls = lefts.join(within.select(*group, "v", "s").distinct(), ["k", "v"]).select(*group, F.col("id").alias("l"), "s", rank)
    rs = rights.join(within.select(*group, F.col("w").alias("v")).distinct(), ["k", "v"]).select(*group, F.col("id").alias("r"), rank)
    rows = ls.join(rs, [*group, "rank"]).select("l", "r", "s")
    firsts = both.join(whole, group, "left_anti").where("to.w = w AND by.v = v").select(F.col("by.m").alias("l"), F.col("to.m").alias("r"), "s")
    return rows.unionByName(firsts)
