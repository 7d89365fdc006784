"""One-to-one assignment of scored pairs, and containment of witness sets with withdrawal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing, settled


def greedy(pairs: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """(left, right, score, round) of the pairs that a walk in order of falling score takes, where a pair is taken
    if neither end was before; ties by left, then right. Pairs without a score or an end are left out, repeated ones count once
    (with their best score).

    The walk is done in rounds: a pair that is first of both its ends' pairs is taken by the walk whatever comes before it, so
    all such pairs are taken at once, and pairs at their ends go. The first pair of each end is an aggregate, so
    an end with many pairs is combined before it is shuffled. There are as many rounds as the longest chain of pairs
    each of which waits for one before it."""
    given = pairs.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).alias("s")).dropna()
    first = F.min(F.struct((-F.col("s")).alias("s"), "l", "r")).alias("p")
    with passing(pairs.sparkSession) as kept:
        open_, taken, n = settled(given.groupBy("l", "r").agg(F.max("s").alias("s")), "pairs"), [], 0
        while True:
            n += 1
            lefts = open_.groupBy("l").agg(first).select("p.*")
            rights = open_.groupBy("r").agg(first).select("p.l", "p.r")
            hits = settled(lefts.join(rights, ["l", "r"]).select("l", "r", (-F.col("s")).alias("s"), F.lit(n).alias("round")), "assigned")
            if hits.isEmpty():
                break
            taken.append(hits)
            rest = open_.join(hits.select("l"), "l", "left_anti").join(hits.select("r"), "r", "left_anti")
            open_ = settled(rest.select("l", "r", "s"), "pairs")
            if len(taken) > 8:
                taken = [settled(_all(taken), "assigned")]
        found = settled(_all(taken) if taken else hits, "assigned")
        kept.append(found)
    return found.select(F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(score), "round")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def contained(sets: DataFrame, owner: str, witness: str, need: Column, most: int, incomplete: DataFrame | None = None) -> DataFrame:
    """(owner, size, pool, rivals, supersets, state) of every owner of a multiset (owner, witness, n).

    A rival is another owner that has ``need`` of its witnesses (a condition on ``size``, from 1 to size) or more, counted as
    often as both have them; a superset has all. States: incomplete (the owner is in ``incomplete``), too_broad, unscannable (a
    possible rival is incomplete), rivalled or unrivalled; only the last two make a claim, others have no numbers.

    Who shares ``need`` of ``size`` witnesses shares one of the ``size - need + 1`` rarest. So the pool is the owners in
    the postings of those, counted from their lengths before any pair is made; owners whose pool is above ``most`` are
    withdrawn there. Pairs are therefore ``most`` an owner at the most, and postings longer than that are not read."""
    spark = sets.sparkSession
    own = Window.partitionBy("o")
    with passing(spark) as kept:
        rows = sets.select(F.col(owner).alias("o"), F.col(witness).alias("w"), F.col("n").cast("long")).dropna()
        rows = settled(rows.groupBy("o", "w").agg(F.sum("n").alias("n")), "witnesses")
        length = rows.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
        ranked = rows.join(length, "w").withColumn("size", F.sum("n").over(own))
        before = F.coalesce(F.sum("n").over(own.orderBy("df", "w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("need", need.cast("long")).withColumn("before", before).where("before < size - need + 1")
        rare = settled(ranked.withColumn("pool", F.sum(F.col("df") - 1).over(own)), "rare")
        owners = rare.groupBy("o").agg(F.first("size").alias("size"), F.first("need").alias("need"), F.first("pool").alias("pool"))
        broken = (incomplete if incomplete is not None else sets.where("false")).select(F.col(owner).alias("o")).distinct().withColumn("broken", F.lit(True))
        owners = settled(owners.join(broken, "o", "left").withColumn("broken", F.coalesce("broken", F.lit(False))), "owners")
        asked = owners.where((F.col("pool") <= most) & ~F.col("broken")).select("o", "size", "need")
        postings = rows.join(length.where(F.col("df") <= most + 1), "w", "left_semi").select("w", F.col("o").alias("other"))
        pairs = rare.select("o", "w").join(asked.select("o"), "o", "left_semi").join(postings, "w").where("o <> other").select("o", "other").distinct()
        pairs = settled(pairs, "pairs")
        theirs = rows.select(F.col("o").alias("other"), "w", F.col("n").alias("m"))
        both = pairs.join(rows, "o").join(theirs, ["other", "w"]).groupBy("o", "other").agg(F.sum(F.least("n", "m")).alias("both"))
        # Who shares none of the rest is in the pool too, and may be incomplete.
        judged = pairs.join(both, ["o", "other"], "left").join(broken.withColumnRenamed("o", "other"), "other", "left").join(asked, "o")
        counts = judged.groupBy("o").agg(
            F.count_if(F.col("both") >= F.col("need")).alias("rivals"), F.count_if(F.col("both") == F.col("size")).alias("supersets"), F.count_if("broken").alias("unscannable")
        )
        out = owners.join(counts, "o", "left").fillna(0, ["rivals", "supersets", "unscannable"])
        state = F.when(F.col("broken"), "incomplete").when(F.col("pool") > most, "too_broad").when(F.col("unscannable") > 0, "unscannable").when(F.col("rivals") > 0, "rivalled").otherwise("unrivalled")
        out = settled(out.withColumn("state", state), "contained")
        kept.append(out)
    claims = F.col("state").isin("rivalled", "unrivalled")
    return out.select(F.col("o").alias(owner), "size", "pool", *(F.when(claims, F.col(c)).alias(c) for c in ("rivals", "supersets")), "state")
