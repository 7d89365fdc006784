"""Similarities, evidence scores and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def multiset_jaccard(pairs: DataFrame, counts: DataFrame, left: str, right: str, owner: str, token: str) -> DataFrame:
    """(left, right, jaccard) from token counts (owner, token, n): sum of least over sum of
    greatest; null where both are empty. Each owner's counts go to its pairs once, and greatest(a, b) = a + b - least(a, b), so
    a pair's tokens are added up where they meet; nothing is written or joined by token."""
    sides = pairs.select(F.col(left).alias(owner), left, right).unionByName(pairs.select(F.col(right).alias(owner), left, right)).distinct()
    each = counts.join(sides, owner).repartition(left, right)
    ends = [F.sum(F.when(F.col(owner) == F.col(e), F.col("n")).otherwise(0)).alias(k) for e, k in ((left, "__a"), (right, "__b"))]
    by_token = each.groupBy(left, right, token).agg(*ends)
    sums = by_token.groupBy(left, right).agg(F.sum(F.least("__a", "__b")).alias("__both"), F.sum(F.col("__a") + F.col("__b")).alias("__all"))
    out = pairs.join(sums, [left, right], "left")
    whole = F.coalesce("__all", F.lit(0)) - F.coalesce("__both", F.lit(0))
    return out.select(left, right, F.when(whole > 0, F.round(F.coalesce("__both", F.lit(0)) / whole, 6)).alias("jaccard"))


def noisy_or(df: DataFrame, target: str, family: str, weight: Column, most: float = 0.995) -> DataFrame:
    """(target, score): one minus the product of what each family's best evidence leaves open."""
    best = df.groupBy(target, family).agg(F.max(weight).alias("__w"))
    score = F.least(F.lit(1.0) - F.product(F.lit(1.0) - F.col("__w")), F.lit(most))
    return best.groupBy(target).agg((F.round(score, 6) + F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("families"))


def weighted_mean(signals: Sequence[tuple[Column, float]]) -> Column:
    """The mean of the signals that aren't null; null where all are."""
    have = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals), F.lit(0.0))
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals), F.lit(0.0))
    return F.when(have > 0, F.round(total / have, 6))


def dominance_votes(pairs: DataFrame, source: str, target: str, least_share: float = 0.8, least_votes: int = 2) -> DataFrame:
    """(source, target, votes, out_share, in_share) of the top target of each source that is also the target's top
    source, with ``least_share`` of the votes of both and ``least_votes``."""
    n = pairs.groupBy(source, target).agg(F.count(F.lit(1)).alias("votes"))
    out, into = Window.partitionBy(source), Window.partitionBy(target)
    n = n.withColumn("out_share", F.round(F.col("votes") / F.sum("votes").over(out), 6))
    n = n.withColumn("in_share", F.round(F.col("votes") / F.sum("votes").over(into), 6))
    n = n.withColumn("__o", F.row_number().over(out.orderBy(F.desc("votes"), target)))
    n = n.withColumn("__i", F.row_number().over(into.orderBy(F.desc("votes"), source)))
    n = n.where("__o = 1 AND __i = 1").drop("__o", "__i")
    return n.where((F.col("out_share") >= least_share) & (F.col("in_share") >= least_share) & (F.col("votes") >= least_votes))


def idf_top(tokens: DataFrame, owners: DataFrame, owner: str, token: str, k: int) -> DataFrame:
    """(owner, token, df, idf, rank): the k rarest tokens of each owner; idf = ln((n + 1) / (df + 1)) + 1.

    Tokens of more than a 4 P-th of all (owner, token) rows on P partitions, of which there can be no more than 4 P, get their
    frequency by broadcast and do not travel; the others are joined by token. Each side's k rarest of an owner go on."""
    spark = tokens.sparkSession
    each = tokens.select(owner, token).distinct()
    n = owners.agg(F.count(F.lit(1)).alias("__n"))  # one row
    df = settled(each.groupBy(token).agg(F.count(F.lit(1)).alias("df")), "frequencies")
    rows = df.agg(F.sum("df")).first()[0] or 0
    most = rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    large = F.broadcast(df.where(F.col("df") > most))
    order = Window.partitionBy(owner).orderBy("df", token)
    rare = each.join(large.select(token), token, "left_anti").join(df.where(F.col("df") <= most), token)
    scored = each.join(large, token).unionByName(rare)
    top = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    idf = F.round(F.log((F.col("__n") + 1) / (F.col("df") + 1)) + 1, 6)
    return top.join(F.broadcast(n)).select(owner, token, "df", idf.alias("idf"), "rank")


def dice(counts: DataFrame, left: str, right: str, token: str) -> DataFrame:
    """Dice coefficient of two count columns ``left`` and ``right`` by token, over the whole table."""
    both = 2 * F.sum(F.least(left, right))
    whole = F.sum(F.col(left) + F.col(right))
    return counts.agg(F.when(whole > 0, F.round(both / whole, 6)).alias("dice"))
