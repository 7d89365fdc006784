"""Evidence lanes: what two versions of a log say about the identity of their targets.

A lane takes frontier rows (owner, target) and the observations of both sides, and gives every
row one outcome: accepted, or the reason why not. Lanes chain: a later one sees only the rows that
an earlier one rejected for one named reason. The ledger holds every frontier row once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED = "accepted"


def signatures(observations: DataFrame, owner: str, target: str, parts: Sequence[str]) -> DataFrame:
    """(owner, target, n, kinds, signature, alike): how many observations a target has, how many different ones, the
    digest of their sorted multiset, and how many targets of the owner have the same. Equal observations are
    counted before they are listed, so a group's list is as long as it has kinds."""
    kind = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts))
    counted = observations.groupBy(owner, target, kind.alias("__kind")).agg(F.count(F.lit(1)).alias("__n"))
    line = F.concat_ws("*", "__kind", "__n")
    signed = counted.groupBy(owner, target).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("signature"))
    return signed.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy(owner, "signature")))


def compared(frontier: DataFrame, old: DataFrame, new: DataFrame, owner: str, target: str, parts: Sequence[str]) -> DataFrame:
    """Frontier rows with the signatures of both sides: old_ and new_ n, kinds, signature and alike; null without observations."""
    out = frontier.select(owner, target)
    for name, side in (("old", old), ("new", new)):
        own = signatures(side, owner, target, parts)
        own = own.select(owner, target, *(F.col(c).alias(f"{name}_{c}") for c in ("n", "kinds", "signature", "alike")))
        out = out.join(own, [owner, target], "left")
    return out


def lane(frontier: DataFrame, old: DataFrame, new: DataFrame, owner: str, target: str, parts: Sequence[str], least: int = 1, exactly: int | None = None, unique: bool = True) -> DataFrame:
    """(owner, target, outcome) of every frontier row: no_usage, one_sided, changed (the multisets of observations
    differ), too_few (fewer than ``least``), not_single (not ``exactly`` so many kinds), not_unique (another
    target of the owner has the same multiset on a side; only if ``unique``), or accepted."""
    return outcomes(compared(frontier, old, new, owner, target, parts), owner, target, least, exactly, unique)


def outcomes(both: DataFrame, owner: str, target: str, least: int = 1, exactly: int | None = None, unique: bool = True) -> DataFrame:
    """(owner, target, outcome) of the rows of ``compared``, as ``lane`` says."""
    outcome = (
        F.when(F.col("old_n").isNull() & F.col("new_n").isNull(), "no_usage")
        .when(F.col("old_n").isNull() | F.col("new_n").isNull(), "one_sided")
        .when(F.col("old_signature") != F.col("new_signature"), "changed")
        .when(F.col("old_n") < least, "too_few")
    )
    if exactly is not None:
        outcome = outcome.when(F.col("old_kinds") != exactly, "not_single")
    if unique:
        outcome = outcome.when((F.col("old_alike") > 1) | (F.col("new_alike") > 1), "not_unique")
    return both.select(owner, target, outcome.otherwise(ACCEPTED).alias("outcome"))


def globally_unique(frontier: DataFrame, old: DataFrame, new: DataFrame, owner: str, target: str, parts: Sequence[str]) -> DataFrame:
    """(old_owner, old_target, new_owner, new_target) of targets whose multiset of observations no other target of any
    owner has, on both sides: the same signature then names one target on each."""

    def alone(side: DataFrame, name: str) -> DataFrame:
        own = signatures(side.join(frontier.select(owner, target), [owner, target], "left_semi"), owner, target, parts)
        return own.groupBy("signature").agg(F.count(F.lit(1)).alias("__n"), F.min(owner).alias(f"{name}_{owner}"), F.min(target).alias(f"{name}_{target}")).where("__n = 1").drop("__n")

    return alone(old, "old").join(alone(new, "new"), "signature").drop("signature")


def chain(frontier: DataFrame, key: Sequence[str], lanes: Sequence[tuple[str, str | None, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(key, lane, outcome): the ledger of lanes (name, reason that it takes on, function of rows to outcomes). The first
    lane takes the whole frontier. A row's outcome is that of the last lane that took it on."""
    name, _, judge = lanes[0]
    ledger = judge(frontier).withColumn("lane", F.lit(name))
    for name, reason, judge in lanes[1:]:
        taken = ledger.where(F.col("outcome") == reason)
        ledger = ledger.where(F.col("outcome") != reason).unionByName(judge(taken.select(*key)).withColumn("lane", F.lit(name)))
    return ledger.select(*key, "lane", "outcome")


def both_ways(matches: DataFrame, left: str, right: str) -> DataFrame:
    """Matches of which either end has no other."""
    n = matches.withColumn("__l", F.count(F.lit(1)).over(Window.partitionBy(left))).withColumn("__r", F.count(F.lit(1)).over(Window.partitionBy(right)))
    return n.where("__l = 1 AND __r = 1").drop("__l", "__r")


def concordance(lanes: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, lanes, votes, verdict): lanes are tables (key, value) that must cover the same keys, each once; where they
    do not, the verdict is uncovered or repeated, else agreed, or split."""
    every = None
    for name, rows in lanes.items():
        own = rows.select(key, F.col(value).cast("string").alias("__v"), F.lit(name).alias("__lane"))
        every = own if every is None else every.unionByName(own)
    out = every.groupBy(key).agg(F.count_distinct("__lane").alias("lanes"), F.count(F.lit(1)).alias("__rows"), F.count_distinct("__v").alias("votes"))
    verdict = F.when(F.col("__rows") > F.col("lanes"), "repeated").when(F.col("lanes") < len(lanes), "uncovered").when(F.col("votes") == 1, "agreed").otherwise("split")
    return out.select(key, "lanes", "votes", verdict.alias("verdict"))


def tiers(sets: DataFrame, other: DataFrame, key: str, item: str, strong: float = 0.8) -> DataFrame:
    """(key, shared, own, tier): how much of each key's set its namesake in ``other`` holds: exact, strong, partial or none."""
    own = sets.select(key, item).distinct()
    held = own.join(other.select(key, item).distinct().withColumn("__held", F.lit(1)), [key, item], "left")
    more = other.select(key, item).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("__other"))
    out = held.groupBy(key).agg(F.count("__held").alias("shared"), F.count(F.lit(1)).alias("own")).join(more, key, "left")
    share: Column = F.col("shared") / F.col("own")
    tier = F.when((F.col("shared") == F.col("own")) & (F.col("__other") == F.col("own")), "exact").when(share >= strong, "strong").when(F.col("shared") > 0, "partial").otherwise("none")
    return out.select(key, "shared", "own", tier.alias("tier"))
