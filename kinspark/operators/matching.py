"""Identity matching between two versions of a table.

A match is emitted only where a key is unique on both sides, or where two rows
are each other's best choice by a margin. Ties are left to the caller as data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing, settled


def unique_rows(df: DataFrame, key: Sequence[str], row_id: str, name: str) -> DataFrame:
    """Keys that exactly one row has (no part of them null), with its id as ``name``."""
    known = df.dropna(subset=list(key))
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(row_id).alias(name)).where("__n = 1").drop("__n")


def unique_match(old: DataFrame, new: DataFrame, key: Sequence[str], row_id: str) -> DataFrame:
    """(old_id, new_id, key...) of keys that are unique on both sides."""
    return unique_rows(old, key, row_id, "old_id").join(unique_rows(new, key, row_id, "new_id"), list(key))


def cascade(old: DataFrame, new: DataFrame, stages: Sequence[tuple[str, Sequence[str]]], row_id: str) -> DataFrame:
    """(old_id, new_id, stage): each stage matches by its key what stages before left over.

    Only ids and keys go on. Both sides are one settled table, and so are the hits of each stage, so a
    stage reads what is left once, whatever the number of stages; what earlier stages left is deleted."""
    names = list(dict.fromkeys(k for _, key in stages for k in key))
    both = old.select(F.lit(True).alias("__old"), row_id, *names).unionByName(new.select(F.lit(False).alias("__old"), row_id, *names))
    with passing(old.sparkSession) as kept:
        left, found = settled(both, "unmatched"), []
        for i, (name, key) in enumerate(stages):
            count = [F.count_if(F.col("__old") == side) for side in (True, False)]
            ids = [F.min(F.when(F.col("__old") == side, F.col(row_id))).alias(c) for side, c in ((True, "old_id"), (False, "new_id"))]
            hits = left.dropna(subset=list(key)).groupBy(*key).agg(*ids, *(c.alias(f"__n{k}") for k, c in enumerate(count))).where("__n0 = 1 AND __n1 = 1")
            hits = settled(hits.select("old_id", "new_id", F.lit(name).alias("stage")), "hits")
            found.append(hits)
            if i + 1 < len(stages):
                gone = hits.select(F.lit(True).alias("__old"), F.col("old_id").alias(row_id)).unionByName(hits.select(F.lit(False).alias("__old"), F.col("new_id").alias(row_id)))
                left = settled(left.join(gone, ["__old", row_id], "left_anti"), "unmatched")
        kept += found
    out = found[0]
    for hits in found[1:]:
        out = out.unionByName(hits)
    return out


def dominant_targets(pairs: DataFrame, source: str, target: str, least_share: float, least_support: int) -> DataFrame:
    """(source, target, support, share): the most frequent target of each source, where it dominates."""
    counted = pairs.groupBy(source, target).agg(F.count(F.lit(1)).alias("support"))
    own = Window.partitionBy(source)
    counted = counted.withColumn("share", F.round(F.col("support") / F.sum("support").over(own), 6))
    counted = counted.withColumn("__rank", F.row_number().over(own.orderBy(F.desc("support"), target)))
    return counted.where((F.col("__rank") == 1) & (F.col("share") >= least_share) & (F.col("support") >= least_support)).drop("__rank")


def within_band(old: DataFrame, new: DataFrame, key: str, old_value: str, new_value: str, width: float) -> DataFrame:
    """Pairs with equal key whose values differ by ``width`` at most, as an equi-join on value bins."""
    left = old.withColumn("__bin", F.floor(F.col(old_value) / width))
    right = new.withColumn("__bin", F.explode(F.array(*(F.floor(F.col(new_value) / width) + k for k in (-1, 0, 1)))))
    near = F.abs(F.col(old_value) - F.col(new_value)) <= width
    return left.join(right, [key, "__bin"]).where(near).drop("__bin")


def best_of_each(pairs: DataFrame, own: str, other: str, k: int) -> DataFrame:
    """The k best pairs of each ``own`` by score, ties by ``other``; adds rank."""
    order = Window.partitionBy(own).orderBy(F.desc("score"), other)
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def judged(pairs: DataFrame, left: str, right: str, margin: float, least: float = 0.0) -> DataFrame:
    """The best pair of each left row (ties by the smaller right id) with its lead over the runner-up (none: its
    score) and an outcome: matched, or why not: low_score, thin_lead (margin not reached), or not_mutual
    (the right side's best, ties by the smaller left id, is another)."""
    by_left = Window.partitionBy(left).orderBy(F.desc("score"), right)
    by_right = Window.partitionBy(right).orderBy(F.desc("score"), left)
    ranked = (
        pairs.withColumn("__l", F.row_number().over(by_left))
        .withColumn("lead", F.round(F.col("score") - F.coalesce(F.lead("score").over(by_left), F.lit(0.0)), 6))
        .withColumn("__r", F.row_number().over(by_right))
    )
    outcome = F.when(F.col("score") < least, "low_score").when(F.col("lead") < margin, "thin_lead").when(F.col("__r") > 1, "not_mutual").otherwise("matched")
    return ranked.where("__l = 1").withColumn("outcome", outcome).drop("__l", "__r")


def mutual_best(pairs: DataFrame, left: str, right: str, margin: float, least: float = 0.0) -> DataFrame:
    """Pairs that are the best of both sides, of a score of ``least`` or more and with a lead of ``margin``
    over the left side's runner-up (none: 0); those that are not are the other rows of ``judged``."""
    return judged(pairs, left, right, margin, least).where("outcome = 'matched'").drop("outcome")


def translated(edges: DataFrame, ends: Sequence[str], mapping: DataFrame) -> DataFrame:
    """Edges whose ends are both in mapping (old, new), with the new ends."""
    for end in ends:
        own = mapping.select(F.col("old").alias(end), F.col("new").alias(f"__{end}"))
        edges = edges.join(own, end).drop(end).withColumnRenamed(f"__{end}", end)
    return edges


def corroborated(source: DataFrame, target: DataFrame, ends: Sequence[str], mapping: DataFrame | None = None) -> DataFrame:
    """Each source edge (ends, n) with the target's count and whether that is as high. With a mapping (old, new),
    the source's ends are translated first and edges with an end outside it drop out."""
    if mapping is not None:
        source = translated(source, ends, mapping)
    held = target.withColumnRenamed("n", "n_target")
    out = source.join(held, list(ends), "left").withColumn("n_target", F.coalesce("n_target", F.lit(0)).cast("long"))
    return out.withColumn("holds", F.col("n_target") >= F.col("n"))


def looked_up(rows: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value that the key has in ``held`` and a state: exact, missing (no such key), or
    several (more than one row has it; no value then)."""
    n = held.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value))
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "several").otherwise("exact")
    return rows.join(n, key, "left").withColumn("state", state).withColumn(value, F.when(F.col("state") == "exact", F.col(value))).drop("__n")


def within_owners(old: DataFrame, new: DataFrame, owners: DataFrame, owner: str, member: str, stages: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(old_owner, new_owner, old_id, new_id, stage) of members matched inside matched owners (old_owner, new_owner):
    the cascade with the owner pair in every key, so that all owners are matched at once."""
    pair = F.concat_ws("\u0000", "old_owner", "new_owner")
    a = old.withColumnRenamed(owner, "old_owner").join(owners, "old_owner").withColumn("__pair", pair)
    b = new.withColumnRenamed(owner, "new_owner").join(owners, "new_owner").withColumn("__pair", pair)
    found = cascade(a, b, [(name, ["__pair", *key]) for name, key in stages], member)
    ends = a.select(F.col(member).alias("old_id"), "old_owner", "new_owner")
    return found.join(ends, "old_id").select("old_owner", "new_owner", "old_id", "new_id", "stage")


def rivals(sets: DataFrame, owner: str, witness: str, least: int, most: int) -> DataFrame:
    """(owner, n_pool, n_supersets, state) of the owners whose witness multiset another one's holds.

    sets: (owner, witness, n). Owners that share ``least`` witnesses or more (with their counts) are the pool;
    those of it that hold all of the owner's witnesses as often are supersets. Where the pool is larger
    than ``most``, the claim is withdrawn: the state says so, and there is no number of supersets.
    Witnesses are joined by value, and the pool's size is known from counts before it is judged."""
    size = sets.groupBy(owner).agg(F.sum("n").alias("__size"))
    other = sets.select(F.col(owner).alias("__other"), witness, F.col("n").alias("__m"))
    shared = sets.join(other, witness).where(F.col(owner) != F.col("__other")).groupBy(owner, "__other").agg(F.sum(F.least("n", "__m")).alias("__both"))
    pool = shared.where(F.col("__both") >= least).join(size, owner)
    counted = pool.groupBy(owner).agg(F.count(F.lit(1)).alias("n_pool"), F.count_if(F.col("__both") == F.col("__size")).alias("__held"))
    out = size.join(counted, owner, "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))
    held = F.coalesce("__held", F.lit(0))
    state = F.when(F.col("n_pool") > most, "withdrawn").when(held > 0, "rivalled").otherwise("unrivalled")
    return out.select(owner, "n_pool", F.when(F.col("n_pool") <= most, held).alias("n_supersets"), state.alias("state"))


def shape_compatible(a: Column, b: Column, least: int, share: float) -> Column:
    """Whether two counts differ by no more than ``least`` or ``share`` of the larger, whichever is more."""
    return F.abs(a - b) <= F.greatest(F.lit(least), F.floor(F.greatest(a, b) * share))
