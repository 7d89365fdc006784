"""What changed between two versions, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, old_digest, new_digest, status): same, changed, added or removed. A null digest is a
    value like any other: the same as null, and changed against all else."""
    a = old.select(key, F.col(digest).alias("old_digest"), F.lit(True).alias("__old"))
    b = new.select(key, F.col(digest).alias("new_digest"), F.lit(True).alias("__new"))
    status = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .when(F.col("old_digest").eqNullSafe(F.col("new_digest")), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").withColumn("status", status).drop("__old", "__new")


def inventory(expected: DataFrame, found: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """(key, status, differing): each key is shared_exact, a metadata_difference (with the names of the attributes
    that differ, in their order), missing from ``found``, or extra there. Nulls are equal to each other."""
    a = expected.select(*key, F.struct(*attributes).alias("__a"))
    b = found.select(*key, F.struct(*attributes).alias("__b"))
    apart = F.array_compact(F.array(*(F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in attributes)))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.size(apart) == 0, "shared_exact").otherwise("metadata_difference")
    named = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.array_join(apart, ",")).otherwise("")
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status"), named.alias("differing"))


def surface(left: DataFrame, right: DataFrame, group: str, member: str, shape: str) -> DataFrame:
    """(group, common, equal, different, left_only, right_only, state): members of each group's two sides by name and
    shape. A group on one side only has all its members there; it is equal if no member tells the sides apart."""
    a = left.select(group, member, F.col(shape).alias("__a"), F.lit(1).alias("__l"))
    b = right.select(group, member, F.col(shape).alias("__b"), F.lit(1).alias("__r"))
    both = a.join(b, [group, member], "full_outer")
    here, there = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    same = F.col("__a").eqNullSafe(F.col("__b"))
    out = both.groupBy(group).agg(F.count_if(here & there).alias("common"), F.count_if(here & there & same).alias("equal"), F.count_if(here & there & ~same).alias("different"), F.count_if(here & ~there).alias("left_only"), F.count_if(~here & there).alias("right_only"))
    state = F.when(F.col("common") == 0, F.when(F.col("right_only") == 0, "left_only").otherwise("right_only")).when(F.col("different") + F.col("left_only") + F.col("right_only") == 0, "equal").otherwise("different")
    return out.withColumn("state", state)


def set_distance(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many keys only one side has, how many both, and whether they are disjoint."""
    sides = left.select(*key).distinct().withColumn("__s", F.lit(1)).unionByName(right.select(*key).distinct().withColumn("__s", F.lit(2)))
    n = sides.groupBy(*key).agg(F.sum("__s").alias("__s"))
    return n.agg(F.count_if(F.col("__s") == 1).alias("left_only"), F.count_if(F.col("__s") == 2).alias("right_only"), F.count_if(F.col("__s") == 3).alias("shared"), (F.count_if(F.col("__s") == 3) == 0).alias("disjoint"))


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def presence(df: DataFrame, key: str, in_old: Column, in_new: Column) -> DataFrame:
    """(key, status) of keys seen in either version: carried, blocked or new_only."""
    seen = df.groupBy(key).agg(F.max(in_old.cast("int")).alias("__old"), F.max(in_new.cast("int")).alias("__new"))
    status = F.when((F.col("__old") == 1) & (F.col("__new") == 1), "carried").when(F.col("__old") == 1, "blocked").otherwise("new_only")
    return seen.where("__old = 1 OR __new = 1").select(key, status.alias("status"))


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """A percentage of four places; ``empty`` where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(F.lit(100.0) * part / whole, 4))
