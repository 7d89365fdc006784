"""Identities that are carried from one version to the next.

A lineage table has a row for each identity and version: (entity_id, build,
name). Only trusted matches carry an identity on; the rest is a review queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import padded
from .sequences import numbered


def seed(rows: DataFrame, name: str, build: str, prefix: str = "E_", after: int = 0) -> DataFrame:
    """First identities: numbers by sorted order of the distinct names, from ``after`` + 1."""
    found = numbered(rows.select(F.col(name).alias("name")).distinct(), ["name"])
    return found.select(F.concat(F.lit(prefix), padded(F.col("number") + after, 6)).alias("entity_id"), F.lit(build).alias("build"), "name")


def promoted(lineage: DataFrame, unmatched: DataFrame, build: str, prefix: str = "E_") -> DataFrame:
    """Rows (entity_id, build, name) for reviewed names that no identity of the build has: numbers go on after the
    largest in use, in the order of the names. Names that an identity of the build owns are left out."""
    owned = lineage.where(F.col("build") == build).select("name")
    last = lineage.agg(F.max(F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("long"))).first()[0] or 0
    return seed(unmatched.join(owned, "name", "left_anti"), "name", build, prefix, last)


def member_deltas(old: DataFrame, new: DataFrame, matched: DataFrame, owner: str, member: str, name: str, shape: str, detail: str) -> DataFrame:
    """(owner, old_id, new_id, delta) of every member of both sides: unchanged, renamed (another name of one shape and
    detail), modified, or without a match removed or new. matched: (old_owner, old_id, new_id)."""
    a = old.select(F.col(member).alias("old_id"), F.col(owner).alias("__ao"), F.col(name).alias("__an"), F.col(shape).alias("__as"), F.col(detail).alias("__ad"))
    b = new.select(F.col(member).alias("new_id"), F.col(owner).alias("__bo"), F.col(name).alias("__bn"), F.col(shape).alias("__bs"), F.col(detail).alias("__bd"))
    pairs = a.join(matched.select("old_id", "new_id"), "old_id", "left")
    both = pairs.join(b, "new_id", "full_outer")
    same_shape = F.col("__as").eqNullSafe(F.col("__bs")) & F.col("__ad").eqNullSafe(F.col("__bd"))
    same_name = F.col("__an").eqNullSafe(F.col("__bn"))
    delta = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "new").when(same_shape & same_name, "unchanged").when(same_shape, "renamed").otherwise("modified")
    return both.select(F.coalesce("__ao", "__bo").alias(owner), "old_id", "new_id", delta.alias("delta"))


def validated(entities: DataFrame, entries: DataFrame, builds: list[str], statuses: list[str]) -> DataFrame:
    """(rule, key) of all that breaks a rule; none may be left. entities: (entity_id, status, name, confidence); entries:
    (entity_id, build, path). Rules: one row an identity, known status, a name where the status asks for one and
    only there, confidence from 0 to 1 and 0 without a name, accepted names unique; entries of known identities
    and builds, one a build, paths unique in a build; and an entry for each identity."""
    named = F.col("name").isNotNull()
    row_rules = {
        "unknown_status": ~F.coalesce(F.col("status").isin(statuses), F.lit(False)),
        "name_without_status": (F.col("status") == "UNKNOWN") & named,
        "status_without_name": F.col("status").isin("CANDIDATE", "ACCEPTED") & ~named,
        "confidence_out_of_range": F.coalesce((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(True)),
        "confidence_without_name": ~named & (F.col("confidence") != 0),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in row_rules.items())))
    entity = F.col("entity_id").cast("string").alias("key")
    out = [entities.select(F.explode(broken).alias("rule"), entity)]

    def several(df: DataFrame, rule: str, by: list[str], key: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))

    out.append(several(entities, "identity_twice", ["entity_id"], "entity_id"))
    out.append(several(entities.where("status = 'ACCEPTED' AND name IS NOT NULL"), "accepted_name_twice", ["name"], "name"))
    out.append(several(entries, "build_twice", ["entity_id", "build"], "entity_id"))
    out.append(several(entries, "path_twice", ["build", "path"], "path"))
    out.append(entries.where(~F.coalesce(F.col("build").isin(builds), F.lit(False))).select(F.lit("unknown_build").alias("rule"), entity).distinct())
    out.append(entries.join(entities, "entity_id", "left_anti").select(F.lit("unknown_identity").alias("rule"), entity).distinct())
    out.append(entities.join(entries, "entity_id", "left_anti").select(F.lit("no_entry").alias("rule"), entity).distinct())
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found


def relationships(matches: DataFrame) -> DataFrame:
    """Proposed relationships from matches (old_name, new_name, old_digest, new_digest, strategy): the relation by
    what changed, and whether it may be applied without review (byte-identical ones only)."""
    same, moved = F.col("old_digest").eqNullSafe(F.col("new_digest")), F.col("old_name") != F.col("new_name")
    relation = F.when(same & ~moved, "identical").when(same, "renamed").when(~moved, "changed").otherwise("renamed_changed")
    return matches.withColumn("relation", relation).withColumn("ready", same)


def applied(lineage: DataFrame, candidates: DataFrame, held: DataFrame, build: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected with a reason) of candidates (entity_id, name, digest), verified again: the identity must be
    known, have no row of the build yet, its name be proposed once, and the digest be what ``held`` (name, digest) has now."""
    known = lineage.groupBy("entity_id").agg(F.max(F.col("build") == build).alias("__has"))
    now = held.select("name", F.col("digest").alias("__now"))
    c = candidates.join(known, "entity_id", "left").join(now, "name", "left").withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy("name")))
    reason = (
        F.when(F.col("__has").isNull(), "unknown_identity")
        .when(F.col("__has"), "has_build_already")
        .when(F.col("__times") > 1, "name_proposed_twice")
        .when(F.col("__now").isNull(), "not_in_build")
        .when(F.col("__now") != F.col("digest"), "digest_drifted")
    )
    c = c.withColumn("reason", reason)
    return c.where("reason IS NULL").select("entity_id", F.lit(build).alias("build"), "name"), c.where("reason IS NOT NULL").select("entity_id", "name", "reason")


def hazards(mapping: DataFrame, literals: DataFrame, resources: DataFrame, members: DataFrame) -> DataFrame:
    """(source, target, hazards, severity) of renames (source, target): whether a literal spells the source with slashes or dots
    (high), a resource stands in its package (medium), or it has members of a risky flag (low). literals: (literal),
    resources: (path), members: (source, flags). The spellings and packages are joined by value."""
    spelt = mapping.select("source", F.explode(F.array_distinct(F.array("source", F.translate("source", "/", ".")))).alias("literal"))
    said = spelt.join(literals.select("literal").distinct(), "literal", "left_semi").select("source", F.lit("literal_mention").alias("hazard")).distinct()
    package = F.regexp_extract("source", "^(.*)/[^/]*$", 1)
    held = resources.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("package")).where("package <> ''").distinct()
    moved = mapping.where(package != F.regexp_extract("target", "^(.*)/[^/]*$", 1)).select("source", package.alias("package"))
    beside = moved.join(held, "package", "left_semi").select("source", F.lit("package_resource").alias("hazard"))
    risky = members.where(F.col("flags").bitwiseAND(1) != 0).select("source", F.lit("flagged_member").alias("hazard")).distinct()
    found = said.unionByName(beside).unionByName(risky).join(mapping.select("source"), "source", "left_semi").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("hazard")), ",").alias("hazards"))
    out = mapping.join(found, "source", "left")
    names = F.coalesce("hazards", F.lit(""))
    severity = F.when(names.contains("literal_mention"), "high").when(names.contains("package_resource"), "medium").otherwise("low")
    return out.select("source", "target", names.alias("hazards"), severity.alias("severity"))


def reaccepted(now: DataFrame, accepted: DataFrame) -> DataFrame:
    """(source, state) of risks (source, material): carried where the material that was accepted is the same as now, changed
    where it is another, unreviewed without an acceptance, and gone where only an acceptance is left."""
    a = now.select("source", F.sha2("material", 256).alias("__now"), F.lit(True).alias("__here"))
    b = accepted.select("source", F.sha2("material", 256).alias("__then"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "unreviewed").when(F.col("__here").isNull(), "gone").when(F.col("__now").eqNullSafe(F.col("__then")), "carried").otherwise("changed")
    return a.join(b, "source", "full_outer").select("source", state.alias("state"))


def violations(lineage: DataFrame) -> DataFrame:
    """(rule, key, n) of identities that a build has twice and of names that two identities share; must be empty."""
    twice = lineage.groupBy("build", "entity_id").count().where("count > 1").select(F.lit("entity_twice").alias("rule"), F.col("entity_id").alias("key"), F.col("count").alias("n"))
    shared = lineage.groupBy("build", "name").count().where("count > 1").select(F.lit("name_shared").alias("rule"), F.col("name").alias("key"), F.col("count").alias("n"))
    return twice.unionByName(shared)


def transfer(lineage: DataFrame, matches: DataFrame, old_build: str, new_build: str, trusted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(carried rows of the new build, review queue) from matches (old_name, new_name, strategy)."""
    held = lineage.where(F.col("build") == old_build).select("entity_id", F.col("name").alias("old_name"))
    known = matches.join(held, "old_name", "left")
    good = F.col("strategy").isin(trusted) & F.col("entity_id").isNotNull()
    carried = known.where(good).select("entity_id", F.lit(new_build).alias("build"), F.col("new_name").alias("name"))
    reason = F.when(F.col("entity_id").isNull(), "unknown_identity").otherwise("untrusted_strategy")
    return carried, known.where(~good).select("old_name", "new_name", "strategy", reason.alias("reason"))


def accept(lineage: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed names (entity_id, proposed) as (accepted, rejected with a reason): an identity must
    be known and have one proposal, and a name must be proposed once and be free."""
    known = lineage.select("entity_id").distinct().withColumn("__known", F.lit(True))
    taken = lineage.select(F.lower("name").alias("__fold")).distinct().withColumn("__taken", F.lit(True))
    p = proposals.select("entity_id", "proposed").distinct().withColumn("__fold", F.lower("proposed"))
    p = p.join(known, "entity_id", "left").join(taken, "__fold", "left")
    p = p.withColumn("__of_id", F.count(F.lit(1)).over(Window.partitionBy("entity_id"))).withColumn("__of_name", F.count(F.lit(1)).over(Window.partitionBy("__fold")))
    reason = (
        F.when(F.col("__known").isNull(), "unknown_identity")
        .when(F.col("__of_id") > 1, "several_proposals")
        .when(F.col("__of_name") > 1, "name_proposed_twice")
        .when(F.col("__taken").isNotNull(), "name_taken")
    )
    p = p.select("entity_id", "proposed", reason.alias("reason"))
    return p.where("reason IS NULL").drop("reason"), p.where("reason IS NOT NULL")


def rename_plan(names: DataFrame, accepted: DataFrame) -> DataFrame:
    """(entity_id, name, target, collides): the accepted name or else the present one, and whether two come out equal."""
    both = names.select("entity_id", "name").join(accepted, "entity_id", "left")
    target = F.coalesce("proposed", "name")
    return both.select("entity_id", "name", target.alias("target"), (F.count(F.lit(1)).over(Window.partitionBy(F.lower(target))) > 1).alias("collides"))


def sandwiched(old: DataFrame, new: DataFrame, owner: str, place: str, anchor: str, shape: str) -> DataFrame:
    """(owner, old_place, new_place, shape) of unanchored rows that stand between the same two anchors
    on both sides, with a shape that is unique there. Anchors are ids that both sides already share."""

    def between(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(owner).orderBy(place)
        left = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        right = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        free = df.withColumn("left", left).withColumn("right", right).where(F.col(anchor).isNull() & F.col("left").isNotNull() & F.col("right").isNotNull())
        return free.groupBy(owner, "left", "right", shape).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias(name)).where("__n = 1").drop("__n")

    return between(old, "old_place").join(between(new, "new_place"), [owner, "left", "right", shape]).drop("left", "right")


def retained(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, state): reached from a root (needed), a root itself (root), or neither (dead); reached as ``graph.walk`` gives it."""
    known = reached.select(F.col("v").alias("node"), "depth")
    state = F.when(F.col("depth") == 0, "root").when(F.col("depth").isNotNull(), "needed").otherwise("dead")
    return nodes.select("node").distinct().join(known, "node", "left").select("node", state.alias("state"))
