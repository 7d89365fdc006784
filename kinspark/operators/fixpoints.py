"""Operators whose rules look at their own results: rounds until nothing changes.

A round works on what the last one added, joined by equality; each round's tables are settled, and deleted when the next ones stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing, release, settled


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def neighbour_matches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, shape, round, new_id, state) of every old node of two graphs.

    nodes: (old boolean, id, shape); edges: (old, src, dst, kind). In each round a node's signature is its shape and, for every
    kind and direction, its neighbours that are mapped already (by their old ids) as a multiset; nodes whose signature
    one node on either side has are mapped, which makes the signatures of their neighbours finer. Known neighbours that
    differ thus veto a pair whose shapes agree. Rounds go on until nothing is mapped. States of the rest: tied (several nodes
    have the signature), vetoed (nodes of its shape are left on the other side, all with other known neighbours), or alone.

    A signature is a sum of hashes, so each round adds only what the nodes mapped last contribute, and a node with many
    neighbours is summed before it is shuffled. No lists are made."""
    spark = nodes.sparkSession
    with passing(spark) as kept:
        ends = edges.select("old", F.col("src").alias("id"), F.col("dst").alias("n"), F.concat("kind", F.lit(">")).alias("kind"))
        ends = settled(ends.unionByName(edges.select("old", F.col("dst").alias("id"), F.col("src").alias("n"), F.concat("kind", F.lit("<")).alias("kind"))), "ends")
        zero = F.lit(0).cast("decimal(38,0)")
        open_ = settled(nodes.select("old", "id", "shape", zero.alias("known"), F.lit(0).cast("long").alias("degree")), "open")
        mapped, n = [], 0
        while True:
            n += 1
            one = [F.count_if(F.col("old")).alias("__o"), F.count_if(~F.col("old")).alias("__n"), F.max(F.when(F.col("old"), F.col("id"))).alias("id"), F.max(F.when(~F.col("old"), F.col("id"))).alias("new_id")]
            found = open_.groupBy("shape", "known", "degree").agg(*one).where("__o = 1 AND __n = 1")
            found = settled(found.select("id", "new_id", "shape", F.lit(n).alias("round")), "mapped")
            if found.isEmpty():
                break
            mapped.append(found)
            if len(mapped) > 8:
                mapped = [settled(_all(mapped), "mapped")]
            fresh = found.select(F.lit(True).alias("old"), F.col("id").alias("n"), F.col("id").alias("canon"))
            fresh = fresh.unionByName(found.select(F.lit(False).alias("old"), F.col("new_id").alias("n"), F.col("id").alias("canon")))
            draw = F.xxhash64("kind", "canon").cast("decimal(38,0)")
            more = ends.join(fresh, ["old", "n"]).groupBy("old", "id").agg(F.sum(draw).alias("__more"), F.count(F.lit(1)).alias("__m"))
            gone = fresh.select("old", F.col("n").alias("id"))
            rest = open_.join(gone, ["old", "id"], "left_anti").join(more, ["old", "id"], "left")
            before = open_
            open_ = settled(rest.select("old", "id", "shape", (F.col("known") + F.coalesce("__more", zero)).cast("decimal(38,0)").alias("known"), (F.col("degree") + F.coalesce("__m", F.lit(0))).alias("degree")), "open")
            release(before)
        sides = [F.count_if(F.col("old")).alias("__o"), F.count_if(~F.col("old")).alias("__n")]
        alike = open_.groupBy("shape", "known", "degree").agg(*sides).withColumn("__left", F.sum("__n").over(Window.partitionBy("shape")))
        state = F.when(F.col("__n") > 0, "tied").when(F.col("__left") > 0, "vetoed").otherwise("alone")
        rest = open_.where("old").join(alike.select("shape", "known", "degree", state.alias("state")), ["shape", "known", "degree"])
        rest = rest.select("id", "shape", F.lit(0).alias("round"), F.lit(None).cast(nodes.schema["id"].dataType).alias("new_id"), "state")
        done = _all([*mapped, found]).select("id", "shape", "round", "new_id", F.lit("matched").alias("state"))
        out = settled(done.unionByName(rest), "matches")
        kept.append(out)
    return out


def grown(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, round) of what the roots (column v) reach over edges (src, dst, guard), where an edge is open once both its
    src and its guard are reached (null: no guard), so that what is reached opens more. Roots have round 0.

    A round joins the nodes reached last with the edges that leave them, and with the edges that wait for them as guards;
    an edge whose src is reached before its guard waits in a table of its own until then."""
    spark = edges.sparkSession
    with passing(spark) as kept:
        edges = settled(edges.select("src", "dst", "guard").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
        fresh = settled(roots.select("v").where("v IS NOT NULL").distinct().withColumn("round", F.lit(0)), "frontier")
        levels, waiting, n = [fresh], None, 0
        while not fresh.isEmpty():
            n += 1
            last = fresh.select("v")
            left = edges.join(last.withColumnRenamed("v", "src"), "src").select("dst", "guard")
            asked = settled(left.where("guard IS NOT NULL").distinct(), "asked")
            reached = _all(levels).select(F.col("v").alias("guard"))
            opened = left.where("guard IS NULL").select("dst").unionByName(asked.join(reached, "guard", "left_semi").select("dst"))
            shut = asked.join(reached, "guard", "left_anti")
            if waiting is not None:
                key = last.withColumnRenamed("v", "guard")
                opened = opened.unionByName(waiting.join(key, "guard", "left_semi").select("dst"))
                shut = shut.unionByName(waiting.join(key, "guard", "left_anti"))
            step = opened.select(F.col("dst").alias("v")).distinct().join(_all(levels).select("v"), "v", "left_anti")
            fresh = settled(step.withColumn("round", F.lit(n)), "frontier")
            before, waiting = waiting, settled(shut.select("dst", "guard").distinct(), "waiting")
            release(asked)
            if before is not None:
                release(before)
            levels.append(fresh)
            if len(levels) > 8:
                levels = [settled(_all(levels[:-1]), "reached"), fresh]
        found = settled(_all(levels), "reached")
        kept.append(found)
    return found


def flowed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(v, name, round, support, rivals, state) of every variable that a name reaches over assignments (src, dst).

    Seeds (v, name) have round 0; one with several names is ambiguous. In each round a variable without a state whose sources
    have names takes theirs if they all agree, with the number of sources as its support, and else is ambiguous, which
    ends the flow there. A state never changes, but sources that are named later are counted: those with
    the variable's name add to its support, others are rivals and make it conflicting in the end."""
    spark = edges.sparkSession
    with passing(spark) as kept:
        edges = settled(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
        agree = [F.count_distinct("name").alias("__k"), F.min("name").alias("name")]
        first = seeds.dropna().groupBy("v").agg(*agree)
        fresh = settled(first.select("v", F.when(F.col("__k") == 1, F.col("name")).alias("name"), F.lit(0).alias("round")), "named")
        levels, n = [fresh], 0
        while not (last := fresh.where("name IS NOT NULL")).isEmpty():
            n += 1
            given = edges.join(last.select(F.col("v").alias("src"), "name"), "src").select(F.col("dst").alias("v"), "name")
            step = given.groupBy("v").agg(*agree).join(_all(levels).select("v"), "v", "left_anti")
            fresh = settled(step.select("v", F.when(F.col("__k") == 1, F.col("name")).alias("name"), F.lit(n).alias("round")), "named")
            levels.append(fresh)
            if len(levels) > 8:
                levels = [settled(_all(levels[:-1]), "named"), fresh]
        found = settled(_all(levels), "named")
        sources = edges.join(found.where("name IS NOT NULL").select(F.col("v").alias("src"), F.col("name").alias("given")), "src").groupBy(F.col("dst").alias("v"), "given").agg(F.count(F.lit(1)).alias("__n"))
        own = found.join(sources, "v", "left")
        same = F.coalesce(F.col("given") == F.col("name"), F.lit(False))
        counts = own.groupBy("v", "name", "round").agg(F.sum(F.when(same, F.col("__n")).otherwise(0)).alias("support"), F.sum(F.when(~same, F.coalesce("__n", F.lit(0))).otherwise(0)).alias("rivals"))
        state = F.when(F.col("name").isNull(), "ambiguous").when(F.col("rivals") > 0, "conflicting").when(F.col("support") > 1, "corroborated").otherwise("named")
        out = settled(counts.withColumn("state", state), "flow")
        kept.append(out)
    return out


def repaired(names: DataFrame, most: int) -> DataFrame:
    """(name, final, round) of every distinct name of the column ``name``: names that do not collide, and the last round in which each was changed (0: never).

    A name is a path of parts between "/"; what follows its first "$" is nested in it, and goes with it. Two paths
    collide if they are equal but for case, or if one is the folder of another. Of equal ones the one that was first by its original
    spelling stays and the others get "_1", "_2", ...; a path that is a folder gets "_0". What a
    round renames may collide anew, so rounds go on until none does; more than ``most`` are an error."""
    spark = names.sparkSession
    with passing(spark) as kept:
        whole = settled(names.select("name").dropna().distinct(), "names")
        path = F.substring_index("name", "$", 1)
        tops = settled(whole.select(path.alias("was")).distinct().select("was", F.col("was").alias("top"), F.lit(0).alias("round")), "tops")
        for n in range(1, most + 2):
            keyed = tops.withColumn("key", F.lower("top"))
            parts = F.split("key", "/")
            folders = keyed.select("key").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.when(k < F.size(parts), F.array_join(F.slice(parts, 1, k), "/")))).alias("key")).dropna().distinct()
            several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), F.min("was").alias("__first")).where("__n > 1").drop("__n")
            bad = several.join(folders.withColumn("__folder", F.lit(True)), "key", "full")
            hit = keyed.join(bad, "key").withColumn("__rank", F.row_number().over(Window.partitionBy("key").orderBy("was")) - 1)
            # The first of several gives way only to a folder.
            suffix = F.when(F.col("__rank") > 0, F.concat(F.lit("_"), F.col("__rank").cast("string"))).when(F.col("__folder"), "_0")
            moved = settled(hit.where(suffix.isNotNull()).select("was", F.concat("top", suffix).alias("to")), "moved")
            if moved.isEmpty():
                break
            if n > most:
                raise ValueError(f"names still collide after {most} rounds")
            before = tops
            tops = settled(tops.join(moved, "was", "left").select("was", F.coalesce("to", "top").alias("top"), F.when(F.col("to").isNotNull(), n).otherwise(F.col("round")).alias("round")), "tops")
            release(before)
        own = whole.withColumn("was", path).join(tops, "was")
        out = settled(own.select("name", F.concat("top", F.expr("substring(name, char_length(was) + 1)")).alias("final"), "round"), "repaired")
        kept.append(out)
    return out
