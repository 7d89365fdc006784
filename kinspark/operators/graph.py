"""Reachability and components of edge tables.

Walks go a level a round, from a frontier; components double the length of their chains with every
join. Each round's tables are settled and deleted as soon as the next one's stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import passing, settled


def walk(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", open_: Column | None = None) -> DataFrame:
    """(v, depth, parent): what the roots (column v) reach, each in the fewest steps and from the smallest
    parent of the level before; roots have depth 0 and no parent.

    open_: a condition on edges; those that fail it are not walked. Only the frontier is joined with
    the edges in a round, so the work is that of the reached edges, not of all pairs.
    """
    spark = edges.sparkSession
    if open_ is not None:
        edges = edges.where(open_)
    with passing(spark) as kept:
        edges = settled(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
        start = roots.select("v").where("v IS NOT NULL").distinct()
        fresh = settled(start.select("v", F.lit(0).alias("depth"), F.lit(None).cast(start.schema["v"].dataType).alias("parent")), "frontier")
        levels = [fresh]
        while not fresh.isEmpty():
            step = fresh.select(F.col("v").alias("src"), "depth").join(edges, "src")
            step = step.groupBy(F.col("dst").alias("v")).agg((F.first("depth") + 1).alias("depth"), F.min("src").alias("parent"))
            fresh = settled(step.join(_all(levels).select("v"), "v", "left_anti"), "frontier")
            levels.append(fresh)
            if len(levels) > 8:
                levels = [settled(_all(levels[:-1]), "reached"), fresh]
        found = settled(_all(levels), "reached")
        kept.append(found)
    return found


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, hops): what each vertex reaches, in the fewest steps. The result has a row for every pair,
    so it is for graphs of bounded reach; use ``walk`` for what some roots reach."""
    spark = edges.sparkSession
    with passing(spark) as kept:
        edges = settled(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "edges")
        found = edges.withColumn("hops", F.lit(1))
        fresh, hops = edges, 1
        while True:
            hops += 1
            step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
            further = fresh.join(step, "dst").select("src", F.col("to").alias("dst")).distinct()
            fresh = settled(further.join(found.select("src", "dst"), ["src", "dst"], "left_anti"), "closure")
            if fresh.isEmpty():
                found = settled(found, "closure")
                kept.append(found)
                return found
            found = settled(found.unionByName(fresh.withColumn("hops", F.lit(hops))), "closure")


def ancestors(edges: DataFrame, starts: DataFrame, src: str, dst: str) -> DataFrame:
    """(v, a): for each start (column v) all that a walk along the edges meets; only new pairs go into the next round."""
    with passing(edges.sparkSession) as kept:
        edges = settled(edges.select(F.col(src).alias("a"), F.col(dst).alias("to")).distinct(), "edges")
        fresh = settled(starts.select("v").distinct().withColumn("a", F.col("v")).join(edges, "a").select("v", F.col("to").alias("a")).distinct(), "ancestors")
        found = fresh
        while not fresh.isEmpty():
            step = fresh.join(edges, "a").select("v", F.col("to").alias("a")).distinct()
            fresh = settled(step.join(found, ["v", "a"], "left_anti"), "ancestors")
            found = settled(found.unionByName(fresh), "ancestors")
        kept.append(found)
    return found


def rewritten(rows: DataFrame, mapping: DataFrame, most: int) -> DataFrame:
    """Rows with ``value`` replaced by mapping (old, new) until nothing changes. The mapping's own chains are followed
    first, by doubling, so the rows are joined once; more than ``most`` steps, or a cycle, is an error."""
    hooks = mapping.where("old <> new").select(F.col("old").alias("v"), F.col("new").alias("to"))
    with passing(rows.sparkSession) as kept:
        hooks, steps = settled(hooks, "mapping"), 1
        while not hooks.join(hooks.select(F.col("v").alias("to")), "to", "left_semi").isEmpty():
            if steps > most:
                raise ValueError(f"the mapping is not stable after {most} steps")
            further = hooks.select(F.col("v").alias("to"), F.col("to").alias("further"))
            hooks = settled(hooks.join(further, "to", "left").select("v", F.coalesce("further", "to").alias("to")), "mapping")
            steps *= 2
        kept.append(hooks)
    return rows.join(hooks.withColumnRenamed("v", "value"), "value", "left").withColumn("value", F.coalesce("to", "value")).select(*rows.columns)


def rooted(hooks: DataFrame) -> DataFrame:
    """(v, to) with each chain of hooks followed to its end: every pass doubles the steps twice."""
    spark = hooks.sparkSession
    while True:
        with passing(spark) as kept:
            for _ in range(2):
                further = hooks.select(F.col("v").alias("to"), F.col("to").alias("further"))
                hooks = hooks.join(further, "to", "left").select("v", F.coalesce("further", "to").alias("to"), F.coalesce(F.col("further") != F.col("to"), F.lit(False)).alias("moved"))
            hooks = settled(hooks, "hooks")
            kept.append(hooks)
        if hooks.where("moved").isEmpty():
            return hooks.select("v", "to")
        hooks = hooks.select("v", "to")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) of every vertex that an edge names (one with itself too); component is the smallest vertex reached.

    In each round every vertex hooks to its smallest neighbour if that is smaller, hooks are followed
    to their roots, and edges move to the roots of their ends; edges inside one root vanish. All
    vertices but local minima go in a round, and a chain of n takes log2(n) joins.
    """
    spark = edges.sparkSession
    with passing(spark) as kept:
        given = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
        edges = given.where("a <> b")
        found = given.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("component"))
        first = True
        while not edges.isEmpty():
            both = edges.union(edges.select("b", "a"))
            hooks = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")).select("v", F.least("v", "to").alias("to"))
            hooks = rooted(settled(hooks, "hooks"))
            if first:
                alone = found.select("v", F.col("component").alias("to")).join(hooks.select("v"), "v", "left_anti")
                found = hooks.unionByName(alone).withColumnRenamed("to", "component")
                first = False
            else:
                step = hooks.select(F.col("v").alias("component"), F.col("to").alias("next"))
                found = settled(found.join(step, "component", "left").select("v", F.coalesce("next", "component").alias("component")), "components")
            ends = [hooks.select(F.col("v").alias(k), F.col("to").alias(f"{k}_to")) for k in ("a", "b")]
            moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
            edges = settled(moved.where("a <> b").distinct(), "edges")
        found = settled(found, "components")
        kept.append(found)
    return found
