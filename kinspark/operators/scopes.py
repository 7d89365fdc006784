"""Which class a name means where it is used, by every channel through which it could be visible, and which names collide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import graph

#: Channels by falling precedence: what an earlier one finds hides what later ones do.
CHANNELS = ("qualified", "nested", "explicit_import", "same_package", "wildcard_import", "base")


def visible(mentions: DataFrame, classes: DataFrame, units: DataFrame, imports: DataFrame, wildcards: DataFrame, base: str) -> DataFrame:
    """(unit, token, channel, name): the classes that each distinct mention (unit, token; parts of a token between ".") could mean.

    classes: (name), packages before "/" and nested classes behind "$". units: (unit, package, top), the class that a unit's are
    nested in. imports: (unit, target) with "." between parts, visible under the last one. wildcards: (unit, package). base: the package that all see.
    Every channel spells the names that it could mean and meets the classes by equality."""
    asked = mentions.select("unit", "token").where("token <> ''").distinct().withColumn("parts", F.split("token", r"\."))
    inner = F.replace("token", F.lit("."), F.lit("$"))
    cut = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.when(k < F.size("parts"), F.concat(F.lit("/"), F.array_join(F.slice("parts", k + 1, F.size("parts")), "$"))).otherwise(F.lit(""))))
    spelled = [asked.select("unit", "token", F.lit(0).alias("rank"), F.explode(F.array_distinct(F.concat(F.array(F.array_join("parts", "/")), cut))).alias("name"))]
    within = asked.join(units, "unit")
    spelled.append(within.select("unit", "token", F.lit(1).alias("rank"), F.concat("top", F.lit("$"), inner).alias("name")))
    taken = imports.select("unit", F.replace("target", F.lit("."), F.lit("/")).alias("target"), F.element_at(F.split("target", r"\."), -1).alias("head")).distinct()
    rest = F.when(F.size("parts") > 1, F.concat(F.lit("$"), F.array_join(F.slice("parts", 2, F.size("parts")), "$"))).otherwise(F.lit(""))
    spelled.append(asked.withColumn("head", F.col("parts")[0]).join(taken, ["unit", "head"]).select("unit", "token", F.lit(2).alias("rank"), F.concat("target", rest).alias("name")))
    spelled.append(within.select("unit", "token", F.lit(3).alias("rank"), F.concat("package", F.lit("/"), inner).alias("name")))
    starred = wildcards.select("unit", F.replace("package", F.lit("."), F.lit("/")).alias("of")).distinct()
    spelled.append(asked.join(starred, "unit").select("unit", "token", F.lit(4).alias("rank"), F.concat("of", F.lit("/"), inner).alias("name")))
    spelled.append(asked.select("unit", "token", F.lit(5).alias("rank"), F.concat(F.lit(base + "/"), inner).alias("name")))
    every = spelled[0]
    for more in spelled[1:]:
        every = every.unionByName(more)
    found = every.where("name IS NOT NULL").distinct().join(classes.select("name").distinct(), "name", "left_semi")
    channel = F.get(F.array(*map(F.lit, CHANNELS)), F.col("rank"))
    return found.select("unit", "token", "rank", channel.alias("channel"), "name")


def triaged(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(unit, token, state, name, channels, candidates, hidden) of every distinct mention, from the rows of ``visible``.

    The channel of the highest precedence decides: one class there is exact, several are ambiguous (no name then), and other classes
    further down are hidden by it. Without candidates the name is missing."""
    own = Window.partitionBy("unit", "token")
    marked = candidates.withColumn("best", F.min("rank").over(own)).withColumn("wins", F.col("rank") == F.col("best"))
    each = marked.groupBy("unit", "token", "name").agg(F.max("wins").alias("wins"))
    counts = each.groupBy("unit", "token").agg(F.count_if("wins").alias("candidates"), F.count_if(~F.col("wins")).alias("hidden"), F.min(F.when(F.col("wins"), F.col("name"))).alias("name"))
    kinds = marked.groupBy("unit", "token").agg(F.array_sort(F.collect_set(F.struct("rank", "channel"))).alias("k"))
    channels = F.array_join(F.transform("k", lambda x: x["channel"]), ",")
    out = mentions.select("unit", "token").distinct().join(counts, ["unit", "token"], "left").join(kinds.select("unit", "token", channels.alias("channels")), ["unit", "token"], "left")
    state = F.when(F.col("candidates").isNull(), "missing").when(F.col("candidates") == 1, "exact").otherwise("ambiguous")
    return out.select("unit", "token", state.alias("state"), F.when(F.col("candidates") == 1, F.col("name")).alias("name"), F.coalesce("channels", F.lit("")).alias("channels"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("hidden", F.lit(0)).alias("hidden"))


def colliding(names: DataFrame) -> DataFrame:
    """(name, component, size, relation) of the distinct names (column ``name``; parts between "/") that collide with another: equal but for
    case, or one the folder of the other. Names that collide hang together in a component, known by its smallest name; the relation
    is folder (of another), inside (another), both, or case (neither). Every name meets its own folders by equality."""
    keyed = settled(names.select("name").dropna().distinct().withColumn("key", F.lower("name")), "names")
    parts = F.split("key", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.when(k < F.size(parts), F.array_join(F.slice(parts, 1, k), "/")))
    above = keyed.select(F.col("name").alias("a"), F.explode(F.array_compact(folders)).alias("key")).join(keyed.withColumnRenamed("name", "b"), "key").select("a", "b", F.lit(True).alias("inside"))
    first = keyed.groupBy("key").agg(F.min("name").alias("b"))
    case = keyed.join(first, "key").where("name <> b").select(F.col("name").alias("a"), "b", F.lit(False).alias("inside"))
    links = settled(above.unionByName(case), "collisions")
    found = graph.components(links.select("a", "b")).withColumnRenamed("v", "name")
    ends = links.where("inside").select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("f")), F.struct(F.col("b").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("f")))).alias("e")).select("e.*")
    sides = ends.groupBy("name").agg(F.max("i").alias("i"), F.max("f").alias("f"))
    relation = F.when((F.col("i") == 1) & (F.col("f") == 1), "both").when(F.col("i") == 1, "inside").when(F.col("f") == 1, "folder").otherwise("case")
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "component").join(sides, "name", "left").select("name", "component", "size", relation.alias("relation"))
