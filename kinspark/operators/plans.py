"""Plans and audits: what to replace, what to bind, what is ready, and why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffing import first_match


def bijection(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Distinct pairs with a state: good, or old_twice / new_twice where an end stands in several."""
    p = pairs.select(old, new).distinct()
    p = p.withColumn("__a", F.count(F.lit(1)).over(Window.partitionBy(old))).withColumn("__b", F.count(F.lit(1)).over(Window.partitionBy(new)))
    return p.withColumn("state", F.when(F.col("__a") > 1, "old_twice").when(F.col("__b") > 1, "new_twice").otherwise("good")).drop("__a", "__b")


def reversed_mapping(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """(new, old) of a mapping's good pairs: those that can be taken back."""
    return bijection(pairs, old, new).where("state = 'good'").select(F.col(new).alias(old), F.col(old).alias(new))


def resources(wanted: DataFrame, provided: DataFrame) -> DataFrame:
    """(path, providers, state) of wanted resources (path, body) against those provided (path, body): missing, ambiguous (several
    providers with different bodies), exact, newline_equivalent (equal once line ends are) or mismatch."""
    plain = lambda c: F.sha2(F.regexp_replace(c, "\\r\\n?", "\n"), 256)
    held = provided.groupBy("path").agg(F.count(F.lit(1)).alias("providers"), F.count_distinct(F.sha2("body", 256)).alias("__bodies"), F.min(F.sha2("body", 256)).alias("__sha"), F.min(plain("body")).alias("__plain"))
    both = wanted.join(held, "path", "left")
    rules = [("missing", F.col("providers").isNull()), ("ambiguous", F.col("__bodies") > 1), ("exact", F.sha2("body", 256) == F.col("__sha")), ("newline_equivalent", plain("body") == F.col("__plain"))]
    return both.select("path", F.coalesce("providers", F.lit(0)).alias("providers"), first_match(rules, "mismatch").alias("state"))


def readiness(reports: DataFrame, blockers: DataFrame) -> DataFrame:
    """(subject, inputs, blockers, ready): a subject is ready if all its reports (subject, input) bind to one input and nothing blocks it."""
    bound = reports.groupBy("subject").agg(F.count_distinct("input").alias("inputs"))
    stopped = blockers.groupBy("subject").agg(F.count(F.lit(1)).alias("blockers"))
    out = bound.join(stopped, "subject", "left").withColumn("blockers", F.coalesce("blockers", F.lit(0)))
    return out.withColumn("ready", (F.col("inputs") == 1) & (F.col("blockers") == 0))


def bound(mentions: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Mentions with what they bind to: one symbol of their name (exact), several (ambiguous) or none."""
    held = symbols.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.min("symbol").alias("symbol"))
    out = mentions.join(held, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    state = F.when(F.col("candidates") == 0, "none").when(F.col("candidates") == 1, "exact").otherwise("ambiguous")
    return out.withColumn("state", state).withColumn("symbol", F.when(F.col("state") == "exact", F.col("symbol")))


def undrifted(rows: DataFrame, key: Sequence[str], evidence: str) -> DataFrame:
    """One row a key with a state: single, repeated (several rows, one evidence) or drifted (evidence that differs; not to be merged)."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(evidence).alias("evidences"))
    return n.withColumn("state", F.when(F.col("evidences") > 1, "drifted").when(F.col("rows") > 1, "repeated").otherwise("single"))


def parity(old: DataFrame, new: DataFrame, key: str, order: str, location: Sequence[str], shape: Column) -> DataFrame:
    """(key, n, state) of the methods of both sides: equal where their sequences are once location columns are dropped."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), shape.alias("s"))))
        out = df.drop(*location).groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.transform(steps, lambda x: x.s).alias("steps"))
        return out.select(key, f"{name}_n", F.sha2(F.array_join("steps", ">"), 256).alias(name))

    both = whole(old, "a").join(whole(new, "b"), key, "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "equal").when(F.col("a_n") == F.col("b_n"), "operands_differ").otherwise("length_differs")
    return both.select(key, F.coalesce("a_n", "b_n").alias("n"), state.alias("state"))


def verified(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) of a release: its manifest (path, size, sha256) against what is found, recomputed: good, size_differs, digest_differs, missing or extra."""
    a = manifest.select("path", F.col("size").alias("__s"), F.col("sha256").alias("__h"), F.lit(True).alias("__a"))
    b = found.select("path", F.col("size").alias("__t"), F.col("sha256").alias("__g"), F.lit(True).alias("__b"))
    rules = [("missing", F.col("__b").isNull()), ("extra", F.col("__a").isNull()), ("size_differs", F.col("__s") != F.col("__t")), ("digest_differs", F.col("__h") != F.col("__g"))]
    return a.join(b, "path", "full_outer").select("path", first_match(rules, "good").alias("state"))
