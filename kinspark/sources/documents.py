"""Structured files as tables, and tables as files that nothing overwrites."""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import passing, release, settled

POM = "groupId string, artifactId string, version string, scope string, optional string"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def strict(value: Column) -> tuple[Column, Column]:
    """The document and the error of a JSON text: one that is no JSON, or names a member of an object twice, has
    an error and no document."""
    good = F.try_parse_json(value).isNotNull()
    return F.when(good, value), F.when(~good, F.lit("not JSON, or a member twice"))


def strict_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, error): JSON files, one document each, by ``strict``."""
    document, error = strict(F.col("value"))
    return _whole(spark, path).select("path", document.alias("document"), error.alias("error"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of ``key=value`` and ``key: value`` lines; comments and blank lines are left out, and of a key's
    lines in one file the last counts."""
    text = _whole(spark, path)
    line = text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("trim(line) <> '' AND NOT ltrim(line) RLIKE '^[#!]'")
    pair = F.regexp_extract("line", r"^\s*([^=:\s]+)\s*[=:\s]\s*(.*?)\s*$", 1), F.regexp_extract("line", r"^\s*([^=:\s]+)\s*[=:\s]\s*(.*?)\s*$", 2)
    found = line.select("path", "at", pair[0].alias("key"), pair[1].alias("value")).where("key <> ''")
    return found.groupBy("path", "key").agg(F.max_by("value", "at").alias("value"))


def pom_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Dependencies of POM files by Spark's XML reader: coordinates, scope and whether optional."""
    return spark.read.format("xml").option("rowTag", "dependency").option("ignoreNamespace", "true").schema(POM).load(path)


def interpolated(rows: DataFrame, most: int = 50) -> DataFrame:
    """(owner, key, value, state, round) of properties (owner, key, value) with the references ``${key}`` in their values replaced by
    the same owner's properties, which may have references too.

    A property without references is resolved in round 0, and one all of whose references are in the round after the last of
    them. One that refers to a key that its owner has not, or to such a property, is unknown; what is left when no more
    resolves stands on a cycle. Both keep their values as they were. Only the properties resolved last are joined with those that
    refer to them; more than ``most`` rounds are an error. Of a key's rows in one owner the greatest value counts."""
    spark = rows.sparkSession
    reference, piece = r"\$\{([^}]*)\}", r"\$\{[^}]*\}|[^$]+|\$"
    with passing(spark) as kept:
        given = rows.dropna().groupBy("owner", "key").agg(F.max("value").alias("value"))
        given = settled(given.withColumn("refs", F.array_distinct(F.regexp_extract_all("value", F.lit(reference), 1))), "properties")
        refs = given.select("owner", "key", F.explode("refs").alias("ref"))
        own = given.select("owner", F.col("key").alias("ref"))
        fresh = settled(given.where("size(refs) = 0").select("owner", "key", "value", F.lit(0).alias("round")), "resolved")
        done, n = [fresh], 0
        # What each open property still waits for, and what it has got so far.
        waits = settled(given.where("size(refs) > 0").select("owner", "key", "value", F.size("refs").cast("long").alias("left"), F.expr("map_from_arrays(array(''), array(''))").alias("got")), "waiting")
        refs = settled(refs, "references")
        while not fresh.isEmpty():
            n += 1
            if n > most:
                raise ValueError(f"properties still resolve after {most} rounds")
            met = refs.join(fresh.select("owner", F.col("key").alias("ref"), F.col("value").alias("said")), ["owner", "ref"])
            met = met.groupBy("owner", "key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("${"), "ref", F.lit("}")), "said"))).alias("more"), F.count(F.lit(1)).alias("n"))
            now = waits.join(met, ["owner", "key"], "left").withColumn("left", F.col("left") - F.coalesce("n", F.lit(0)))
            now = settled(now.withColumn("got", F.when(F.col("more").isNull(), F.col("got")).otherwise(F.map_concat("got", "more"))).drop("more", "n"), "waiting")
            value = F.array_join(F.transform(F.regexp_extract_all("value", F.lit(piece), 0), lambda p: F.coalesce(F.element_at("got", p), p)), "")
            fresh = settled(now.where("left = 0").select("owner", "key", value.alias("value"), F.lit(n).alias("round")), "resolved")
            release(waits)
            waits = settled(now.where("left > 0"), "waiting")
            release(now)
            done.append(fresh)
        bad = settled(refs.join(own, ["owner", "ref"], "left_anti").select("owner", "key").distinct(), "unknown")
        unknown, n = [bad], 0
        while not bad.isEmpty():
            step = refs.join(bad.select("owner", F.col("key").alias("ref")), ["owner", "ref"]).select("owner", "key").distinct()
            for before in unknown:
                step = step.join(before, ["owner", "key"], "left_anti")
            bad = settled(step, "unknown")
            unknown.append(bad)
            if len(unknown) > 4:
                unknown = [settled(_all(unknown), "unknown")]
        found = _all(done).withColumn("state", F.lit("resolved"))
        rest = waits.join(_all(unknown).withColumn("state", F.lit("unknown")), ["owner", "key"], "left")
        rest = rest.select("owner", "key", "value", F.lit(-1).alias("round"), F.coalesce("state", F.lit("cycle")).alias("state"))
        out = settled(found.unionByName(rest).select("owner", "key", "value", "state", "round"), "interpolated")
        kept.append(out)
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def pom_authority(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, field, value, state) of the coordinates of POM files' dependencies, with references replaced by the
    ``<properties>`` of the same file; place numbers the dependencies of a file as they stand."""
    texts = _whole(spark, path)
    bare = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    block = F.regexp_extract(bare, r"(?s)<properties>(.*?)</properties>", 1)
    pairs = texts.select(F.col("path").alias("owner"), F.explode(F.regexp_extract_all(block, F.lit(r"<([\w.-]+)>[^<]*</\1>"), 0)).alias("p"))
    held = pairs.select("owner", F.regexp_extract("p", r"<([\w.-]+)>", 1).alias("key"), F.trim(F.regexp_extract("p", ">([^<]*)<", 1)).alias("value"))
    each = texts.select(F.col("path").alias("owner"), F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("place", "d"))
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.regexp_extract("d", f"<{f}>([^<]*)</{f}>", 1)).alias("value")) for f in ("groupId", "artifactId", "version"))))
    wanted = each.select("owner", "place", fields.alias("f")).select("owner", F.concat(F.lit("dependency:"), F.col("place").cast("string"), F.lit(":"), "f.field").alias("key"), "f.value").where("value <> ''")
    found = interpolated(held.unionByName(wanted)).where(F.col("key").startswith("dependency:"))
    parts = F.split("key", ":")
    return found.select(F.col("owner").alias("path"), parts[1].cast("int").alias("place"), parts[2].alias("field"), "value", "state")


def source_tree(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """(path, relative, size, sha256) of the files of a tree whose names fit; bytes stay where they are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://")
    relative = F.expr("substring(path, instr(path, root) + char_length(root) + 1)")
    return found.withColumn("root", F.lit(root)).select("path", relative.alias("relative"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def canonical(*columns: str) -> Column:
    """A row as JSON with its members in the order of their names and nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_new(df: DataFrame, path: str, inputs: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """Write rows as canonical JSON lines to a folder that must not exist and must not hold, or lie in, an input. With an
    order (that ends in a unique key), parts and the lines in them follow it."""
    own = path.rstrip("/") + "/"
    if any(own.startswith(i.rstrip("/") + "/") or i.startswith(own) for i in inputs):
        raise ValueError(f"{path} would overwrite an input")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select(canonical(*df.columns).alias("value")).write.mode("errorifexists").text(path)


def scanned(rows: DataFrame, column: str, command: list[str], fields: list[str]) -> DataFrame:
    """Rows of an external scanner: ``command`` runs once for each batch of values, gets a value a line, and writes lines of
    tab-separated fields. A scanner that fails ends its task, which is tried again."""

    def run(batches):
        for batch in batches:
            given = "".join(f"{v}\n" for v in batch.column(column).to_pylist() if v is not None)
            said = subprocess.run(command, input=given, capture_output=True, text=True, check=True).stdout
            found = [line.split("\t") for line in said.splitlines()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in found], pa.string()) for k in range(len(fields))], fields)

    return rows.select(column).mapInArrow(run, ", ".join(f"{f} string" for f in fields))
