"""Assertions over data: expectations, ledgers and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How an actual value is held against the expected one.
COMPARE = {"eq": lambda a, e: a == e, "gte": lambda a, e: a >= e, "lte": lambda a, e: a <= e}


def expectations(df: DataFrame, checks: Sequence[tuple[str, Column, str, int]], known: Sequence[str] | None = None) -> DataFrame:
    """(name, comparator, expected, actual, holds) of aggregates over one table, in one pass. Unknown
    comparators, and names outside ``known`` if that is given, are rejected before anything runs."""
    if odd := sorted({c for _, _, c, _ in checks if c not in COMPARE} | {n for n, *_ in checks if known is not None and n not in known}):
        raise ValueError(f"unknown expectations: {', '.join(odd)}")
    row = df.agg(*(actual.cast("long").alias(name) for name, actual, _, _ in checks))
    made = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("comparator"), F.lit(e).cast("long").alias("expected"), F.col(n).alias("actual"), COMPARE[c](F.col(n), F.lit(e)).alias("holds")) for n, _, c, e in checks))
    return row.select(F.inline(made))


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(side, key, n) of ends that stand in more than one pair; must be empty."""
    out = None
    for side, c in (("left", left), ("right", right)):
        own = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(side).alias("side"), F.col(c).cast("string").alias("key"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def pinned(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, state) of inputs (name, digest) pinned before a scan and read again after it: held, drifted, gone or unpinned."""
    both = before.select("name", F.col("digest").alias("__a")).join(after.select("name", F.col("digest").alias("__b")), "name", "full_outer")
    state = F.when(F.col("__a").isNull(), "unpinned").when(F.col("__b").isNull(), "gone").when(F.col("__a") == F.col("__b"), "held").otherwise("drifted")
    return both.select("name", state.alias("state"))


def authenticated(rows: DataFrame, row_id: str, columns: Sequence[str], prefix: str = "", length: int = 20) -> DataFrame:
    """Rows with ``authentic``: whether the id is the prefix and the first ``length`` hex digits of the body's SHA-256."""
    return rows.withColumn("authentic", F.col(row_id).eqNullSafe(F.concat(F.lit(prefix), body_digest(columns, length))))


def body_digest(columns: Sequence[str], length: int = 64) -> Column:
    """The first hex digits of the SHA-256 of the columns in the given order, each with its length before it, so that no two bodies spell alike."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def required(violations: DataFrame, what: str) -> None:
    """Raise with the first rows of a table of violations that must be empty."""
    if rows := violations.take(5):
        raise ValueError(f"{what}: {'; '.join(str(r.asDict()) for r in rows)}")


def ledger(df: DataFrame, outcome: Column) -> DataFrame:
    """(outcome, n, total, balanced): every row has one outcome, and the counts add up."""
    n = df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    summed = n.agg(F.sum("n").alias("__sum"))
    both = total.join(F.broadcast(summed))  # a row each
    return n.join(F.broadcast(both)).select("outcome", "n", "total", (F.col("total") == F.col("__sum")).alias("balanced"))


def stable_digest(df: DataFrame, columns: Sequence[str], bits: int = 12) -> DataFrame:
    """One digest of a table whatever the order of its rows: SHA-256 of each row, of the sorted digests of each of
    2**bits buckets (by their first hex digits), and of the sorted digests of the buckets."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d")
    buckets = df.select(F.sha2(line, 256).alias("d")).groupBy(F.substring("d", 1, -(-bits // 4)).alias("bucket")).agg(joined(), F.count(F.lit(1)).alias("n"))
    return buckets.agg(joined(), F.sum("n").alias("n")).withColumnRenamed("d", "digest")


def digest_of(df: DataFrame, *part: str) -> DataFrame:
    """(part, n, digest) of a table, or of each part of it: whatever the order of rows, with repeated ones counted. Every row's SHA-256 is
    cut into four numbers, which are added up, so rows are combined before they are shuffled and no list is made."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    cut = [F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)").alias(f"__{k}") for k in range(4)]
    sums = df.select(*part, *cut).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"__{k}").alias(f"__{k}") for k in range(4)))
    return sums.select(*part, "n", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"__{k}"), F.lit(0)).cast("string") for k in range(4))), 256).alias("digest"))


def frozen(df: DataFrame, path: str) -> DataFrame:
    """The rows of df from a table at ``path`` that is written once. Where one stands already it is not touched: it is read if it
    has the same digest, and else this is an error. The digest is written last, so a table without one was never finished; that is an error too."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration())
    own = digest_of(df).first()
    if there.exists(where):
        if not there.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/digest")):
            raise ValueError(f"{path} was never finished")
        held = spark.read.json(f"{path}/digest").first()
        if (held["n"], held["digest"]) != (own["n"], own["digest"]):
            raise ValueError(f"{path} is frozen with other rows")
    else:
        df.write.mode("errorifexists").parquet(f"{path}/rows")
        spark.createDataFrame([(own["n"], own["digest"])], "n long, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/digest")
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
