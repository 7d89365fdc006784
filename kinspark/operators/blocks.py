"""Basic blocks of numbered instructions, their graph, and fixed patterns without jumps into them.

Instructions are numbered over the whole table by ranges (``sequences.numbered``), so an owner with a third of all rows is
split like any other; what lies before a range comes from one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing, settled
from . import sequences, spans

RANGE_ROWS = 100_000
#: Rows that one fold of a pattern goes over.
MATCH_ROWS = 8192
NEXT, BRANCH, GOTO, STOP = "next", "branch", "goto", "stop"


def latest(df: DataFrame, number: str, holds: Column, name: str) -> DataFrame:
    """df with ``name``: the last number up to a row's at which ``holds`` is true. Numbers are gapless, so ranges of them are even."""
    marked = df.withColumn("__r", F.floor(F.col(number) / RANGE_ROWS)).withColumn("__v", F.when(holds, F.col(number)))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("__r").agg(F.max("__v").alias("__v")).select("__r", F.max("__v").over(before).alias("__c"))
    upto = Window.partitionBy("__r").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(F.broadcast(carried), "__r").withColumn(name, F.coalesce(F.max("__v").over(upto), "__c")).drop("__r", "__v", "__c")


def placed(rows: DataFrame, owner: str, order: Sequence[str]) -> DataFrame:
    """rows with number (over all, from 1), first (the number of the owner's first row) and place (in its owner, from 0). ``order`` ends in a unique key."""
    found = settled(sequences.numbered(rows, [owner, *order]), "numbered")
    starts = settled(found.groupBy(owner).agg(F.min("number").alias("first")), "owners")
    begins = found.join(starts.select(F.col("first").alias("number"), F.lit(True).alias("__begins")), "number", "left")
    return settled(latest(begins, "number", F.col("__begins"), "first").withColumn("place", F.col("number") - F.col("first")).drop("__begins"), "placed")


def basic_blocks(rows: DataFrame, owner: str, handlers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks (owner, start, end, n, last) and edges (owner, start, successor, via) of rows of ``placed`` with ``kind``
    (next, branch, goto or stop) and ``target`` (a place of the owner, for branch and goto).

    Leaders are an owner's first row, targets, rows behind a branch, goto or stop, and the starts, ends and handlers
    of ``handlers`` (owner, start_pc, end_pc, handler_pc). A block runs from a leader to before the next one. Its successors are its last row's target,
    the next block where that row can fall through, and (via handler) the handlers that cover a row of it. A target or
    handler outside its owner leads nowhere, and is an edge with a null successor, via bad_target or bad_handler."""
    spark = rows.sparkSession
    with passing(spark) as kept:
        size = rows.groupBy(owner).agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("size"))
        size = settled(size, "sizes")
        jumps = rows.where(F.col("kind").isin(BRANCH, GOTO)).select(owner, "number", (F.col("first") + F.col("target")).alias("to"), "target")
        jumps = jumps.join(size.select(owner, "first", "size"), owner)
        good = F.coalesce((F.col("target") >= 0) & (F.col("target") < F.col("size")), F.lit(False))
        jumps = settled(jumps.select("number", F.when(good, F.col("to")).alias("to")), "jumps")
        leads = [size.select(F.col("first").alias("number")), jumps.where("to IS NOT NULL").select(F.col("to").alias("number")), rows.where(F.col("kind") != NEXT).select((F.col("number") + 1).alias("number"))]
        caught = None
        if handlers is not None:
            own = handlers.join(size, owner)
            ok = (F.col("start_pc") >= 0) & (F.col("start_pc") < F.col("end_pc")) & (F.col("end_pc") <= F.col("size")) & (F.col("handler_pc") >= 0) & (F.col("handler_pc") < F.col("size"))
            at = lambda c: F.col("first") + F.col(c)
            caught = settled(own.select(owner, at("start_pc").alias("from"), at("end_pc").alias("upto"), at("handler_pc").alias("handler"), F.coalesce(ok, F.lit(False)).alias("ok")), "handlers")
            leads += [caught.where("ok").select(F.col(c).alias("number")) for c in ("from", "upto", "handler")]
        leaders = leads[0]
        for more in leads[1:]:
            leaders = leaders.unionByName(more)
        marked = rows.join(leaders.distinct().withColumn("__lead", F.lit(True)), "number", "left")
        inside = settled(latest(marked, "number", F.col("__lead"), "start").drop("__lead"), "inside")
        tail = F.max(F.struct("number", "kind")).alias("tail")
        blocks = inside.groupBy(owner, "first", "start").agg(F.count(F.lit(1)).alias("n"), tail)
        blocks = settled(blocks.select(owner, "first", "start", "n", F.col("tail.number").alias("last"), F.col("tail.kind").alias("kind")), "blocks")
        behind = blocks.select(F.col("start").alias("to"), F.col("first").alias("of"))
        falls = blocks.where(F.col("kind").isin(NEXT, BRANCH)).withColumn("to", F.col("last") + 1).join(behind, "to").where("of = first")
        jumped = blocks.join(jumps.withColumnRenamed("number", "last"), "last")
        via = F.when(F.col("to").isNull(), "bad_target").otherwise("jump")
        edges = falls.select(owner, "first", "start", "to", F.lit("next").alias("via")).unionByName(jumped.select(owner, "first", "start", "to", via.alias("via")))
        if caught is not None:
            heads = blocks.select("start", F.col("first"), (F.col("last") + 1).alias("__stop"), F.col("start").alias("__head"))
            covered = spans.points_in_spans(heads.withColumnRenamed("start", "block"), caught.where("ok").select(owner, "from", "upto", "handler"), [], "__head", "from", "upto")
            edges = edges.unionByName(covered.select(owner, "first", F.col("block").alias("start"), F.col("handler").alias("to"), F.lit("handler").alias("via")))
            bad = caught.where("NOT ok").join(size.select(owner, "first"), owner)
            edges = edges.unionByName(bad.select(owner, "first", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("to"), F.lit("bad_handler").alias("via")))
        edges = settled(edges.distinct().select(owner, (F.col("start") - F.col("first")).alias("start"), (F.col("to") - F.col("first")).alias("successor"), "via"), "block-edges")
        kept += [blocks, edges]
    return blocks.select(owner, (F.col("start") - F.col("first")).alias("start"), (F.col("last") - F.col("first") + 1).alias("end"), "n", F.col("kind").alias("last")), edges


def covered(blocks: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """(owner, blocks, rows, whole): whether an owner's blocks hold each of its rows once."""
    held = blocks.groupBy(owner).agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("__n"), F.sum(F.col("end") - F.col("start")).alias("__len"), F.min("start").alias("__low"), F.max("end").alias("__high"))
    n = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("rows"))
    whole = (F.col("__n") == F.col("rows")) & (F.col("__len") == F.col("rows")) & (F.col("__low") == 0) & (F.col("__high") == F.col("rows"))
    return n.join(held, owner, "left").select(owner, F.coalesce("blocks", F.lit(0)).alias("blocks"), "rows", F.coalesce(whole, F.lit(False)).alias("whole"))


def matched(rows: DataFrame, owner: str, pattern: Sequence[Column]) -> DataFrame:
    """(owner, first, last): places of rows of ``placed`` where every step of a pattern holds in turn, one condition a step.

    Bit k of a row's mask says whether the row may be step k. Rows go to chunks of MATCH_ROWS numbers, each with the steps before it, and
    one fold a chunk carries the set of open matches as bits: shifted by a step, joined by a new one, and cut by the mask.
    A match never spans two owners: an owner's first row closes what is open."""
    m = len(pattern)
    mask = F.lit(0).cast("long")
    for k, holds in enumerate(pattern):
        mask = mask + F.when(holds, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    chunk = F.floor(F.col("number") / MATCH_ROWS)
    tail = F.pmod(F.col("number"), F.lit(MATCH_ROWS)) > MATCH_ROWS - m
    masks = rows.select("number", mask.alias("mask"), (F.col("place") == 0).alias("opens"), F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("chunk"))
    # Rows that no step takes only close what is open: the row's number tells whether any were between.
    masks = masks.where("mask > 0")
    each = masks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("number", "mask", "opens"))).alias("rows"))
    start = F.struct(F.lit(-1).cast("long").alias("number"), F.lit(0).cast("long").alias("open"), F.array().cast("array<bigint>").alias("ends"))

    def step(s: Column, r: Column) -> Column:
        goes_on = (r["number"] == s["number"] + 1) & ~r["opens"]
        open_ = F.when(goes_on, F.shiftleft(s["open"], 1)).otherwise(F.lit(0).cast("long")).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(r["mask"])
        ends = F.when(open_ >= (1 << m - 1), F.concat(s["ends"], F.array(r["number"]))).otherwise(s["ends"])
        return F.struct(r["number"].alias("number"), open_.alias("open"), ends.alias("ends"))

    ends = each.select("chunk", F.explode(F.aggregate("rows", start, step)["ends"]).alias("number"))
    ends = ends.where(F.floor(F.col("number") / MATCH_ROWS) == F.col("chunk")).select("number")
    return rows.select("number", owner, "place").join(ends, "number").select(owner, (F.col("place") - (m - 1)).alias("first"), F.col("place").alias("last"))


def stabbed(matches: DataFrame, owner: str, targets: DataFrame) -> DataFrame:
    """(owner, first, last, entries) of every match: how many of ``targets`` (owner, target) lead behind its first place."""
    inner = matches.select(owner, "first", "last", (F.col("first") + 1).alias("__b"), (F.col("last") + 1).alias("__e"))
    hits = spans.points_in_spans(targets.select(owner, F.col("target").alias("__p")), inner, [owner], "__p", "__b", "__e")
    n = hits.groupBy(owner, "first", "last").agg(F.count(F.lit(1)).alias("entries"))
    return matches.join(n, [owner, "first", "last"], "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
