"""Alignment of token sequences by chains of anchors.

Tokens that stand once on either side of a pair are its anchors, found by an equi-join. The longest chain of anchors that rise on both sides
cuts the pair into gaps, and each gap is a pair of its own in the next round, in which more tokens may stand once. Rounds end when
no gap has anchors. No two sequences are compared token by token.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import passing, settled, ship


def longest_rise(values: np.ndarray) -> np.ndarray:
    """The places of the longest strictly rising subsequence; of several, the one whose last, second last, ... places have the smallest values."""
    ends: list[int] = []
    at: list[int] = []
    before = np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        k = bisect_left(ends, v)
        if k:
            before[i] = at[k - 1]
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1], np.int64)


def anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, gap, l, r): places of the tokens that stand once in a gap on both sides; sides are (pair, gap, place, token)."""
    once = lambda df, name: df.groupBy("pair", "gap", "token").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias(name)).where("n = 1").drop("n")
    return once(left, "l").join(once(right, "r"), ["pair", "gap", "token"]).select("pair", "gap", "l", "r")


def chained(found: DataFrame) -> DataFrame:
    """The rows of ``anchors`` that are on their gap's chain. A gap's anchors are two numbers each, in one task."""
    kind = found.schema["pair"].dataType.simpleString()

    def run(batches):
        kept: pa.Table | None = None

        def chains(t: pa.Table):
            pair, gap = t.column("pair").to_pylist(), t.column("gap").to_pylist()
            keys = list(zip(pair, gap, strict=True))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                yield s + longest_rise(t.column("r").slice(s, e - s).to_numpy())

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([kept, t]).combine_chunks() if kept is not None else t
            if not t.num_rows:
                continue
            last = (t.column("pair")[-1].as_py(), t.column("gap")[-1].as_py())
            cut = t.num_rows
            pair, gap = t.column("pair").to_pylist(), t.column("gap").to_pylist()
            while cut and (pair[cut - 1], gap[cut - 1]) == last:
                cut -= 1
            if cut:
                whole = t.slice(0, cut)
                yield from whole.take(pa.array(np.concatenate(list(chains(whole))))).to_batches()
            kept = t.slice(cut)
        if kept is not None and kept.num_rows:
            yield from kept.take(pa.array(np.concatenate(list(chains(kept))))).to_batches()

    ship(found.sparkSession)
    rows = found.select("pair", *(F.col(c).cast("long") for c in ("gap", "l", "r")))
    return rows.repartition("pair", "gap").sortWithinPartitions("pair", "gap", "l").mapInArrow(run, f"pair {kind}, gap long, l long, r long")


def aligned(left: DataFrame, right: DataFrame, most: int = 20) -> DataFrame:
    """(pair, l, r, round): which places of the two sides of each pair are aligned, rising on both; sides are (pair, place, token).

    Anchors that both lie behind the same two neighbours on the chain are in one gap. More than ``most`` rounds with anchors stop there: what is
    left in the gaps stays unaligned."""
    spark = left.sparkSession
    with passing(spark) as kept:
        sides = [settled(df.select("pair", F.lit(0).cast("long").alias("gap"), F.col("place").cast("long"), "token"), "tokens") for df in (left, right)]
        found, n = [], 0
        while n < most:
            n += 1
            chain = settled(chained(anchors(*sides)), "chain")
            if n > 1 and chain.isEmpty():
                break
            found.append(chain.select("pair", "l", "r", F.lit(n).alias("round")))
            every = _all(found)
            # A token's gap is the number of chain places before it on its own side; those are the same on both, as chains rise.
            sides = [settled(_gapped(side, every.select("pair", F.col(c).alias("place"))), "tokens") for side, c in zip(sides, "lr", strict=True)]
        out = settled(_all(found), "aligned")
        kept.append(out)
    return out


def _gapped(side: DataFrame, places: DataFrame) -> DataFrame:
    marks = side.select("pair", "place", "token").unionByName(places.select("pair", "place", F.lit(None).cast("string").alias("token")))
    upto = Window.partitionBy("pair").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.count_if(F.col("token").isNull()).over(upto)
    taken = F.max(F.col("token").isNull()).over(Window.partitionBy("pair", "place"))
    return marks.withColumn("gap", gap).withColumn("taken", taken).where("NOT taken").select("pair", "gap", "place", "token")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
