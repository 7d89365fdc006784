"""Hard negatives by k-means inverted lists and bounds on inner products.

1. Centroids come from a sample of about SAMPLE_ROWS rows, chosen by a hash of id and vector. Every
   row goes to its nearest centroid's list, and each list stores its radius, the largest distance of its
   rows from the centroid. Lists are cut into blocks of about BLOCK_ROWS rows.
2. By Cauchy-Schwarz, the scores of an anchor a with a list of centroid m and radius r lie within
   a.m - |a| r and a.m + |a| r. A search has windows of scores for each anchor; lists outside all of them
   are skipped. The FIRST lists by upper bound are visited, which gives every window its kth score so far;
   then all lists whose upper bound does not fall strictly below a window's kth score are, so results
   are exact, ties by smaller vec_id included.
3. Positives are such a search among rows of the anchor's label, with one window without ends. Negatives are
   one among the other labels, with a window for each positive.

A visit is a row (anchor, block) with the anchor's vector. Blocks and visits meet in a shuffle, in work items of one
block and PART_ANCHORS anchors or so, and the scores of an item are one matrix product: in float32 or float64
where norms prove that it is exact, else in int64. The driver holds the centroids and a few numbers a list.

Defined results: rows with a null label, vec_id or vector or a null or non-finite component take no part. Missing
components of shorter vectors count as zero, and those beyond vectors.LIMIT as that. Rows that repeat a vec_id each take
part, but of anchors the first by label and vector is one, and rows with an anchor's own id are never found
for it. An anchor without positives, or a positive without negatives, has no rows; nor has an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ragged import mix
from .scratch import partitions, passing, settled, ship
from .vectors import matrix, packed, widest

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
SAMPLE_ROWS, MOST_LISTS, STEPS = 8192, 1024, 8
BLOCK_ROWS, PART_ANCHORS, FIRST = 512, 4096, 4
CHUNK = 256
ENDS = 1 << 62
ANCHOR = "anchor long, label int, v binary, lows array<long>, highs array<long>, raised array<long>"


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of the sample's distinct rows by Lloyd's steps; a list that loses all its rows keeps its centroid."""
    x = sample.astype(np.float64)
    out = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(STEPS):
        own = _nearest(x, out)
        n = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def _nearest(x: np.ndarray, middles: np.ndarray) -> np.ndarray:
    return ((middles**2).sum(1) - 2 * (x @ middles.T)).argmin(1)


@dataclass(frozen=True)
class Index:
    """Of each list: its centroid, radius (-1 where it is empty) and number of blocks; and the number of components."""

    width: int
    middles: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray


def indexed(rows: DataFrame, lists: int | None = None) -> tuple[DataFrame, Index] | None:
    """Packed rows (vec_id, label, v; settled) with their list and block, and the lists; None if there are no rows. The number of lists grows
    with the root of the rows, to MOST_LISTS at most."""
    n, width = widest(rows)
    if not n:
        return None
    width = max(width, 1)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) < SAMPLE_ROWS).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(2 * SAMPLE_ROWS)
    sample = matrix([bytes(r.v) for r in drawn.collect()] or [b""], width)
    middles = centroids(sample, lists or min(MOST_LISTS, max(1, int(n**0.5) // 2)))

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            own = _nearest(x, middles)
            away = np.sqrt(((x - middles[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array(own.astype(np.int32)), pa.array(away)], ["vec_id", "label", "v", "list", "away"])

    filed = settled(rows.mapInArrow(run, "vec_id long, label int, v binary, list int, away double"), "lists")
    found = filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    radii, blocks = np.full(len(middles), -1.0), np.zeros(len(middles), np.int64)
    for r in found:
        radii[r.list], blocks[r.list] = r.radius, -(-r.n // BLOCK_ROWS)
    number = F.get(F.array(*(F.lit(int(b)) for b in blocks)), F.col("list"))
    return filed.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), number).cast("int")).drop("away"), Index(width, middles, radii, blocks)


def bounds(index: Index, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score that rows of each list can have with each anchor; rounding only widens them."""
    a = a.astype(np.float64)
    size = np.sqrt((a**2).sum(1))[:, None]
    middle, reach = a @ index.middles.T, size * index.radii
    slack = 1e-9 * (size * np.sqrt((index.middles**2).sum(1)) + np.abs(reach)) + 1e-6
    empty = index.radii < 0
    low, high = middle - reach - slack, middle + reach + slack
    low[:, empty], high[:, empty] = np.inf, -np.inf
    return low, high


def open_lists(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which lists may hold scores of any window of each anchor."""
    out = np.zeros(low.shape, bool)
    for k in range(lows.shape[1]):
        lo, hi = lows[:, k, None].astype(np.float64), highs[:, k, None].astype(np.float64)
        out |= (lo <= hi) & (high >= lo) & (low <= hi)
    return out


def visits_of(index: Index, batch: pa.RecordBatch, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """(anchor's place in the batch, list): the first lists by upper bound, or all later ones that are still open."""
    if not batch.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = bounds(index, matrix(batch.column("v").to_pylist(), index.width))
    lows, highs, raised = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("lows", "highs", "raised"))
    wanted = open_lists(low, high, lows, highs)
    order = np.argsort(np.where(wanted, -high, np.inf), axis=1, kind="stable")[:, :FIRST]
    first = np.zeros(wanted.shape, bool)
    np.put_along_axis(first, order, True, 1)
    return np.nonzero(open_lists(low, high, raised, highs) & ~first if later else wanted & first)


def visited(rows: DataFrame, index: Index, anchors: DataFrame, later: bool) -> DataFrame:
    """A row for each anchor and block to visit, with the part of the block's anchors that it is in. The number of parts is
    that of the list's visits, counted first."""

    def count(batches):
        n = np.zeros(len(index.middles), np.int64)
        for batch in batches:
            n += np.bincount(visits_of(index, batch, later)[1], minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own])], ["list", "n"])

    parts = np.zeros(len(index.middles), np.int64)
    for r in anchors.mapInArrow(count, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        parts[r.list] = -(-r.n // PART_ANCHORS)

    def run(batches):
        for batch in batches:
            place, lists = visits_of(index, batch, later)
            times = index.blocks[lists]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place, lists = np.repeat(place, times), np.repeat(lists, times)
            for i in range(0, len(place), CHUNK * 16):
                p, own = place[i : i + CHUNK * 16], lists[i : i + CHUNK * 16]
                taken = batch.take(pa.array(p))
                part = mix(np.asarray(batch.column("anchor"))[p].astype(np.uint64)) % parts[own].astype(np.uint64)
                keys = [own.astype(np.int32), block[i : i + CHUNK * 16].astype(np.int32), part.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *(taken.column(c) for c in ("anchor", "label", "v", "raised", "highs"))], ["list", "block", "part", "vec_id", "label", "v", "lows", "highs"])

    asked = anchors.mapInArrow(run, "list int, block int, part int, vec_id long, label int, v binary, lows array<long>, highs array<long>")
    times = F.get(F.array(*(F.lit(int(p)) for p in parts)), F.col("list"))
    held = rows.withColumn("times", times).where("times > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
    nothing = F.lit(None).cast("array<long>")
    held = held.select("list", "block", "part", F.lit(0).alias("kind"), "vec_id", "label", "v", nothing.alias("lows"), nothing.alias("highs"))
    both = held.unionByName(asked.withColumn("kind", F.lit(1)))
    keys = ["list", "block", "part"]
    return both.repartition(partitions(both.sparkSession), *keys).sortWithinPartitions(*keys, "kind", "vec_id")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int64 rows, exact: every partial sum is an integer of at most |a| |b|."""
    most = float(np.sqrt((a.astype(np.float64) ** 2).sum(1).max() * (b.astype(np.float64) ** 2).sum(1).max())) * 1.001
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def best_in_block(ids, labels, vectors, asked: dict, same: bool, k: int):
    """(anchor, window, score, vec_id) of the k best rows of a block (ascending ids) in each window of each anchor."""
    out = []
    for i in range(0, len(asked["anchor"]), CHUNK):
        anchor, label, a, lows, highs = (asked[c][i : i + CHUNK] for c in ("anchor", "label", "v", "lows", "highs"))
        scores = products(a, vectors)
        none = scores.dtype.type(-ENDS)
        most = 2**60 if scores.dtype == np.int64 else 2**53 if scores.dtype == np.float64 else 2**24
        fits = (label[:, None] == labels) == same
        fits &= anchor[:, None] != ids
        scores[~fits] = none
        at = np.arange(len(anchor))
        for w in range(lows.shape[1]):
            lo, hi = (np.clip(x[:, w], -most, most).astype(scores.dtype)[:, None] for x in (lows, highs))
            left = np.where((scores >= lo) & (scores <= hi), scores, none)
            for _ in range(min(k, len(ids))):
                best = left.argmax(1)  # the first of equal scores: the smallest id
                score = left[at, best]
                hit = score > none
                if not hit.any():
                    break
                out.append((anchor[hit], np.full(hit.sum(), w), score[hit].astype(np.int64), ids[best[hit]]))
                left[at, best] = none
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def items(batches, keys: list[str]):
    """Tables of rows with equal keys; batches come sorted by keys."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        change = np.zeros(t.num_rows, bool)
        for c in keys:
            x = t.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield t.slice(s, e - s)
        kept = t.slice(cuts[-1]).combine_chunks()
    if kept is not None:
        yield kept


def searched(filed: DataFrame, index: Index, anchors: DataFrame, same: bool, k: int, later: bool) -> DataFrame:
    """(anchor, window, score, vec_id): the k best of each visited block."""

    def run(batches):
        for t in items(batches, ["list", "block", "part"]):
            held = int((t.column("kind").to_numpy() == 0).sum())
            if held in (0, t.num_rows):
                continue
            rows, visits = t.slice(0, held), t.slice(held)
            ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            asked = {"anchor": visits.column("vec_id").to_numpy(), "label": visits.column("label").to_numpy(), "v": matrix(visits.column("v").to_pylist(), index.width)}
            asked |= {c: np.array(visits.column(c).to_pylist(), np.int64) for c in ("lows", "highs")}
            found = best_in_block(ids, labels, matrix(rows.column("v").to_pylist(), index.width), asked, same, k)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3])], ["anchor", "window", "score", "vec_id"])

    return visited(filed, index, anchors, later).mapInArrow(run, "anchor long, window int, score long, vec_id long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor's window with their ranks from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(filed: DataFrame, index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, window, rank, score, vec_id) of the k best rows in each window of the anchors (anchor, label, v, lows, highs)."""
    anchors = anchors.withColumn("raised", F.col("lows"))
    first = settled(ranked(searched(filed, index, anchors, same, k, False), k), "first-visits")
    full = first.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    kth = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.element_at("kth", i.cast("int")), low)))
    raised = settled(anchors.drop("raised").join(full, "anchor", "left").withColumn("raised", kth).drop("kth"), "anchors")
    rest = searched(filed, index, raised, same, k, True)
    return settled(ranked(first.drop("rank").unionByName(rest), k), "found")


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (rows that satisfy
    ``anchor``, a condition on vec_id and label) and each of its positives, the best other-label rows whose
    score is from ``low`` to ``high`` percent of the positive's."""
    spark = rows.sparkSession
    ship(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with passing(spark) as kept:
        given = rows.where("label IS NOT NULL AND vec_id IS NOT NULL")
        found = indexed(settled(packed(given, scale), "vectors"))
        if found is None:
            return spark.createDataFrame([], schema)
        filed, index = found
        asked = filed.where(anchor).groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("r")).select("anchor", "r.label", "r.v")
        ends = [F.array(F.lit(x).cast("long")).alias(c) for x, c in ((-ENDS, "lows"), (ENDS, "highs"))]
        asked = settled(asked.select("*", *ends), "anchors")
        liked = best(filed, index, asked, True, positives)
        of = F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score")))
        liked = liked.groupBy("anchor").agg(of.alias("p"))
        # Shorter lists of windows are filled with empty ones.
        score = lambda k: F.get("p.score", F.lit(k)).cast("decimal(38,0)")
        lows = F.array(*(F.coalesce(F.ceil(score(k) * low / 100).cast("long"), F.lit(1).cast("long")) for k in range(positives)))
        highs = F.array(*(F.coalesce(F.floor(score(k) * high / 100).cast("long"), F.lit(0).cast("long")) for k in range(positives)))
        windows = settled(asked.select("anchor", "label", "v").join(liked, "anchor").select("*", lows.alias("lows"), highs.alias("highs")), "windows")
        disliked = best(filed, index, windows.drop("p"), False, negatives)
        kept += [windows, disliked]
    out = windows.select(F.col("anchor").alias("of"), "p").join(disliked, F.col("of") == F.col("anchor")).withColumn("q", F.get("p", F.col("window")))
    return out.select(F.col("anchor").alias("anchor_id"), F.col("q.id").alias("positive_id"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), F.col("q.score").alias("positive_score"), F.col("score").alias("negative_score"))
