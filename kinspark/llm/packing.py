"""Best-fit packing of tokenised documents into sequences of fixed length.

Only the counts of piece lengths reach the driver (as many numbers as a
sequence has places). There, exact-complement hashing fills gaps: sums of one,
two or three lengths are looked up by the gap that they fill, and a combination is
used as often as the available counts allow; what is left is packed best-fit.
Every pair or triple spends small pieces that best fit could place one by one, so
as many of them are used as cost no sequence: halved numbers are tried in turn.
The plan says which ranks of each length go to which sequences, and every piece
finds its place by its rank among the pieces of its length.

Defined results: null text counts as empty (the end id alone); a null doc_id is
kept as it is; repeated rows are packed as documents of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import library_encoder
from .scratch import partitions, settled, ship, tidy

SIZE = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
_SHIFT = 44


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than size when n > size."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(i, size) for i in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids and end id."""

    def run(batches):
        encoder = library_encoder(tokenizer, added=True)
        for batch in batches:
            rows: list[tuple] = []
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for ids, edge in encoder.encode(texts_of(batch)):
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    rows += [(doc_ids[at], k, s, n, zlib.crc32(own[s : s + n])) for k, (s, n) in enumerate(cut(len(own), size))]
                    at += 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences are filled so), using up all counts: of the plans that fill gaps from the longest or
    from the shortest length, with all pairs and triples that fit or ever fewer of them, the one
    with the fewest sequences, and of such the one with the most exact combinations."""
    least = -(-sum(x * n for x, n in counts.items()) // size)
    best, order = [], (1 << 62, 0)
    for rising in (True, False):
        most = None
        while most is None or most > 0:
            found, used = filled(counts, size, rising, most)
            score = (sum(n for _, n in found), -used)
            if not best or score < order:
                best, order = found, score
            if score[0] == least or not used:
                break
            most = (used if most is None else min(most, used)) // 2
    return best


def filled(counts: dict[int, int], size: int, rising: bool, most: int | None) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """A plan, and how many sequences a pair or triple beside the longest length fills exactly; at most ``most``."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    used = 0

    def use(lengths: tuple[int, ...]) -> None:
        nonlocal used
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        m = min(int(left[x]) // k for x, k in need.items())
        if len(lengths) > 2:
            m = m if most is None else min(m, most - used)
            used += m
        if m:
            for x, k in need.items():
                left[x] -= m * k
            out.append((lengths, m))

    use((size,))
    longs = range(size // 3 + 1, size) if rising else range(size - 1, size // 3, -1)
    for long in longs:
        if left[long] and size - long <= long:
            use((long, size - long))
    for parts in (2, 3):
        for long in longs:
            gap = size - long
            # The least of the lengths that fill the gap: from the smallest, so that the others are large, or, from
            # the longest length down, as even as can be, so that small ones are kept for later.
            leasts = range(1, gap // parts + 1) if rising else range(gap // parts, 0, -1)
            for c in leasts:
                if not left[long] or most is not None and used >= most:
                    break
                if not left[c]:
                    continue
                if parts == 2:
                    if left[gap - c] and gap - c <= long:
                        use((long, gap - c, c))
                    continue
                rest = gap - c
                b = np.arange(c, rest // 2 + 1)
                for x in b[(left[b] > 0) & (left[rest - b] > 0) & (rest - b <= long)].tolist():
                    if not left[long] or not left[c]:
                        break
                    use((long, rest - x, x, c))

    # Best fit, longest first, on groups of equal sequences: free places -> [(lengths, how many)].
    free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        n = int(left[length])
        for gap in range(length, size + 1):
            while n and gap < size and free[gap]:
                lengths, m = free[gap].pop()
                k = min(gap // length, n)
                bins = min(m, n // k)
                if bins < m:
                    free[gap].append((lengths, m - bins))
                free[gap - k * length].append((lengths + (length,) * k, bins))
                n -= bins * k
        k = size // length
        if n >= k:
            free[size - k * length].append(((length,) * k, n // k))
        if n % k:
            free[size - n % k * length].append(((length,) * (n % k), 1))
    return out + [x for group in free.values() for x in group], used


def slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the first sequence and the offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, m in planned:
        offset = 0
        for x in lengths:
            rows.append(((x << _SHIFT) + used[x], base, offset))
            used[x] += m
            offset += x
        base += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy()


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """``rank``: numbers from 0 within each length. Ranks are taken within
    salted parts of a length and shifted by the parts before, so that a very
    common length isn't one task's work."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = rows.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        rows.withColumn("own", F.row_number().over(own) - 1)
        .join(parts, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("own"))
        .drop("salt", "before", "own")
    )


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cut_up = settled(pieces(docs, tokenizer, size, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most ``size`` rows
    keys, bases, offsets = slots(plan(counts, size))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << _SHIFT) + rank, "right") - 1
            sequence = bases[at] + rank - (keys[at] - (length << _SHIFT))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    return ranked(cut_up, max(32, partitions(spark))).select(*names, "rank").mapInArrow(tidy(place), PACKED)
