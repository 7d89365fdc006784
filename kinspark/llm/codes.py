"""Vector code compression: product codes whose nearest entries are exact.

A vector is cut into equal consecutive parts, and each part is coded by the nearest entry of
its position's codebook. Entries are screened by one float32 matrix product, |c|^2 - 2 x.c,
whose rounding error has a rigorous bound for each row. Every entry whose interval overlaps that
of the best is evaluated again in int64, and ties go to the lower index, so codes, errors and
codebooks are those of integer arithmetic throughout.

Codebooks start from the rows of the smallest vec_ids. A round is one pass over the packed rows:
each task adds up its parts by entry, and the sums (a row for each part and entry of a task) are
merged in the shuffle; the driver holds the codebooks alone.

Defined results: rows with a null vector or a null or non-finite component are left out. Vectors
shorter than the widest, or whose width does not divide, end in zeros. Rows that repeat are each coded
(of one vec_id, those of smaller bytes come first in the codebooks);
rows without vec_id are coded too but start no codebook. With fewer rows than entries there are as
many entries as rows with an id, and one of zeros where there is none. An empty table gives no rows;
other columns are ignored. Components beyond vectors.LIMIT count as that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, passing, settled, ship
from .vectors import matrix, packed, widest

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
UNIT = 2.0**-24
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each int64 row (ties: the lower index) and its squared distance."""
    square = (book * book).sum(1)
    length = float(np.sqrt(square.max()))
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    # Products and sums of d terms, with both sides rounded to float32; then the square's rounding and the difference's.
    terms = (x.shape[1] + 2) * UNIT
    error = 1.001 * (2 * terms / (1 - terms) * size * length + 4 * UNIT * (float(square.max()) + 2 * size * length))
    x32, book32, square32 = x.astype(np.float32), book.astype(np.float32).T, square.astype(np.float32)
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(0, len(x), ROWS):
        screen = square32 - 2 * (x32[i : i + ROWS] @ book32)
        reach = (screen.min(1).astype(np.float64) + 2 * error[i : i + ROWS]).astype(np.float32)
        row, entry = np.nonzero(screen <= np.nextafter(reach, np.float32(np.inf))[:, None])
        exact = ((x[i + row] - book[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == best[row])
        hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        index[i : i + ROWS], distance[i : i + ROWS] = entry[hit], best
    return index, distance


def started(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The first codebooks: an array (parts, entries, width of a part)."""
    firsts = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()
    found = matrix([bytes(r.v) for r in firsts], width) if firsts else np.zeros((1, width), np.int64)
    return found.reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the componentwise floor of its parts' mean."""
    parts, entries, size = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v").to_pylist(), parts * size)
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                index, _ = nearest(own, books[p])
                counts[p] += np.bincount(index, minlength=entries)
                for k in range(size):  # exact: a batch's sums stay far below 2 ** 53
                    sums[p, :, k] += np.bincount(index, own[:, k], entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["part", "entry", "n", *(f"s{k}" for k in range(size))]
    schema = ", ".join(f"{c} {'int' if c in ('part', 'entry') else 'long'}" for c in names)
    added = rows.select("v").mapInArrow(run, schema).groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]))
    out = books.copy()
    for r in added.collect():
        out[r.part, r.entry] = [int(r[c]) // int(r.n) for c in names[3:]]
    return out


def fitted(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width of a part) of packed rows (vec_id, v)."""
    books = started(rows, width, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of packed rows; the code has two hex digits a part."""
    parts, _, size = books.shape

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), parts * size)
            found = [nearest(x[:, p * size : (p + 1) * size], books[p]) for p in range(parts)] if len(x) else []
            raw = np.stack([index for index, _ in found], 1).astype(np.uint8).tobytes().hex() if found else ""
            codes = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
            error = sum(d for _, d in found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label int, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (settled) with label_error: the error summed over equal labels, nulls together.

    Labels that hold more than a 4 P-th of all rows on P partitions, of which there can be no more than
    4 P, are broadcast; all others are joined by label. A sum beyond a long is null."""
    n, most = rows.count(), 4 * partitions(rows.sparkSession)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = settled(sums, "label-errors")
    large, small = (sums.where(w).drop("rows") for w in (f"rows * {most} > {n}", f"rows * {most} <= {n}"))
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = rows.join(F.broadcast(large), same)
    rest = rows.join(F.broadcast(large.select("of")), same, "left_anti").join(small, same)
    return hot.unionByName(rest).drop("of")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every whole row."""
    ship(rows.sparkSession)
    with passing(rows.sparkSession) as kept:
        own = settled(packed(rows, scale), "vectors")
        _, width = widest(own)
        books = fitted(own, -(-max(width, 1) // parts) * parts, parts, entries, rounds)
        found = settled(coded(own, books), "codes")
        kept.append(found)
    return with_label_errors(found).withColumn("codebooks_sha256", F.lit(digest(books)))
