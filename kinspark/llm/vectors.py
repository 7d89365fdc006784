"""Embedding rows as integers, for the operators that search and compress them.

A vector is kept as little-endian 32-bit integers floor(scale * x); whole rows with a null
vector or a null or non-finite component are left out. Components beyond LIMIT count as LIMIT,
so that every inner product and squared distance of up to 512 components fits a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship

LIMIT = 1 << 23


def integers(column: pa.ListArray, scale: int) -> tuple[np.ndarray, list[bytes]]:
    """Which rows are whole, and the integers of each of those."""
    at = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = ~np.isfinite(flat)
    before = np.concatenate([[0], np.cumsum(bad)])
    whole = ~np.asarray(column.is_null()) & (before[at[1:]] == before[at[:-1]])
    with np.errstate(over="ignore"):
        raw = np.clip(np.floor(np.where(bad, 0.0, flat) * scale), -LIMIT, LIMIT).astype("<i4").tobytes()
    return whole, [raw[4 * a : 4 * b] for a, b, w in zip(at[:-1].tolist(), at[1:].tolist(), whole.tolist(), strict=True) if w]


def packed(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) of the whole rows."""

    def run(batches):
        for batch in batches:
            whole, vectors = integers(batch.column("embedding"), scale)
            kept = [batch.column(c).filter(pa.array(whole)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(vectors, pa.binary())], ["vec_id", "label", "v"])

    ship(rows.sparkSession)
    given = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    return given.mapInArrow(run, "vec_id long, label int, v binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """The vectors as int64 rows; those shorter than ``width`` end in zeros."""
    if all(len(v) == 4 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), width).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def widest(rows: DataFrame) -> tuple[int, int]:
    """How many rows there are, and the largest number of components."""
    found = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    return found[0], (found[1] or 0) // 4
