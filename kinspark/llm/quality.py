"""Quality scores by a regularised quadratic discriminant.

A document becomes a short vector of transformed statistics (logs of smoothed
rates of words, characters and lines). Per class, count, sums and cross
products are added up on the cluster; the class covariances are shrunk towards
the diagonal of the pooled one, and their Cholesky factors are kept. A score is
the logistic of the difference of log densities (Mahalanobis distances and
determinants from the factors) plus that of the log class shares.

Defined results: null and empty texts are scored like any other, as zero words;
without both classes to learn from, the score is the share of label 1 (0.5 with
no labels); null doc_ids and repeated rows are kept; labels that aren't 0 or 1
teach nothing; other columns are ignored by ``scored`` and carried by ``accepted``.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .packing import texts_of
from .scratch import settled, ship, tidy

SHRINK, FLOOR, SMOOTH = 0.3, 0.05, 0.02
THRESHOLD = 0.7
NAMES = ("words", "distinct", "stutter", "symbols", "bangs", "bars", "length", "capitals", "digits", "stops", "marks", "lines")
D = len(NAMES)
_OF = {k: np.array([ord(c) for c in v]) for k, v in {"symbols": "#*$%&<>|", "bangs": "!?", "bars": "|", "stops": ".,;:", "marks": "\"'()[]{}_=+/\\@^~`-", "digits": "0123456789"}.items()}


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    words = text.split()
    raw = np.frombuffer(text.encode(), np.uint8)
    n, seen = len(words), np.bincount(raw, minlength=256)
    c = {k: int(seen[v].sum()) for k, v in _OF.items()}
    capitals, small = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    repeated = len(lines) - len(set(lines))
    rate = [
        (sum(map(eq, words, words[1:])), n),
        (c["symbols"], n),
        (c["bangs"], n),
        (c["bars"], n),
        (capitals, capitals + small),
        (c["digits"], len(raw)),
        (c["stops"], n),
        (c["marks"], n),
        (repeated, len(lines)),
    ]
    stutter, symbols, bangs, bars, caps, digits, stops, marks, dup = (np.log(a / (b + 1) + SMOOTH) for a, b in rate)
    distinct = np.log((len(set(words)) + 1) / (n + 1))
    length = np.log((sum(map(len, words)) + 1) / (n + 1))
    return [np.log1p(n), distinct, stutter, symbols, bangs, bars, length, caps, digits, stops, marks, dup]


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in texts_of(batch)]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            edges = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * D)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(edges, flat)], ["doc_id", "x"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and cross products of x by label: 2 * (1 + D + D * D) numbers, summed on the cluster."""

    def run(batches):
        total = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            y = np.asarray(batch.column("label"))
            x = np.asarray(batch.column("x").flatten()).reshape(-1, D)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        where = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total.reshape(-1))], ["at", "v"])

    found = labelled.mapInArrow(tidy(run), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + D + D * D))
    for r in found:
        total[r["at"]] = r["v"]
    return {k: (row[0], row[1 : 1 + D], row[1 + D :].reshape(D, D)) for k, row in enumerate(total.reshape(2, -1))}


class Discriminant:
    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        counts = np.array([found[k][0] for k in (0, 1)])
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.ready = bool((counts > 1).all())
        if not self.ready:
            return
        self.means = [found[k][1] / counts[k] for k in (0, 1)]
        covariances = [found[k][2] / counts[k] - np.outer(self.means[k], self.means[k]) for k in (0, 1)]
        pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / counts.sum()
        target = np.diag(np.diag(pooled) + FLOOR)
        self.factors = [np.linalg.cholesky((1 - SHRINK) * c + SHRINK * target) for c in covariances]
        self.inverse = [np.linalg.inv(f) for f in self.factors]
        self.constant = [np.log(n / counts.sum()) - np.log(np.diag(f)).sum() for n, f in zip(counts, self.factors, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        log = [c - (((x - m) @ i.T) ** 2).sum(1) / 2 for m, i, c in zip(self.means, self.inverse, self.constant, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))


def fitted(x: DataFrame, labels: DataFrame) -> Discriminant:
    """Learned from labelled documents whose crc32 modulo 4 isn't 2."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    known = known.where(~held_out(4, 2))
    return Discriminant(moments(x.join(known, "doc_id").select("label", "x")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    x = settled(vectors(docs), "statistics")
    model = fitted(x, labels)

    def run(batches):
        for batch in batches:
            values = model.score(np.asarray(batch.column("x").flatten()).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    out = x.mapInArrow(tidy(run), "doc_id long, score double").withColumn("held_out", held_out(4, 2))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that score the threshold or more, with all their columns.

    The model is fitted on the statistics of ``learn_from`` (by default the same
    documents); each document is then scored where it is read, so no text is shuffled."""
    model = fitted(vectors(docs if learn_from is None else learn_from), labels)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch)], np.float64).reshape(-1, D)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
