"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing reduces the names of neighbouring symbols to labels
from a small range (position and value of the lowest bit in which a name
differs from its left neighbour); local maxima of the labels begin phrases, and
a phrase's name is the hash of its symbols. Phrases are the symbols of the next
level, until a text is one phrase. Where phrases begin depends on a few symbols around, so equal substrings
have equal phrases inside, wherever they stand. A fingerprint is the bottom-K
sample of the names of all phrases from level BASE up; likeness is the
estimated Jaccard similarity of two such sets.

Defined results: null texts count as empty, with an empty fingerprint (like
another empty one, unlike all else); null doc_ids come last in descending
order; rows of equal doc_id follow each other by text; a table's only document
is its own next one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import Rolling, chunks, mix
from .scratch import partitions, ship

BASE, KEPT = 2, 64
CHUNK = 500_000
_LOWEST = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


def tossed(names: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 8 that differ between neighbours, where names do; head: a text begins."""
    diff = names.copy()
    diff[1:] ^= names[:-1]
    diff[head] = 1
    low = diff & (~diff + np.uint64(1))
    place = (low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    label = (place * np.uint64(2) + (names >> place & np.uint64(1))).astype(np.uint8)
    for _ in range(3):
        diff = label.copy()
        diff[1:] ^= label[:-1]
        diff[head] = 1
        place = _LOWEST[diff]
        label = place * np.uint8(2) + (label >> place & np.uint8(1))
    return label


def parsed(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level up, and where texts begin among them."""
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | head[1:]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(names)))
    head = head[start]
    names = mix(names[start].astype(np.uint64) + np.uint64(1))
    many = np.flatnonzero(size > 1)  # a run of one symbol becomes a symbol of its own
    names[many] = mix(names[many] ^ size[many].astype(np.uint64))
    label = tossed(names, head)
    begin = head.copy()
    inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~head[2:]
    begin[1:-1] |= inner
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(names))
    return Rolling(names).slices(start, end), head[start]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The sorted sample of phrase names of each text."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    names = np.frombuffer(b"".join(raw), np.uint8)
    filled = np.flatnonzero(size)
    head = np.zeros(len(names), bool)
    head[(np.cumsum(size) - size)[filled]] = True
    found, owner, texts_left, level = [], [], np.arange(len(filled)), 0
    while len(names):
        level += 1
        names, head = parsed(names, head)
        if level >= BASE:
            ordinal = np.cumsum(head) - 1
            found.append(names)
            owner.append(texts_left[ordinal])
            more = np.bincount(ordinal) > 1
            names, head, texts_left = names[more[ordinal]], head[more[ordinal]], texts_left[more]
    out = [np.zeros(0, np.uint32)] * len(raw)
    if found:
        all_names, all_owners = mix(np.concatenate(found)), np.concatenate(owner)
        order = np.argsort(all_owners, kind="stable")
        all_names, edges = all_names[order], np.searchsorted(all_owners[order], np.arange(len(filled) + 1))
        for k, i in enumerate(filled.tolist()):
            own = (all_names[edges[k] : edges[k + 1]] >> np.uint64(32)).astype(np.uint32)
            out[i] = np.unique(own)[:KEPT]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of what two samples stand for."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:] == union[:-1]
    distinct = np.append(union[:-1][~twice], union[-1])
    # A sample that isn't full holds all its names; then no value limits it.
    n = KEPT if max(len(a), len(b)) >= KEPT else len(distinct)
    limit = distinct[min(n, len(distinct)) - 1]
    return float((union[1:][twice] <= limit).sum()) / min(n, len(distinct))


def spell(sample: np.ndarray) -> str:
    return sample.astype(">u4").tobytes().hex()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents in buckets that are ranges of descending doc_id; the first of
    the following bucket (after the last: the first) is at each one's end, as ``extra``."""
    lowest = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    probes = [i / buckets for i in range(1, buckets)]
    bounds = np.unique(np.array(docs.approxQuantile("doc_id", probes, 0.25 / buckets) if probes else [], np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(), "left")).astype("int32")

    heads = docs.select(bucket_of("key").alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()  # a row a bucket
    keys = np.array([r["key"] for r in heads][::-1], np.int64)
    before = np.array([heads[i - 1]["bucket"] for i in range(len(heads))][::-1], np.int64)

    @F.pandas_udf("int")
    def extra_of(key: pd.Series) -> pd.Series:
        key = key.to_numpy()
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return pd.Series(np.where(keys[at] == key, before[at], -1)).astype("int32")

    own = F.struct(bucket_of("key").alias("bucket"), F.lit(False).alias("extra"))
    also = F.struct(extra_of("key").alias("bucket"), F.lit(True).alias("extra"))
    placed = docs.withColumn("at", F.explode(F.filter(F.array(own, also), lambda x: x.bucket >= 0)))
    placed = placed.select("at.bucket", "at.extra", "key", "doc_id", "text")
    return placed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "extra", F.col("key").desc(), "text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses."""
    spark = docs.sparkSession

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, the next one's text)."""
        out: list[tuple] = []
        for a, b in chunks([t for _, t, _ in rows], CHUNK):
            own = [t for _, t, _ in rows[a:b]]
            after = [t for *_, t in rows[a:b]]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, after, strict=True)]
            # Texts follow each other, so the next one's fingerprint is the next in the list.
            joined = all(x is y for x, y in zip(own[1:], after, strict=False))
            mine = fingerprints([*own, after[-1]])
            nexts = mine[1:] if joined else fingerprints(after)
            for (doc_id, text, _), e, x, y, z in zip(rows[a:b], edited, mine, fingerprints(edited), nexts, strict=False):
                out.append((doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), spell(x), spell(y), likeness(x, y), likeness(x, z)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [c.split()[0] for c in OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names)

    def run(batches):
        last = None  # (bucket, doc_id, text), waiting for its next
        for batch in batches:
            rows = []
            for bucket, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
                if last is not None and last[0] == bucket:
                    rows.append((last[1], last[2], text))
                last = None if extra else (bucket, doc_id, text)
            if rows:
                yield judged(rows)

    ship(spark)
    return with_next(docs, max(1, partitions(spark))).mapInArrow(run, OUT)
