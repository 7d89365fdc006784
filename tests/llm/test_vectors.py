"""Shards, hard negatives and product codes against plain versions, on odd and skewed tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from kinspark.llm import codes, entry, negatives, sharding, vectors

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, list string, v int, n int, block string"


def sized(rows):
    return [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]


def drawn(key, shard):
    return (int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def shard(key, weights):
    return min((-math.log(drawn(key, i)) / w, i) for i, w in enumerate(weights) if w)[1]


def key_of(d, t):
    return str(d) if d is not None else "none" if t is None else "text " + hashlib.md5(t.encode()).hexdigest()


@pytest.mark.parametrize(("copies", "rows_a_bucket"), [(100_000, 250_000), (7, 5)])
def test_shards_of_odd_rows(spark, odd, odd_rows, monkeypatch, copies, rows_a_bucket):
    monkeypatch.setattr(sharding, "COPIES", copies)
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", rows_a_bucket)
    docs = odd.unionByName(odd.where("doc_id = 9").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("x"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.sharded(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(sized(rows)) and {r.law for r in got} == {"key"}
    keys = {}
    for d, t in rows:
        keys.setdefault((d, *sized([(d, t)])[0][1:]), set()).add(key_of(d, t))
    for r in got:
        assert r.shard in {shard(k, [1.0] * 8) for k in keys[r.doc_id, r.size, r.text_crc32]}
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = sharding.sharded(docs.repartition(7), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.sharded(docs.limit(0), 8).count() == 0


def test_shards_by_weight_move_few_rows(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    weights = [1.0, 2.0, 0.0, 5.0]
    got = {r.doc_id: r.shard for r in sharding.sharded(docs, weights).collect()}
    assert all(got[d] == shard(str(d), weights) for d in range(0, 4000, 37))
    share = Counter(got.values())
    assert 2 not in share and all(abs(share[i] / 4000 - w / 8) < 0.03 for i, w in enumerate(weights))
    fewer = {r.doc_id: r.shard for r in sharding.sharded(docs, [1.0, 2.0]).collect()}
    assert all(fewer[d] == s for d, s in got.items() if s != 3)  # only the rows of the shard that went moved
    with pytest.raises(ValueError, match="weights"):
        sharding.sharded(docs, [0.0, 0.0])
    sharding.written(docs, weights, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert {r.doc_id: r.shard for r in back} == got and len(back) == 4000


def test_op11_and_op12_and_op13_equal_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("op11_rendezvous_shards", "op12_hard_negatives", "op13_vector_codes"):
        df = entry.queries()[name](spark, DATA)
        found = c.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert Counter(tuple(r) for r in df.select(columns).collect()) == Counter(found.fetchall())


def random_rows(seed, n, width=12, dup=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (6, width))
    rows = [(int(i), (middles[rng.integers(6)] * 0.4 + rng.normal(0, 0.3, width)).astype(np.float32).tolist(), int(rng.integers(4))) for i in rng.permutation(3 * n)[:n]]
    rows += [(10_000 + i, rows[0][1], i % 4) for i in range(dup)]  # a hot vector: every tie is broken by id
    nan, inf = float("nan"), float("inf")
    rows += [(20_000, None, 1), (20_001, [None] + [0.1] * (width - 1), 1), (20_002, [nan] * width, 2), (20_003, [inf] + [0.0] * (width - 1), 2), (20_004, [0.1] * width, None), (20_050, [0.2] * 5, 3), (20_006, [], 1), (None, [0.3] * width, 1)]
    return [(*r, "l", 7, 8, "b") for r in rows]


def whole(rows, scale):
    """(vec_id, label, integers) of rows without nulls and the like, ended with zeros."""
    kept = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in kept), default=0)
    return [(i, y, np.array(v + [0] * (width - len(v)), np.int64)) for i, y, v in kept]


def mined(rows, positives=5, negatives_=3):
    kept = [r for r in whole(rows, 256) if r[0] is not None and r[1] is not None]
    out = []
    for a, y, v in kept:
        if a % 50:
            continue
        scored = sorted((-int(v @ w), i, z == y) for i, z, w in kept if i != a)
        liked = [x for x in scored if x[2]][:positives]
        for s, p, _ in liked:
            fit = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives_]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return out


@pytest.mark.parametrize(("seed", "n", "dup", "small"), [(1, 300, 0, False), (2, 300, 400, True), (3, 60, 60, True)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, n, dup, small):
    if small:
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
        monkeypatch.setattr(negatives, "PART_ANCHORS", 3)
        monkeypatch.setattr(negatives, "CHUNK", 4)
        monkeypatch.setattr(negatives, "FIRST", 1)
    rows = random_rows(seed, n, dup=dup)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = [tuple(r) for r in negatives.mined(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(mined(rows)) and got


def test_hard_negatives_of_odd_tables(spark):
    df = spark.createDataFrame(random_rows(4, 80), VECTORS)
    assert negatives.mined(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mined(df, F.lit(False)).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1, "l", 1, 1, "b"), (51, [1.0, 2.0], 1, "l", 1, 1, "b")], VECTORS)
    assert negatives.mined(one, F.col("vec_id") % 50 == 0).count() == 0  # no other label
    huge = [(50, [3e38, 1.0], 1), (51, [3e38, 2.0], 1), (52, [1e30, 2.0], 2), (53, [20000.0, 5.0], 2), (100, [-3e38, 0.0], 1)]
    limit = vectors.LIMIT
    plain = [(i, [max(-limit, min(limit, math.floor(256 * x))) / 256 for x in v], y) for i, v, y in huge]
    got = [tuple(r) for r in negatives.mined(spark.createDataFrame([(*r, "l", 1, 1, "b") for r in huge], VECTORS), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(mined([(*r, "") for r in plain]))
    same = spark.createDataFrame([(50, [1.0, 0.5], 1, "l", 1, 1, "b")] * 3 + [(7, [1.0, 0.5], 1, "l", 1, 1, "b")] * 2 + [(8, [0.6, 0.5], 2, "l", 1, 1, "b")] * 2, VECTORS)
    found = [tuple(r) for r in negatives.mined(same, F.col("vec_id") % 50 == 0).collect()]
    assert len(found) == 4 and {r[:2] for r in found} == {(50, 7)} and {r[3] for r in found} == {8}  # repeated rows each take part, an anchor once


def test_few_lists_are_visited(spark):
    """Where the data have structure, the bounds leave most lists out."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (40, 16))
    rows = [(i, (middles[i % 40] + rng.normal(0, 0.02, 16)).tolist(), i % 2, "l", 1, 1, "b") for i in range(2000)]
    x = np.array([np.floor(256 * np.array(r[1], np.float32).astype(float)) for r in rows]).astype(np.int64)
    middle = negatives.centroids(x, 40)
    own = negatives._nearest(x.astype(float), middle)
    radii = np.array([np.sqrt(((x[own == k] - middle[k]) ** 2).sum(1)).max(initial=0) if (own == k).any() else -1 for k in range(len(middle))])
    index = negatives.Index(16, middle, radii, np.ones(len(middle), np.int64))
    a = x[::50]
    low, high = negatives.bounds(index, a)
    scores = a @ x.T
    for k in range(len(middle)):
        if (own == k).any():
            assert (scores[:, own == k] <= high[:, [k]]).all() and (scores[:, own == k] >= low[:, [k]]).all()
    kth = np.sort(scores, 1)[:, -5]
    assert (high >= kth[:, None]).mean() < 0.3


def coded(rows, parts=4, entries=256, rounds=4):
    kept = whole(rows, 1024)
    width = -(-max(len(v) for *_, v in kept) // parts) * parts
    x = np.stack([np.pad(v, (0, width - len(v))) for *_, v in kept]).reshape(len(kept), parts, -1)
    order = sorted((i for i in range(len(kept)) if kept[i][0] is not None), key=lambda i: (kept[i][0], kept[i][2].astype("<i4").tobytes()))[:entries]
    books = x[order].transpose(1, 0, 2).copy()

    def near(book, part):
        d = ((part[:, None] - book[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            own, _ = near(books[p], x[:, p])
            for e in set(own.tolist()):
                books[p][e] = x[own == e, p].sum(0) // (own == e).sum()
    found = [near(books[p], x[:, p]) for p in range(parts)]
    error = sum(d for _, d in found)
    of = Counter()
    for (_, y, _), e in zip(kept, error.tolist(), strict=True):
        of[y] += e
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return [(i, "".join(f"{own[k]:02x}" for own, _ in found), e, of[y], sha) for k, ((i, y, _), e) in enumerate(zip(kept, error.tolist(), strict=True))]


@pytest.mark.parametrize(("seed", "n", "dup"), [(1, 400, 0), (2, 300, 300), (3, 20, 0)])
def test_codes_equal_integer_arithmetic(spark, seed, n, dup):
    rows = random_rows(seed, n, dup=dup) + random_rows(9, 3)[:2] * 2
    rows = [r if i % 9 else (*r[:2], None, *r[3:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = [tuple(r) for r in codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert Counter(got) == Counter(coded(rows))


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame(random_rows(4, 10), VECTORS)
    assert codes.compressed(df.limit(0)).count() == 0 and codes.compressed(df.where("embedding IS NULL")).count() == 0
    alone = codes.compressed(df.where("vec_id IS NULL")).collect()
    assert len(alone) == 1 and alone[0].code == "00000000" and alone[0].vec_id is None
    assert codes.compressed(spark.createDataFrame([(1, [], 1, "", 1, 1, "")], VECTORS)).collect()[0].error == 0


def test_screening_is_exact_where_float32_is_not():
    """Entries that float32 cannot tell apart, ties, and numbers beyond its whole numbers."""
    rng = random.Random(3)
    for size in (10, 3_000, 5_000_000):
        book = np.array([[rng.randrange(-size, size) for _ in range(8)] for _ in range(40)], np.int64)
        book = np.concatenate([book, book[5:9], book[:6] + np.eye(6, 8, dtype=np.int64)])
        x = np.concatenate([book + 1, np.array([[rng.randrange(-size, size) for _ in range(8)] for _ in range(200)], np.int64), (book[:20] + book[20:40]) // 2])
        distance = ((x[:, None] - book[None]) ** 2).sum(2)
        index, best = codes.nearest(x, book)
        assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()
