"""Range joins, blocks and patterns against plain loops, also with tiny ranges and hot intervals."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from kinspark.operators import blocks, sequences, spans


@pytest.mark.parametrize(("hot", "keyed"), [(20_000, True), (3, False), (3, True)])
def test_points_and_overlaps_equal_the_predicate(spark, monkeypatch, hot, keyed):
    monkeypatch.setattr(spans, "POINTS", hot)
    rng = random.Random(hot)
    held = [(rng.choice("ab"), i, b := rng.randrange(-50, 200), b + rng.choice([0, -3, 1, 2, 7, 64, 150])) for i in range(60)] + [("a", 90, -60, 400), ("a", 91, 5, None), (None, 92, 0, 9)]
    points = [(rng.choice("ab"), i, rng.choice([7, 7, 7, rng.randrange(-80, 300)])) for i in range(150)] + [("a", 900, None), (None, 901, 4), ("a", 902, 7), ("a", 902, 7)]
    on = ["k"] if keyed else []
    s = spark.createDataFrame(held, "k string, span int, b long, e long")
    p = spark.createDataFrame(points, "k string, point int, at long")
    got = spans.points_in_spans(p if keyed else p.drop("k"), s if keyed else s.drop("k"), on, "at", "b", "e").collect()
    same = lambda x, y: not keyed or x == y and x is not None
    want = sorted((x[1], y[1]) for x in held for y in points if same(x[0], y[0]) and None not in (*x[2:], y[2]) and x[2] <= y[2] < x[3])
    assert sorted((r.span, r.point) for r in got) == want
    pairs = spans.overlapping(s if keyed else s.drop("k"), on, "span", "b", "e").collect()
    real = [x for x in held if x[3] is not None and x[2] < x[3]]
    assert sorted((r.left_id, r.right_id) for r in pairs) == sorted((x[1], y[1]) for x in real for y in real if same(x[0], y[0]) and x[2] < y[3] and y[2] < x[3] and (x[2], x[1]) < (y[2], y[1]))
    assert spans.points_in_spans(p, s.where("false"), ["k"], "at", "b", "e").count() == 0


KINDS = [blocks.NEXT, blocks.NEXT, blocks.BRANCH, blocks.GOTO, blocks.STOP]


def program(seed, sizes):
    rng = random.Random(seed)
    return {o: [(k := rng.choice(KINDS), rng.randrange(-1, n + 2) if k in (blocks.BRANCH, blocks.GOTO) else None) for _ in range(n)] for o, n in sizes.items()}


def graph_of(code, handlers):
    """Leaders, blocks and edges of one program, instruction by instruction."""
    n, lead, bad = len(code), {0}, set()
    for i, (kind, target) in enumerate(code):
        if kind in (blocks.BRANCH, blocks.GOTO) and 0 <= target < n:
            lead.add(target)
        if kind != blocks.NEXT:
            lead.add(i + 1)
    good = [h for h in handlers if 0 <= h[0] < h[1] <= n and 0 <= h[2] < n]
    for h in good:
        lead |= set(h)
    starts = sorted(x for x in lead if x < n)
    found, edges = [], set()
    for s, e in zip(starts, [*starts[1:], n], strict=True):
        kind, target = code[e - 1]
        found.append((s, e, e - s, kind))
        if kind in (blocks.NEXT, blocks.BRANCH) and e < n:
            edges.add((s, e, "next"))
        if kind in (blocks.BRANCH, blocks.GOTO):
            edges.add((s, target, "jump") if 0 <= target < n else (s, None, "bad_target"))
        edges |= {(s, h[2], "handler") for h in good if h[0] < e and s < h[1]}
    return found, edges | ({(None, None, "bad_handler")} if len(good) < len(handlers) else set())


@pytest.mark.parametrize("size", [100_000, 7])
def test_blocks_and_edges_of_programs(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "RANGE_ROWS", size)
    code = program(3, {"hot": 90, "b": 12, "c": 1, "d": 30})
    rng = random.Random(4)
    handlers = {o: [(a := rng.randrange(len(c)), a + rng.randrange(1, 6), rng.randrange(len(c) + 1)) for _ in range(3)] for o, c in code.items()} | {"c": []}
    rows = [(o, i * 3, k, t) for o, c in code.items() for i, (k, t) in enumerate(c)]
    placed = blocks.placed(spark.createDataFrame(rows, "o string, at int, kind string, target int"), "o", ["at"])
    assert sorted((r.o, r.place) for r in placed.collect()) == sorted((o, i) for o, c in code.items() for i in range(len(c)))
    found, edges = blocks.basic_blocks(placed, "o", spark.createDataFrame([(o, *h) for o, hs in handlers.items() for h in hs], "o string, start_pc int, end_pc int, handler_pc int"))
    got, arcs = found.collect(), edges.collect()
    for o, c in code.items():
        want, want_arcs = graph_of(c, handlers[o])
        assert sorted((r.start, r.end, r.n, r["last"]) for r in got if r.o == o) == want
        assert {(r.start, r.successor, r.via) for r in arcs if r.o == o} == want_arcs
    assert all(r.whole for r in blocks.covered(found, placed, "o").collect())
    broken = found.where("NOT (o = 'b' AND start = 0)")
    assert {r.o for r in blocks.covered(broken, placed, "o").collect() if not r.whole} == {"b"}


@pytest.mark.parametrize("size", [8192, 5, 4])
def test_patterns_across_chunks_and_owners(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "MATCH_ROWS", size)
    rng = random.Random(9)
    logs = {o: [rng.choice("abc") for _ in range(n)] for o, n in (("hot", 160), ("b", 9), ("c", 2), ("d", 40))}
    steps = ["ab", "b", "bc", "abc"]
    rows = [(o, i, x) for o, s in logs.items() for i, x in enumerate(s)]
    placed = blocks.placed(spark.createDataFrame(rows, "o string, at int, x string"), "o", ["at"])
    found = blocks.matched(placed, "o", [F.col("x").isin(*s) for s in steps])
    want = {(o, i, i + 3) for o, s in logs.items() for i in range(len(s) - 3) if all(s[i + k] in steps[k] for k in range(4))}
    got = found.collect()
    assert {(r.o, r["first"], r["last"]) for r in got} == want and len(got) == len(want)
    targets = [(o, rng.randrange(len(s))) for o, s in logs.items() for _ in range(len(s) // 4)]
    entries = blocks.stabbed(found, "o", spark.createDataFrame(targets, "o string, target long")).collect()
    assert {(r.o, r["first"]): r.entries for r in entries} == {(o, i): sum(t == o and i < at <= j for t, at in targets) for o, i, j in want}
    assert sequences.numbered(placed.select("o", "at"), ["o", "at"]).count() == len(rows)
