"""Near rows, judged and assigned without their pairs, against all pairs."""

from __future__ import annotations

import random

import pytest

from kinspark.operators import assignment, matching, near

SIDES = ("k", "l", "r", "v", "w", 250.0)


def tables(spark, lefts, rights):
    return spark.createDataFrame(lefts, "k int, l long, v double"), spark.createDataFrame(rights, "k int, r long, w double")


def drawn(kind):
    """Rows of both sides: few values with many rows each, values in cents with ties on both sides, or values nearer than scores tell apart."""
    rng = random.Random(kind)
    value = {
        "copies": lambda: rng.choice([-120.5, 0.0, 10.25, 20.5, 249.99, 250.0, 499.98, 500.0, 777.0, 3000.0]),
        "cents": lambda: round(rng.uniform(-300, 900), 0) + rng.choice([0.0, 0.5]),
        "dense": lambda: rng.choice([100.0, 340.0]) + rng.randrange(40) * 0.00004,
    }[kind]
    side = lambda n: [(rng.randrange(2), k, value()) for k in rng.sample(range(1000), n)]
    return side(160), side(60)


@pytest.mark.parametrize("kind", ["copies", "cents", "dense"])
def test_near_rows_are_those_of_all_pairs(spark, kind):
    lefts, rights = drawn(kind)
    lefts += [(None, 2000, 1.0), (0, 2001, None), (0, 2002, float("nan")), (1, 2003, float("inf")), (1, 2004, 90000.0)]
    rights += [(None, 2000, 1.0), (1, 2001, None), (1, 2002, float("nan")), (1, 2003, float("inf"))]
    left, right = tables(spark, lefts, rights)
    pairs = near.scored(left, right, "k", "v", "w", 250.0).localCheckpoint()
    got = near.judged(left, right, *SIDES, 0.01, 0.5)
    wanted = matching.judged(pairs, "l", "r", 0.01, 0.5)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    wanted = sorted(tuple(r)[:3] for r in assignment.greedy(pairs, "l", "r").collect())
    assert wanted
    for few in (0, 16):
        assert sorted(tuple(r)[:3] for r in near.assigned(left, right, *SIDES, few).collect()) == wanted


def test_rows_of_one_id_are_one_end(spark):
    left, right = tables(spark, [(0, 1, 5.0), (1, 1, 7.0), (0, 2, 5.5), (0, None, 5.0)], [(0, 1, 5.0), (1, 2, 7.5), (0, 3, 6.0)])
    pairs = near.scored(left, right, "k", "v", "w", 250.0).localCheckpoint()
    got = near.judged(left, right, *SIDES, 0.01)
    assert sorted(map(str, got.collect())) == sorted(map(str, matching.judged(pairs, "l", "r", 0.01).collect()))
    assert sorted(map(tuple, near.assigned(left, right, *SIDES).collect())) == sorted(map(tuple, assignment.greedy(pairs, "l", "r").collect()))


def test_rows_of_equal_values_take_a_round_together(spark):
    left, right = tables(spark, [(0, i, float(i % 3) * 40) for i in range(600)], [(0, i, float(i % 3) * 40 + 1) for i in range(450)])
    got = near.assigned(left, right, *SIDES).collect()
    assert len(got) == len({r.l for r in got}) == len({r.r for r in got}) == 450
    assert max(r["round"] for r in got) <= 3
