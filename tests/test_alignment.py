"""Alignment by chains of anchors."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from kinspark.operators import alignment


def test_longest_rise_is_longest_and_rises():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(30), rng.randint(0, 9))
        at = alignment.longest_rise(np.array(values, np.int64)).tolist()
        chain = [values[i] for i in at]
        assert at == sorted(set(at)) and chain == sorted(chain)
        longest = next(n for n in range(len(values), -1, -1) if any(list(c) == sorted(c) for c in combinations(values, n)))
        assert len(chain) == longest
    assert len(alignment.longest_rise(np.arange(100_000))) == 100_000


def test_pairs_align_round_by_round(spark):
    rng = random.Random(2)
    texts = {}
    for p in range(6):
        a = [rng.choice([f"w{rng.randrange(60)}", "the", "of"]) for _ in range(rng.choice([5, 60, 120]))]
        b = list(a)
        for _ in range(8):
            k = rng.randrange(len(b))
            b[k:k + rng.randint(0, 2)] = [rng.choice(["new", "the", "w3"])]
        texts[f"p{p}"] = (a, b)
    texts["moved"] = ("a b c d e f".split(), "d e f a b c".split())
    texts["apart"] = (["x"], ["y"])
    texts["nested"] = ("s p x q e p".split(), "s p x q e".split())  # p stands twice until the chain s x q e cuts it apart
    sides = [spark.createDataFrame([(p, i, t) for p, both in texts.items() for i, t in enumerate(both[k])], "pair string, place int, token string").repartition(3) for k in (0, 1)]
    rows = alignment.aligned(*sides).collect()
    for p, (a, b) in texts.items():
        got = sorted((r.l, r.r) for r in rows if r.pair == p)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        once = [t for t in a if a.count(t) == b.count(t) == 1]
        first = [(r.l, r.r) for r in rows if r.pair == p and r.round == 1]
        assert len(first) == len(alignment.longest_rise(np.array([b.index(t) for t in once], np.int64)))
    assert {(r.l, r.r, r.round) for r in rows if r.pair == "nested"} == {(0, 0, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (1, 1, 2)}
    assert sum(r.pair == "moved" for r in rows) == 3 and not any(r.pair == "apart" for r in rows)
    assert max(r.round for r in rows) > 1
    assert alignment.aligned(sides[0].where("false"), sides[1]).count() == 0
