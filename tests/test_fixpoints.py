"""Assignment, containment and fixpoints against plain versions of their rules."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from kinspark.operators import assignment, checks, fixpoints, scopes


def walk_of(pairs):
    """The sequential walk."""
    best = {}
    for a, b, s in pairs:
        if None not in (a, b, s):
            best[a, b] = max(s, best.get((a, b), s))
    taken, left, right = set(), set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in left and b not in right:
            taken.add((a, b, s))
            left.add(a)
            right.add(b)
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_is_the_walk_in_order_of_score(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(20), rng.randrange(12) / 4) for _ in range(220)]
    pairs += [(None, 1, 9.0), (1, None, 9.0), (3, 3, None), *pairs[:5]]
    got = assignment.greedy(spark.createDataFrame(pairs, "l int, r int, score double"), "l", "r").collect()
    assert {(r.l, r.r, r.score) for r in got} == walk_of(pairs)
    assert len(got) == len(walk_of(pairs)) and max(r.round for r in got) > 1


def test_greedy_follows_a_chain_of_waiting_pairs(spark):
    pairs = [(k // 2 + k % 2, k // 2, float(k)) for k in range(14)]
    got = assignment.greedy(spark.createDataFrame(pairs, "l int, r int, score double"), "l", "r").collect()
    assert {(r.l, r.r, r.score) for r in got} == walk_of(pairs) and max(r.round for r in got) >= 6
    assert assignment.greedy(spark.createDataFrame([], "l int, r int, score double"), "l", "r").count() == 0


def rivals_of(sets, need_of, most, broken):
    length = Counter(w for s in sets.values() for w in s)
    out = {}
    for o, own in sets.items():
        size = sum(own.values())
        need, before, rare = need_of(size), 0, []
        for w in sorted(own, key=lambda w: (length[w], w)):
            if before < size - need + 1:
                rare.append(w)
            before += own[w]
        pool = sum(length[w] - 1 for w in rare)
        near = {p for p in sets if p != o and any(w in sets[p] for w in rare)}
        both = {p: sum((own & sets[p]).values()) for p in sets if p != o}
        assert all(p in near for p in both if both[p] >= need)  # the rule behind the pool
        n = sum(b >= need for b in both.values())
        state = "incomplete" if o in broken else "too_broad" if pool > most else "unscannable" if near & broken else "rivalled" if n else "unrivalled"
        claims = state.endswith("rivalled")
        out[o] = (size, pool, n if claims else None, sum(b == size for b in both.values()) if claims else None, state)
    return out


@pytest.mark.parametrize("part", [1, 3])
def test_containment_withdraws_broad_owners_before_pairs(spark, part):
    rng = random.Random(part)
    sets = {o: Counter(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(1, 6))) for o in range(120)}
    sets |= {200 + o: Counter(sets[o]) for o in range(0, 30, 3)} | {300: Counter({"w0": 5, "lone": 2}), 301: Counter(["own"])}
    broken = {5, 203, 17}
    rows = [(o, w, n) for o, s in sets.items() for w, n in s.items()] + [(None, "w1", 1), (7, None, 1)]
    got = assignment.contained(spark.createDataFrame(rows, "o int, w string, n int"), "o", "w", F.col("size") - F.floor(F.col("size") / part) * int(part > 1), 12, spark.createDataFrame([(b,) for b in broken], "o int")).collect()
    want = rivals_of(sets, lambda size: size - size // part * int(part > 1), 12, broken)
    assert {r.o: (r.size, r.pool, r.rivals, r.supersets, r.state) for r in got} == want
    assert {"too_broad", "rivalled", "unrivalled", "incomplete"} <= {s[-1] for s in want.values()}


def test_neighbours_match_more_in_every_round(spark):
    shapes = {"root": "R", "a": "X", "b": "X", "c": "Y", "d": "Y", "t1": "T", "t2": "T", "v": "V"}
    edges = [("root", "a", "left"), ("root", "b", "right"), ("a", "c", "k"), ("b", "d", "k"), ("root", "t1", "m"), ("root", "t2", "m"), ("c", "v", "k")]
    rows = [(True, n, s) for n, s in shapes.items()] + [(False, f"n_{n}", s) for n, s in shapes.items()] + [(True, "lonely", "L"), (False, "n_v2", "V")]
    lines = [(True, a, b, k) for a, b, k in edges] + [(False, f"n_{a}", f"n_{b}", k) for a, b, k in edges if (a, b) != ("c", "v")] + [(False, "n_d", "n_v", "k"), (False, "n_d", "n_v2", "k")]
    got = {r.id: (r.round, r.new_id, r.state) for r in fixpoints.neighbour_matches(spark.createDataFrame(rows, "old boolean, id string, shape string"), spark.createDataFrame(lines, "old boolean, src string, dst string, kind string")).collect()}
    assert got["root"] == (1, "n_root", "matched")
    assert got["a"] == (2, "n_a", "matched") and got["b"] == (2, "n_b", "matched")
    assert got["c"] == (3, "n_c", "matched") and got["d"] == (3, "n_d", "matched")
    assert got["t1"][2] == got["t2"][2] == "tied" and got["lonely"] == (0, None, "alone")
    assert got["v"] == (0, None, "vetoed")  # a known neighbour differs on either side


def closure_of(edges, roots):
    found, n = dict.fromkeys(roots, 0), 0
    while True:
        n += 1
        more = {d for s, d, g in edges if s in found and (g is None or g in found)} - found.keys()
        if not more:
            return found
        found |= dict.fromkeys(more, n)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_growing_closure_opens_edges_by_what_it_reaches(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([None, rng.randrange(60)])) for _ in range(130)]
    got = fixpoints.grown(spark.createDataFrame([*edges, *edges[:9], (None, 1, None)], "src int, dst int, guard int"), spark.createDataFrame([(0,), (0,), (1,), (None,)], "v int")).collect()
    assert {r.v: r.round for r in got} == closure_of(edges, [0, 1]) and len(got) == len({r.v for r in got})


def test_a_guard_reached_long_after_its_edge_opens_it(spark):
    chain = [(k, k + 1, None) for k in range(12)] + [(0, 100, 12), (100, 101, 3), (5, 102, 999)]
    got = {r.v: r.round for r in fixpoints.grown(spark.createDataFrame(chain, "src int, dst int, guard int"), spark.createDataFrame([(0,)], "v int")).collect()}
    assert (got[12], got[100], got[101]) == (12, 13, 14) and 102 not in got


def test_names_flow_until_they_disagree(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "c2"), ("a", "c2"), ("c2", "d"), ("a", "e"), ("a2", "e"), ("e", "a"), ("y", "f"), ("f", "g"), ("g", "h"), ("h", "a"), ("s", "s"), ("k", "z")]
    seeds = [("a", "red"), ("a2", "red"), ("x", "blue"), ("y", "blue"), ("k", "one"), ("k", "two"), (None, "red"), ("q", None)]
    got = {r.v: (r.name, r.round, r.support, r.rivals, r.state) for r in fixpoints.flowed(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "v string, name string")).collect()}
    assert got["c2"] == (None, 1, 0, 2, "ambiguous") and "d" not in got and got["k"][4] == "ambiguous" and "z" not in got
    assert got["b"] == ("red", 1, 1, 0, "named") and got["c"] == ("red", 2, 1, 0, "named")
    assert got["e"] == ("red", 1, 2, 0, "corroborated")
    assert got["a"] == ("red", 0, 1, 1, "conflicting")  # e agrees, and h, named later, does not


def collisions(names):
    keys = [n.split("$")[0].lower() for n in {n.split("$")[0] for n in names}]
    folders = {"/".join(k.split("/")[:i]) for k in keys for i in range(1, k.count("/") + 1)}
    return [k for k, n in Counter(keys).items() if n > 1 or k in folders]


def test_repair_ends_without_collisions_and_moves_families(spark):
    names = ["p/A", "p/a", "p/a$In", "p/A/q", "p/a_1", "p/A_1", "p/b", "p/b$x", "p/b$x$y", "p/b/c", "p/b_0", "z", "z/y", None, "p/A"]
    got = {r.name: r.final for r in fixpoints.repaired(spark.createDataFrame([(n,) for n in names], "name string"), 10).collect()}
    assert got.keys() == {n for n in names if n}
    assert not collisions(got.values()) and len(set(got.values())) == len(got)
    assert got["p/b$x"] == got["p/b"] + "$x" and got["p/b$x$y"] == got["p/b"] + "$x$y" and got["p/A/q"] == "p/A/q" and got["z/y"] == "z/y"
    again = {r.name: r.final for r in fixpoints.repaired(spark.createDataFrame([(n,) for n in reversed(names)], "name string"), 10).collect()}
    assert again == got
    with pytest.raises(ValueError, match="still collide after 1"):
        fixpoints.repaired(spark.createDataFrame([(n,) for n in names], "name string"), 1)


def test_visible_classes_by_channel_and_precedence(spark):
    classes = ["p/Box", "p/Box$Lid", "q/Box", "r/Box", "r/Jar", "s/Jar", "base/Str", "p/Outer$Box", "q/Cup", "q/Cup$Rim", "deep/pkg/Cls$In", "p/Str"]
    mentions = [(1, "Box"), (2, "Box"), (2, "Jar"), (1, "Str"), (2, "Str"), (3, "Cup.Rim"), (3, "Cup"), (1, "deep.pkg.Cls.In"), (1, "Nope"), (1, ""), (1, None), (1, "Box")]
    units, imports, stars = [(1, "p", "p/Outer"), (2, "x", "x/T"), (3, "p", "p/T")], [(3, "q.Cup")], [(2, "r"), (2, "s"), (2, "q")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = make(mentions, "unit int, token string")
    found = scopes.visible(asked, make([(c,) for c in classes], "name string"), make(units, "unit int, package string, top string"), make(imports, "unit int, target string"), make(stars, "unit int, package string"), "base")
    got = {(r.unit, r.token): (r.state, r.name, r.channels, r.candidates, r.hidden) for r in scopes.triaged(asked, found).collect() if r.token}
    assert got[1, "Box"] == ("exact", "p/Outer$Box", "nested,same_package", 1, 1)  # the nested class hides the package's
    assert got[2, "Box"] == ("ambiguous", None, "wildcard_import", 2, 0) and got[2, "Jar"][:2] == ("ambiguous", None)
    assert got[1, "Str"] == ("exact", "p/Str", "same_package,base", 1, 1) and got[2, "Str"] == ("exact", "base/Str", "base", 1, 0)
    assert got[3, "Cup.Rim"] == ("exact", "q/Cup$Rim", "explicit_import", 1, 0) and got[3, "Cup"][:2] == ("exact", "q/Cup")
    assert got[1, "deep.pkg.Cls.In"] == ("exact", "deep/pkg/Cls$In", "qualified", 1, 0) and got[1, "Nope"] == ("missing", None, "", 0, 0)


def test_collisions_hang_together(spark):
    names = ["p/A", "p/a", "p/a/x", "P/A/x/y", "q", "q/r", "lone/one", "lone2", None, "p/A", "s/T", "s/t"]
    got = {r.name: (r.component, r.size, r.relation) for r in scopes.colliding(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    first = min(n for n in names if n and n.lower().startswith("p"))
    assert got == {"p/A": (first, 4, "folder"), "p/a": (first, 4, "folder"), "p/a/x": (first, 4, "both"), "P/A/x/y": (first, 4, "inside"), "q": ("q", 2, "folder"), "q/r": ("q", 2, "inside"), "s/T": ("s/T", 2, "case"), "s/t": ("s/T", 2, "case")}


def test_a_frozen_table_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/frozen"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert sorted(map(str, checks.frozen(df, path).collect())) == sorted(map(str, df.collect()))
    before = sorted(p.name for p in (tmp_path / "frozen/rows").iterdir())
    assert checks.frozen(df.repartition(5), path).count() == 3  # the same rows in another order
    for other in (df.distinct(), df.where("k = 2"), df.withColumn("v", F.coalesce("v", F.lit("null"))), df.withColumnRenamed("v", "w")):
        with pytest.raises(ValueError, match="other rows"):
            checks.frozen(other, path)
    assert sorted(p.name for p in (tmp_path / "frozen/rows").iterdir()) == before
    df.write.parquet(f"{path}-half/rows")
    with pytest.raises(ValueError, match="never finished"):
        checks.frozen(df, f"{path}-half")
    assert checks.digest_of(df.where("false")).first()["n"] == 0
