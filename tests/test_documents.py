"""Properties that refer to each other, and coordinates of POM files."""

from __future__ import annotations

import random
import re

import pytest

from kinspark.functions import text
from kinspark.operators import scoring, sequences
from kinspark.sources import documents


def resolved(rows):
    """Round by round, a property at a time."""
    held = {}
    for o, k, v in rows:
        if None not in (o, k, v):
            held[o, k] = max(v, held.get((o, k), v))
    refs = {at: set(re.findall(r"\$\{([^}]*)\}", v)) for at, v in held.items()}
    done, n = {at: (v, 0) for at, v in held.items() if not refs[at]}, 0
    while True:
        n += 1
        fresh = {at: (re.sub(r"\$\{([^}]*)\}", lambda m: done[at[0], m[1]][0], held[at]), n) for at in held.keys() - done.keys() if all((at[0], r) in done for r in refs[at])}
        if not fresh:
            break
        done |= fresh
    unknown, more = set(), {at for at in held if any((at[0], r) not in held for r in refs[at])}
    while more:
        unknown |= more
        more = {at for at in held if any((at[0], r) in unknown for r in refs[at])} - unknown
    return {at: (*done[at], "resolved") if at in done else (held[at], -1, "unknown" if at in unknown else "cycle") for at in held}


@pytest.mark.parametrize("seed", [1, 2])
def test_references_resolve_to_a_fixpoint(spark, seed):
    rng = random.Random(seed)
    ref = lambda: "${k%d}" % rng.randrange(40)
    rows = [(o, f"k{k}", rng.choice(["plain", "a$b {x}", "", ref(), f"x-{ref()}/{ref()}", f"{ref()}{ref()}{ref()}", f"$${ref()}", "${gone}" if k % 9 == 0 else "end"])) for o in "ab" for k in range(36)]
    rows += [("c", f"k{k}", "${k%d}!" % (k + 1)) for k in range(15)] + [("c", "k15", "last"), ("c", "k15", "first"), ("d", "x", "${y}"), ("d", "y", "${x}"), ("d", "z", "${x}${nope}"), (None, "k", "v"), ("e", None, "v"), ("e", "k", None), ("f", "k", "${k}")]
    got = {(r.owner, r.key): (r.value, r.round, r.state) for r in documents.interpolated(spark.createDataFrame(rows, "owner string, key string, value string")).collect()}
    assert got == resolved(rows)
    assert got["c", "k0"] == ("last" + "!" * 15, 15, "resolved") and got["d", "x"][2] == "cycle" and got["d", "z"][2] == "unknown"
    with pytest.raises(ValueError, match="still resolve after 3"):
        documents.interpolated(spark.createDataFrame(rows, "owner string, key string, value string"), 3)


POM = """<project><properties><v>1.2</v><!-- <v>9</v> --><full.version>${v}-${kind}</full.version><kind>final</kind><loop>${loop}</loop></properties>
<dependencies><dependency><groupId>g</groupId><artifactId>a-${kind}</artifactId><version>${full.version}</version></dependency>
<dependency><groupId>${group}</groupId><artifactId>b</artifactId><version>${loop}</version></dependency><dependency><groupId>h</groupId><artifactId>c</artifactId></dependency></dependencies></project>"""


def test_pom_coordinates_by_chained_properties(spark, tmp_path):
    (tmp_path / "pom.xml").write_text(POM)
    (tmp_path / "other.xml").write_text(POM.replace("<v>1.2", "<v>7"))
    got = {(r.path.rsplit("/", 1)[1], r.place, r.field): (r.value, r.state) for r in documents.pom_authority(spark, f"{tmp_path}/*.xml").collect()}
    assert got["pom.xml", 0, "version"] == ("1.2-final", "resolved") and got["other.xml", 0, "version"] == ("7-final", "resolved")
    assert got["pom.xml", 0, "artifactId"] == ("a-final", "resolved") and got["pom.xml", 1, "artifactId"] == ("b", "resolved")
    assert got["pom.xml", 1, "groupId"] == ("${group}", "unknown") and got["pom.xml", 1, "version"] == ("${loop}", "cycle")
    assert len(got) == 16 and ("pom.xml", 2, "version") not in got


def test_nesting_of_any_depth_and_halves_to_even(spark):
    deep = "a," + "f(" * 30 + "x,y" + ")" * 30
    lists = [(deep, 2), ("a", 1), (" ", 0), ("a,b,", 3), ("f(a,b),g<h,[i,{j,k}]>,l", 3), ("a),b", 2), ("(a,b", 1)]
    df = spark.createDataFrame(lists, "l string, n int")
    assert [tuple(r) for r in df.select(text.top_level_count(df.l).alias("got"), "n").collect()] == [(n, n) for _, n in lists]
    sizes = spark.createDataFrame([(1, 2000000), (3, 2000000), (0, 0), (0, 5)], "a int, b int")  # 0.0000005 and 0.0000015
    assert [r.s for r in sizes.select(text.size_similarity(sizes.a, sizes.b).alias("s")).collect()] == [0.0, 0.000002, 1.0, 0.0]


def test_successors_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("hot", k) for k in rng.sample(range(4000), 1500)] + [(rng.choice("abc"), k) for k in range(60)] + [(None, 3), (None, 8)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {tuple(r) for r in sequences.successors(spark.createDataFrame(rows, "g string, k int"), "g", "k").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = set()
    for g in {g for g, _ in rows}:
        keys = sorted(k for h, k in rows if h == g)
        want |= {(g, a, b) for a, b in zip(keys, keys[1:], strict=False)}
    assert got == want


def test_rarest_tokens_with_a_token_in_every_owner(spark):
    rows = [(o, t) for o in range(60) for t in ("the", f"w{o % 7}", f"x{o % 3}", "the", f"own{o}")] + [(99, "the")]
    tokens, owners = spark.createDataFrame(rows, "o int, t string"), spark.createDataFrame([(o,) for o in [*range(60), 99, 100]], "o int")
    got = {(r.o, r.rank): (r.t, r.df) for r in scoring.idf_top(tokens, owners, "o", "t", 3).collect()}
    assert got[5, 1] == ("own5", 1) and got[5, 2] == ("w5", 8) and got[5, 3] == ("x2", 20) and got[99, 1] == ("the", 61) and (99, 2) not in got and (100, 1) not in got
