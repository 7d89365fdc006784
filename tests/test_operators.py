"""Operators on small cases worked out by hand."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from kinspark.functions import text
from kinspark.operators import checks, diffing, edits, evidence, graph, lineage, matching, scoring, sequences
from kinspark.sources import archive, documents, logs
from kinspark.streaming import appends


def test_unique_match_needs_one_row_on_both_sides(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "id int, k string")
    new = spark.createDataFrame([(11, "a"), (12, "b"), (13, "c"), (14, "c"), (15, None)], "id int, k string")
    assert [tuple(r) for r in matching.unique_match(old, new, ["k"], "id").select("old_id", "new_id").collect()] == [(1, 11)]


def test_cascade_leaves_matched_rows_out(spark):
    schema = "id int, k string, j string"
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], schema)
    new = spark.createDataFrame([(11, "a", "z"), (12, "q", "x"), (13, "r", "y")], schema)
    got = matching.cascade(old, new, [("first", ["k"]), ("second", ["j"])], "id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 11, "first"), (2, 12, "second"), (3, 13, "second")]


def test_mutual_best_reports_no_tie(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 2, 0.8), (2, 1, 0.8), (3, 3, 0.4)], "l int, r int, score double")
    assert sorted(tuple(x) for x in matching.mutual_best(pairs, "l", "r", 0.1).select("l", "r", "lead").collect()) == [(1, 1, 0.4), (3, 3, 0.4)]


def test_within_band_equals_the_plain_predicate(spark):
    a = spark.createDataFrame([(i, i % 3, i * 7.3 % 50) for i in range(60)], "a int, k int, x double")
    b = spark.createDataFrame([(i, i % 3, i * 5.1 % 50 - 5) for i in range(60)], "b int, k int, y double")
    got = {(r.a, r.b) for r in matching.within_band(a, b, "k", "x", "y", 4.0).collect()}
    assert got == {(r.a, r.b) for r in a.join(b, "k").where("abs(x - y) <= 4.0").collect()}


def test_outer_diff_and_percent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, d string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "c")], "k int, d string")
    got = {r.k: r.status for r in diffing.outer_diff(old, new, "k", "d").collect()}
    assert got == {1: "same", 2: "changed", 3: "removed", 4: "added"}
    row = spark.range(1).select(diffing.percent(F.lit(1), F.lit(3)).alias("a"), diffing.percent(F.lit(0), F.lit(0), 100.0).alias("b")).first()
    assert tuple(row) == (33.3333, 100.0)


def test_scores(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 1)], "o int, t string, n int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "x int, y int")
    got = {(r.x, r.y): r.jaccard for r in scoring.multiset_jaccard(pairs, counts, "x", "y", "o", "t").collect()}
    assert got == {(1, 2): 0.25, (1, 3): 0.0, (3, 4): None}
    evidence = spark.createDataFrame([("t", "f", 0.5), ("t", "f", 0.4), ("t", "g", 0.5), ("u", "f", 1.0)], "t string, f string, w double")
    assert {r.t: r.score for r in scoring.noisy_or(evidence, "t", "f", F.col("w")).collect()} == {"t": 0.75, "u": 0.995}
    row = spark.range(1).select(scoring.weighted_mean([(F.lit(1.0), 0.6), (F.lit(None).cast("double"), 0.4)]).alias("m"), scoring.weighted_mean([(F.lit(None).cast("double"), 1.0)]).alias("n")).first()
    assert tuple(row) == (1.0, None)


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("abcab")], "o int, p int, v string")
    w = sequences.ordered("o", "p")
    before, after = sequences.nearest(F.when(F.col("v") == "a", F.col("p")), w)
    got = df.select(sequences.frame_signature("v", 1, w).alias("s"), before.alias("b"), after.alias("f"), sequences.running_ordinal(F.col("v") == "b", w).alias("n"), sequences.ends_pattern("v", ["a", "b"], w).alias("e"), "p").orderBy("p").collect()
    assert [r.s for r in got] == ["->a>b", "a>b>c", "b>c>a", "c>a>b", "a>b>-"]
    assert [r.b for r in got] == [None, 0, 0, 0, 3] and [r.f for r in got] == [3, 3, 3, None, None]
    assert [r.n for r in got] == [None, 0, None, None, 1] and [r.e for r in got] == [False, True, False, False, True]
    assert sequences.islands(df, F.col("v") == "a", w, "i").orderBy("p").select("i").toPandas().i.tolist() == [1, 1, 1, 2, 2]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    got = {(r.src, r.dst): r.hops for r in graph.closure(edges).collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (5, 6): 1, (1, 3): 2, (2, 1): 2, (3, 2): 2, (1, 1): 3, (2, 2): 3, (3, 3): 3}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a int, b int")
    got = {r.v: r.component for r in graph.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90}
    assert graph.components(chain.limit(0)).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([('{"a": {"b/c": [1, 2]}}', "https://h.example/x/y?q=1")], "j string, u string")
    row = df.select(text.pointer(F.col("j"), "/a/b~1c/1").alias("p"), text.pointer(F.col("j"), "/z").alias("z"), text.proper_prefixes(text.segments(F.col("u"))).alias("x")).first()
    assert (row.p, row.z, row.x) == ("2", None, ["h.example", "h.example/x"])
    kinds = spark.createDataFrame([("12.5",), ("MAX_SIZE",), ("a@b.co",), ("Then,",), ("é",)], "t string").select(text.literal_kind(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["number", "constant", "email", "title", "other"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert checks.stable_digest(df, ["k", "v"]).first() == checks.stable_digest(df.orderBy(F.desc("k")), ["k", "v"]).first()
    got = checks.expectations(df, [("rows", F.count(F.lit(1)), "eq", 2), ("nulls", F.count_if(F.col("v").isNull()), "lte", 0)]).collect()
    assert [(r.name, r.actual, r.holds) for r in got] == [("rows", 2, True), ("nulls", 1, False)]
    assert {(r.outcome, r.n, r.balanced) for r in checks.ledger(df, F.coalesce("v", F.lit("none"))).collect()} == {("a", 1, True), ("none", 1, True)}


def test_edit_scripts(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"])], "k int, left array<string>, right array<string>")
    assert [r.op for r in edits.edit_scripts(df, "k", "int").orderBy("step").collect()] == ["equal", "replace", "equal", "insert"]


def test_every_pair_of_neighbouring_turns_has_an_edit_script(spark, tmp_path):
    from difflib import SequenceMatcher

    from kinspark.plans.sequences import sequence_edit_script

    turns = {1: ["a b c", "a x c d", "", "x  c"], 2: ["only one"], 3: ["p q", "p q"]}
    rows = [(c, 10 * i, "user", t) for c, texts in turns.items() for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for c, texts in turns.items():
        for place, (x, y) in enumerate(zip(texts, texts[1:], strict=False), 1):
            want |= {(c, place, n, *op) for n, op in enumerate(SequenceMatcher(None, x.split(), y.split(), autojunk=False).get_opcodes())}
    assert {p for c, p, *_ in want if c == 1} == {1, 2, 3}
    got = [tuple(r) for r in sequence_edit_script(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def class_bytes(name: str, fields: list[tuple[str, str]]) -> bytes:
    """A class file with the given fields and nothing else."""
    pool: list[bytes] = []

    def utf(s: str) -> int:
        pool.append(b"\x01" + struct.pack(">H", len(s)) + s.encode())
        return len(pool)

    def ref(tag: int, s: str) -> int:
        at = utf(s)
        pool.append(bytes([tag]) + struct.pack(">H", at))
        return len(pool)

    this, parent = ref(7, name), ref(7, "java/lang/Object")
    ref(8, "literal")
    body = b"".join(struct.pack(">HHHH", 1, utf(n), utf(d), 0) for n, d in fields)
    head = b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 65, len(pool) + 1) + b"".join(pool)
    return head + struct.pack(">HHHH", 0x21, this, parent, 0) + struct.pack(">H", len(fields)) + body + struct.pack(">HH", 0, 0)


def test_archive(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/A.class", class_bytes("a/A", [("x", "I"), ("y", "La/B;")]))
        z.writestr("q/Q.class", class_bytes("q/Q", [("m", "Lq/R;"), ("n", "I")]))
        z.writestr("bad.class", b"nothing")
        z.writestr("note.txt", b"text")
    (tmp_path / "one.jar").write_bytes(raw.getvalue())
    (tmp_path / "broken.jar").write_bytes(b"no archive")
    found = archive.entries(spark, str(tmp_path)).collect()
    assert {r.path for r in found if not r.error} == {"a/A.class", "q/Q.class", "bad.class", "note.txt"} and sum(bool(r.error) for r in found) == 1
    heads = {r.path: r for r in archive.classes(spark, str(tmp_path)).collect()}
    assert heads["a/A.class"].class_name == "a/A" and heads["a/A.class"].strings == ["literal"]
    assert heads["a/A.class"].structure == heads["q/Q.class"].structure and heads["bad.class"].error


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("noise\nA.java:1: error: one\n  more\nB.java:2: error: two\n")
    lines = logs.lines(spark, str(tmp_path / "x.log")).where("line <> ''")
    got = logs.records(lines, "file", "line_no", "line", F.col("line").rlike("^[^ ]+:[0-9]+: error")).orderBy("record").collect()
    assert [(r.record, r.n_lines, r.header) for r in got] == [(0, 1, None), (1, 2, "A.java:1: error: one"), (2, 1, "B.java:2: error: two")]


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:20:00", "a"), (2, "2024-01-01 05:00:00", "b")], "user_id int, t string, event_type string").selectExpr("user_id", "timestamp(t) AS ts", "event_type").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id int, ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    for name, made in (("windows", appends.windowed_counts(stream)), ("sessions", appends.session_counts(stream))):
        made.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("windows").collect()} == {("a", 2), ("b", 1)}
    assert [r.n for r in spark.table("sessions").collect()] == [2]


def test_streaming_diff(spark, tmp_path):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "k int, d string")
    spark.createDataFrame([(1, "a"), (3, "c")], "k int, d string").write.parquet(f"{tmp_path}/in")
    builds = spark.readStream.schema("k int, d string").parquet(f"{tmp_path}/in")
    appends.diff_against(builds, known, "k", "d", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r.k, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "same"), (2, "removed"), (3, "added")}


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).schema
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("bad", [b"", b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbe" + bytes(6) + b"\x63"])
def test_class_head_rejects(bad):
    with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
        archive.class_head(bad if len(bad) != 11 else bad[:8] + b"\x00\x05" + bad[10:])


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_outer_diff_takes_nulls_as_values(spark):
    old = spark.createDataFrame([(1, None), (2, None), (3, "c")], "k int, d string")
    new = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, None)], "k int, d string")
    assert {r.k: r.status for r in diffing.outer_diff(old, new, "k", "d").collect()} == {1: "same", 2: "changed", 3: "changed", 4: "added"}


def test_inventory_and_surface(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, n string, m int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "w", 1)], "k int, n string, m int")
    assert rows_of(diffing.inventory(a, b, ["k"], ["n", "m"])) == [(1, "shared_exact", ""), (2, "metadata_difference", "m"), (3, "missing", ""), (4, "extra", "")]
    c = spark.createDataFrame([("g", 1, "s"), ("g", 2, "s"), ("h", 1, None), ("l", 1, "s")], "g string, m int, s string")
    d = spark.createDataFrame([("g", 1, "s"), ("g", 2, "t"), ("g", 3, "s"), ("h", 1, None)], "g string, m int, s string")
    assert rows_of(diffing.surface(c, d, "g", "m", "s")) == [("g", 2, 1, 1, 0, 1, "different"), ("h", 1, 1, 0, 0, 0, "equal"), ("l", 0, 0, 0, 1, 0, "left_only")]
    assert tuple(diffing.set_distance(a, b, ["k"]).first()) == (1, 1, 2, False)


def test_judged_says_why(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.8), (3, 3, 0.3), (4, 4, 0.9), (4, 5, 0.88), (5, 6, 0.9), (6, 6, 0.9)], "l int, r int, score double")
    got = {r.l: r.outcome for r in matching.judged(pairs, "l", "r", 0.1, 0.4).collect()}
    assert got == {1: "matched", 2: "not_mutual", 3: "low_score", 4: "thin_lead", 5: "matched", 6: "not_mutual"}


def test_lookup_members_and_rivals(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert rows_of(matching.looked_up(spark.createDataFrame([(1,), (2,), (3,)], "k int"), held, "k", "v").select("k", F.coalesce("v", F.lit("")), "state")) == [(1, "a", "exact"), (2, "", "several"), (3, "", "missing")]
    schema = "id int, owner string, name string, shape string"
    old = spark.createDataFrame([(1, "A", "m", "x"), (2, "A", "n", "y"), (3, "A", "p", "z"), (4, "A", "q", "z"), (5, "B", "m", "x")], schema)
    new = spark.createDataFrame([(11, "C", "m", "w"), (12, "C", "o", "y"), (13, "C", "r", "z"), (15, "D", "m", "x")], schema)
    owners = spark.createDataFrame([("A", "C")], "old_owner string, new_owner string")
    got = matching.within_owners(old, new, owners, "owner", "id", [("stable", ["name"]), ("structural", ["shape"])])
    assert rows_of(got) == [("A", "C", 1, 11, "stable"), ("A", "C", 2, 12, "structural")]
    sets = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 2), (2, "b", 3), (3, "a", 1), (4, "z", 1)], "o int, w string, n int")
    assert rows_of(matching.rivals(sets, "o", "w", 1, 5).select("o", "n_pool", "n_supersets", "state")) == [(1, 2, 1, "rivalled"), (2, 2, 0, "unrivalled"), (3, 2, 2, "rivalled"), (4, 0, 0, "unrivalled")]
    assert {r.o: r.state for r in matching.rivals(sets, "o", "w", 1, 1).collect()} == {1: "withdrawn", 2: "withdrawn", 3: "withdrawn", 4: "unrivalled"}


def test_dominance_needs_shares_and_votes(spark):
    pairs = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "z")] + [("c", "w")] * 5 + [("d", "w")] * 5, "s string, t string")
    assert [r.s for r in scoring.dominance_votes(pairs, "s", "t").collect()] == ["a"]
    assert {r.s for r in scoring.dominance_votes(pairs, "s", "t", 0.5, 1).collect()} == {"a", "b", "c"}


def test_ids_grow_beyond_their_width(spark):
    df = spark.createDataFrame([(999_999,), (1_000_000,), (1_000_001,), (7,)], "n long")
    assert [r.p for r in df.select(text.padded(F.col("n"), 6).alias("p")).collect()] == ["999999", "1000000", "1000001", "000007"]
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k")).repartition(7)
    got = {r.k: r.id for r in sequences.dense_ids(keys, "k", "N_").collect()}
    assert got == {f"k{i:04d}": f"N_{i + 1:06d}" for i in range(1000)}
    first = lineage.seed(keys.withColumnRenamed("k", "name"), "name", "1")
    more = spark.createDataFrame([("k0001",), ("zz",), ("aa",)], "name string")
    assert {(r.name, r.entity_id) for r in lineage.promoted(first, more, "1").collect()} == {("aa", "E_001001"), ("zz", "E_001002")}


def test_successors_overlaps_and_blocks(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 9), (None, 4), (None, 5)], "g string, k int")
    assert {tuple(r) for r in sequences.successors(df, "g", "k").collect()} == {("a", 1, 3), ("a", 3, 9), (None, 4, 5)}
    spans = [(1, 0, 5), (1, 5, 9), (1, 4, 6), (1, 0, 9), (1, 0, 5), (2, 1, 2)]
    want = sum(1 for i, x in enumerate(spans) for y in spans[:i] if x[0] == y[0] == 1 and x[1] < y[2] and y[1] < x[2])
    got = {r.o: r.overlaps for r in sequences.overlapping_pairs(spark.createDataFrame(spans, "o int, b int, e int"), "o", "b", "e").collect()}
    assert got == {1: want, 2: 0}
    schema = "o int, p int, a int, s string"
    old = spark.createDataFrame([(1, i, 7 if c == "#" else None, c) for i, c in enumerate("abc#xyz")] + [(2, i, None, c) for i, c in enumerate("pq")], schema)
    new = spark.createDataFrame([(1, i, 7 if c == "#" else None, c) for i, c in enumerate("abd#wyz")] + [(2, i, None, c) for i, c in enumerate("pq")], schema)
    assert rows_of(sequences.anchored_blocks(old, new, "o", "p", "a", "s")) == [(1, 0, 0, "prefix"), (1, 1, 1, "prefix"), (1, 5, 5, "suffix"), (1, 6, 6, "suffix"), (2, 0, 0, "whole"), (2, 1, 1, "whole")]


def test_cascade_reads_each_side_once_a_stage(spark, tmp_path):
    for name, rows in (("old", [(i, i % 7, i % 5) for i in range(50)]), ("new", [(i + 100, i % 7, i % 5) for i in range(50)])):
        spark.createDataFrame(rows, "id int, k int, j int").write.parquet(f"{tmp_path}/{name}")
    old, new = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new"))
    found = matching.cascade(old, new, [("a", ["k", "j"]), ("b", ["k"]), ("c", ["j"])], "id")
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") <= 3 and "Exchange" not in plan


def test_walks(spark):
    edges = spark.createDataFrame([(1, 2, True), (1, 3, True), (3, 4, True), (2, 4, True), (4, 1, True), (4, 5, False), (8, 9, True)], "src int, dst int, ok boolean")
    roots = spark.createDataFrame([(1,)], "v int")
    assert rows_of(graph.walk(edges, roots, open_=F.col("ok")).select("v", "depth", F.coalesce("parent", F.lit(0)))) == [(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 2, 2)]
    assert {r.v for r in graph.walk(edges, roots).collect()} == {1, 2, 3, 4, 5}
    chain = spark.range(30).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.v: r.depth for r in graph.walk(chain, spark.range(1).withColumnRenamed("id", "v")).collect()} == {i: i for i in range(31)}
    up = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 2)], "c int, p int")
    assert rows_of(graph.ancestors(up, spark.createDataFrame([(1,), (5,)], "v int"), "c", "p")) == [(1, 1), (1, 2), (1, 3), (5, 1), (5, 2), (5, 3)]
    rows = spark.createDataFrame([("a", 40), ("b", 3), ("c", None)], "k string, value int")
    halve = spark.createDataFrame([(i, i // 2) for i in range(4, 50)], "old int, new int")
    assert rows_of(graph.rewritten(rows.na.fill(-1), halve, 20)) == [("a", 2), ("b", 3), ("c", -1)]
    with pytest.raises(ValueError, match="not stable"):
        graph.rewritten(rows, spark.createDataFrame([(1, 2), (2, 1)], "old int, new int"), 20)


def test_components_by_doubling(spark, monkeypatch):
    made = []
    settle = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name: made.append(name) or settle(df, name))
    got = graph.components(spark.range(10_000).selectExpr("id AS a", "id + 1 AS b"))
    assert got.where("component = 0").count() == 10_001 and made.count("hooks") < 20
    loops = spark.createDataFrame([(3, 3), (4, 4), (4, 5)], "a int, b int")
    assert rows_of(graph.components(loops)) == [(3, 3), (4, 4), (5, 4)]


def test_pointer_goes_by_what_stands_there(spark):
    doc = '{"a": {"1": "x", "b\'c": 2, "n": null}, "l": [{"k": 1}, [7, 8]], "1": {"0": true}}'
    df = spark.createDataFrame([(doc,), ("[1]",), ("3",), ("no json",), (None,)], "j string")
    for path, want in (("/a/1", "x"), ("/a/b'c", "2"), ("/a/n", None), ("/l/0/k", "1"), ("/l/1/1", "8"), ("/1/0", "true"), ("/l/k", None), ("/l/9", None), ("/l/01", None)):
        got = [r.p for r in df.select(text.pointer(F.col("j"), path).alias("p")).collect()]
        assert got == [want, None, None, None, None], path
    assert df.select(text.pointer(F.col("j"), "/0").alias("p")).collect()[1].p == "1"
    with pytest.raises(ValueError):
        text.pointer(F.col("j"), "a")


def test_projected_rejects(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"j": 2}',)], "props string")
    assert rows_of(text.projected(df, "props", {}, {"k": "/k", "j": "/j"}).select(F.coalesce("k", F.lit("")), F.coalesce("j", F.lit("")))) == [("", "2"), ("1", "")]
    with pytest.raises(Exception, match="nothing at /k for k"):
        text.projected(df, "props", {"k": "/k"}).collect()
    for required, optional in (({"K": "/k"}, {"k": "/j"}), ({"Props": "/k"}, {})):
        with pytest.raises(ValueError, match="collide"):
            text.projected(df, "props", required, optional)


def test_more_text_functions(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m\r\nnext\r", "9 a-b", "f(a, b), c[d, e], g<h>", "(IJLa/B;[[D)V", 3, 8)], "l string, n string, a string, d string, x int, y int")
    row = df.select(text.plain_lines(F.col("l")).alias("l"), text.legal_name(F.col("n")).alias("n"), text.top_level_count(F.col("a")).alias("a"), text.parameter_types(F.col("d")).alias("p"), text.argument_slots(F.col("d")).alias("s"), text.parameter_types(F.lit("(Q)V")).alias("q"), text.size_similarity(F.col("x"), F.col("y")).alias("z")).first()
    assert (row.l, row.n, row.a, row.p, row.s, row.q, row.z) == ("red\nnext\n", "n_9_a_b", 3, ["I", "J", "La/B;", "[[D"], 5, None, 0.375)


def test_gates(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "c")], "l int, r string")
    assert rows_of(checks.one_to_one(pairs, "l", "r")) == [("left", "3", 2), ("right", "a", 2)]
    with pytest.raises(ValueError, match="not one to one"):
        checks.required(checks.one_to_one(pairs, "l", "r"), "not one to one")
    checks.required(checks.one_to_one(pairs.where("l = 1"), "l", "r"), "not one to one")
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "name string, digest string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "name string, digest string")
    assert rows_of(checks.pinned(a, b)) == [("w", "unpinned"), ("x", "held"), ("y", "drifted"), ("z", "gone")]
    with pytest.raises(ValueError, match="unknown expectations: odd"):
        checks.expectations(pairs, [("odd", F.count(F.lit(1)), "eq", 1)], known=["rows"])
    two = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "p string, q string").select(checks.body_digest(["p", "q"]).alias("d"))
    assert len({r.d for r in two.collect()}) == 3


def test_lineage_rules(spark):
    entities = spark.createDataFrame([(1, "ACCEPTED", "N", 0.9), (2, "ACCEPTED", "N", 0.5), (3, "UNKNOWN", "M", 0.1), (4, "CANDIDATE", None, 0.0), (5, "NEW", None, 0.2), (6, "UNKNOWN", None, 0.0), (6, "UNKNOWN", None, 0.0), (7, None, None, None), (8, "ACCEPTED", "P", 1.5)], "entity_id int, status string, name string, confidence double")
    entries = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "a", "q"), (3, "a", "r"), (4, "z", "s"), (5, "b", "t"), (6, "b", "u"), (8, "b", "v"), (9, "b", "w")], "entity_id int, build string, path string")
    want = {("accepted_name_twice", "N"), ("name_without_status", "3"), ("status_without_name", "4"), ("unknown_status", "5"), ("unknown_status", "7"), ("confidence_without_name", "5"), ("confidence_out_of_range", "7"), ("confidence_out_of_range", "8"), ("identity_twice", "6"), ("path_twice", "p"), ("build_twice", "3"), ("unknown_build", "4"), ("unknown_identity", "9"), ("no_entry", "7")}
    assert set(rows_of(lineage.validated(entities, entries, ["a", "b"], ["UNKNOWN", "CANDIDATE", "ACCEPTED"]))) == want


def test_evidence_chain_covers_its_frontier(spark):
    rows = [("u", t, s, op) for t, old, new in (("a", "xy", "yx"), ("b", "x", "x"), ("c", "zz", "zw"), ("d", "q", ""), ("e", "", ""), ("f", "kk", "kk"), ("g", "kk", "kk")) for s, ops in ((0, old), (1, new)) for op in ops]
    seen = spark.createDataFrame(rows, "o string, t string, s int, op string")
    frontier = spark.createDataFrame([("u", t) for t in "abcdefg"], "o string, t string")
    old, new = seen.where("s = 0"), seen.where("s = 1")
    one = {r.t: r.outcome for r in evidence.lane(frontier, old, new, "o", "t", ["op"], least=2).collect()}
    assert one == {"a": "accepted", "b": "too_few", "c": "changed", "d": "one_sided", "e": "no_usage", "f": "not_unique", "g": "not_unique"}
    lanes = [("strict", None, lambda f: evidence.lane(f, old, new, "o", "t", ["op"], least=2)), ("loose", "not_unique", lambda f: evidence.lane(f, old, new, "o", "t", ["op"], unique=False)), ("few", "too_few", lambda f: evidence.lane(f, old, new, "o", "t", ["op"], exactly=1))]
    ledger = {r.t: (r.lane, r.outcome) for r in evidence.chain(frontier, ["o", "t"], lanes).collect()}
    assert ledger == {"a": ("strict", "accepted"), "b": ("few", "accepted"), "c": ("strict", "changed"), "d": ("strict", "one_sided"), "e": ("strict", "no_usage"), "f": ("loose", "accepted"), "g": ("loose", "accepted")}


def test_builds_that_arrive_in_parts_are_judged_whole(spark, tmp_path):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, d string")
    schema = "b string, k int, d string"
    parts = [[("x", 1, "a"), ("y", 9, "z")], [("x", 2, "q")], [("x", 3, "c"), ("y", 1, "a")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        builds = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        appends.diff_against(builds, known, "k", "d", f"{tmp_path}/out", f"{tmp_path}/checkpoint", "b").awaitTermination()
    got = {(r.build, r.k, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("x", 1, "same"), ("x", 2, "changed"), ("x", 3, "same"), ("y", 1, "same"), ("y", 2, "removed"), ("y", 3, "removed"), ("y", 9, "added")}


def test_archives_of_rows(spark):
    rows = spark.createDataFrame([("a.zip", f"p{i}", bytes([i]) * 50) for i in range(5)] + [("a.zip", "p1", b"again"), ("b.zip", "q", b"")], "archive string, path string, content binary")
    made = archive.packed(rows).cache()
    assert {(r.archive, r.path, r.size) for r in archive.entries_of(made).collect()} == {("a.zip", f"p{i}", 50) for i in range(5)} | {("a.zip", "p1", 5), ("b.zip", "q", 0)}
    assert rows_of(archive.duplicates(archive.directory_of(made))) == [("a.zip", "p1", 2)]
    wanted = spark.createDataFrame([("a.zip", "p3"), ("a.zip", "none"), ("c.zip", "p")], "archive string, path string")
    assert [(r.path, bytes(r.content)) for r in archive.lookup(made, wanted).collect()] == [("p3", bytes([3]) * 50)]
    assert archive.packed(rows).where("path = 'a.zip'").first().content == made.where("path = 'a.zip'").first().content


def test_class_files_down_to_instructions():
    pool = [b"\x01" + struct.pack(">H", len(x)) + x for x in (b"q/Q", b"java/lang/Object", b"Code", b"m", b"(I)V", b"f", b"I", b"a\xc0\x80\xed\xa0\xbd\xed\xb8\x80")]
    pool += [b"\x07\x00\x01", b"\x07\x00\x02", b"\x0c\x00\x06\x00\x07", b"\x09\x00\x09\x00\x0b", b"\x03" + struct.pack(">i", -5), b"\x08\x00\x08"]
    code = bytes([0x2A, 0xB4, 0, 12, 0x9A, 0, 7, 0x12, 14, 0x57, 0, 0xAA]) + struct.pack(">iiiii", 5, 1, 2, 5, 9) + bytes([0xC4, 0x15, 1, 0, 0xB1])
    body = struct.pack(">HHI", 1, 1, len(code)) + code + bytes(4)
    method = struct.pack(">HHHH", 1, 4, 5, 1) + struct.pack(">HI", 3, len(body)) + body
    raw = b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 65, len(pool) + 1) + b"".join(pool) + struct.pack(">HHHH", 0x21, 9, 10, 0) + bytes(2) + struct.pack(">H", 1) + method + bytes(2)
    head = archive.class_head(raw)
    assert head["strings"] == ["a\0\U0001f600"] and head["numbers"] == ["-5"] and head["refs"] == ["q/Q.f:I"] and head["methods"][0]["code_length"] == len(code)
    rows = archive.method_rows(raw)
    assert [(at, op) for _, at, op, _, _ in rows] == [(0, 0x2A), (1, 0xB4), (4, 0x9A), (7, 0x12), (9, 0x57), (10, 0), (11, 0xAA), (32, 0xC4), (36, 0xB1)]
    assert rows[1][3] == "q/Q.f:I" and rows[2][4] == [11] and rows[6][4] == [16, 20]
    with pytest.raises(ValueError, match="beyond"):
        list(archive.instructions(b"\xb4\x00"))


def test_documents_as_tables(spark, tmp_path):
    for name, body in {"a.json": '{"k": {"x": 1}}', "b.json": '{"k": 1, "k": 2}', "c.json": "{"}.items():
        (tmp_path / name).write_text(body)
    assert {r.path.rsplit("/", 1)[1]: r.error is None for r in documents.strict_json(spark, f"{tmp_path}/*.json").collect()} == {"a.json": True, "b.json": False, "c.json": False}
    (tmp_path / "p.properties").write_text("# note\nversion=1\r\n group : a.b \n\nversion=2\n! x=y\nurl=http://h/?a=b\n")
    assert {(r.key, r.value) for r in documents.properties(spark, f"{tmp_path}/p.properties").collect()} == {("version", "2"), ("group", "a.b"), ("url", "http://h/?a=b")}
    (tmp_path / "pom.xml").write_text('<project xmlns="http://m"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version><scope>test</scope></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency></dependencies></project>')
    assert rows_of(documents.pom_dependencies(spark, f"{tmp_path}/pom.xml").select("groupId", "artifactId", F.coalesce("version", F.lit("")))) == [("g", "a", "1.0"), ("h", "b", "")]
    (tmp_path / "src" / "x").mkdir(parents=True)
    (tmp_path / "src" / "x" / "A.java").write_text("class A {}")
    (tmp_path / "src" / "B.txt").write_text("no")
    assert [(r.relative, r.size) for r in documents.source_tree(spark, f"{tmp_path}/src").collect()] == [("x/A.java", 10)]
    df = spark.createDataFrame([(2, None, "b"), (1, "z", "a")], "k int, b string, a string")
    documents.write_new(df, f"{tmp_path}/out", order=("k",))
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":"a","b":"z","k":1}', '{"a":"b","b":null,"k":2}']
    for inputs in ((), (f"{tmp_path}/out/part",), (str(tmp_path),)):
        with pytest.raises(Exception):  # noqa: B017
            documents.write_new(df, f"{tmp_path}/out", inputs=inputs)
    found = documents.scanned(df, "a", ["sed", "s/.*/&\\tX&/"], ["name", "seen"])
    assert rows_of(found) == [("a", "Xa"), ("b", "Xb")]
