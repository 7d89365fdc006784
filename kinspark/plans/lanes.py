"""Evidence lanes over the two halves of the event log: users own targets (event types of a part of the day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks, evidence, lineage, matching, sequences
from ..sources.shared import settled
from .tables import Catalogue, table, year

query = Catalogue()

KEY = ["user_id", "target"]
#: Observations: target is the event type by half of the day, op whether the value is high, method the third of the month, ordinal the event's
#: place among the target's, prev and next the types around it in the half, size the value in tens.
OBSERVED = """SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY ts, event_id) AS ordinal FROM (
  SELECT event_id, ts, user_id, value, event_type || (hour(ts) // 12) AS target, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS op, 'm' || (day(ts) // 11) AS method, floor(value / 10)::INT AS size,
   coalesce(lag(event_type) OVER w, '^') AS prev, coalesce(lead(event_type) OVER w, '$') AS next FROM events WHERE event_id % 2 = {k} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
FRONTIER = "f AS (SELECT DISTINCT user_id, event_type || (hour(ts) // 12) AS target FROM events)"


def _side(spark: SparkSession, sf: str, k: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    half = table(spark, sf, "events").where(F.col("event_id") % 2 == k)
    seen = half.select(
        "event_id", "ts", "user_id", "value", F.concat("event_type", F.floor(F.hour("ts") / 12).cast("string")).alias("target"), F.when(F.col("value") > 20, "high").otherwise("low").alias("op"), F.concat(F.lit("m"), F.floor(F.dayofmonth("ts") / 11).cast("string")).alias("method"),
        F.floor(F.col("value") / 10).cast("int").alias("size"), F.coalesce(F.lag("event_type").over(w), F.lit("^")).alias("prev"), F.coalesce(F.lead("event_type").over(w), F.lit("$")).alias("next"),
    )
    return seen.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id", "target").orderBy("ts", "event_id")))


def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", F.concat("event_type", F.floor(F.hour("ts") / 12).cast("string")).alias("target")).distinct()


def _signed(k: int, parts: str, where: str = "true") -> str:
    kind = " || ':' || ".join(f"({p})::VARCHAR" for p in parts.split(", "))
    return f"""SELECT *, count(*) OVER (PARTITION BY user_id, signature) AS alike FROM (SELECT user_id, target, sum(c)::BIGINT AS n, count(*) AS kinds, sha256(string_agg(kind || '*' || c, ',' ORDER BY kind || '*' || c)) AS signature
      FROM (SELECT user_id, target, {kind} AS kind, count(*) AS c FROM ({OBSERVED.format(k=k)}) WHERE {where} GROUP BY ALL) GROUP BY ALL)"""


def _outcome(least: int = 1, exactly: int | None = None, unique: bool = True) -> str:
    single = f"WHEN a.kinds <> {exactly} THEN 'not_single'" if exactly else ""
    alone = "WHEN a.alike > 1 OR b.alike > 1 THEN 'not_unique'" if unique else ""
    return f"""CASE WHEN a.n IS NULL AND b.n IS NULL THEN 'no_usage' WHEN a.n IS NULL OR b.n IS NULL THEN 'one_sided' WHEN a.signature <> b.signature THEN 'changed' WHEN a.n < {least} THEN 'too_few' {single} {alone} ELSE 'accepted' END"""


def _lane_sql(parts: str, where: str = "true", **how) -> str:
    return f"""WITH {FRONTIER} SELECT f.user_id, f.target, {_outcome(**how)} AS outcome FROM f
      LEFT JOIN ({_signed(0, parts, where)}) a ON a.user_id = f.user_id AND a.target = f.target LEFT JOIN ({_signed(1, parts, where)}) b ON b.user_id = f.user_id AND b.target = f.target"""


def _lane(name: str, doc: str, parts: str, where: str = "true", **how):
    """Register one lane: its observations' parts, which of them count, and what it asks for."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        old, new = (_side(spark, sf, k).where(where) for k in (0, 1))
        return evidence.lane(_frontier(spark, sf), old, new, *KEY, parts.split(", "), **how)

    run.__doc__ = doc
    return query(name, _lane_sql(parts, where, **how))(run)


_lane("lane_position", "Where in a method, by which operation and as which of the target's accesses: two observations or more.", "method, op, ordinal", least=2)
_lane("lane_constant", "The sizes that are written to a target.", "size")
_lane("lane_method_context", "The types around each access, by method and operation.", "method, prev, next", least=2)
_lane("lane_nonunique_context", "Equal contexts that other targets may have too; something else must carry the proof.", "op", unique=False)
_lane("lane_single_context", "One context alone, however often.", "op, method", exactly=1)
_lane("lane_usage_topology", "How often each operation occurs in each method.", "method, op", least=3)
_lane("lane_outgoing_references", "What follows the target's accesses, as a multiset.", "next", least=2)
_lane("lane_inbound_callers", "What leads to the target's accesses, and how.", "prev, op", least=2)
_lane("lane_literals", "Only accesses of high value, by their size.", "size", where="op = 'high'")


def _globally(k: int, parts: str) -> str:
    return f"SELECT signature, min(user_id) AS user_id, min(target) AS target FROM ({_signed(k, parts)}) GROUP BY 1 HAVING count(*) = 1"


@query("lane_raw_exact", f"""SELECT a.user_id AS old_user_id, a.target AS old_target, b.user_id AS new_user_id, b.target AS new_target FROM ({_globally(0, 'op, method, size')}) a JOIN ({_globally(1, 'op, method, size')}) b USING (signature)""")
def lane_raw_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose observations no other target of any user has, on both sides."""
    return evidence.globally_unique(_frontier(spark, sf), _side(spark, sf, 0), _side(spark, sf, 1), *KEY, ["op", "method", "size"])


def _tokens(k: int) -> str:
    return f"SELECT user_id, target, CASE WHEN count(*) OVER (PARTITION BY op_mix) = 1 THEN op_mix ELSE 'shape' || n END AS token FROM (SELECT user_id, target, sum(c)::BIGINT AS n, string_agg(op || '*' || c, ',' ORDER BY op) || '/' || sum(sizes)::BIGINT AS op_mix FROM (SELECT user_id, target, op, count(*) AS c, sum(size) AS sizes FROM ({OBSERVED.format(k=k)}) GROUP BY ALL) GROUP BY ALL)"


@query("lane_shared_tokens", f"""
SELECT a.user_id AS old_user_id, a.target AS old_target, b.user_id AS new_user_id, b.target AS new_target, token FROM ({_tokens(0)}) a JOIN ({_tokens(1)}) b USING (token) WHERE token NOT LIKE 'shape%'""")
def lane_shared_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Targets named by a token of their operations and sizes where that names one target on each side; others have their shape's."""

    def side(k: int, name: str) -> DataFrame:
        counted = _side(spark, sf, k).groupBy(*KEY, "op").agg(F.concat_ws("*", "op", F.count(F.lit(1)).cast("string")).alias("line"), F.sum("size").alias("sizes"))
        grouped = counted.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("ops"), F.sum("sizes").alias("sizes"))
        mix = F.concat_ws("/", "ops", F.col("sizes").cast("string"))
        alone = F.count(F.lit(1)).over(Window.partitionBy("token")) == 1
        found = grouped.select(*KEY, mix.alias("token")).withColumn("alone", alone).where("alone")
        return found.select("token", *(F.col(c).alias(f"{name}_{c}") for c in KEY))

    return side(0, "old").join(side(1, "new"), "token")


_PRINT = "SELECT user_id, day(ts) AS method, sha256(string_agg(op, '>' ORDER BY ts, event_id)) AS print, count(*) AS n FROM ({}) GROUP BY ALL HAVING count(*) > 1"


@query("lane_full_method", f"""
SELECT a.user_id, a.method AS old_method, b.method AS new_method, a.n FROM ({_PRINT.format(OBSERVED.format(k=0))}) a JOIN ({_PRINT.format(OBSERVED.format(k=1))}) b USING (user_id, print)""")
def lane_full_method(spark: SparkSession, sf: str) -> DataFrame:
    """Methods (days) whose whole sequence of operations, targets masked, is the same on both sides."""

    def prints(k: int, name: str) -> DataFrame:
        steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("op").alias("s"))))
        found = _side(spark, sf, k).groupBy("user_id", F.dayofmonth("ts").cast("long").alias(f"{name}_method")).agg(F.transform(steps, lambda x: x.s).alias("steps")).where(F.size("steps") > 1)
        return found.select("user_id", f"{name}_method", F.sha2(F.array_join("steps", ">"), 256).alias("print"), F.size("steps").cast("long").alias("n"))

    return prints(0, "old").join(prints(1, "new").drop("n"), ["user_id", "print"]).drop("print")


_CHAIN = [("position", None, "method, op", {"least": 2}), ("constant", "changed", "op", {}), ("nonunique", "not_unique", "op", {"unique": False}), ("loose", "too_few", "op", {"unique": False})]


def _chain_sql() -> str:
    ctes, parts = [FRONTIER], []
    before = "f"
    for i, (name, reason, observed, how) in enumerate(_CHAIN):
        rows = before if i == 0 else f"(SELECT user_id, target FROM c{i - 1} WHERE outcome = '{reason}')"
        ctes.append(f"""l{i} AS (SELECT f.user_id, f.target, '{name}' AS lane, {_outcome(**how)} AS outcome FROM {rows} f
          LEFT JOIN ({_signed(0, observed)}) a ON a.user_id = f.user_id AND a.target = f.target LEFT JOIN ({_signed(1, observed)}) b ON b.user_id = f.user_id AND b.target = f.target)""")
        kept = "" if i == 0 else f"SELECT * FROM c{i - 1} WHERE outcome <> '{reason}' UNION ALL "
        ctes.append(f"c{i} AS ({kept}SELECT * FROM l{i})")
        parts.append(name)
    return f"WITH {', '.join(ctes)} SELECT * FROM c{len(_CHAIN) - 1}"


@query("evidence_ledger", _chain_sql())
def evidence_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Four lanes, each on what the one before rejected for one reason; every frontier row has one outcome."""
    frontier = settled(_frontier(spark, sf), "frontier")
    old, new = (settled(_side(spark, sf, k).select(*KEY, "method", "op"), "observations") for k in (0, 1))
    # Lanes that look at the same parts share their signatures.
    both = {parts: settled(evidence.compared(frontier, old, new, *KEY, parts.split(", ")), "signatures") for parts in dict.fromkeys(c[2] for c in _CHAIN)}

    def judge(parts: str, how: dict):
        return lambda rows: evidence.outcomes(both[parts].join(rows, KEY, "left_semi"), *KEY, **how)

    return evidence.chain(frontier, KEY, [(name, reason, judge(parts, how)) for name, reason, parts, how in _CHAIN])


@query("topology_match", """
WITH s AS (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS shape FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), t AS (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS shape FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
 c AS (SELECT s.p_brand, s.p_type AS old_type, t.p_type AS new_type FROM s JOIN t ON s.p_brand = t.p_brand AND s.n = t.n AND s.shape = t.shape)
SELECT p_brand, old_type, new_type FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, old_type) AS a, count(*) OVER (PARTITION BY p_brand, new_type) AS b FROM c) WHERE a = 1 AND b = 1""")
def topology_match(spark: SparkSession, sf: str) -> DataFrame:
    """Types matched inside their brand by equal shape, where either side's is the only one."""
    part = table(spark, sf, "part")
    shape = lambda k, name: part.where(F.col("p_partkey") % 2 == k).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_size").alias("shape")).withColumnRenamed("p_type", name)
    pairs = shape(0, "old_type").join(shape(1, "new_type"), ["p_brand", "n", "shape"]).withColumn("l", F.concat_ws("~", "p_brand", "old_type")).withColumn("r", F.concat_ws("~", "p_brand", "new_type"))
    return evidence.both_ways(pairs, "l", "r").select("p_brand", "old_type", "new_type")


@query("literal_tiers", """
WITH a AS (SELECT DISTINCT user_id, event_type || floor(value / 12)::INT AS w FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type || floor(value / 12)::INT AS w FROM events WHERE event_id % 2 = 1),
 h AS (SELECT a.user_id, count(b.w) AS shared, count(*) AS own FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.w = a.w GROUP BY 1), m AS (SELECT user_id, count(*) AS other FROM b GROUP BY 1)
SELECT user_id, shared, own, CASE WHEN shared = own AND other = own THEN 'exact' WHEN shared / own >= 0.8 THEN 'strong' WHEN shared > 0 THEN 'partial' ELSE 'none' END AS tier FROM h LEFT JOIN m USING (user_id)""")
def literal_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a user's set of values the other half of the log corroborates."""
    events = table(spark, sf, "events")
    word = F.concat("event_type", F.floor(F.col("value") / 12).cast("int").cast("string"))
    a, b = (events.where(F.col("event_id") % 2 == k).select("user_id", word.alias("w")) for k in (0, 1))
    return evidence.tiers(a, b, "user_id", "w")


@query("anchor_graph", """
WITH e AS (SELECT user_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_id % 2 AS k FROM events),
 o AS (SELECT user_id, s AS node, k, string_agg(DISTINCT t, ',' ORDER BY t) AS outs FROM e WHERE t IS NOT NULL GROUP BY ALL), i AS (SELECT user_id, t AS node, k, string_agg(DISTINCT s, ',' ORDER BY s) AS ins FROM e WHERE t IS NOT NULL GROUP BY ALL),
 n AS (SELECT user_id, node, k, coalesce(ins, '') AS ins, coalesce(outs, '') AS outs FROM o FULL JOIN i USING (user_id, node, k))
SELECT user_id, node, a.ins = b.ins AS same_in, a.outs = b.outs AS same_out FROM (SELECT * FROM n WHERE k = 0) a JOIN (SELECT * FROM n WHERE k = 1) b USING (user_id, node)""")
def anchor_graph(spark: SparkSession, sf: str) -> DataFrame:
    """In and out neighbourhood sets of each node of a user's log in both halves."""
    after = F.lead("event_type").over(sequences.ordered("user_id", "ts", "event_id"))
    steps = table(spark, sf, "events").select("user_id", F.col("event_type").alias("s"), after.alias("t"), (F.col("event_id") % 2).alias("k")).where("t IS NOT NULL")
    ends = steps.select("user_id", F.col("s").alias("node"), "k", F.col("t").alias("o"), F.lit(None).cast("string").alias("i")).unionByName(steps.select("user_id", F.col("t").alias("node"), "k", F.lit(None).cast("string").alias("o"), F.col("s").alias("i")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    sets = ends.groupBy("user_id", "node", "k").agg(joined("i").alias("ins"), joined("o").alias("outs"))
    sides = sets.groupBy("user_id", "node").pivot("k", [0, 1]).agg(F.first("ins").alias("ins"), F.first("outs").alias("outs"))
    return sides.where("`0_ins` IS NOT NULL AND `1_ins` IS NOT NULL").select("user_id", "node", (F.col("0_ins") == F.col("1_ins")).alias("same_in"), (F.col("0_outs") == F.col("1_outs")).alias("same_out"))


@query("review_spec", f"""SELECT user_id, target, 'P' || upper(substr(sha256(length(user_id::VARCHAR) || ':' || user_id || '|' || length(target) || ':' || target), 1, 12)) AS proposal_id
FROM ({_lane_sql('method, op', least=3)}) WHERE outcome = 'accepted'""")
def review_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows of a lane, worked out anew, under ids made from what they say."""
    old, new = (_side(spark, sf, k) for k in (0, 1))
    found = evidence.lane(_frontier(spark, sf), old, new, *KEY, ["method", "op"], least=3).where("outcome = 'accepted'")
    return found.select(*KEY, F.concat(F.lit("P"), checks.body_digest(KEY, 12)).alias("proposal_id"))


@query("class_witnesses", """
WITH w AS (SELECT l_suppkey AS owner, l_partkey AS witness, min(l_orderkey) AS o, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) >= 2)
SELECT owner, count(*) AS witnesses, count(*) FILTER (WHERE n > 2) AS strong, min(witness) AS first_witness FROM w GROUP BY 1""")
def class_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks for each supplier: parts with two returned lines or more."""
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("owner"), "l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return seen.groupBy("owner").agg(F.count(F.lit(1)).alias("witnesses"), F.count_if(F.col("n") > 2).alias("strong"), F.min("l_partkey").alias("first_witness"))


@query("counterfactual_impact", """
WITH c AS (SELECT event_id % 2 AS k, event_type AS t, user_id % 20 AS g, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT k, CASE WHEN t = 'click' THEN 'view' ELSE t END AS t, g, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
SELECT g, count(*) FILTER (WHERE kind = 'now' AND a = b) AS equal_now, count(*) FILTER (WHERE kind = 'then' AND a = b) AS equal_then FROM (
 SELECT 'now' AS kind, g, t, max(n) FILTER (WHERE k = 0) AS a, max(n) FILTER (WHERE k = 1) AS b FROM c GROUP BY ALL UNION ALL SELECT 'then', g, t, max(n) FILTER (WHERE k = 0), max(n) FILTER (WHERE k = 1) FROM m GROUP BY ALL) GROUP BY 1""")
def counterfactual_impact(spark: SparkSession, sf: str) -> DataFrame:
    """How many counts of a group agree between the halves now, and would if clicks were views."""
    events = table(spark, sf, "events").select((F.col("event_id") % 2).alias("k"), F.col("event_type").alias("t"), (F.col("user_id") % 20).alias("g"))
    alias = F.when(F.col("t") == "click", "view").otherwise(F.col("t"))
    kinds = F.explode(F.array(F.struct(F.lit("now").alias("kind"), F.col("t").alias("t")), F.struct(F.lit("then").alias("kind"), alias.alias("t"))))
    counted = events.select("k", "g", kinds.alias("x")).groupBy("g", "x").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") == 1).alias("b"))
    same = lambda kind: F.count_if((F.col("x.kind") == kind) & (F.col("a") == F.col("b")))
    return counted.groupBy("g").agg(same("now").alias("equal_now"), same("then").alias("equal_then"))


MEMBERS = """SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus || o_orderpriority AS name, o_orderstatus AS shape, floor(o_totalprice / 100000)::INT AS detail FROM orders WHERE o_orderdate >= '{0}-01-01' AND o_orderdate < '{1}-01-01'"""
_STAGES = (("stable_symbol", ["name", "detail"]), ("structural_unique", ["shape", "detail"]))


def _members(spark: SparkSession, sf: str, y: int) -> DataFrame:
    rows = table(spark, sf, "orders").where(year("o_orderdate", y))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.concat("o_orderstatus", "o_orderpriority").alias("name"), F.col("o_orderstatus").alias("shape"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("detail"))


def _match_sql() -> str:
    ctes, a, b = [f"o AS ({MEMBERS.format(1996, 1997)})", f"n AS ({MEMBERS.format(1997, 1998)})"], "o", "n"
    out = []
    for i, (stage, key) in enumerate(_STAGES):
        k = "owner, " + ", ".join(key)
        ctes.append(f"m{i} AS (SELECT owner, x.id AS old_id, y.id AS new_id, '{stage}' AS stage FROM (SELECT {k}, min(id) AS id FROM {a} GROUP BY {k} HAVING count(*) = 1) x JOIN (SELECT {k}, min(id) AS id FROM {b} GROUP BY {k} HAVING count(*) = 1) y USING ({k}))")
        ctes.append(f"o{i} AS (SELECT * FROM {a} WHERE id NOT IN (SELECT old_id FROM m{i}))")
        ctes.append(f"n{i} AS (SELECT * FROM {b} WHERE id NOT IN (SELECT new_id FROM m{i}))")
        a, b = f"o{i}", f"n{i}"
        out.append(f"SELECT * FROM m{i}")
    return f"WITH {', '.join(ctes)}, m AS ({' UNION ALL '.join(out)})"


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = (settled(_members(spark, sf, y), "members") for y in (1996, 1997))
    owners = old.select(F.col("owner").alias("old_owner")).distinct().select("old_owner", F.col("old_owner").alias("new_owner"))
    return old, new, matching.within_owners(old, new, owners, "owner", "id", _STAGES)


@query("member_match", f"{_match_sql()} SELECT * FROM m")
def member_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in two years, matched inside the customer: by name and detail, then by shape and detail."""
    return _matched(spark, sf)[2].select(F.col("old_owner").alias("owner"), "old_id", "new_id", "stage")


@query("member_delta", f"""{_match_sql()}
SELECT coalesce(o.owner, n.owner) AS owner, coalesce(o.id, -1) AS old_id, coalesce(n.id, -1) AS new_id, CASE WHEN n.id IS NULL THEN 'removed' WHEN o.id IS NULL THEN 'new' WHEN o.shape = n.shape AND o.detail = n.detail AND o.name = n.name THEN 'unchanged'
  WHEN o.shape = n.shape AND o.detail = n.detail THEN 'renamed' ELSE 'modified' END AS delta FROM o LEFT JOIN m ON m.old_id = o.id FULL JOIN n ON n.id = m.new_id""")
def member_delta(spark: SparkSession, sf: str) -> DataFrame:
    old, new, matched = _matched(spark, sf)
    return lineage.member_deltas(old, new, matched, "owner", "id", "name", "shape", "detail").fillna(-1, ["old_id", "new_id"])
