"""Identities, names and risks as registers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, diffing, graph, lineage, matching, scoring
from ..sources.shared import settled
from .tables import Catalogue, table, year

query = Catalogue()

STATUSES = ["UNKNOWN", "CANDIDATE", "ACCEPTED"]
_ENTITIES = """e AS (SELECT c_custkey AS entity_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ODD' WHEN c_acctbal > 8000 THEN 'ACCEPTED' WHEN c_acctbal > 5000 THEN 'CANDIDATE' ELSE 'UNKNOWN' END AS status,
  CASE WHEN c_acctbal > 7900 THEN 'N' || c_custkey % 500 WHEN c_acctbal > 5200 THEN 'C' || c_custkey END AS name, CASE WHEN c_acctbal > 5200 THEN c_acctbal / 9900 ELSE 0.0 END AS confidence FROM customer UNION ALL
  SELECT c_custkey, 'UNKNOWN', NULL, 0.0 FROM customer WHERE c_custkey % 97 = 5),
 b AS (SELECT o_custkey + (CASE WHEN o_orderkey % 500 = 0 THEN 10000000 ELSE 0 END) AS entity_id, year(o_orderdate)::VARCHAR AS build, o_custkey % 300 || '/' || o_orderstatus || floor(o_totalprice)::BIGINT % 300 AS path FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1999-01-01')"""


@query("lineage_validation", f"""WITH {_ENTITIES}
SELECT 'unknown_status' AS rule, entity_id::VARCHAR AS key FROM e WHERE status = 'ODD' UNION ALL SELECT 'name_without_status', entity_id::VARCHAR FROM e WHERE status = 'UNKNOWN' AND name IS NOT NULL
UNION ALL SELECT 'status_without_name', entity_id::VARCHAR FROM e WHERE status IN ('CANDIDATE', 'ACCEPTED') AND name IS NULL UNION ALL SELECT 'confidence_out_of_range', entity_id::VARCHAR FROM e WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'confidence_without_name', entity_id::VARCHAR FROM e WHERE name IS NULL AND confidence <> 0 UNION ALL SELECT 'identity_twice', entity_id::VARCHAR FROM e GROUP BY entity_id HAVING count(*) > 1
UNION ALL SELECT 'accepted_name_twice', name FROM e WHERE status = 'ACCEPTED' AND name IS NOT NULL GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'build_twice', entity_id::VARCHAR FROM b GROUP BY entity_id, build HAVING count(*) > 1
UNION ALL SELECT 'path_twice', path FROM b GROUP BY build, path HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown_build', entity_id::VARCHAR FROM b WHERE build NOT IN ('1995', '1996', '1997')
UNION ALL SELECT DISTINCT 'unknown_identity', entity_id::VARCHAR FROM b WHERE entity_id NOT IN (SELECT entity_id FROM e) UNION ALL SELECT DISTINCT 'no_entry', entity_id::VARCHAR FROM e WHERE entity_id NOT IN (SELECT entity_id FROM b)""")
def lineage_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as identities and their orders as entries, against every rule of a lineage."""
    balance = F.col("c_acctbal")
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "ODD").when(balance > 8000, "ACCEPTED").when(balance > 5000, "CANDIDATE").otherwise("UNKNOWN")
    name = F.when(balance > 7900, F.concat(F.lit("N"), (F.col("c_custkey") % 500).cast("string"))).when(balance > 5200, F.concat(F.lit("C"), F.col("c_custkey").cast("string")))
    customer = table(spark, sf, "customer")
    own = customer.select(F.col("c_custkey").alias("entity_id"), status.alias("status"), name.alias("name"), F.when(balance > 5200, balance / 9900).otherwise(0.0).alias("confidence"))
    again = customer.where("c_custkey % 97 = 5").select(F.col("c_custkey").alias("entity_id"), F.lit("UNKNOWN").alias("status"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("confidence"))
    entities = settled(own.unionByName(again), "entities")
    orders = table(spark, sf, "orders").where("o_orderdate >= timestamp '1995-01-01' AND o_orderdate < timestamp '1999-01-01'")
    stray = F.when(F.col("o_orderkey") % 500 == 0, 10000000).otherwise(0)
    path = F.concat((F.col("o_custkey") % 300).cast("string"), F.lit("/"), "o_orderstatus", (F.floor("o_totalprice") % 300).cast("string"))
    entries = settled(orders.select((F.col("o_custkey") + stray).alias("entity_id"), F.year("o_orderdate").cast("string").alias("build"), path.alias("path")), "entries")
    return lineage.validated(entities, entries, ["1995", "1996", "1997"], STATUSES)


@query("propose_relationships", """
WITH a AS (SELECT o_custkey, min(o_orderpriority) AS name, count(*) AS d FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey, min(o_orderpriority) AS name, count(*) AS d FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT o_custkey, CASE WHEN a.d = b.d AND a.name = b.name THEN 'identical' WHEN a.d = b.d THEN 'renamed' WHEN a.name = b.name THEN 'changed' ELSE 'renamed_changed' END AS relation, a.d = b.d AS ready FROM a JOIN b USING (o_custkey)""")
def propose_relationships(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    side = lambda y, n: orders.where(year("o_orderdate", y)).groupBy("o_custkey").agg(F.min("o_orderpriority").alias(f"{n}_name"), F.count(F.lit(1)).alias(f"{n}_digest"))
    return lineage.relationships(side(1996, "old").join(side(1997, "new"), "o_custkey")).select("o_custkey", "relation", "ready")


_CANDIDATES = """l AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 11 = 0 THEN '1997' ELSE '1996' END AS build FROM customer WHERE c_custkey % 5 <> 0),
 c AS (SELECT o_custkey AS entity_id, o_orderpriority || o_custkey % 700 AS name, count(*) AS digest FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL),
 h AS (SELECT o_orderpriority || o_custkey % 700 AS name, count(*) AS digest FROM orders WHERE year(o_orderdate) = 1997 AND o_orderstatus <> 'P' GROUP BY ALL)"""


@query("apply_candidates", f"""WITH {_CANDIDATES}, j AS (SELECT c.*, l.build AS held, h.digest AS now, count(*) OVER (PARTITION BY c.name) AS times FROM c LEFT JOIN l USING (entity_id) LEFT JOIN h ON h.name = c.name)
SELECT entity_id, name, CASE WHEN held IS NULL THEN 'unknown_identity' WHEN held = '1997' THEN 'has_build_already' WHEN times > 1 THEN 'name_proposed_twice' WHEN now IS NULL THEN 'not_in_build' WHEN now <> digest THEN 'digest_drifted' ELSE 'applied' END AS outcome FROM j""")
def apply_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates verified again before they are appended: names by priority and group, digests from counts."""
    held = table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 11 == 0, "1997").otherwise("1996").alias("build"))
    orders = table(spark, sf, "orders").where(year("o_orderdate", 1997))
    name = F.concat("o_orderpriority", (F.col("o_custkey") % 700).cast("string")).alias("name")
    candidates = orders.groupBy(F.col("o_custkey").alias("entity_id"), name).agg(F.count(F.lit(1)).alias("digest"))
    now = orders.where("o_orderstatus <> 'P'").groupBy(name).agg(F.count(F.lit(1)).alias("digest"))
    good, bad = lineage.applied(held, candidates, now, "1997")
    return good.select("entity_id", "name", F.lit("applied").alias("outcome")).unionByName(bad.withColumnRenamed("reason", "outcome"))


@query("promote_new", """
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), n AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997),
 k AS (SELECT count(*) AS last FROM o), p AS (SELECT c_name AS name, row_number() OVER (ORDER BY c_name) + (SELECT last FROM k) AS i FROM customer WHERE c_custkey IN (SELECT o_custkey FROM n) AND c_custkey NOT IN (SELECT o_custkey FROM o))
SELECT 'E_' || lpad(i::VARCHAR, greatest(6, length(i::VARCHAR))::INT, '0') AS entity_id, '1997' AS build, name FROM p""")
def promote_new(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the second year that the first did not know get the next numbers."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(year("o_orderdate", 1996)).alias("a"), F.bool_or(year("o_orderdate", 1997)).alias("b"))
    known = settled(customer.select("c_custkey", "c_name").join(seen, "c_custkey"), "active")
    first = settled(lineage.seed(known.where("a"), "c_name", "1996"), "lineage")
    carried = first.join(known.where("a AND b").select(F.col("c_name").alias("name")), "name", "left_semi").select("entity_id", F.lit("1997").alias("build"), "name")
    return lineage.promoted(first.unionByName(carried), known.where("b AND NOT a").select(F.col("c_name").alias("name")), "1997")


@query("completeness_gate", """
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), n AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT 'expected_not_held' AS gap, k FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT 'held_not_expected', k FROM n WHERE k NOT IN (SELECT k FROM o)""")
def completeness_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What is expected but not held, and the other way round."""
    expected = table(spark, sf, "orders").where(year("o_orderdate", 1996)).select(F.col("o_custkey").alias("k")).distinct()
    held = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return expected.join(held, "k", "left_anti").select(F.lit("expected_not_held").alias("gap"), "k").unionByName(held.join(expected, "k", "left_anti").select(F.lit("held_not_expected").alias("gap"), "k"))


@query("historical_backfill", """
WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS id FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL HAVING count(*) = 1), q AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS id FROM orders WHERE year(o_orderdate) = 1995 GROUP BY ALL HAVING count(*) = 1)
SELECT p.id AS known_id, q.id AS older_id FROM p JOIN q USING (o_custkey, o_orderpriority)""")
def historical_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade with its sides swapped: what an older build had of the identities of a later one."""
    orders = table(spark, sf, "orders")
    found = matching.cascade(orders.where(year("o_orderdate", 1997)), orders.where(year("o_orderdate", 1995)), [("backfill", ["o_custkey", "o_orderpriority"])], "o_orderkey")
    return found.select(F.col("old_id").alias("known_id"), F.col("new_id").alias("older_id"))


@query("rederive_compare", """
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice < 490000 GROUP BY 1)
SELECT 'held_only' AS side, o_custkey, n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'derived_only', o_custkey, n FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def rederive_compare(spark: SparkSession, sf: str) -> DataFrame:
    """A table against the same one derived anew, without its dearest orders: rows of either side alone."""
    orders = table(spark, sf, "orders")
    held, derived = (settled(df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "counts") for df in (orders, orders.where("o_totalprice < 490000")))
    return held.exceptAll(derived).withColumn("side", F.lit("held_only")).unionByName(derived.exceptAll(held).withColumn("side", F.lit("derived_only")))


@query("freeze_snapshot", "SELECT o_orderstatus AS part, count(*) AS n, sha256(string_agg(d, ',' ORDER BY d)) AS digest FROM (SELECT o_orderstatus, substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM (SELECT o_orderstatus, sha256(o_orderkey || '|' || o_custkey) AS h FROM orders) GROUP BY ALL) JOIN (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1) USING (o_orderstatus) GROUP BY 1".replace("count(*) AS n,", "max(c) AS n,"))
def freeze_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The digest that a snapshot of each part is frozen under: rows, then buckets of 256."""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("part"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey"), 256).alias("d"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)
    buckets = rows.groupBy("part", F.substring("d", 1, 2).alias("bucket")).agg(joined.alias("d"), F.count(F.lit(1)).alias("n"))
    return buckets.groupBy("part").agg(F.sum("n").alias("n"), joined.alias("digest"))


@query("semantic_registry", """
WITH a AS (SELECT s_suppkey AS id, 'first' AS review, s_name AS name FROM supplier WHERE s_acctbal > 0), b AS (SELECT s_suppkey, 'second', CASE WHEN s_suppkey % 9 = 0 THEN 'other' || s_suppkey ELSE s_name END FROM supplier WHERE s_acctbal < 6000), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT id, count(*) AS reviews, count(DISTINCT name) AS names, CASE WHEN count(DISTINCT name) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'confirmed' ELSE 'single' END AS state FROM u GROUP BY 1""")
def semantic_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Names from two reviews in one register, and where they agree."""
    supplier = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id")
    first = supplier.where("s_acctbal > 0").select("id", F.col("s_name").alias("name"))
    second = supplier.where("s_acctbal < 6000").select("id", F.when(F.col("id") % 9 == 0, F.concat(F.lit("other"), F.col("id").cast("string"))).otherwise(F.col("s_name")).alias("name"))
    state = F.when(F.col("names") > 1, "conflict").when(F.col("reviews") > 1, "confirmed").otherwise("single")
    return first.unionByName(second).groupBy("id").agg(F.count(F.lit(1)).alias("reviews"), F.count_distinct("name").alias("names")).withColumn("state", state)


@query("carry_names", """
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), n AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM o) THEN 'new_only' WHEN c_custkey NOT IN (SELECT o_custkey FROM n) THEN 'not_in_new' WHEN c_acctbal < 0 THEN 'not_accepted' WHEN c_mktsegment = 'BUILDING' THEN 'needs_review' ELSE 'carried' END AS reason FROM customer""")
def carry_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names carried forward or held back, by the first reason that holds."""
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(year("o_orderdate", 1996)).alias("a"), F.bool_or(year("o_orderdate", 1997)).alias("b"))
    both = table(spark, sf, "customer").join(seen, "c_custkey", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [("new_only", no("a")), ("not_in_new", no("b")), ("not_accepted", F.col("c_acctbal") < 0), ("needs_review", F.col("c_mktsegment") == "BUILDING")]
    return both.select("c_custkey", diffing.first_match(rules, "carried").alias("reason"))


@query("rename_hazards", """
WITH m AS (SELECT DISTINCT event_type || '/' || user_id % 30 || '/' || floor(value / 8)::INT AS source, CASE WHEN user_id % 2 = 0 THEN event_type || '/' || user_id % 30 ELSE 'new' END || '/T' || floor(value / 8)::INT AS target FROM events),
 l AS (SELECT DISTINCT event_type || '.' || user_id % 30 || '.' || floor(value / 8)::INT AS literal FROM events WHERE event_type = 'signup'), r AS (SELECT DISTINCT event_type || '/' || user_id % 30 AS package FROM events WHERE event_type = 'purchase' AND value < 2),
 g AS (SELECT DISTINCT event_type || '/' || user_id % 30 || '/' || floor(value / 8)::INT AS source FROM events WHERE event_id % 4 & 1 <> 0),
 h AS (SELECT source, 'literal_mention' AS hazard FROM m WHERE replace(source, '/', '.') IN (SELECT literal FROM l) UNION SELECT source, 'package_resource' FROM m WHERE regexp_extract(source, '^(.*)/[^/]*$', 1) <> regexp_extract(target, '^(.*)/[^/]*$', 1) AND regexp_extract(source, '^(.*)/[^/]*$', 1) IN (SELECT package FROM r) UNION SELECT source, 'flagged_member' FROM g)
SELECT m.source, m.target, coalesce(string_agg(DISTINCT hazard, ',' ORDER BY hazard), '') AS hazards, CASE WHEN bool_or(hazard = 'literal_mention') THEN 'high' WHEN bool_or(hazard = 'package_resource') THEN 'medium' ELSE 'low' END AS severity FROM m LEFT JOIN h ON h.source = m.source GROUP BY ALL""")
def rename_hazards(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks against renaming: literals in either spelling, resources of the package that is left, flagged members."""
    events = table(spark, sf, "events")
    kind, group, top = F.col("event_type"), (F.col("user_id") % 30).cast("string"), F.floor(F.col("value") / 8).cast("int").cast("string")
    source = F.concat_ws("/", kind, group, top)
    high = events
    target = F.concat(F.when(F.col("user_id") % 2 == 0, F.concat_ws("/", kind, group)).otherwise("new"), F.lit("/T"), top)
    mapping = settled(high.select(source.alias("source"), target.alias("target")).distinct(), "mapping")
    literals = events.where("event_type = 'signup'").select(F.concat_ws(".", kind, group, top).alias("literal"))
    resources = events.where("event_type = 'purchase' AND value < 2").select(F.concat_ws("/", kind, group, F.lit("r.txt")).alias("path"))
    return lineage.hazards(mapping, literals, resources, high.select(source.alias("source"), (F.col("event_id") % 4).alias("flags")))


@query("risk_reacceptance", """
WITH a AS (SELECT o_custkey AS source, count(*) AS m FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice > 200000 GROUP BY 1), b AS (SELECT o_custkey AS source, count(*) AS m FROM orders WHERE year(o_orderdate) = 1996 AND o_totalprice > 200000 GROUP BY 1)
SELECT source, CASE WHEN b.m IS NULL THEN 'unreviewed' WHEN a.m IS NULL THEN 'gone' WHEN a.m = b.m THEN 'carried' ELSE 'changed' END AS state FROM a FULL JOIN b USING (source)""")
def risk_reacceptance(spark: SparkSession, sf: str) -> DataFrame:
    """An accepted risk stays accepted while its material does."""
    orders = table(spark, sf, "orders").where("o_totalprice > 200000")
    side = lambda y: orders.where(year("o_orderdate", y)).groupBy(F.col("o_custkey").alias("source")).agg(F.count(F.lit(1)).cast("string").alias("material"))
    return lineage.reaccepted(side(1997), side(1996))


@query("readable_namespace", """
WITH n AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9_]+', '_', 'g')) || '_' || s_nationkey AS readable, s_nationkey || '/' || s_suppkey % 4 AS fallback FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN fallback ELSE readable END AS name, count(*) OVER (PARTITION BY CASE WHEN s_suppkey % 3 = 0 THEN fallback ELSE readable END) > 1 AS collides FROM n""")
def readable_namespace(spark: SparkSession, sf: str) -> DataFrame:
    """Readable names, with the fallback where none is accepted, and whether two come out equal."""
    supplier = table(spark, sf, "supplier")
    readable = F.concat(F.lower(text.legal_name(F.col("s_name"))), F.lit("_"), F.col("s_nationkey").cast("string"))
    fallback = F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), (F.col("s_suppkey") % 4).cast("string"))
    named = supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, fallback).otherwise(readable).alias("name"))
    return named.withColumn("collides", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)


@query("symbol_inventory", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+')) AS symbol FROM documents)
SELECT symbol, count(*) AS n, count(DISTINCT doc_id) AS docs, sha256(symbol) AS symbol_id FROM t GROUP BY 1""")
def symbol_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words as the symbols of a source tree, under ids made from their spelling."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("symbol"))
    counted = found.groupBy("symbol", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("symbol").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).withColumn("symbol_id", F.sha2("symbol", 256))


@query("source_name_candidates", """
WITH g AS (SELECT DISTINCT c_nationkey, c_mktsegment, floor(c_acctbal)::BIGINT % 100 AS tail, c_custkey FROM customer)
SELECT c_custkey, c_mktsegment || tail AS candidate FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, tail) AS n FROM g) WHERE n = 1""")
def source_name_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are unique in their group."""
    tail = F.floor("c_acctbal") % 100
    named = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat("c_mktsegment", tail.cast("string")).alias("candidate"))
    return named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", "candidate"))).where("n = 1").select("c_custkey", "candidate")


@query("semantic_merge", """
WITH f AS (SELECT l_partkey AS target, l_suppkey % 5 AS name, l_returnflag AS family, max(l_discount + l_tax) AS w FROM lineitem GROUP BY ALL), s AS (SELECT target, name, round(least(1 - product(1 - w), 0.995), 6) + 0.0 AS score FROM f GROUP BY ALL)
SELECT target, count(*) AS proposals, count(DISTINCT score) AS scores, max(score) AS best, min(name) FILTER (WHERE score = top) AS name, count(*) > 1 AS conflict FROM (SELECT *, max(score) OVER (PARTITION BY target) AS top FROM s) GROUP BY 1""")
def semantic_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed names of a target with their evidence merged, the best one, and whether there is another."""
    rows = table(spark, sf, "lineitem").select(F.concat_ws("~", "l_partkey", F.col("l_suppkey") % 5).alias("pair"), "l_returnflag", (F.col("l_discount") + F.col("l_tax")).alias("w"))
    scored = scoring.noisy_or(rows, "pair", "l_returnflag", F.col("w"))
    split = scored.select(F.split("pair", "~")[0].cast("long").alias("target"), F.split("pair", "~")[1].cast("long").alias("name"), "score")
    best = F.max(F.struct("score", (-F.col("name")).alias("m"))).alias("b")
    return split.groupBy("target").agg(F.count(F.lit(1)).alias("proposals"), F.count_distinct("score").alias("scores"), best).select("target", "proposals", "scores", F.col("b.score").alias("best"), (-F.col("b.m")).alias("name"), (F.col("proposals") > 1).alias("conflict"))


_GRAPH = """e AS (SELECT DISTINCT event_type || user_id % 40 AS src, nxt || (user_id + floor(value)::INT) % 40 AS dst FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moved = F.concat("nxt", ((F.col("user_id") + F.floor("value").cast("int")) % 40).cast("string"))
    node = F.concat("event_type", (F.col("user_id") % 40).cast("string"))
    return table(spark, sf, "events").withColumn("nxt", after).where("nxt IS NOT NULL").select(node.alias("src"), moved.alias("dst")).distinct()


@query("breadth_first_tree", f"""
WITH RECURSIVE {_GRAPH}, r AS (SELECT (SELECT min(src) FROM e) AS v, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = v WHERE depth < 60), m AS (SELECT v, min(depth) AS depth FROM r GROUP BY 1)
SELECT m.v, m.depth, coalesce((SELECT min(e.src) FROM e JOIN m p ON p.v = e.src WHERE e.dst = m.v AND p.depth = m.depth - 1), '') AS parent FROM m""")
def breadth_first_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every node reached from the first, with its depth and the smallest parent of the level before."""
    steps = settled(_steps(spark, sf), "steps")
    return graph.walk(steps, steps.agg(F.min("src").alias("v"))).fillna("", ["parent"])


@query("hierarchy_walk", """
WITH RECURSIVE p AS (SELECT DISTINCT doc_id AS c, doc_id // 3 AS p FROM documents WHERE doc_id > 0 UNION SELECT DISTINCT doc_id, doc_id // 7 FROM documents WHERE doc_id > 0 AND doc_id % 5 = 0),
 r AS (SELECT c AS v, p AS a FROM p UNION SELECT v, p.p FROM r JOIN p ON p.c = r.a) SELECT v, count(*) AS ancestors, min(a) AS top FROM r WHERE a <> v GROUP BY 1""")
def hierarchy_walk(spark: SparkSession, sf: str) -> DataFrame:
    """All supertypes (one parent, and for some an interface) of each document."""
    docs = table(spark, sf, "documents").where("doc_id > 0").select("doc_id")
    edges = docs.select(F.col("doc_id").alias("c"), F.floor(F.col("doc_id") / 3).alias("p")).unionByName(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("c"), F.floor(F.col("doc_id") / 7).alias("p"))).distinct()
    return graph.ancestors(edges, docs.select(F.col("doc_id").alias("v")), "c", "p").where("a <> v").groupBy("v").agg(F.count(F.lit(1)).alias("ancestors"), F.min("a").alias("top"))


@query("reverse_index", "SELECT l_partkey, count(DISTINCT l_suppkey) AS users, array_to_string(list_sort(list(DISTINCT l_suppkey))[1:5], ',') AS first_users FROM lineitem GROUP BY 1")
def reverse_index(spark: SparkSession, sf: str) -> DataFrame:
    """Which suppliers refer to each part."""
    users = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return users.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("users"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("l_suppkey")), 1, 5), lambda x: x.cast("string")), ",").alias("first_users"))


@query("rewrite_until_stable", """
WITH RECURSIVE m AS (SELECT DISTINCT p_size AS k, p_size // 2 AS t FROM part WHERE p_size > 3), r AS (SELECT p_partkey, p_size AS x FROM part UNION SELECT p_partkey, t FROM r JOIN m ON k = x)
SELECT p_partkey, min(x) AS final FROM r GROUP BY 1""")
def rewrite_until_stable(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes rewritten by a mapping until nothing changes."""
    part = table(spark, sf, "part")
    mapping = part.where("p_size > 3").select(F.col("p_size").alias("old"), F.floor(F.col("p_size") / 2).cast("int").alias("new")).distinct()
    return graph.rewritten(part.select("p_partkey", F.col("p_size").alias("value")), mapping, 50).select("p_partkey", F.col("value").alias("final"))


@query("expectation_ledger", """
SELECT 'accepted' AS outcome, count(*) FILTER (WHERE c_acctbal >= 0) AS n, count(*) AS total FROM customer UNION ALL SELECT 'rejected', count(*) FILTER (WHERE c_acctbal < 0), count(*) FROM customer""")
def expectation_ledger(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("c_acctbal") >= 0, "accepted").otherwise("rejected")
    return checks.ledger(table(spark, sf, "customer"), outcome).select("outcome", "n", "total")
