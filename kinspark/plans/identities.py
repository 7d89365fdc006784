"""Identities carried between versions, over the driver's tables: customers are entities, order years are builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, graph, lineage
from ..sources.shared import settled
from .tables import table, year

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _active(spark: SparkSession, sf: str, y: int) -> DataFrame:
    seen = table(spark, sf, "orders").where(year("o_orderdate", y)).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(seen, "c_custkey", "left_semi")


_ACTIVE = "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = {})"


@query("lineage_transfer", f"""
WITH o AS ({_ACTIVE.format(1996)}), n AS ({_ACTIVE.format(1997)}), i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS k FROM o)
SELECT c_custkey, CASE WHEN o.c_acctbal >= 0 THEN 'carried' ELSE 'untrusted_strategy' END AS outcome, CASE WHEN o.c_acctbal >= 0 THEN 'E_' || lpad(k::VARCHAR, greatest(6, length(k::VARCHAR))::INT, '0') ELSE '' END AS entity_id
FROM o JOIN n USING (c_custkey) JOIN i USING (c_custkey)""")
def lineage_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one year found again in the next; only those in credit are a trusted match."""
    customer, seen = table(spark, sf, "customer"), table(spark, sf, "orders")
    active = seen.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(year("o_orderdate", 1996)).alias("old"), F.bool_or(year("o_orderdate", 1997)).alias("new")).where("old OR new")
    known = settled(customer.join(active, "c_custkey").select("c_custkey", "c_name", "c_acctbal", "old", "new"), "active")
    strategy = F.when(F.col("c_acctbal") >= 0, "exact").otherwise("loose")
    matches = known.where("old AND new").select(F.col("c_name").alias("old_name"), F.col("c_name").alias("new_name"), strategy.alias("strategy"))
    carried, review = lineage.transfer(settled(lineage.seed(known.where("old"), "c_name", "1996"), "lineage"), matches, "1996", "1997", ["exact"])
    both = carried.select("name", F.lit("carried").alias("outcome"), "entity_id").unionByName(review.select(F.col("new_name").alias("name"), F.col("reason").alias("outcome"), F.lit("").alias("entity_id")))
    return both.join(known.select(F.col("c_name").alias("name"), "c_custkey"), "name").select("c_custkey", "outcome", "entity_id")


@query("lineage_violations", """
SELECT 'name_shared' AS rule, p_name AS key, count(*) AS n FROM (SELECT p_partkey, p_name FROM part) GROUP BY 2 HAVING count(*) > 1""")
def lineage_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Part keys as identities, part names as names: names that identities share."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("1").alias("build"), F.col("p_name").alias("name"))
    return lineage.violations(rows)


_PROPOSALS = "p AS (SELECT DISTINCT s_suppkey::VARCHAR AS entity_id, 'S' || (floor(s_acctbal))::BIGINT AS proposed FROM supplier UNION SELECT DISTINCT (c_custkey + 1000000)::VARCHAR, 'S' || (floor(c_acctbal))::BIGINT FROM customer)"


@query("name_acceptance", f"""WITH {_PROPOSALS}, q AS (SELECT p.*, s.s_suppkey IS NOT NULL AS known, count(*) OVER (PARTITION BY entity_id) AS a, count(*) OVER (PARTITION BY lower(proposed)) AS b
 FROM p LEFT JOIN supplier s ON s.s_suppkey::VARCHAR = p.entity_id)
SELECT entity_id, proposed, CASE WHEN NOT known THEN 'unknown_identity' WHEN a > 1 THEN 'several_proposals' WHEN b > 1 THEN 'name_proposed_twice' ELSE 'accepted' END AS outcome FROM q""")
def name_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Whole balances as proposed names of suppliers; customers are no known identities."""
    supplier, customer = table(spark, sf, "supplier"), table(spark, sf, "customer")
    named = lambda key, balance: [key.cast("string").alias("entity_id"), F.concat(F.lit("S"), F.floor(balance).cast("string")).alias("proposed")]
    proposals = supplier.select(*named(F.col("s_suppkey"), F.col("s_acctbal"))).unionByName(customer.select(*named(F.col("c_custkey") + 1000000, F.col("c_acctbal"))))
    held = supplier.select(F.col("s_suppkey").cast("string").alias("entity_id"), F.lit("1").alias("build"), F.col("s_name").alias("name"))
    accepted, rejected = lineage.accept(held, proposals)
    return accepted.withColumn("outcome", F.lit("accepted")).unionByName(rejected.withColumnRenamed("reason", "outcome"))


_SIDE = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_type,
  CASE WHEN event_type = 'purchase' THEN count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS anchor FROM events WHERE event_id % 2 = {}"""
_FREE = """(SELECT user_id, l, r, event_type, min(place) AS p FROM (SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  first_value(anchor IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM ({})) WHERE anchor IS NULL AND l IS NOT NULL AND r IS NOT NULL GROUP BY ALL HAVING count(*) = 1)"""


@query("declaration_sandwich", f"SELECT a.user_id, a.event_type, a.p AS old_place, b.p AS new_place FROM {_FREE.format(_SIDE.format(0))} a JOIN {_FREE.format(_SIDE.format(1))} b USING (user_id, l, r, event_type)")
def declaration_sandwich(spark: SparkSession, sf: str) -> DataFrame:
    """Events between the same numbered purchases of a user in both halves of the log."""

    def side(k: int) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        bought = F.col("event_type") == "purchase"
        nth = F.sum(bought.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        half = table(spark, sf, "events").where(F.col("event_id") % 2 == k)
        return half.select("user_id", F.row_number().over(w).cast("long").alias("place"), "event_type", F.when(bought, nth).alias("anchor"))

    return lineage.sandwiched(side(0), side(1), "user_id", "place", "anchor", "event_type")


@query("runtime_retention", """
WITH RECURSIVE e AS (SELECT DISTINCT event_type || user_id % 40 AS src, coalesce(nxt || (user_id + floor(value)::INT) % 40, '') AS dst FROM
  (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type <> 'error' AND nxt IS NOT NULL),
 k AS (SELECT DISTINCT event_type || user_id % 40 AS node FROM events), t AS (SELECT min(node) AS node FROM k WHERE node LIKE 'purchase%'),
 r AS (SELECT node FROM t UNION SELECT dst FROM r JOIN e ON src = node)
SELECT node, CASE WHEN node IN (SELECT node FROM t) THEN 'root' WHEN node IN (SELECT node FROM r) THEN 'needed' ELSE 'dead' END AS state FROM k""")
def runtime_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of groups of users as nodes, steps as edges; edges from errors are not walked."""
    events = table(spark, sf, "events")
    node = F.concat("event_type", (F.col("user_id") % 40).cast("string"))
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moved = F.concat("nxt", ((F.col("user_id") + F.floor("value").cast("int")) % 40).cast("string"))
    steps = events.withColumn("nxt", after).where("nxt IS NOT NULL").select("event_type", node.alias("src"), moved.alias("dst"))
    nodes = events.select(node.alias("node")).distinct()
    roots = nodes.where(F.col("node").startswith("purchase")).agg(F.min("node").alias("v"))
    return lineage.retained(nodes, graph.walk(steps, roots, open_=F.col("event_type") != "error"))


@query("rename_plan", """
WITH a AS (SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 0 THEN 'R' || n_nationkey WHEN n_regionkey = 1 THEN 'SAME' END AS p FROM nation)
SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS name, coalesce(p, n_name) AS target, count(*) OVER (PARTITION BY lower(coalesce(p, n_name))) > 1 AS collides FROM a""")
def rename_plan(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").withColumn("entity_id", F.col("n_nationkey").cast("string"))
    proposed = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("R"), "entity_id")).when(F.col("n_regionkey") == 1, F.lit("SAME"))
    return lineage.rename_plan(nation.select("entity_id", F.col("n_name").alias("name")), nation.select("entity_id", proposed.alias("proposed")).where("proposed IS NOT NULL"))


@query("reference_surface", """
SELECT event_type, count(*) AS refs, count(DISTINCT user_id) AS sources, array_to_string(list_sort(list(DISTINCT json_extract_string(props, '$.k')))[1:20], ',') AS targets FROM events GROUP BY 1""")
def reference_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Count, distinct count and the first 20 of the sorted list in one pass; what is listed is distinct values."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("user_id").alias("sources"), F.array_join(F.slice(F.array_sort(F.collect_set(k)), 1, 20), ",").alias("targets"))


@query("multilane_concordance", """
WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS v FROM orders),
 m AS (SELECT l_orderkey AS k, max(l_linestatus) AS v FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey AS k, min(l_linestatus) AS v FROM lineitem GROUP BY 1),
 a AS (SELECT * FROM l UNION ALL SELECT * FROM m UNION ALL SELECT * FROM n)
SELECT k, count(*) AS lanes, count(DISTINCT v) AS votes, CASE WHEN count(*) < 3 THEN 'uncovered' WHEN count(DISTINCT v) = 1 THEN 'agreed' ELSE 'split' END AS verdict FROM a GROUP BY 1""")
def multilane_concordance(spark: SparkSession, sf: str) -> DataFrame:
    """What an order's own status and its first and last line status say; orders without lines are not covered."""
    status = F.when(F.col("o_orderstatus") == "F", "F").otherwise("O")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("last"), F.min("l_linestatus").alias("first"))
    lanes = {"own": table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), status.alias("v")), "last": lines.select("k", F.col("last").alias("v")), "first": lines.select("k", F.col("first").alias("v"))}
    return evidence.concordance(lanes, "k", "v")
