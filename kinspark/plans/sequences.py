"""Sequences and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import edits, graph, sequences
from ..sources import logs
from .tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark: SparkSession, sf: str):
    return table(spark, sf, "events"), sequences.ordered("user_id", "ts", "event_id")


@query("nearest_anchor", """
SELECT event_id, coalesce(before, -1) AS before, coalesce(after, -1) AS after FROM (
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events)""")
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    events, window = _events(spark, sf)
    before, after = sequences.nearest(F.when(F.col("event_type") == "purchase", F.col("event_id")), window)
    return events.select("event_id", before.alias("before"), after.alias("after")).fillna(-1)


SIGNUPS = f"i AS (SELECT user_id, event_id AS signup_id, ts AS opened, event_id AS first_id, lead(ts) OVER {W} AS closed FROM events WHERE event_type = 'signup')"


@query("point_in_interval", f"WITH {SIGNUPS} SELECT signup_id, count(*) AS n FROM i JOIN events e ON e.user_id = i.user_id AND e.ts >= opened AND (closed IS NULL OR e.ts < closed) GROUP BY 1")
def point_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the spans between a user's signups: spans that do not overlap, so each event's is the last one opened.
    Of signups at one moment only the last spans anything."""
    events, _ = _events(spark, sf)
    signup = F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select(F.max(signup).over(upto).alias("span")).where("span IS NOT NULL").groupBy(F.col("span.event_id").alias("signup_id")).agg(F.count(F.lit(1)).alias("n"))


LIVES = "s AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1), v AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS b, e FROM orders JOIN s ON l_orderkey = o_orderkey WHERE o_orderdate < e)"


@query("interval_overlap", f"WITH {LIVES} SELECT x.c AS custkey, count(*) AS overlaps FROM v x JOIN v y ON x.c = y.c AND x.k < y.k AND x.b < y.e AND y.b < x.e GROUP BY 1")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's orders that are open at once: one sweep over starts and ends instead of all pairs."""
    ends = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("e"))
    lives = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("b")).join(ends, "k").where("b < e")
    return sequences.overlapping_pairs(lives, "custkey", "b", "e").where("overlaps > 0")


@query("context_frame_signature", "SELECT event_id, concat_ws('>', " + ", ".join(f"coalesce(lag(event_type, {k}) OVER w, '-')" for k in (2, 1, 0, -1, -2)) + f") AS signature FROM events WINDOW w AS {W}")
def context_frame_signature(spark: SparkSession, sf: str) -> DataFrame:
    events, window = _events(spark, sf)
    return events.select("event_id", sequences.frame_signature("event_type", 2, window).alias("signature"))


@query("running_predicate_ordinal", "SELECT event_id, CASE WHEN event_type <> 'purchase' THEN -1 ELSE (sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT END AS ordinal FROM events")
def running_predicate_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    events, window = _events(spark, sf)
    return events.select("event_id", sequences.running_ordinal(F.col("event_type") == "purchase", window).alias("ordinal")).fillna(-1)


@query("gaps_and_islands", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER {W} > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
 i AS (SELECT *, (sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM i GROUP BY ALL""")
def gaps_and_islands(spark: SparkSession, sf: str) -> DataFrame:
    events, window = _events(spark, sf)
    cut = F.col("ts") - F.lag("ts").over(window) > F.expr("INTERVAL 30 MINUTE")
    numbered = sequences.islands(events, cut, window, "session")
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("pattern_sequence", f"""SELECT user_id, event_id FROM (SELECT *, lag(event_type, 2) OVER w AS a, lag(event_type) OVER w AS b FROM events WINDOW w AS {W})
 WHERE a = 'view' AND b = 'click' AND event_type = 'purchase'""")
def pattern_sequence(spark: SparkSession, sf: str) -> DataFrame:
    events, window = _events(spark, sf)
    found = sequences.ends_pattern("event_type", ["view", "click", "purchase"], window)
    return events.withColumn("found", found).where("found").select("user_id", "event_id")


def _said(role: str) -> str:
    return f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS size, turn FROM conversations WHERE role = '{role}'"


@query("positional_zip", f"SELECT conv_id, a.place, a.turn AS left_item, b.turn AS right_item FROM ({_said('user')}) a JOIN ({_said('assistant')}) b USING (conv_id) WHERE a.place = b.place AND a.size = b.size")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").withColumn("item", F.col("turn"))
    return sequences.positional_zip(talk.where("role = 'user'"), talk.where("role = 'assistant'"), "conv_id", "turn")


@query("contiguity_check", "SELECT conv_id, count(*) AS n, bool_and(s) AS contiguous FROM (SELECT conv_id, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn + 1, true) AS s FROM conversations) GROUP BY 1")
def contiguity_check(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.contiguous(table(spark, sf, "conversations"), "conv_id", "turn")


@query("dense_ids", "SELECT o_orderkey, 'N_' || CASE WHEN n >= 1000000 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 6, '0') END AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_orderkey FROM orders))")
def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.dense_ids(table(spark, sf, "orders"), "o_orderkey", "N_")


@query("first_seen_alias", "SELECT event_type, row_number() OVER (ORDER BY f) AS alias FROM (SELECT event_type, min(row(ts, event_id)) AS f FROM events GROUP BY 1)")
def first_seen_alias(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.first_seen(table(spark, sf, "events"), "event_type", "ts", "event_id")


@query("reachability_closure", """
WITH RECURSIVE e AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS src, string_split(p_name, ' ')[2] AS dst FROM part),
 r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT * FROM r""")
def reachability_closure(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    return graph.closure(table(spark, sf, "part").select(words[0].alias("src"), words[1].alias("dst"))).select("src", "dst")


@query("connected_components", """
WITH RECURSIVE k AS (SELECT doc_id AS v, sha256(text) AS k FROM documents UNION ALL SELECT doc_id, sha256(string_split(text, chr(10))[1]) FROM documents),
 e AS (SELECT DISTINCT v AS a, min(v) OVER (PARTITION BY k) AS b FROM k), d AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 r AS (SELECT a AS v, a AS c FROM d UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.v WHERE r.c < d.b)
SELECT v, min(c) AS component FROM r GROUP BY 1""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents joined by an equal text or an equal first line."""
    docs = table(spark, sf, "documents")
    keys = docs.select("doc_id", F.explode(F.array(F.sha2("text", 256), F.sha2(F.split("text", "\n")[0], 256))).alias("k"))
    firsts = keys.groupBy("k").agg(F.min("doc_id").alias("b"))
    return graph.components(keys.join(firsts, "k").select(F.col("doc_id").alias("a"), "b").where("a <> b"))


@query("degree_profile", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, count(*) AS lines FROM lineitem GROUP BY 1")
def degree_profile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.count(F.lit(1)).alias("lines"))


@query("topology_equality", """
WITH c AS (SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT user_id, bool_and(a = b) AS equal, string_agg(event_type || ':' || a || ':' || b, ',' ORDER BY event_type) AS vector FROM c GROUP BY 1""")
def topology_equality(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count_if(even).alias("a"), F.count_if(~even).alias("b"))
    line = F.concat_ws(":", "event_type", "a", "b")
    return counts.groupBy("user_id").agg(F.bool_and(F.col("a") == F.col("b")).alias("equal"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("vector"))


@query("log_records", """
WITH n AS (SELECT *, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS record FROM conversations)
SELECT conv_id, record, max(CASE WHEN role = 'user' THEN text END) AS header, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY turn) AS body FROM n GROUP BY ALL""")
def log_records(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn heads a record; the answers up to the next one belong to it."""
    return logs.records(table(spark, sf, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")


@query("sequence_edit_script", None)
def sequence_edit_script(spark: SparkSession, sf: str) -> DataFrame:
    """How each turn of a conversation turns into the next, word by word; place numbers the turns from 1."""
    talk = table(spark, sf, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    words = F.filter(F.split("text", " "), lambda x: x != "")
    pairs = talk.select("conv_id", F.row_number().over(own).alias("place"), words.alias("left"), F.lead(words).over(own).alias("right")).where("right IS NOT NULL")
    return edits.edit_scripts(pairs, "conv_id", "long", {"place": "int"})
