"""Dependencies, resources, bindings and releases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diffing, graph, plans
from ..operators.sequences import numbered
from ..sources.shared import settled
from .tables import Catalogue, table, year

query = Catalogue()

_BARE = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("dependency_inventory", f"SELECT string_split({_BARE}, '/')[1] || '/' || string_split({_BARE}, '/')[2] AS namespace, count(*) AS entries, count(DISTINCT {_BARE}) AS names FROM pages GROUP BY 1")
def dependency_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by the first two segments of their names."""
    parts = text.segments(F.col("url"))
    named = table(spark, sf, "pages").select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("namespace"), F.array_join(parts, "/").alias("name"))
    return named.groupBy("namespace").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("name").alias("names"))


@query("artifact_proof", """
WITH a AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
SELECT p_brand, count(*) FILTER (WHERE a.n IS NOT NULL) AS wanted, count(*) FILTER (WHERE a.n IS NOT NULL AND b.n >= a.n) AS provided, CASE WHEN count(*) FILTER (WHERE a.n IS NOT NULL AND (b.n IS NULL OR b.n < a.n)) = 0 THEN 'compatible' ELSE 'gaps' END AS state
FROM a FULL JOIN b USING (p_brand, p_type, p_size) GROUP BY 1""")
def artifact_proof(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one half of a brand's parts offers all shapes of the other, as often."""
    part = table(spark, sf, "part")
    n = part.groupBy("p_brand", "p_type", "p_size").agg(F.count_if(F.col("p_partkey") % 2 == 0).alias("a"), F.count_if(F.col("p_partkey") % 2 == 1).alias("b"))
    wanted, good = F.col("a") > 0, F.col("b") >= F.col("a")
    out = n.groupBy("p_brand").agg(F.count_if(wanted).alias("wanted"), F.count_if(wanted & good).alias("provided"))
    return out.withColumn("state", F.when(F.col("wanted") == F.col("provided"), "compatible").otherwise("gaps"))


_REPLACE = """CASE WHEN s_acctbal < 0 THEN 'keep_private' WHEN n IS NULL THEN 'remove' WHEN n > 620 THEN 'replace' WHEN parts > 5 * n / 6 THEN 'shim' ELSE 'review' END"""


@query("replacement_plan", f"WITH u AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT s_suppkey, coalesce(n, 0) AS uses, {_REPLACE} AS action FROM supplier LEFT JOIN u ON l_suppkey = s_suppkey")
def replacement_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with each dependency by its uses, the first reason deciding."""
    uses = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"))
    rules = [("keep_private", F.col("s_acctbal") < 0), ("remove", F.col("n").isNull()), ("replace", F.col("n") > 620), ("shim", F.col("parts") > 5 * F.col("n") / 6)]
    return table(spark, sf, "supplier").join(uses, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("uses"), diffing.first_match(rules, "review").alias("action"))


@query("resource_equivalence", """
WITH w AS (SELECT doc_id % 400 AS path, min_by(text, doc_id) AS body FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), p AS (SELECT doc_id % 400 + (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS path, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS body FROM documents WHERE doc_id % 5 <> 0),
 h AS (SELECT path, count(*) AS providers, count(DISTINCT body) AS bodies, min(sha256(body)) AS s, min(sha256(regexp_replace(body, chr(13) || chr(10) || '?', chr(10), 'g'))) AS pl FROM p GROUP BY 1)
SELECT w.path, coalesce(providers, 0) AS providers, CASE WHEN providers IS NULL THEN 'missing' WHEN bodies > 1 THEN 'ambiguous' WHEN sha256(body) = s THEN 'exact' WHEN sha256(regexp_replace(body, chr(13) || chr(10) || '?', chr(10), 'g')) = pl THEN 'newline_equivalent' ELSE 'mismatch' END AS state FROM w LEFT JOIN h USING (path)""")
def resource_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as resources that others provide under the same path, some with other line ends."""
    docs = table(spark, sf, "documents")
    wanted = docs.where("doc_id % 2 = 0").groupBy((F.col("doc_id") % 400).alias("path")).agg(F.min_by("text", "doc_id").alias("body"))
    body = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    path = F.col("doc_id") % 400 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return plans.resources(wanted, docs.where("doc_id % 5 <> 0").select(path.alias("path"), body.alias("body")))


@query("runtime_readiness", """
WITH r AS (SELECT l_orderkey AS subject, count(DISTINCT l_returnflag || l_linestatus) AS inputs FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS subject, count(*) AS blockers FROM lineitem WHERE l_discount >= 0.1 AND l_tax >= 0.08 AND l_quantity > 40 GROUP BY 1)
SELECT subject, inputs, coalesce(blockers, 0) AS blockers, inputs = 1 AND coalesce(blockers, 0) = 0 AS ready FROM r LEFT JOIN b USING (subject)""")
def runtime_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Orders all of whose lines say the same and that nothing blocks."""
    lines = table(spark, sf, "lineitem")
    reports = lines.select(F.col("l_orderkey").alias("subject"), F.concat("l_returnflag", "l_linestatus").alias("input"))
    return plans.readiness(reports, lines.where("l_discount >= 0.1 AND l_tax >= 0.08 AND l_quantity > 40").select(F.col("l_orderkey").alias("subject")))


@query("runtime_frontier", """
WITH k AS (SELECT s_suppkey, s_nationkey, s_acctbal >= 0 AS known FROM supplier)
SELECT l_partkey, count(DISTINCT s_suppkey) AS edges, count(DISTINCT s_suppkey) FILTER (WHERE NOT known) AS open FROM lineitem JOIN k ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT s_suppkey) FILTER (WHERE NOT known) > 0""")
def runtime_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with an edge to a supplier that is not resolved."""
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") >= 0).alias("known"))
    edges = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(known, "l_suppkey")
    return edges.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("known")).alias("open")).where("open > 0")


@query("runtime_closure", """
WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM l UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM l WHERE l_partkey % 3 = 0),
 r AS (SELECT 's' || min(s_suppkey) AS v FROM supplier UNION SELECT dst FROM r JOIN e ON src = v) SELECT v FROM r""")
def runtime_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What the first supplier reaches over all lines; only every third part leads on to other suppliers."""
    lines = settled(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct(), "lines")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = lines.select(s.alias("src"), p.alias("dst"), F.lit(True).alias("open")).unionByName(lines.select(p.alias("src"), s.alias("dst"), (F.col("l_partkey") % 3 == 0).alias("open")))
    roots = table(spark, sf, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey").cast("string")).alias("v"))
    return graph.walk(edges, roots, open_=F.col("open")).select("v")


_DYNAMIC = "SELECT user_id, event_id, event_type, lag(event_type) OVER w AS prev, lag(value) OVER w AS literal, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("dynamic_inventory", f"SELECT event_id, CASE WHEN prev IS NULL THEN 'unknown' WHEN prev = 'view' AND literal > 10 THEN 'literal' WHEN prev = 'error' THEN 'computed' ELSE 'unknown' END AS target_kind FROM ({_DYNAMIC}) WHERE event_type = 'click'")
def dynamic_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic calls (clicks) by what stands right before them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = table(spark, sf, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("prev"), F.lag("value").over(w).alias("literal")).where("event_type = 'click'")
    rules = [("literal", (F.col("prev") == "view") & (F.col("literal") > 10)), ("computed", F.col("prev") == "error")]
    return calls.select("event_id", diffing.first_match(rules, "unknown").alias("target_kind"))


@query("dynamic_targets", f"""
WITH c AS (SELECT event_id, floor(literal)::INT AS size FROM ({_DYNAMIC}) WHERE event_type = 'click' AND prev = 'view'), s AS (SELECT p_size AS size, count(*) AS n, min(p_partkey) AS p FROM part GROUP BY 1)
SELECT event_id, coalesce(n, 0) AS candidates, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS state FROM c LEFT JOIN s USING (size)""")
def dynamic_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Literals before dynamic calls against the members that have their size."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = table(spark, sf, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("prev"), F.floor(F.lag("value").over(w)).cast("int").alias("size")).where("event_type = 'click' AND prev = 'view'")
    symbols = table(spark, sf, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("symbol"))
    return plans.bound(calls.select("event_id", "size"), symbols, "size").select("event_id", "candidates", "state")


@query("source_binding", """
WITH m AS (SELECT doc_id, lower(w) AS name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]{3,}')) AS w FROM documents) GROUP BY ALL),
 s AS (SELECT lower(split_part(p_name, ' ', 2)) AS name, p_brand AS symbol FROM part UNION ALL SELECT DISTINCT lang, source FROM documents UNION ALL SELECT DISTINCT regexp_extract(text, '^([a-zA-Z]+)', 1), 'head' FROM documents),
 h AS (SELECT name, count(*) AS c, min(symbol) AS symbol FROM s GROUP BY 1)
SELECT state, count(*) AS mentions, sum(n)::BIGINT AS uses FROM (SELECT n, CASE WHEN c IS NULL THEN 'none' WHEN c = 1 THEN 'exact' ELSE 'ambiguous' END AS state FROM m LEFT JOIN h USING (name)) GROUP BY 1""")
def source_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents bound to symbols of the same name, if there is one such symbol."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0)).alias("name"))
    mentions = words.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
    symbols = table(spark, sf, "part").select(F.lower(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("name"), F.col("p_brand").alias("symbol"))
    symbols = symbols.unionByName(docs.select(F.col("lang").alias("name"), F.col("source").alias("symbol")).distinct())
    heads = docs.select(F.regexp_extract("text", "^([a-zA-Z]+)", 1).alias("name"), F.lit("head").alias("symbol")).distinct()
    return plans.bound(mentions, symbols.unionByName(heads), "name").groupBy("state").agg(F.count(F.lit(1)).alias("mentions"), F.sum("n").alias("uses"))


@query("capsule_audit", """
WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1 HAVING count(*) > 2), b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1 HAVING count(*) > 2)
SELECT k, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n = b.n AND a.s = b.s THEN 'shared_exact' ELSE 'metadata_difference' END AS status FROM a FULL JOIN b USING (k)""")
def capsule_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The busy customers of two years: what a capsule should hold against what it does."""
    side = lambda y: table(spark, sf, "orders").where(year("o_orderdate", y)).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s")).where("n > 2")
    return diffing.inventory(side(1996), side(1997), ["k"], ["n", "s"]).select("k", "status")


@query("alias_plan", """
WITH p AS (SELECT DISTINCT c_nationkey || ':' || c_custkey % 120 AS old, c_mktsegment || ':' || c_custkey % 500 AS new FROM customer)
SELECT old, new, CASE WHEN count(*) OVER (PARTITION BY old) > 1 THEN 'old_twice' WHEN count(*) OVER (PARTITION BY new) > 1 THEN 'new_twice' ELSE 'good' END AS state FROM p""")
def alias_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases that must be one to one, both ways."""
    named = table(spark, sf, "customer").select(F.concat_ws(":", "c_nationkey", F.col("c_custkey") % 120).alias("old"), F.concat_ws(":", "c_mktsegment", F.col("c_custkey") % 500).alias("new"))
    return plans.bijection(named, "old", "new")


@query("reverse_alias", """
WITH p AS (SELECT DISTINCT c_nationkey || ':' || c_custkey % 120 AS old, c_mktsegment || ':' || c_custkey % 500 AS new FROM customer),
 q AS (SELECT *, count(*) OVER (PARTITION BY old) AS a, count(*) OVER (PARTITION BY new) AS b FROM p) SELECT new AS old, old AS new FROM q WHERE a = 1 AND b = 1""")
def reverse_alias(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "customer").select(F.concat_ws(":", "c_nationkey", F.col("c_custkey") % 120).alias("old"), F.concat_ws(":", "c_mktsegment", F.col("c_custkey") % 500).alias("new"))
    return plans.reversed_mapping(named, "old", "new")


@query("recovery_plan", """
SELECT l_orderkey, l_partkey % 8 AS unit, count(*) AS rows, count(DISTINCT l_returnflag) AS evidences, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'drifted' WHEN count(*) > 1 THEN 'repeated' ELSE 'single' END AS state FROM lineitem GROUP BY ALL""")
def recovery_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Entries for one unit merged only where their evidence is the same."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 8).alias("unit"), "l_returnflag")
    return plans.undrifted(rows, ["l_orderkey", "unit"], "l_returnflag")


@query("gap_worklist", """
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
 g AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS wanted, coalesce(b.n, 0) AS held FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT *, row_number() OVER (ORDER BY wanted - held DESC, wanted DESC, user_id) AS rank FROM g WHERE wanted > held""")
def gap_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Users by the gap between what they viewed and bought, the largest first."""
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("wanted"), F.count_if(F.col("event_type") == "purchase").alias("held")).where("wanted > held")
    keyed = n.withColumn("gap", F.col("held") - F.col("wanted")).withColumn("most", -F.col("wanted"))
    return numbered(keyed, ["gap", "most", "user_id"], "rank").drop("gap", "most")


@query("method_parity", """
WITH m AS (SELECT l_orderkey AS k, l_suppkey % 2 AS side, l_linenumber AS pos, l_returnflag || l_linestatus AS s, l_partkey, l_extendedprice FROM lineitem),
 w AS (SELECT k, side, count(*) AS n, sha256(string_agg(s, '>' ORDER BY pos, s)) AS h FROM m GROUP BY ALL), a AS (SELECT * FROM w WHERE side = 0), b AS (SELECT * FROM w WHERE side = 1)
SELECT k, coalesce(a.n, b.n) AS n, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.h = b.h THEN 'equal' WHEN a.n = b.n THEN 'operands_differ' ELSE 'length_differs' END AS state FROM a FULL JOIN b USING (k)""")
def method_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as methods, lines as instructions: equal once prices and parts, which only say where, are dropped."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey", F.col("l_linenumber").alias("at"), "l_returnflag", "l_linestatus", "l_partkey", "l_extendedprice")
    old, new = (lines.where(F.col("l_suppkey") % 2 == side) for side in (0, 1))
    return plans.parity(old, new, "k", "at", ["l_partkey", "l_extendedprice"], F.concat("l_returnflag", "l_linestatus"))


@query("release_verify", """
WITH m AS (SELECT page_id AS path, length(html) AS size, sha256(html) AS h FROM pages WHERE page_id % 10 <> 4), f AS (SELECT page_id AS path, length(html) + (CASE WHEN page_id % 9 = 2 THEN 1 ELSE 0 END) AS size, sha256(CASE WHEN page_id % 8 = 5 THEN url ELSE html END) AS h FROM pages WHERE page_id % 11 <> 6)
SELECT path, CASE WHEN f.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'extra' WHEN m.size <> f.size THEN 'size_differs' WHEN m.h <> f.h THEN 'digest_differs' ELSE 'good' END AS state FROM m FULL JOIN f USING (path)""")
def release_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Pages against a manifest: some are missing, longer or of other bytes than it says."""
    pages = table(spark, sf, "pages").withColumnRenamed("page_id", "path")
    manifest = pages.where("path % 10 <> 4").select("path", F.char_length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    body = F.when(F.col("path") % 8 == 5, F.col("url")).otherwise(F.col("html"))
    found = pages.where("path % 11 <> 6").select("path", (F.char_length("html") + F.when(F.col("path") % 9 == 2, 1).otherwise(0)).alias("size"), F.sha2(body, 256).alias("sha256"))
    return plans.verified(manifest, found)
