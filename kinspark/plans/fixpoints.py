"""Assignment, containment and rules that look at their own results, over the driver's tables.

The SQL of a fixpoint spells out more rounds than it takes on the given tables; those after the last one change nothing. On larger
tables names may flow for more rounds than that; the queries go on until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assignment, fixpoints, near, scopes
from .matching import PAIRS, balances
from .tables import Catalogue, table

query = Catalogue()


@query("greedy_assignment", f"""
WITH RECURSIVE {PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, c_custkey, s_suppkey) AS n FROM p),
 w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS c, []::BIGINT[] AS s UNION ALL
  SELECT o.n, CASE WHEN list_contains(c, c_custkey) OR list_contains(s, s_suppkey) THEN c ELSE list_append(c, c_custkey) END, CASE WHEN list_contains(c, c_custkey) OR list_contains(s, s_suppkey) THEN s ELSE list_append(s, s_suppkey) END
  FROM w JOIN o ON o.n = w.n + 1),
 t AS (SELECT unnest(c) AS c_custkey, unnest(s) AS s_suppkey FROM (SELECT * FROM w ORDER BY n DESC LIMIT 1))
SELECT c_custkey, s_suppkey, score FROM t JOIN p USING (c_custkey, s_suppkey)""")
def greedy_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of near balances, one to one, as a walk over falling scores assigns them."""
    return near.assigned(*balances(spark, sf)).drop("round")


_BROAD = 8


@query("superset_rivals", f"""
WITH s AS (SELECT user_id || '@' || ts::DATE AS owner, event_type || floor(value)::INT AS w, count(*) AS n FROM events GROUP BY ALL), x AS (SELECT DISTINCT user_id || '@' || ts::DATE AS owner FROM events WHERE value > 250),
 d AS (SELECT w, count(*) AS df FROM s GROUP BY 1), z AS (SELECT owner, sum(n)::BIGINT AS size, (sum(n) - sum(n) // 5)::BIGINT AS need FROM s GROUP BY 1),
 k AS (SELECT owner, w, n, df, size, need, coalesce(sum(n) OVER (PARTITION BY owner ORDER BY df, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM s JOIN d USING (w) JOIN z USING (owner)),
 r AS (SELECT owner, w, df FROM k WHERE bef < size - need + 1), p AS (SELECT owner, sum(df - 1)::BIGINT AS pool FROM r GROUP BY 1),
 c AS (SELECT DISTINCT r.owner, s.owner AS other FROM r JOIN p USING (owner) JOIN s USING (w) WHERE pool <= {_BROAD} AND r.owner <> s.owner),
 b AS (SELECT c.owner, c.other, coalesce(sum(CASE WHEN t.n IS NOT NULL THEN least(s.n, t.n) END), 0) AS both_n FROM c LEFT JOIN s ON s.owner = c.owner LEFT JOIN s t ON t.owner = c.other AND t.w = s.w GROUP BY ALL),
 j AS (SELECT b.owner, count(*) FILTER (WHERE both_n >= need) AS rivals, count(*) FILTER (WHERE both_n = size) AS supersets, count(*) FILTER (WHERE b.other IN (SELECT owner FROM x)) AS broken FROM b JOIN z ON z.owner = b.owner GROUP BY 1),
 v AS (SELECT z.owner, size, pool, coalesce(rivals, 0) AS rivals, coalesce(supersets, 0) AS supersets,
   CASE WHEN z.owner IN (SELECT owner FROM x) THEN 'incomplete' WHEN pool > {_BROAD} THEN 'too_broad' WHEN coalesce(broken, 0) > 0 THEN 'unscannable' WHEN coalesce(rivals, 0) > 0 THEN 'rivalled' ELSE 'unrivalled' END AS state FROM z JOIN p USING (owner) LEFT JOIN j USING (owner))
SELECT owner, size, pool, CASE WHEN state LIKE '%rivalled' THEN rivals ELSE -1 END AS rivals, CASE WHEN state LIKE '%rivalled' THEN supersets ELSE -1 END AS supersets, state FROM v""")
def superset_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """Days of users whose events another day has too, all or four fifths of them; days with too common events are withdrawn."""
    owner = F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    events = table(spark, sf, "events").select(owner.alias("owner"), F.concat("event_type", F.floor("value").cast("int").cast("string")).alias("w"), "value")
    sets = events.groupBy("owner", "w").agg(F.count(F.lit(1)).alias("n"))
    need = F.col("size") - F.floor(F.col("size") / 5)
    return assignment.contained(sets, "owner", "w", need, _BROAD, events.where("value > 250")).fillna(-1, ["rivals", "supersets"])


def _match_sql(rounds: int) -> str:
    step = ["""l AS (SELECT l_orderkey, l_partkey, NOT (l_linenumber = 1 AND l_orderkey % 10 = 0) AS later FROM lineitem),
 n AS MATERIALIZED (SELECT old, 'o' || o_orderkey AS id, 'o' || o_orderpriority || o_orderstatus AS shape FROM orders, (VALUES (true), (false)) t(old)
   UNION ALL SELECT old, 'c' || c_custkey, 'c' || c_mktsegment || CASE WHEN NOT old AND c_custkey % 20 = 0 THEN c_nationkey + 1 ELSE c_nationkey END FROM customer, (VALUES (true), (false)) t(old)
   UNION ALL SELECT old, 'p' || p_partkey, 'p' || p_brand || '~' || p_type || '~' || CASE WHEN NOT old AND p_partkey % 25 = 0 THEN p_size + 1 ELSE p_size END FROM part, (VALUES (true), (false)) t(old)),
 x AS (SELECT old, 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'by' AS kind FROM orders, (VALUES (true), (false)) t(old) UNION
   SELECT true, 'o' || l_orderkey, 'p' || l_partkey, 'line' FROM l UNION SELECT false, 'o' || l_orderkey, 'p' || l_partkey, 'line' FROM l WHERE later),
 e AS MATERIALIZED (SELECT old, src AS id, dst AS n, kind || '>' AS kind FROM x UNION ALL SELECT old, dst, src, kind || '<' FROM x),
 m0 AS (SELECT true AS old, '' AS n, '' AS canon, 0 AS round, '' AS new_id WHERE false)"""]
    for k in range(1, rounds + 2):
        step.append(f"""g{k} AS MATERIALIZED (SELECT n.old, n.id, n.shape, coalesce(s.sig, '') AS sig FROM n LEFT JOIN (SELECT e.old, e.id, md5(string_agg(e.kind || m.canon, ',' ORDER BY e.kind || m.canon)) AS sig
   FROM e JOIN m{k - 1} m ON m.old = e.old AND m.n = e.n GROUP BY ALL) s ON s.old = n.old AND s.id = n.id WHERE NOT EXISTS (SELECT 1 FROM m{k - 1} m WHERE m.old = n.old AND m.n = n.id)),
 u{k} AS MATERIALIZED (SELECT max(id) FILTER (WHERE old) AS id, max(id) FILTER (WHERE NOT old) AS new_id FROM g{k} GROUP BY shape, sig HAVING count(*) FILTER (WHERE old) = 1 AND count(*) FILTER (WHERE NOT old) = 1),
 m{k} AS MATERIALIZED (SELECT * FROM m{k - 1} UNION ALL SELECT true, id, id, {k}, new_id FROM u{k} UNION ALL SELECT false, new_id, id, {k}, new_id FROM u{k})""")
    last = rounds + 1
    return f"""WITH {', '.join(step)},
 h AS (SELECT shape, sig, count(*) FILTER (WHERE NOT old) AS there FROM g{last} GROUP BY ALL), i AS (SELECT *, sum(there) OVER (PARTITION BY shape) AS in_shape FROM h)
SELECT n AS id, round, new_id, 'matched' AS state FROM m{last} WHERE old UNION ALL
SELECT id, 0, '', CASE WHEN there > 0 THEN 'tied' WHEN in_shape > 0 THEN 'vetoed' ELSE 'alone' END FROM g{last} JOIN i USING (shape, sig) WHERE old"""


@query("neighbour_match", _match_sql(7))
def neighbour_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, customers and parts of two builds, the later one without some lines and with other shapes here and there, matched by shapes and
    by the neighbours that are matched already."""
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("old")
    orders, customer, part, lines = (table(spark, sf, t) for t in ("orders", "customer", "part", "lineitem"))
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    moved = lambda key, every, c: F.when(~F.col("old") & (F.col(key) % every == 0), F.col(c) + 1).otherwise(F.col(c)).cast("string")
    nodes = orders.select("*", sides).select("old", node("o", "o_orderkey").alias("id"), F.concat(F.lit("o"), "o_orderpriority", "o_orderstatus").alias("shape"))
    nodes = nodes.unionByName(customer.select("*", sides).select("old", node("c", "c_custkey").alias("id"), F.concat(F.lit("c"), "c_mktsegment", moved("c_custkey", 20, "c_nationkey")).alias("shape")))
    nodes = nodes.unionByName(part.select("*", sides).select("old", node("p", "p_partkey").alias("id"), F.concat(F.lit("p"), F.concat_ws("~", "p_brand", "p_type", moved("p_partkey", 25, "p_size"))).alias("shape")))
    edges = orders.select(sides, node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"), F.lit("by").alias("kind"))
    held = lines.select(sides, "l_orderkey", "l_partkey", "l_linenumber").where("old OR NOT (l_linenumber = 1 AND l_orderkey % 10 = 0)")
    edges = edges.unionByName(held.select("old", node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"), F.lit("line").alias("kind"))).distinct()
    return fixpoints.neighbour_matches(nodes, edges).select("id", "round", F.coalesce("new_id", F.lit("")).alias("new_id"), "state")


_LINKS = """t AS (SELECT count(*) AS n, min(c_custkey) AS low FROM customer),
 e AS MATERIALIZED (SELECT o_custkey AS src, (o_custkey * 17 + o_orderkey) % n + low AS dst, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey % n + low END AS guard FROM orders, t
  UNION SELECT c_custkey, (c_custkey - low + 1) % n + low, NULL FROM customer, t WHERE c_acctbal > 9000)"""


def _closure_sql(rounds: int) -> str:
    step = [_LINKS, "r0 AS (SELECT low AS v, 0 AS round FROM t)"]
    for k in range(1, rounds + 1):
        step.append(f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT DISTINCT dst, {k} FROM e WHERE src IN (SELECT v FROM r{k - 1}) AND (guard IS NULL OR guard IN (SELECT v FROM r{k - 1})) AND dst NOT IN (SELECT v FROM r{k - 1}))")
    return f"WITH {', '.join(step)} SELECT v, round FROM r{rounds}"


@query("growing_closure", _closure_sql(40))
def growing_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What the first customer reaches over orders, where one that is not urgent opens only once the customer that guards it is reached too, and rich
    customers that are reached bring the next one in."""
    customer = table(spark, sf, "customer")
    size = F.broadcast(customer.agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low")))
    guard = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey") % F.col("n") + F.col("low"))
    links = table(spark, sf, "orders").join(size).select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 17 + F.col("o_orderkey")) % F.col("n") + F.col("low")).alias("dst"), guard.alias("guard"))
    more = customer.where("c_acctbal > 9000").join(size).select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") - F.col("low") + 1) % F.col("n") + F.col("low")).alias("dst"), F.lit(None).cast("long").alias("guard"))
    return fixpoints.grown(links.unionByName(more), customer.agg(F.min("c_custkey").alias("v")))


_ASSIGNED = """k AS (SELECT user_id || ':' || json_extract_string(props, '$.k') AS v, event_type, value, user_id, ts, event_id FROM events),
 e AS MATERIALIZED (SELECT DISTINCT src, v AS dst FROM (SELECT v, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM k) WHERE src <> v),
 f AS (SELECT v, min(event_type) AS name, count(DISTINCT event_type) AS k FROM k WHERE value > 120 GROUP BY 1)"""


def _flow_sql(rounds: int) -> str:
    step = [_ASSIGNED, "r0 AS (SELECT v, CASE WHEN k = 1 THEN name END AS name, 0 AS round FROM f)"]
    for k in range(1, rounds + 1):
        step.append(f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT dst, CASE WHEN count(DISTINCT name) = 1 THEN min(name) END, {k} FROM e JOIN r{k - 1} ON v = src WHERE name IS NOT NULL AND dst NOT IN (SELECT v FROM r{k - 1}) GROUP BY 1)")
    return f"""WITH {', '.join(step)}, c AS (SELECT t.v, t.name, t.round, count(*) FILTER (WHERE s.name = t.name) AS support, count(*) FILTER (WHERE s.name IS DISTINCT FROM t.name AND s.name IS NOT NULL) AS rivals
  FROM r{rounds} t LEFT JOIN e ON e.dst = t.v LEFT JOIN r{rounds} s ON s.v = e.src GROUP BY ALL)
SELECT v, coalesce(name, '') AS name, round, support, rivals, CASE WHEN name IS NULL THEN 'ambiguous' WHEN rivals > 0 THEN 'conflicting' WHEN support > 1 THEN 'corroborated' ELSE 'named' END AS state FROM c"""


@query("flow_evidence", _flow_sql(30))
def flow_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Names along the assignments between neighbouring steps of a log: variables are a user's keys, and events of a high value name theirs."""
    v = F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    steps = table(spark, sf, "events").select(v.alias("v"), "event_type", "value", "user_id", "ts", "event_id")
    before = F.lag("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = steps.select(before.alias("src"), F.col("v").alias("dst")).where("src IS NOT NULL")
    return fixpoints.flowed(edges, steps.where("value > 120").select("v", F.col("event_type").alias("name"))).fillna("", ["name"])


_NAMES = r"""d AS (SELECT lang, doc_id, list_transform(string_split(text, ' ')[1:3], lambda x: regexp_replace(x, '[^A-Za-z]+', '', 'g')) AS w FROM documents),
 w AS (SELECT DISTINCT unnest([lang || '/' || w[1], lang || '/' || w[1] || '/' || w[2], lang || '/' || w[2] || '$' || w[3], lang || '/' || upper(w[3]), lang || '/' || upper(w[3]) || CASE WHEN doc_id % 5 = 0 THEN '_1' ELSE '' END]) AS name FROM d WHERE len(w) = 3 AND w[1] <> '' AND w[2] <> '' AND w[3] <> '')"""


def _repair_sql(rounds: int) -> str:
    step = [_NAMES, """t0 AS (SELECT DISTINCT string_split(name, '$')[1] AS was, string_split(name, '$')[1] AS top, 0 AS round FROM w)"""]
    for k in range(1, rounds + 1):
        step.append(f"""k{k} AS MATERIALIZED (SELECT *, lower(top) AS key, row_number() OVER (PARTITION BY lower(top) ORDER BY was) - 1 AS rank FROM t{k - 1}),
 f{k} AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS key FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(key, '/') AS p FROM k{k}))),
 t{k} AS MATERIALIZED (SELECT was, CASE WHEN rank > 0 THEN top || '_' || rank WHEN key IN (SELECT key FROM f{k}) THEN top || '_0' ELSE top END AS top, CASE WHEN rank > 0 OR key IN (SELECT key FROM f{k}) THEN {k} ELSE round END AS round FROM k{k})""")
    return f"WITH {', '.join(step)} SELECT name, top || name[length(was) + 1:] AS final, round FROM w JOIN t{rounds} ON was = string_split(name, '$')[1]"


@query("collision_repair", _repair_sql(6))
def collision_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Names made from the first words of documents, renamed until no two differ by case alone and none is a folder of another."""
    return fixpoints.repaired(_word_names(spark, sf), 20)


def _word_names(spark: SparkSession, sf: str) -> DataFrame:
    words = F.transform(F.slice(F.split("text", " "), 1, 3), lambda x: F.regexp_replace(x, "[^A-Za-z]+", ""))
    docs = table(spark, sf, "documents").select("lang", "doc_id", words.alias("w")).where("size(w) = 3").select("lang", "doc_id", *(F.col("w")[k].alias(f"w{k}") for k in range(3))).where("w0 <> '' AND w1 <> '' AND w2 <> ''")
    made = F.array(F.concat_ws("/", "lang", "w0"), F.concat_ws("/", "lang", "w0", "w1"), F.concat(F.concat_ws("/", "lang", "w1"), F.lit("$"), "w2"), F.concat_ws("/", "lang", F.upper("w2")), F.concat(F.concat_ws("/", "lang", F.upper("w2")), F.when(F.col("doc_id") % 5 == 0, "_1").otherwise("")))
    return docs.select(F.explode(made).alias("name"))


@query("collision_components", f"""WITH RECURSIVE {_NAMES}, k AS (SELECT name, lower(name) AS key, string_split(lower(name), '/') AS p FROM w),
 u AS (SELECT a.name AS a, b.name AS b FROM (SELECT name, array_to_string(p[1:i], '/') AS key FROM (SELECT name, p, unnest(range(1, len(p))) AS i FROM k)) a JOIN k b USING (key)),
 c AS (SELECT name AS a, min(name) OVER (PARTITION BY key) AS b FROM k), l AS (SELECT a, b FROM u UNION SELECT a, b FROM c WHERE a <> b), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT DISTINCT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b), m AS (SELECT v, min(c) AS component FROM r GROUP BY 1)
SELECT v AS name, component, count(*) OVER (PARTITION BY component) AS size, CASE WHEN v IN (SELECT a FROM u) AND v IN (SELECT b FROM u) THEN 'both' WHEN v IN (SELECT a FROM u) THEN 'inside' WHEN v IN (SELECT b FROM u) THEN 'folder' ELSE 'case' END AS relation FROM m""")
def collision_components(spark: SparkSession, sf: str) -> DataFrame:
    """Which of those names hang together by collisions, and how each collides."""
    return scopes.colliding(_word_names(spark, sf))


_COLOURS, _THINGS = "red blue hot small cold large green black".split(), "ring widget bolt gear gizmo nut screw panel".split()
_SCOPES = f"""p AS (SELECT p_partkey, replace(p_brand, '#', '') AS brand, split_part(p_name, ' ', 1) AS c, split_part(p_name, ' ', 2) AS t FROM part),
 cls AS (SELECT DISTINCT unnest([brand || '/' || c, brand || '/' || c || '$' || t]) AS name FROM p UNION SELECT brand || '/' || t FROM p WHERE p_partkey % 3 = 0),
 l AS (SELECT list(DISTINCT c ORDER BY c) AS cs, list(DISTINCT t ORDER BY t) AS ts FROM p),
 m AS (SELECT event_id, user_id AS unit, (json_extract_string(props, '$.k'))::INT AS k FROM events WHERE event_type = 'error'),
 a AS (SELECT event_id, unit, CASE WHEN k % 3 = 0 THEN ts[k % len(ts) + 1] WHEN k % 3 = 1 THEN cs[k % len(cs) + 1] || '.' || ts[k // 8 % len(ts) + 1] WHEN k % 7 = 0 THEN 'Brand' || (k % 25 + 1) || '.' || cs[k % len(cs) + 1] ELSE cs[k % len(cs) + 1] END AS token FROM m, l),
 u AS (SELECT DISTINCT user_id AS unit, 'Brand' || (user_id % 25 + 1) AS package, 'Brand' || (user_id % 25 + 1) || '/' || cs[user_id % len(cs) + 1] AS top FROM events, l),
 i AS (SELECT DISTINCT p_partkey % 150 AS unit, brand || '.' || c AS target FROM p WHERE p_partkey % 2 = 0), s AS (SELECT s_suppkey % 150 AS unit, 'Brand' || (s_nationkey + 1) AS package FROM supplier),
 d AS (SELECT DISTINCT unit, token, string_split(token, '.') AS q, replace(token, '.', '$') AS z FROM a),
 v AS (SELECT unit, token, 0 AS rank, 'qualified' AS channel, replace(token, '.', '/') AS name FROM d UNION
  SELECT unit, token, 0, 'qualified', array_to_string(q[1:j], '/') || CASE WHEN j < len(q) THEN '/' || array_to_string(q[j + 1:], '$') ELSE '' END FROM (SELECT *, unnest(range(1, len(q) + 1)) AS j FROM d) UNION
  SELECT unit, token, 1, 'nested', top || '$' || z FROM d JOIN u USING (unit) UNION
  SELECT unit, token, 2, 'explicit_import', replace(target, '.', '/') || CASE WHEN len(q) > 1 THEN '$' || array_to_string(q[2:], '$') ELSE '' END FROM d JOIN i USING (unit) WHERE q[1] = split_part(target, '.', 2) UNION
  SELECT unit, token, 3, 'same_package', package || '/' || z FROM d JOIN u USING (unit) UNION
  SELECT unit, token, 4, 'wildcard_import', s.package || '/' || z FROM d JOIN s USING (unit) UNION SELECT unit, token, 5, 'base', 'Brand1/' || z FROM d),
 c AS (SELECT v.* FROM v JOIN cls USING (name)), b AS (SELECT *, min(rank) OVER (PARTITION BY unit, token) = rank AS wins FROM c),
 g AS (SELECT unit, token, count(DISTINCT name) FILTER (WHERE wins) AS candidates, min(name) FILTER (WHERE wins) AS name, string_agg(DISTINCT rank || channel, ',' ORDER BY rank || channel) AS ch FROM b GROUP BY ALL),
 h AS (SELECT unit, token, count(DISTINCT name) AS every FROM b GROUP BY ALL)"""


@query("unresolved_triage", f"""WITH {_SCOPES}
SELECT event_id, a.token, CASE WHEN candidates IS NULL THEN 'missing' WHEN candidates = 1 THEN 'exact' ELSE 'ambiguous' END AS state, CASE WHEN candidates = 1 THEN name ELSE '' END AS name,
  coalesce(regexp_replace(ch, '[0-9]', '', 'g'), '') AS channels, coalesce(candidates, 0) AS candidates, coalesce(every - candidates, 0) AS hidden FROM a LEFT JOIN g USING (unit, token) LEFT JOIN h USING (unit, token)""")
def unresolved_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Errors over names, by the classes that the name could mean in its user's scope: nested, imported, in the package, by wildcard or of the base."""
    c, t = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    part = table(spark, sf, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"), c.alias("c"), t.alias("t"))
    classes = part.select(F.explode(F.array(F.concat_ws("/", "brand", "c"), F.concat(F.concat_ws("/", "brand", "c"), F.lit("$"), "t"))).alias("name")).unionByName(part.where("p_partkey % 3 = 0").select(F.concat_ws("/", "brand", "t").alias("name"))).distinct()
    lists = F.broadcast(part.agg(F.array_sort(F.collect_set("c")).alias("cs"), F.array_sort(F.collect_set("t")).alias("ts")))
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    at = lambda words, n: F.get(F.col(words), (n % F.size(words)).cast("int"))
    token = F.when(F.col("k") % 3 == 0, at("ts", F.col("k"))).when(F.col("k") % 3 == 1, F.concat_ws(".", at("cs", F.col("k")), at("ts", F.floor(F.col("k") / 8))))
    token = token.when(F.col("k") % 7 == 0, F.concat(F.lit("Brand"), (F.col("k") % 25 + 1).cast("string"), F.lit("."), at("cs", F.col("k")))).otherwise(at("cs", F.col("k")))
    mentions = events.where("event_type = 'error'").select("event_id", F.col("user_id").alias("unit"), k.alias("k")).join(lists).select("event_id", "unit", token.alias("token"))
    package = F.concat(F.lit("Brand"), (F.col("user_id") % 25 + 1).cast("string"))
    units = events.select("user_id").distinct().join(lists).select(F.col("user_id").alias("unit"), package.alias("package"), F.concat_ws("/", package, at("cs", F.col("user_id"))).alias("top"))
    imports = part.where("p_partkey % 2 = 0").select((F.col("p_partkey") % 150).alias("unit"), F.concat_ws(".", "brand", "c").alias("target"))
    wildcards = table(spark, sf, "supplier").select((F.col("s_suppkey") % 150).alias("unit"), F.concat(F.lit("Brand"), (F.col("s_nationkey") + 1).cast("string")).alias("package"))
    found = scopes.triaged(mentions, scopes.visible(mentions, classes, units, imports, wildcards, "Brand1"))
    return mentions.join(found, ["unit", "token"]).select("event_id", "token", "state", F.coalesce("name", F.lit("")).alias("name"), "channels", "candidates", "hidden")
