"""Filters, projections, inventories and sequences over the driver's tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, diffing, edits, matching, near, sequences
from ..sources import archive, logs
from ..sources.shared import settled
from .matching import balances
from .tables import Catalogue, table, year

query = Catalogue()

_BARE = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("multi_prefix_filter", f"""SELECT page_id, {_BARE} AS name FROM pages
WHERE starts_with({_BARE}, 'th') OR starts_with({_BARE}, 'm.') OR starts_with({_BARE}, 'be')""")
def multi_prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under any of several prefixes of their bare name."""
    name = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, sf, "pages").select("page_id", name.alias("name"))
    return pages.where(reduce(or_, (F.col("name").startswith(p) for p in ("th", "m.", "be"))))


@query("suffix_filter", f"""SELECT page_id, {_BARE} LIKE '%5' AS ends_in_5 FROM pages WHERE {_BARE} LIKE '%5' OR {_BARE} LIKE '%0'""")
def suffix_filter(spark: SparkSession, sf: str) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, sf, "pages").select("page_id", name.alias("name"))
    return pages.where(F.col("name").endswith("5") | F.col("name").endswith("0")).select("page_id", F.col("name").endswith("5").alias("ends_in_5"))


@query("special_name_exclusion", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1")
def special_name_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(~F.col("event_type").isin("error", "signup")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("json_projection", """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.other') AS other FROM events""")
def json_projection(spark: SparkSession, sf: str) -> DataFrame:
    """A required and an optional member of every event's properties."""
    return text.projected(table(spark, sf, "events").select("event_id", "props"), "props", {"k": "/k"}, {"other": "/other"}).drop("props")


@query("redaction_views", """
WITH a AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS segment FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT segment, c_nationkey, count(*) AS n FROM customer JOIN a USING (c_mktsegment) GROUP BY ALL""")
def redaction_views(spark: SparkSession, sf: str) -> DataFrame:
    """The public view of customers: names dropped, and segments, being few, replaced by their places in order, not by hashes."""
    customer = table(spark, sf, "customer")
    alias = sequences.numbered(customer.select("c_mktsegment").distinct(), ["c_mktsegment"], "segment")
    return customer.join(F.broadcast(alias), "c_mktsegment").groupBy("segment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("struct_flatten", """SELECT o_custkey, max(o_totalprice) AS top_price, max_by(o_orderkey, row(o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY 1""")
def struct_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's largest order as one struct, chosen whole and flattened again."""
    top = F.max(F.struct(F.col("o_totalprice").alias("top_price"), F.col("o_orderkey").alias("top_order")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(top.alias("s")).select("o_custkey", "s.*")


def _by_user(k: int) -> str:
    return f"SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events WHERE event_id % 2 = {k} GROUP BY ALL"


def _profile(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("inventory_compare", f"""
SELECT user_id, event_type, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n = b.n AND a.top = b.top THEN 'shared_exact' ELSE 'metadata_difference' END AS status,
  CASE WHEN a.n IS NULL OR b.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN a.top <> b.top THEN 'top' END) END AS differing
FROM ({_by_user(0)} HAVING n > 3) a FULL JOIN ({_by_user(1)} HAVING n > 3) b USING (user_id, event_type)""")
def inventory_compare(spark: SparkSession, sf: str) -> DataFrame:
    """What each half of the log has of a user's frequent event types, with the attributes that differ."""
    a, b = (_profile(spark, sf, k).where("n > 3") for k in (0, 1))
    return diffing.inventory(a, b, ["user_id", "event_type"], ["n", "top"])


@query("surface_compare", f"""
WITH j AS (SELECT user_id, event_type, a.n AS a, b.n AS b FROM ({_by_user(0)} HAVING n > 4) a FULL JOIN ({_by_user(1)} HAVING n > 4) b USING (user_id, event_type)),
 c AS (SELECT user_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE a <> b) AS different,
  count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only FROM j GROUP BY 1)
SELECT *, CASE WHEN common = 0 THEN CASE WHEN right_only = 0 THEN 'left_only' ELSE 'right_only' END WHEN different + left_only + right_only = 0 THEN 'equal' ELSE 'different' END AS state FROM c""")
def surface_compare(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (_profile(spark, sf, k).where("n > 4") for k in (0, 1))
    return diffing.surface(a, b, "user_id", "event_type", "n")


@query("set_distance", """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only,
 (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, NOT EXISTS (SELECT * FROM a INTERSECT SELECT * FROM b) AS disjoint""")
def set_distance(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return diffing.set_distance(orders.where("o_totalprice > 400000"), orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("exactly_one_lookup", """
SELECT p_partkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'several' ELSE 'exact' END AS state, CASE WHEN n = 1 THEN o ELSE -1 END AS l_orderkey
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""")
def exactly_one_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The order of a part's one large returned line."""
    held = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return matching.looked_up(table(spark, sf, "part").select("p_partkey"), held, "p_partkey", "l_orderkey").fillna(-1, ["l_orderkey"])


def _co(flag: str) -> str:
    return f"SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY ALL"


@query("edge_corroboration_mapped", f"""
WITH m AS (SELECT s_suppkey AS old, s_suppkey + 1 AS new FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT m.new AS l_suppkey, a.l_partkey, a.n, coalesce(b.n, 0) AS n_target, coalesce(b.n, 0) >= a.n AS holds
FROM ({_co('A')}) a JOIN m ON m.old = a.l_suppkey LEFT JOIN ({_co('R')}) b ON b.l_suppkey = m.new AND b.l_partkey = a.l_partkey""")
def edge_corroboration_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose supplier end goes through a mapping, before they are looked for on the other side."""
    lines = table(spark, sf, "lineitem")
    source, target = (lines.where(F.col("l_returnflag") == f).groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")) for f in "AR")
    mapping = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1).alias("new"))
    return matching.corroborated(matching.translated(source, ["l_suppkey"], mapping), target, ["l_suppkey", "l_partkey"])


_PAIRS = """p AS (SELECT c_custkey, s_suppkey, round(1 - abs(c_acctbal - s_acctbal) / 250.0, 6) AS score
  FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 250.0)"""


@query("mutual_best_outcomes", f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER l AS a, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS b,
  round(score - coalesce(lead(score) OVER l, 0.0), 6) AS lead FROM p WINDOW l AS (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey))
SELECT c_custkey, s_suppkey, score, lead, CASE WHEN score < 0.5 THEN 'low_score' WHEN lead < 0.05 THEN 'thin_lead' WHEN b > 1 THEN 'not_mutual' ELSE 'matched' END AS outcome FROM r WHERE a = 1""")
def mutual_best_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's best supplier, and why it is or is not a match."""
    return near.judged(*balances(spark, sf), 0.05, 0.5)


@query("weighted_status_sums", """
WITH f AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'risky' WHEN c_mktsegment = 'MACHINERY' THEN 'bound' ELSE 'free' END AS status FROM customer)
SELECT o_orderpriority, round(sum(CASE WHEN status = 'risky' THEN o_totalprice ELSE 0 END), 2) + 0.0 AS risky, round(sum(CASE WHEN status = 'bound' THEN o_totalprice ELSE 0 END), 2) + 0.0 AS bound,
  round(sum(CASE WHEN status = 'free' THEN o_totalprice ELSE 0 END), 2) + 0.0 AS free, count(*) FILTER (WHERE status IS NULL) AS unknown FROM orders LEFT JOIN f ON c_custkey = o_custkey GROUP BY 1""")
def weighted_status_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Prices by priority and the status of who ordered."""
    status = F.when(F.col("c_acctbal") < 0, "risky").when(F.col("c_mktsegment") == "MACHINERY", "bound").otherwise("free")
    held = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), status.alias("status"))
    of = lambda s: (F.round(F.sum(F.when(F.col("status") == s, F.col("o_totalprice")).otherwise(0.0)), 2) + F.lit(0.0)).alias(s)
    return table(spark, sf, "orders").join(held, "o_custkey", "left").groupBy("o_orderpriority").agg(of("risky"), of("bound"), of("free"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query("unnest_counts", """
WITH t AS (SELECT doc_id, 'doc' AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents UNION ALL SELECT conv_id, 'talk', unnest(string_split(coalesce(text, ''), chr(10))) FROM conversations)
SELECT kind, length(line) = 0 AS blank, count(*) AS n, count(DISTINCT doc_id) AS owners FROM t GROUP BY ALL""")
def unnest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents and of conversations, from two nested sources into one count."""
    split = lambda df, key, kind: df.select(F.col(key).alias("owner"), F.lit(kind).alias("kind"), F.explode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = split(table(spark, sf, "documents"), "doc_id", "doc").unionByName(split(table(spark, sf, "conversations"), "conv_id", "talk"))
    return lines.groupBy("kind", (F.char_length("line") == 0).alias("blank")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner").alias("owners"))


@query("trailing_frame", """
SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS before FROM events""")
def trailing_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The ten event types before each event."""
    before = sequences.trailing("event_type", 10, sequences.ordered("user_id", "ts", "event_id"))
    return table(spark, sf, "events").select("event_id", F.array_join(before, ">").alias("before"))


@query("kind_ordinals", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem")
def kind_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Which of its order's lines of one return flag a line is."""
    ordinal = sequences.kind_ordinal(["l_orderkey"], "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", ordinal.cast("long").alias("ordinal"))


@query("predecessor_test", """
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 40)
SELECT event_id, user_id FROM e WHERE event_type = 'purchase' AND prev = 'click' AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id)""")
def predecessor_test(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases right after a click, of users that no costly error ever jumped into."""
    events = table(spark, sf, "events")
    before = F.lag("event_type").over(sequences.ordered("user_id", "ts", "event_id"))
    found = events.select("event_id", "user_id", "event_type", before.alias("prev")).where("event_type = 'purchase' AND prev = 'click'")
    return found.join(events.where("event_type = 'error' AND value > 40").select("user_id"), "user_id", "left_anti").select("event_id", "user_id")


def _zip_side(k: int) -> str:
    return f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_type AS shape,
      CASE WHEN event_type = 'purchase' THEN count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS anchor FROM events WHERE event_id % 2 = {k}"""


def _blocks(k: int) -> str:
    w = "(PARTITION BY user_id ORDER BY place ROWS BETWEEN {})"
    lr = f"""SELECT *, coalesce((last_value(anchor IGNORE NULLS) OVER {w.format('UNBOUNDED PRECEDING AND 1 PRECEDING')})::VARCHAR, '^') AS l,
      coalesce((first_value(anchor IGNORE NULLS) OVER {w.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')})::VARCHAR, '$') AS r FROM ({_zip_side(k)})"""
    return f"SELECT user_id, l, r, place, shape, row_number() OVER (PARTITION BY user_id, l, r ORDER BY place) AS pos, count(*) OVER (PARTITION BY user_id, l, r) AS size FROM ({lr}) WHERE anchor IS NULL"


@query("anchored_blocks", f"""
WITH a AS ({_blocks(0)}), b AS ({_blocks(1)}),
 h AS (SELECT user_id, a.place AS old_place, b.place AS new_place, a.pos, min((a.shape = b.shape)::INT) OVER (PARTITION BY user_id, l ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ok FROM a JOIN b USING (user_id, l, pos)),
 t AS (SELECT user_id, x.place AS old_place, y.place AS new_place, min((x.shape = y.shape)::INT) OVER (PARTITION BY user_id, r ORDER BY back ROWS UNBOUNDED PRECEDING) AS ok
   FROM (SELECT *, size - pos AS back FROM a) x JOIN (SELECT *, size - pos AS back FROM b) y USING (user_id, r, back)),
 u AS (SELECT user_id, old_place, new_place, 'prefix' AS mode FROM h WHERE ok = 1 UNION ALL SELECT user_id, old_place, new_place, 'suffix' FROM t WHERE ok = 1)
SELECT user_id, old_place, new_place, CASE WHEN count(*) > 1 THEN 'whole' ELSE min(mode) END AS mode FROM u GROUP BY ALL""")
def anchored_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks between numbered purchases that begin, end or read alike in both halves of a user's log."""

    def side(k: int) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        bought = F.col("event_type") == "purchase"
        nth = F.sum(bought.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        half = table(spark, sf, "events").where(F.col("event_id") % 2 == k)
        return half.select("user_id", F.row_number().over(w).cast("long").alias("place"), F.col("event_type").alias("shape"), F.when(bought, nth).alias("anchor"))

    return sequences.anchored_blocks(side(0), side(1), "user_id", "place", "anchor", "shape")


@query("flow_edges", """
WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
 x AS (SELECT event_type AS src, nxt AS dst FROM e WHERE nxt IS NOT NULL AND event_type <> 'purchase'
   UNION ALL SELECT 'purchase', unnest(['view', 'exit']) FROM e WHERE event_type = 'purchase' UNION ALL SELECT event_type, 'handler' FROM e WHERE nxt = 'error')
SELECT src, dst, count(*) AS n FROM x GROUP BY ALL""")
def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Control flow of a log: a step falls through to the next, a purchase branches to two targets, and a step before an error also to its handler."""
    after = F.lead("event_type").over(sequences.ordered("user_id", "ts", "event_id"))
    steps = table(spark, sf, "events").select("event_type", after.alias("nxt"))
    through = F.when((F.col("event_type") != "purchase") & F.col("nxt").isNotNull(), F.col("nxt"))
    targets = F.array_compact(F.concat(F.array(through, F.when(F.col("nxt") == "error", F.lit("handler"))), F.when(F.col("event_type") == "purchase", F.array(F.lit("view"), F.lit("exit"))).otherwise(F.array().cast("array<string>"))))
    return steps.select(F.col("event_type").alias("src"), F.explode(targets).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("vetoed_pattern", """
WITH e AS (SELECT *, lag(event_type, 2) OVER w AS a, lag(event_type) OVER w AS b, lag(event_id, 2) OVER w AS first_id, lag(value, 1) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, first_id, event_id FROM e WHERE a = 'view' AND b = 'click' AND event_type = 'view' AND NOT (v > 20)""")
def vetoed_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed pattern of three steps, unless something jumps into its middle (a click of a high value)."""
    w = sequences.ordered("user_id", "ts", "event_id")
    found = sequences.ends_pattern("event_type", ["view", "click", "view"], w) & ~F.coalesce(F.lag("value").over(w) > 20, F.lit(False))
    return table(spark, sf, "events").select("user_id", F.lag("event_id", 2).over(w).alias("first_id"), "event_id", found.alias("found")).where("found").drop("found")


@query("global_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 largest orders: each partition keeps 25, and those are merged."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("canonical_order", """
SELECT p_brand, p_type, p_size, row_number() OVER (ORDER BY s) AS place FROM (SELECT DISTINCT p_brand, p_type, p_size, concat_ws('~', p_brand, p_type, p_size) AS s FROM part)""")
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed keys in the order of their canonical spelling."""
    keys = table(spark, sf, "part").select("p_brand", "p_type", "p_size").distinct().withColumn("s", F.concat_ws("~", "p_brand", "p_type", F.col("p_size").cast("string")))
    return sequences.numbered(keys, ["s"], "place").drop("s")


@query("map_lookup", """
WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, coalesce(max(n) FILTER (WHERE event_type = 'purchase'), 0) AS purchases, coalesce(max(n) FILTER (WHERE event_type = 'error'), 0) AS errors, count(*) AS kinds FROM m GROUP BY 1""")
def map_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by event type as a map of each user, with zero for what a map has not."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("long")
    return maps.select("user_id", get("purchase").alias("purchases"), get("error").alias("errors"), F.size("m").cast("long").alias("kinds"))


@query("name_functions", """
SELECT p_partkey, regexp_replace(p_name || '#' || p_size, '[^A-Za-z0-9_]+', '_', 'g') AS legal, round_even(least(p_size, p_partkey % 50 + 1) / greatest(p_size, p_partkey % 50 + 1), 6) AS similarity,
 2 + (p_size % 3) AS arguments, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 6 END AS slots FROM part""")
def name_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Legal names, size similarity, top-level arguments and descriptor slots."""
    other = F.col("p_partkey") % 50 + 1
    third = F.col("p_size") % 3
    call = F.concat(F.lit("f(a, b[c, d]), g<h, i>"), F.repeat(F.lit(", (x, {y, z})"), third))
    descriptor = F.concat(F.lit("(IJ"), F.when(third == 0, "").when(third == 1, "Lq/R;").otherwise("[[DI[J"), F.lit(")V"))
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey",
        text.legal_name(F.concat("p_name", F.lit("#"), F.col("p_size").cast("string"))).alias("legal"),
        text.size_similarity(F.col("p_size"), other).alias("similarity"),
        text.top_level_count(call).cast("long").alias("arguments"),
        text.argument_slots(descriptor).cast("long").alias("slots"),
    )


@query("log_classification", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations),
 c AS (SELECT conv_id, CASE WHEN line = '' THEN 'blank' WHEN line LIKE '%?' THEN 'question' WHEN regexp_matches(line, '^[0-9]') THEN 'numbered' WHEN line LIKE '%,%' THEN 'clause' WHEN length(line) < 40 THEN 'short' ELSE 'other' END AS category FROM l)
SELECT conv_id, category, count(*) AS n FROM c GROUP BY ALL""")
def log_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a log without colour codes and returns, by the first category that fits."""
    lines = table(spark, sf, "conversations").select("conv_id", F.explode(F.split(text.plain_lines(F.col("text")), "\n")).alias("line"))
    line = F.col("line")
    rules = [("blank", line == ""), ("question", line.endswith("?")), ("numbered", line.rlike("^[0-9]")), ("clause", line.contains(",")), ("short", F.char_length(line) < 40)]
    return lines.groupBy("conv_id", diffing.first_match(rules, "other").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _anchor_case(column: int) -> str:
    values = [f"WHEN regexp_matches(literal, '{a[1]}') THEN {a[column]!r}{'::DOUBLE' if column == 2 else ''}" for a in text.ANCHORS]
    return f"CASE {' '.join(values)} END"


_LITERALS = f"""l AS (SELECT DISTINCT owner, trim(x, e' \t\r\n') AS literal FROM (SELECT 'c' || conv_id AS owner, unnest(string_split(text, chr(10))) AS x FROM conversations UNION ALL SELECT 'c' || conv_id, unnest(regexp_split_to_array(text, '[ .,\n]+')) FROM conversations
   UNION ALL SELECT 'p' || page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') FROM pages)),
 k AS (SELECT *, {_anchor_case(0)} AS kind, {_anchor_case(2)} AS weight FROM l)"""


@query("semantic_dossier", f"""WITH {_LITERALS}, d AS (SELECT literal, count(*) AS df FROM k WHERE kind IS NOT NULL GROUP BY 1), n AS (SELECT count(DISTINCT owner) AS owners FROM l),
 s AS (SELECT owner, literal, kind, df, round(weight * ln((owners + 1) / df) * (length(literal) / (length(literal) + {text.HALF_LENGTH})), 6) AS score FROM k JOIN d USING (literal), n WHERE kind IS NOT NULL)
SELECT owner, literal, kind, df, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, literal) AS rank FROM s) WHERE rank <= 4""")
def semantic_dossier(spark: SparkSession, sf: str) -> DataFrame:
    """The four best anchors among the lines, words and addresses of each conversation and page, by kind, rarity and length."""
    talk = table(spark, sf, "conversations")
    name = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    owner = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string")).alias("owner")
    said = talk.select(owner("c", "conv_id"), F.explode(F.concat(F.split("text", "\n"), F.split("text", "[ .,\n]+"))).alias("literal"))
    literals = said.unionByName(table(spark, sf, "pages").select(owner("p", "page_id"), name.alias("literal")))
    literals = settled(literals.select("owner", F.trim("literal", F.lit(" \t\r\n")).alias("literal")).distinct(), "literals")
    kinds = literals.withColumn("a", text.anchor(F.col("literal"))).where("a IS NOT NULL").select("owner", "literal", "a.kind", "a.weight")
    frequency = kinds.groupBy("literal").agg(F.count(F.lit(1)).alias("df"))
    owners = literals.agg(F.count_distinct("owner").alias("owners"))
    score = F.round(text.anchor_score(F.col("weight"), F.col("literal"), F.col("df"), F.col("owners")), 6)
    scored = kinds.join(frequency, "literal").join(F.broadcast(owners)).withColumn("score", score)
    return matching.best_of_each(scored, "owner", "literal", 4).select("owner", "literal", "kind", "df", "score", "rank")


def _front(k: int) -> str:
    return f"SELECT event_type AS category, floor(value / 10)::INT AS shape, count(*) AS n FROM events WHERE event_id % 2 = {k} GROUP BY ALL"


@query("frontier_compare", f"""
SELECT category, shape, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS shared, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS resolved, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS introduced,
  CASE WHEN coalesce(a.n, 0) = 0 THEN 100.0 ELSE round(100.0 * least(coalesce(a.n, 0), coalesce(b.n, 0)) / a.n, 4) END AS percent_kept FROM ({_front(0)}) a FULL JOIN ({_front(1)}) b USING (category, shape)""")
def frontier_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two frontiers of diagnostics as multisets: what is shared, resolved and introduced."""
    shape = F.floor(F.col("value") / 10).cast("int")
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), shape.alias("shape"))
    return logs.compared(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["category", "shape"])


@query("ordinal_pseudonyms", """
WITH s AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1), a AS (SELECT source, 'F' || row_number() OVER (ORDER BY f, source) AS alias FROM s)
SELECT alias, count(*) AS n, count(DISTINCT lang) AS langs FROM documents JOIN a USING (source) GROUP BY 1""")
def ordinal_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Sources under names that only tell the order in which they were first seen."""
    docs = table(spark, sf, "documents")
    alias = sequences.first_seen(docs, "source", "doc_id").select("source", F.concat(F.lit("F"), F.col("alias").cast("string")).alias("alias"))
    return docs.join(F.broadcast(alias), "source").groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))


@query("edit_steps", None)
def edit_steps(spark: SparkSession, sf: str) -> DataFrame:
    """How the event types of a user's two halves differ step by step."""
    halves = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("all"))
    half = F.floor(F.size("all") / 2).cast("int")
    pairs = halves.select("user_id", F.transform(F.slice("all", F.lit(1), half), lambda x: x.event_type).alias("left"), F.transform(F.slice("all", half + 1, F.size("all")), lambda x: x.event_type).alias("right"))
    return edits.edit_scripts(pairs, "user_id", "long")


@query("archive_index_scan", "SELECT 'pages-' || page_id // 100 || '.zip' AS archive, page_id || '.html' AS path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS sha256 FROM pages")
def archive_index_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Pages packed into archives of a hundred and found again in their index; there are more archives of more pages, none larger."""
    return archive.entries_of(archive.packed(_packable(spark, sf))).where("error IS NULL").select("archive", "path", "size", "sha256")


def _packable(spark: SparkSession, sf: str) -> DataFrame:
    number = F.floor(F.col("page_id") / 100).cast("string")
    return table(spark, sf, "pages").select(F.concat(F.lit("pages-"), number, F.lit(".zip")).alias("archive"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))


@query("archive_lookup", """
SELECT 'pages-' || page_id // 100 || '.zip' AS archive, page_id || '.html' AS path, sha256(html) AS sha256 FROM pages WHERE url LIKE '%.html' OR url LIKE '%#top'""")
def archive_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of some kinds of addresses looked up in those archives: only wanted entries are decompressed."""
    pages = table(spark, sf, "pages").where("url LIKE '%.html' OR url LIKE '%#top'")
    number = F.floor(F.col("page_id") / 100).cast("string")
    wanted = pages.select(F.concat(F.lit("pages-"), number, F.lit(".zip")).alias("archive"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    missing = wanted.withColumn("path", F.concat("path", F.lit(".gone")))  # no entry, so no row
    found = archive.lookup(archive.packed(_packable(spark, sf)), wanted.unionByName(missing))
    return found.select("archive", "path", F.sha2("content", 256).alias("sha256"))


@query("archive_manifest_gate", "SELECT 'a' || page_id // 200 AS archive, (page_id % 100)::VARCHAR AS path, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1")
def archive_manifest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Names that an archive has more than once, from its directory alone."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("a"), F.floor(F.col("page_id") / 200).cast("string")).alias("archive"), (F.col("page_id") % 100).cast("string").alias("path"), F.encode("url", "UTF-8").alias("content"))
    return archive.duplicates(archive.directory_of(archive.packed(pages)))


@query("body_authentication", """
WITH b AS (SELECT o_orderkey, upper(substr(sha256(length(o_custkey::VARCHAR) || ':' || o_custkey || '|' || length(o_orderstatus) || ':' || o_orderstatus), 1, 20)) AS d FROM orders)
SELECT o_orderkey, o_orderkey % 10 <> 3 AS authentic FROM b""")
def body_authentication(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under ids made from their bodies; in one of ten the id is of something else."""
    columns = ["o_custkey", "o_orderstatus"]
    own = F.concat(F.lit("O_"), checks.body_digest(columns, 20))
    rows = table(spark, sf, "orders").withColumn("id", F.when(F.col("o_orderkey") % 10 == 3, F.concat(own, F.lit("0"))).otherwise(own))
    return checks.authenticated(rows, "id", columns, "O_").select("o_orderkey", "authentic")


@query("digest_pins", """
WITH a AS (SELECT o_custkey AS name, count(*) AS n FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS name, count(*) AS n FROM orders WHERE o_orderdate < '1997-03-01' GROUP BY 1)
SELECT name, CASE WHEN a.n IS NULL THEN 'unpinned' WHEN b.n IS NULL THEN 'gone' WHEN a.n = b.n THEN 'held' ELSE 'drifted' END AS state FROM a FULL JOIN b USING (name)""")
def digest_pins(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders pinned at the end of a year and read again two months later."""
    orders = table(spark, sf, "orders")
    at = lambda day: orders.where(F.col("o_orderdate") < F.lit(day).cast("timestamp")).groupBy(F.col("o_custkey").alias("name")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("digest"))
    return checks.pinned(at("1997-01-01"), at("1997-03-01"))


@query("one_to_one_gate", """
WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT 'left' AS side, l_orderkey::VARCHAR AS key, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'right', l_suppkey::VARCHAR, count(*) FROM p GROUP BY ALL HAVING count(*) > 1""")
def one_to_one_gate(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return checks.one_to_one(pairs, "l_orderkey", "l_suppkey")


@query("version_backtest", """
WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' GROUP BY 1)
SELECT 'orders_1996' AS name, 'gte' AS comparator, 100::BIGINT AS expected, n AS actual, n >= 100 AS holds FROM y WHERE y = 1996 UNION ALL
SELECT 'orders_1997', 'lte', 100::BIGINT, n, n <= 100 FROM y WHERE y = 1997 UNION ALL SELECT 'customers_1996', 'eq', 5::BIGINT, c, c = 5 FROM y WHERE y = 1996""")
def version_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of two builds against what was expected of them; unknown names would be rejected."""
    orders = table(spark, sf, "orders").where(year("o_orderdate", 1996) | year("o_orderdate", 1997))
    a, b = (year("o_orderdate", y) for y in (1996, 1997))
    expected = [("orders_1996", F.count_if(a), "gte", 100), ("orders_1997", F.count_if(b), "lte", 100), ("customers_1996", F.count_distinct(F.when(a, F.col("o_custkey"))), "eq", 5)]
    return checks.expectations(orders, expected, known=["orders_1996", "orders_1997", "customers_1996"])
