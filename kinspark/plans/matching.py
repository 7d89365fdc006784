"""Matching, joins and differences over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffing, matching, near
from .tables import halves, table, year

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


HALVES = "o AS (SELECT * FROM part WHERE p_partkey % 2 = 0), n AS (SELECT * FROM part WHERE p_partkey % 2 = 1)"


def _unique(key: str, o: str = "o", n: str = "n") -> str:
    return f"""SELECT a.id AS old_id, b.id AS new_id, {key} FROM
      (SELECT {key}, min(p_partkey) AS id FROM {o} GROUP BY {key} HAVING count(*) = 1) a
      JOIN (SELECT {key}, min(p_partkey) AS id FROM {n} GROUP BY {key} HAVING count(*) = 1) b USING ({key})"""


@query("coverage_rollup", """
SELECT coalesce(o_orderstatus, 'ALL') AS status, count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
       round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 4) AS percent
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())""")
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    rolled = table(spark, sf, "orders").rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("total"), urgent.alias("urgent"))
    return rolled.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), "total", "urgent", diffing.percent(F.col("urgent"), F.col("total")).alias("percent"))


@query("unique_key_match", f"WITH {HALVES} {_unique('p_brand, p_type, p_size, p_name')}")
def unique_key_match(spark: SparkSession, sf: str) -> DataFrame:
    old, new = halves(spark, sf)
    return matching.unique_match(old, new, ["p_brand", "p_type", "p_size", "p_name"], "p_partkey")


STAGES = (("exact", ["p_brand", "p_type", "p_size", "p_name"]), ("structure", ["p_brand", "p_type", "p_size"]), ("loose", ["p_type", "p_size", "p_name"]))


def _cascade_sql() -> str:
    ctes, old, new, out = [HALVES], "o", "n", []
    for i, (name, key) in enumerate(STAGES):
        ctes.append(f"m{i} AS ({_unique(', '.join(key), old, new)})")
        ctes.append(f"o{i} AS (SELECT * FROM {old} WHERE p_partkey NOT IN (SELECT old_id FROM m{i}))")
        ctes.append(f"n{i} AS (SELECT * FROM {new} WHERE p_partkey NOT IN (SELECT new_id FROM m{i}))")
        old, new = f"o{i}", f"n{i}"
        out.append(f"SELECT old_id, new_id, '{name}' AS stage FROM m{i}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(out)}"


@query("cascade_match", _cascade_sql())
def cascade_match(spark: SparkSession, sf: str) -> DataFrame:
    old, new = halves(spark, sf)
    return matching.cascade(old, new, STAGES, "p_partkey")


ANCHORS = f"""{HALVES}, u AS ({_unique('p_type, p_size, p_name')}),
  c AS (SELECT x.p_brand AS old_brand, y.p_brand AS new_brand, count(*) AS support
        FROM u JOIN o x ON x.p_partkey = u.old_id JOIN n y ON y.p_partkey = u.new_id GROUP BY ALL),
  r AS (SELECT *, round(support / sum(support) OVER (PARTITION BY old_brand), 6) AS share,
               row_number() OVER (PARTITION BY old_brand ORDER BY support DESC, new_brand) AS k FROM c),
  a AS (SELECT old_brand, new_brand, support, share FROM r WHERE k = 1 AND share >= 0.01 AND support >= 1)"""


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    old, new = halves(spark, sf)
    pairs = matching.unique_match(old, new, ["p_type", "p_size", "p_name"], "p_partkey").select("old_id", "new_id")
    pairs = pairs.join(old.select(F.col("p_partkey").alias("old_id"), F.col("p_brand").alias("old_brand")), "old_id")
    pairs = pairs.join(new.select(F.col("p_partkey").alias("new_id"), F.col("p_brand").alias("new_brand")), "new_id")
    return matching.dominant_targets(pairs, "old_brand", "new_brand", 0.01, 1)


@query("anchor_prefixes", f"WITH {ANCHORS} SELECT * FROM a")
def anchor_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return _anchors(spark, sf)


@query("anchor_translate_join", f"""
WITH {ANCHORS}, t AS (SELECT o.* EXCLUDE (p_brand), a.new_brand AS p_brand FROM o JOIN a ON a.old_brand = o.p_brand)
{_unique('p_brand, p_size, p_name', 't', 'n')}""")
def anchor_translate_join(spark: SparkSession, sf: str) -> DataFrame:
    old, new = halves(spark, sf)
    anchors = _anchors(spark, sf).select(F.col("old_brand").alias("p_brand"), "new_brand")
    moved = old.join(anchors, "p_brand").drop("p_brand").withColumnRenamed("new_brand", "p_brand")
    return matching.unique_match(moved, new, ["p_brand", "p_size", "p_name"], "p_partkey")


BAND = 250.0
PAIRS = f"""p AS (SELECT c_custkey, s_suppkey, round(1 - abs(c_acctbal - s_acctbal) / {BAND}, 6) AS score
  FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= {BAND})"""


def balances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str, str, str, str, str, float]:
    """Customers and suppliers of a nation by balance, as the operators on near rows take them."""
    left = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    right = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return left, right, "nation", "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal", BAND


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    left, right, nation, _, _, *band = balances(spark, sf)
    return near.scored(left, right, nation, *band)


@query("scored_pairs_topk", f"""WITH {PAIRS}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS rank FROM p) WHERE rank <= 3""")
def scored_pairs_topk(spark: SparkSession, sf: str) -> DataFrame:
    return matching.best_of_each(scored_pairs(spark, sf), "c_custkey", "s_suppkey", 3)


@query("mutual_best_margin", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER l AS a, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS b,
  round(score - coalesce(lead(score) OVER l, 0.0), 6) AS lead FROM p WINDOW l AS (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey))
SELECT c_custkey, s_suppkey, score, lead FROM r WHERE a = 1 AND b = 1 AND lead >= 0.01""")
def mutual_best_margin(spark: SparkSession, sf: str) -> DataFrame:
    return near.judged(*balances(spark, sf), 0.01).where("outcome = 'matched'").drop("outcome")


def _year(y: int) -> str:
    return f"SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = {y} GROUP BY 1"


DIFF = f"""d AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS old_digest, b.n AS new_digest,
  CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status
  FROM ({_year(1996)}) a FULL JOIN ({_year(1997)}) b ON a.o_custkey = b.o_custkey)"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    old, new = (orders.where(year("o_orderdate", y)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")) for y in (1996, 1997))
    return diffing.outer_diff(old, new, "o_custkey", "n")


@query("snapshot_diff", f"WITH {DIFF} SELECT o_custkey, coalesce(old_digest, 0) AS old_digest, coalesce(new_digest, 0) AS new_digest, status FROM d")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).fillna(0, ["old_digest", "new_digest"])


@query("delta_classification", f"""WITH {DIFF}
SELECT CASE WHEN status = 'same' THEN 'unchanged' WHEN status IN ('added', 'removed') THEN 'moved' WHEN abs(new_digest - old_digest) = 1 THEN 'minor'
  WHEN new_digest > old_digest THEN 'grown' ELSE 'shrunk' END AS delta, count(*) AS n FROM d GROUP BY 1""")
def delta_classification(spark: SparkSession, sf: str) -> DataFrame:
    change = F.col("new_digest") - F.col("old_digest")
    rules = [("unchanged", F.col("status") == "same"), ("moved", F.col("status").isin("added", "removed")), ("minor", F.abs(change) == 1), ("grown", change > 0)]
    return _diff(spark, sf).groupBy(diffing.first_match(rules, "shrunk").alias("delta")).agg(F.count(F.lit(1)).alias("n"))


@query("two_build_partition", """
SELECT o_custkey, CASE WHEN a AND b THEN 'carried' WHEN a THEN 'blocked' ELSE 'new_only' END AS status FROM
 (SELECT o_custkey, bool_or(year(o_orderdate) = 1996) AS a, bool_or(year(o_orderdate) = 1997) AS b FROM orders GROUP BY 1) WHERE a OR b""")
def two_build_partition(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where(year("o_orderdate", 1996) | year("o_orderdate", 1997))
    return diffing.presence(orders, "o_custkey", year("o_orderdate", 1996), year("o_orderdate", 1997))


@query("unmatched_left", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 25)")
def unmatched_left(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of which no large line was returned."""
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 25").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", "p_name").join(seen, "p_partkey", "left_anti")


@query("unmatched_right", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def unmatched_right(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order."""
    seen = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("semi_targets", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_targets(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_semi")


def _edges(flag: str) -> str:
    return f"SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY ALL"


@query("edge_corroboration", f"SELECT a.*, coalesce(b.n, 0) AS n_target, coalesce(b.n, 0) >= a.n AS holds FROM ({_edges('A')}) a LEFT JOIN ({_edges('R')}) b USING (l_suppkey, l_partkey)")
def edge_corroboration(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    source, target = (lines.where(F.col("l_returnflag") == f).groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")) for f in "AR")
    return matching.corroborated(source, target, ["l_suppkey", "l_partkey"])


@query("left_lookup_unresolved", """
SELECT c_custkey, coalesce(n, 0) AS n_orders, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'exact' ELSE 'several' END AS state
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_lookup_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "exact").otherwise("several")
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), state.alias("state"))


@query("shape_compatible_pairs", """
WITH s AS (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS sizes FROM part GROUP BY ALL)
SELECT a.p_brand, a.p_type, b.p_type AS other_type FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_type < b.p_type
 AND abs(a.n - b.n) <= greatest(2, floor(greatest(a.n, b.n) * 0.35)) AND abs(a.sizes - b.sizes) <= greatest(3, floor(greatest(a.sizes, b.sizes) * 0.30))""")
def shape_compatible_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_size").alias("sizes"))
    a, b = s.alias("a"), s.alias("b")
    c = F.col
    fits = (c("a.p_brand") == c("b.p_brand")) & (c("a.p_type") < c("b.p_type")) & matching.shape_compatible(c("a.n"), c("b.n"), 2, 0.35) & matching.shape_compatible(c("a.sizes"), c("b.sizes"), 3, 0.30)
    return a.join(b, fits).select("a.p_brand", "a.p_type", c("b.p_type").alias("other_type"))


@query("containment_rivals", """
WITH k AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1),
 c AS (SELECT s, count(*) AS members FROM k GROUP BY 1)
SELECT a.s AS witness_set, a.members, count(b.s) AS rival_sets, coalesce(sum(b.members), 0)::BIGINT AS rivals
FROM c a LEFT JOIN c b ON a.s <> b.s AND list_has_all(string_split(b.s, ','), string_split(a.s, ',')) GROUP BY ALL""")
def containment_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with equal witness sets are one class; classes are divided by their witnesses."""
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("set"))
    classes = sets.groupBy("set").agg(F.count(F.lit(1)).alias("members")).withColumn("witness_set", F.array_join("set", ","))
    each = classes.select("witness_set", F.explode("set").alias("w"))
    other = classes.select(F.col("witness_set").alias("other"), F.col("members").alias("other_members"), F.explode("set").alias("w"))
    shared = each.join(other, "w").where("witness_set <> other").groupBy("witness_set", "other", "other_members").agg(F.count(F.lit(1)).alias("n"))
    size = classes.select("witness_set", F.size("set").alias("size"))
    rivals = shared.join(size, "witness_set").where("n = size").groupBy("witness_set").agg(F.count(F.lit(1)).alias("r"), F.sum("other_members").alias("m"))
    return classes.join(rivals, "witness_set", "left").select("witness_set", "members", F.coalesce("r", F.lit(0)).alias("rival_sets"), F.coalesce("m", F.lit(0)).alias("rivals"))
