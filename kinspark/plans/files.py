"""Documents, properties and files that nothing overwrites, made of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..sources import documents
from ..sources.shared import shared_folder
from .tables import Catalogue, table

query = Catalogue()


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("strict_json", """
SELECT event_id, CASE WHEN event_id % 7 = 3 OR event_id % 11 = 5 THEN '' ELSE props END AS document, event_id % 7 = 3 OR event_id % 11 = 5 AS refused FROM events""")
def strict_json(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events as documents; some are cut short and some name a member twice, and none of those is taken."""
    member = F.expr("substring(props, 2, char_length(props) - 2)")
    twice = F.concat(F.lit("{"), member, F.lit(", "), member, F.lit("}"))
    text = F.when(F.col("event_id") % 7 == 3, twice).when(F.col("event_id") % 11 == 5, F.expr("substring(props, 1, char_length(props) - 1)")).otherwise(F.col("props"))
    document, error = documents.strict(F.col("text"))
    return table(spark, sf, "events").select("event_id", text.alias("text")).select("event_id", F.coalesce(document, F.lit("")).alias("document"), error.isNotNull().alias("refused"))


@query("canonical_sink", """
SELECT o_orderkey, sha256('{"comment":null,"custkey":' || o_custkey || ',"orderkey":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS line_sha256 FROM orders""")
def canonical_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as canonical JSON lines to a new folder and read back byte for byte."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("comment"))
    path = _fresh(spark, "canonical")
    documents.write_new(rows, path, (f"{sf}/orders.parquet",), order=("orderkey",))
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.orderkey").cast("long").alias("o_orderkey"), F.sha2("value", 256).alias("line_sha256"))


_PROPERTY = """p AS (SELECT c_nationkey AS owner, 'k' || c_custkey % 97 AS key, c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'a-${k' || (c_custkey * 7 + 3) % 97 || '}' WHEN 2 THEN '${k' || (c_custkey * 5 + 1) % 97 || '}/${k' || (c_custkey * 11 + 2) % 97 || '}' ELSE c_mktsegment END AS value FROM customer),
 l AS (SELECT owner, key, max_by(value, c_custkey) AS value FROM p GROUP BY ALL)"""


def _properties(spark: SparkSession, sf: str) -> DataFrame:
    """A properties file a nation, with a comment and lines that others of their key override, written and read again."""
    number = lambda a, b: ((F.col("c_custkey") * a + b) % 97).cast("string")
    value = (
        F.when(F.col("c_custkey") % 4 == 0, F.col("c_name"))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("a-${k"), number(7, 3), F.lit("}")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("${k"), number(5, 1), F.lit("}/${k"), number(11, 2), F.lit("}")))
        .otherwise(F.col("c_mktsegment"))
    )
    key = F.concat(F.lit("k"), (F.col("c_custkey") % 97).cast("string"))
    line = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("# "), "c_name", F.lit("\n"), key, F.lit(" = "), value)).otherwise(F.concat(key, F.lit("="), value))
    lines = table(spark, sf, "customer").select("c_nationkey", "c_custkey", line.alias("line")).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    path = _fresh(spark, "properties")
    lines.select("c_nationkey", "line").write.partitionBy("c_nationkey").text(path)
    found = documents.properties(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", "c_nationkey=(\\d+)", 1).cast("int").alias("owner"), "key", "value")


@query("properties_scan", f"WITH {_PROPERTY} SELECT owner, key, value FROM l")
def properties_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and values of a properties file a nation; of a key's lines the last one counts."""
    return _properties(spark, sf)


def _resolve_sql(rounds: int) -> str:
    step = [_PROPERTY, r"f AS (SELECT owner, key, unnest(list_distinct(regexp_extract_all(value, '\$\{([^}]*)\}', 1))) AS ref FROM l)", "r0 AS (SELECT owner, key, value, 0 AS round FROM l WHERE value NOT LIKE '%${%')"]
    for k in range(1, rounds + 1):
        step.append(f"""s{k} AS MATERIALIZED (SELECT f.owner, f.key, count(*) AS n, count(r.key) AS m, max(CASE WHEN r.key IS NOT NULL THEN f.ref || chr(1) || r.value END) AS one, min(CASE WHEN r.key IS NOT NULL THEN f.ref || chr(1) || r.value END) AS two
   FROM f LEFT JOIN r{k - 1} r ON r.owner = f.owner AND r.key = f.ref WHERE NOT EXISTS (SELECT 1 FROM r{k - 1} d WHERE d.owner = f.owner AND d.key = f.key) GROUP BY ALL),
 r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT s.owner, s.key, replace(replace(l.value, '${{' || split_part(one, chr(1), 1) || '}}', split_part(one, chr(1), 2)), '${{' || split_part(two, chr(1), 1) || '}}', split_part(two, chr(1), 2)), {k} FROM s{k} s JOIN l ON l.owner = s.owner AND l.key = s.key WHERE n = m)""")
    return f"""WITH RECURSIVE {', '.join(step)},
 b AS (SELECT owner, key FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.owner = f.owner AND l.key = f.ref) UNION SELECT f.owner, f.key FROM b JOIN f ON f.owner = b.owner AND f.ref = b.key)
SELECT owner, key, value, 'resolved' AS state, round FROM r{rounds} UNION ALL
SELECT owner, key, value, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.owner = l.owner AND b.key = l.key) THEN 'unknown' ELSE 'cycle' END, -1 FROM l WHERE NOT EXISTS (SELECT 1 FROM r{rounds} d WHERE d.owner = l.owner AND d.key = l.key)"""


@query("property_resolution", _resolve_sql(12))
def property_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The same properties with the references in their values resolved: chains, unknown keys and cycles."""
    return documents.interpolated(_properties(spark, sf))


_CUT = ", ".join(f"sum(('0x' || h[{15 * k + 1}:{15 * k + 15}])::BIGINT::HUGEINT)::VARCHAR" for k in range(4))


@query("frozen_snapshot", f"""
WITH r AS (SELECT o_orderstatus, sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders)
SELECT o_orderstatus, count(*) AS n, sha256(concat_ws('|', {_CUT})) AS digest FROM r GROUP BY 1""")
def frozen_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Orders frozen to a table that is written once, and the digest of each of its parts as it is read back."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return checks.digest_of(checks.frozen(rows, _fresh(spark, "frozen")), "o_orderstatus")
