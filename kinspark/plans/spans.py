"""Range joins, block graphs, patterns and alignments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alignment, blocks, spans
from ..sources.shared import settled
from .tables import Catalogue, table

query = Catalogue()

_SPANS = """t AS (SELECT event_id, floor(epoch(ts))::BIGINT AS pos, value FROM events),
 s AS (SELECT event_id AS span_id, pos AS b, pos + ceil(value * 10)::BIGINT AS e FROM t WHERE value > 150 UNION ALL SELECT -1, min(pos), max(pos) + 1 FROM t)"""


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All events at their seconds; a span of ten seconds for each unit of a large value, and one of the whole log."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    points = table(spark, sf, "events").select("event_id", at.alias("at"), "value")
    large = points.where("value > 150").select(F.col("event_id").alias("span_id"), F.col("at").alias("b"), (F.col("at") + F.ceil(F.col("value") * 10)).alias("e"))
    return points.select("event_id", "at"), large.unionByName(points.agg(F.lit(-1).cast("long").alias("span_id"), F.min("at").alias("b"), (F.max("at") + 1).alias("e")))


@query("points_in_spans", f"WITH {_SPANS} SELECT span_id, event_id FROM s JOIN t ON b <= pos AND pos < e")
def points_in_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Which events of any user fall into the spans that large ones open: spans that overlap, nest and cover the whole table, without a key."""
    points, held = _spans(spark, sf)
    return spans.points_in_spans(points, held, [], "at", "b", "e").select("span_id", "event_id")


@query("overlapping_spans", f"WITH {_SPANS} SELECT x.span_id AS left_id, y.span_id AS right_id FROM s x JOIN s y ON x.b < y.e AND y.b < x.e AND (x.b < y.b OR x.b = y.b AND x.span_id < y.span_id)")
def overlapping_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The same spans, every two that have a moment in common."""
    return spans.overlapping(_spans(spark, sf)[1], [], "span_id", "b", "e")


_CODE = """c AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS size,
   CASE event_type WHEN 'purchase' THEN 'branch' WHEN 'signup' THEN 'goto' WHEN 'error' THEN 'stop' ELSE 'next' END AS kind, CASE event_type WHEN 'purchase' THEN event_id % 70 WHEN 'signup' THEN event_id * 7 % 60 END AS target FROM events),
 h AS (SELECT user_id, size, event_id % 20 AS s, event_id % 20 + event_id % 13 + 1 AS e, event_id % 30 AS h FROM c WHERE event_type = 'click' AND value > 120), g AS (SELECT * FROM h WHERE e <= size AND h < size),
 l AS (SELECT user_id, 0 AS place FROM c UNION SELECT user_id, target FROM c WHERE target < size UNION SELECT user_id, place + 1 FROM c WHERE kind <> 'next' UNION SELECT user_id, unnest([s, e, h]) FROM g),
 k AS (SELECT c.*, max(l.place) OVER (PARTITION BY c.user_id ORDER BY c.place ROWS UNBOUNDED PRECEDING) AS start FROM c LEFT JOIN l ON l.user_id = c.user_id AND l.place = c.place),
 b AS (SELECT user_id, start, max(place) + 1 AS stop, count(*) AS n, max_by(kind, place) AS last, max_by(target, place) AS target, any_value(size) AS size FROM k GROUP BY ALL)"""


@query("block_graph", f"""WITH {_CODE}, x AS (SELECT user_id, start, stop AS successor, 'next' AS via FROM b WHERE last IN ('next', 'branch') AND stop < size UNION SELECT user_id, start, CASE WHEN target < size THEN target END, CASE WHEN target < size THEN 'jump' ELSE 'bad_target' END FROM b WHERE last IN ('branch', 'goto')
  UNION SELECT b.user_id, b.start, g.h, 'handler' FROM b JOIN g ON g.user_id = b.user_id AND g.s < b.stop AND b.start < g.e)
SELECT b.user_id, b.start AS block, stop AS "end", n, last, coalesce(successor, -1) AS successor, coalesce(via, 'none') AS via FROM b LEFT JOIN x ON x.user_id = b.user_id AND x.start = b.start
UNION ALL SELECT DISTINCT user_id, -1, -1, 0, 'none', -1, 'bad_handler' FROM h WHERE NOT (e <= size AND h < size)""")
def block_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Logs as programs: purchases branch, signups jump, errors stop, and large clicks are handlers of a stretch of their user's log."""
    code, handlers = _code(spark, sf)
    found, edges = blocks.basic_blocks(code, "user_id", handlers)
    out = found.join(edges.where("start IS NOT NULL"), ["user_id", "start"], "left").select("user_id", F.col("start").alias("block"), "end", "n", "last", "successor", "via")
    bad = edges.where("start IS NULL").select("user_id", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"), F.lit("none").alias("last"), "successor", "via")
    return out.unionByName(bad).fillna(-1, ["successor"]).fillna("none", ["via"])


def _code(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("event_type") == "purchase", blocks.BRANCH).when(F.col("event_type") == "signup", blocks.GOTO).when(F.col("event_type") == "error", blocks.STOP).otherwise(blocks.NEXT)
    target = F.when(F.col("event_type") == "purchase", F.col("event_id") % 70).when(F.col("event_type") == "signup", F.col("event_id") * 7 % 60)
    events = table(spark, sf, "events")
    code = blocks.placed(events.select("user_id", "ts", "event_id", "event_type", "value", kind.alias("kind"), target.alias("target")), "user_id", ["ts", "event_id"])
    start = F.col("event_id") % 20
    handlers = events.where("event_type = 'click' AND value > 120").select("user_id", start.alias("start_pc"), (start + F.col("event_id") % 13 + 1).alias("end_pc"), (F.col("event_id") % 30).alias("handler_pc"))
    return code, handlers


@query("block_coverage", f"WITH {_CODE} SELECT user_id, count(*) AS blocks, sum(n)::BIGINT AS rows, sum(n) = max(size) AND sum(stop - start) = max(size) AS whole FROM b GROUP BY 1")
def block_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the blocks of each log hold every row of it once."""
    code, handlers = _code(spark, sf)
    return blocks.covered(blocks.basic_blocks(code, "user_id", handlers)[0], code, "user_id")


_STEPS = [("event_type IN ('view', 'click', 'signup')"), ("event_type IN ('click', 'purchase')"), ("event_type <> 'error' AND value < 80"), ("event_type IN ('view', 'error', 'purchase')"), ("value >= 10"), ("event_type IN ('click', 'signup') AND value > 5")]
_LAGS = "SELECT *, lead(value, 5) OVER w AS last_value, " + " AND ".join(f"coalesce(lead({s}, {k}) OVER w, false)" if k else s for k, s in enumerate(_STEPS)) + " AS found FROM c WINDOW w AS (PARTITION BY user_id ORDER BY place)"


@query("write_chains", f"""WITH {_CODE}, f AS (SELECT user_id, place AS first, place + 5 AS last, value AS first_value, last_value FROM ({_LAGS}) WHERE found),
 j AS (SELECT user_id, target FROM c WHERE target < size), n AS (SELECT f.user_id, first, count(j.target) AS entries FROM f LEFT JOIN j ON j.user_id = f.user_id AND target > first AND target <= last GROUP BY ALL)
SELECT user_id, first, last, entries, CASE WHEN last_value < first_value THEN 'falls' WHEN entries > 0 THEN 'entered' ELSE 'accepted' END AS outcome FROM f JOIN n USING (user_id, first)""")
def write_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of six steps, each of a class of events; those whose value falls, and those that a jump leads into, are vetoed with the reason."""
    code, _ = _code(spark, sf)
    found = blocks.matched(code, "user_id", [F.coalesce(F.expr(s), F.lit(False)) for s in _STEPS])
    size = code.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    targets = code.where("target IS NOT NULL").join(size, "user_id").where("target < size").select("user_id", "target")
    judged = blocks.stabbed(found, "user_id", targets)
    value = lambda place, name: code.select("user_id", F.col("place").alias(place), F.col("value").alias(name))
    judged = judged.join(value("first", "__a"), ["user_id", "first"]).join(value("last", "__b"), ["user_id", "last"])
    outcome = F.when(F.col("__b") < F.col("__a"), "falls").when(F.col("entries") > 0, "entered").otherwise("accepted")
    return judged.select("user_id", "first", "last", "entries", outcome.alias("outcome"))


_TURNS = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, lead(list_filter(string_split(text, ' '), lambda x: x <> '')) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations),
 p AS (SELECT conv_id, place, w, v FROM t WHERE v IS NOT NULL), a AS (SELECT conv_id, place, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM p), b AS (SELECT conv_id, place, unnest(v) AS token, generate_subscripts(v, 1) AS i FROM p),
 x AS (SELECT conv_id, place, token, min(i) AS l FROM a GROUP BY ALL HAVING count(*) = 1), y AS (SELECT conv_id, place, token, min(i) AS r FROM b GROUP BY ALL HAVING count(*) = 1),
 k AS (SELECT conv_id, place, list(r ORDER BY l) AS rs FROM x JOIN y USING (conv_id, place, token) GROUP BY ALL)"""
# The longest chain that ends at each anchor, from left to right, as pairs of its place and length.
_RISE = "list_max(list_transform(list_reduce(list_prepend([]::BIGINT[][], list_transform(rs, lambda r: [[r, 0]])), lambda s, r: list_append(s, [r[1][1], 1 + coalesce(list_max(list_transform(list_filter(s, lambda q: q[1] < r[1][1]), lambda q: q[2])), 0)])), lambda q: q[2]))"


def _turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The words of each turn and those of the next, as the two sides of a pair."""
    talk = table(spark, sf, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    words = F.filter(F.split("text", " "), lambda x: x != "")
    pairs = talk.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.row_number().over(own).cast("string")).alias("pair"), words.alias("w"), F.lead(words).over(own).alias("v")).where("v IS NOT NULL")
    each = lambda c: pairs.select("pair", F.posexplode(c).alias("place", "token"))
    return each("w"), each("v")


@query("anchor_alignment", f"WITH {_TURNS} SELECT conv_id || ':' || place AS pair, len(rs) AS anchors, {_RISE} AS chain FROM k")
def anchor_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation beside the next one: words that stand once in both, and the longest chain of them that rises in both."""
    sides = [df.withColumn("gap", F.lit(0).cast("long")) for df in _turns(spark, sf)]
    found = settled(alignment.anchors(*sides), "anchors")
    chain = alignment.chained(found).groupBy("pair").agg(F.count(F.lit(1)).alias("chain"))
    return found.groupBy("pair").agg(F.count(F.lit(1)).alias("anchors")).join(chain, "pair")
