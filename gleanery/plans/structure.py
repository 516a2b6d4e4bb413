"""Queries on document structure, networks, coverage ratios, reviews and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators import learner as L
from gleanery.operators import links, structure
from gleanery.operators.documents import lines
from gleanery.plans.documents import _CLEAN, _LINES
from gleanery.plans.sheets import _kind
from gleanery.plans.learner import _C, _answers
from gleanery.plans.links import _HOST, _INV
from gleanery.sources.tables import table


def task_structure(spark: SparkSession, d: str) -> DataFrame:
    """The driver's profile: short lines begin sections, lines that begin with a capital A begin tasks."""
    rows = lines(table(spark, d, "documents"))
    got = structure.tasks(rows, F.length("line") < 40, F.col("line").startswith("A"))
    return got.select("doc_id", "section", "task", "task_id", "first_pos", "last_pos", "label", "kind", "n_chars", "confidence", "review")


def composition_graph(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    rows = l.groupBy("l_orderkey", "l_linenumber").count().select(F.concat(F.lit("o"), "l_orderkey").alias("owner"), F.concat_ws("-", F.lit("p"), "l_orderkey", "l_linenumber").alias("part"), "l_linenumber")
    return structure.composition(rows, "owner", "part", "l_linenumber")


def discovery_network(spark: SparkSession, d: str) -> DataFrame:
    return structure.network(links.inventory(table(spark, d, "pages")))


def bounded_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Customers within four steps of customer 1, where c leads to 3c, 3c + 1 and c - 1."""
    c = table(spark, d, "customer").select("c_custkey")
    edges = c.select("c_custkey", F.explode(F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 3 + 1, F.col("c_custkey") - 1)).alias("to"))
    edges = edges.join(c.select(F.col("c_custkey").alias("to")), "to")
    return structure.reachable(edges, "c_custkey", "to", spark.range(1, 2).select(F.col("id").alias("node")), 4)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", (F.col("p_size") > 10).alias("structured"), F.col("p_type").isin("ECONOMY", "PROMO").alias("mapped"), (F.col("p_retailprice") < 1800).alias("supported"))


def coverage_ratios(spark: SparkSession, d: str) -> DataFrame:
    return structure.coverage_ratios(_parts(spark, d), ["structured", "mapped", "supported"], ["p_brand"])


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return structure.gap_clusters(_parts(spark, d), ["structured", "mapped", "supported"])


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    machine = table(spark, d, "documents").select("doc_id", (F.length("text") > 1500).cast("int").alias("machine"))
    return structure.reviewed(machine, table(spark, d, "labels"), "doc_id", "machine", "quality").select("doc_id", "machine", "human", "decision")


def first_seen_types(spark: SparkSession, d: str) -> DataFrame:
    got = structure.first_seen_order(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return got.select("user_id", F.array_join("values", ",").alias("types"))


def reward_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Answers that bring a reward: a run of exactly 3, 5, 8, 10 or 15, every tenth answer, or a new record."""
    order = W.partitionBy("learner").orderBy("ts", "event_id")
    rows = L.combos(_answers(spark, d)).withColumns({"nth": F.row_number().over(order), "record_before": F.coalesce(F.lag("best_combo").over(order), F.lit(0))})
    kinds = F.array_compact(F.array(F.when(F.col("combo").isin(3, 5, 8, 10, 15), "combo"), F.when(F.col("nth") % 10 == 0, "tenth"), F.when(F.col("combo") > F.col("record_before"), "record")))
    return rows.where(F.size(kinds) > 0).select("event_id", F.array_join(kinds, ",").alias("rewards"))


def lifetime_totals(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("user_id", F.round(delta * 100).cast("long").alias("delta"))
    return rows.groupBy("user_id").agg(F.sum(F.greatest("delta", F.lit(0))).alias("earned"), F.sum(F.least("delta", F.lit(0))).alias("spent"), F.sum("delta").alias("balance"))


QUERIES = {f.__name__: f for f in (task_structure, composition_graph, discovery_network, bounded_crawl, coverage_ratios, gap_clusters, review_decisions, first_seen_types, reward_milestones, lifetime_totals)}

_FLAGS = "WITH f AS (SELECT p_brand, p_size > 10 AS structured, p_type IN ('ECONOMY', 'PROMO') AS mapped, p_retailprice < 1800 AS supported FROM part)"
ORACLE_SQL = {
    "task_structure": _LINES
    + f""", m AS (SELECT *, length(line) < 40 AS sec FROM l), x AS (SELECT *, CAST(sum(CAST(sec AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM m),
t AS (SELECT *, CAST(sum(CAST(starts_with(line, 'A') AND NOT sec AS INT)) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS task FROM x),
g AS (SELECT doc_id, section, task, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos, arg_min(line, pos) AS label, string_agg(line, chr(10) ORDER BY pos) AS text FROM t GROUP BY ALL),
c AS (SELECT *, round(0.95::DOUBLE - CASE WHEN task = 0 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN length(trim(text)) < 40 THEN 0.2::DOUBLE ELSE 0 END, 3) AS confidence FROM g)
SELECT doc_id, section, task, 'task_' || substring(sha1(doc_id || '|' || section || '|' || task), 1, 20) AS task_id, first_pos, last_pos, label, {_kind(_CLEAN.format(x="text"))} AS kind, CAST(length(text) AS INT) AS n_chars, confidence, confidence < 0.78 AS review FROM c""",
    "composition_graph": "WITH p AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), r AS (SELECT 'o' || o AS own, 'p-' || o || '-' || n AS part, lag('p-' || o || '-' || n) OVER (PARTITION BY o ORDER BY n) AS before FROM p) SELECT own AS source, 'OWNS_PART' AS kind, part AS target FROM r UNION ALL SELECT part, 'DEPENDS_ON', before FROM r WHERE before IS NOT NULL",
    "discovery_network": _INV + f", v AS (SELECT 'site' AS kind, {_HOST.format(u='parent_url')} AS value FROM inventory UNION ALL SELECT 'page', parent_url FROM inventory UNION ALL SELECT 'resource', url FROM inventory) SELECT kind || '_' || substring(sha256(value), 1, 24) AS id, kind, value, count(*) AS n FROM v GROUP BY ALL",
    "bounded_crawl": "WITH RECURSIVE e AS (SELECT c_custkey AS a, unnest([c_custkey * 3, c_custkey * 3 + 1, c_custkey - 1]) AS b FROM customer), k AS (SELECT a, b FROM e WHERE b IN (SELECT c_custkey FROM customer)), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT k.b, depth + 1 FROM r JOIN k ON k.a = r.node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "coverage_ratios": _FLAGS + " SELECT p_brand, count(*) AS total, count(*) FILTER (structured) AS structured, count(*) FILTER (mapped) AS mapped, count(*) FILTER (supported) AS supported, count(*) FILTER (structured AND mapped AND supported) AS runnable, round(count(*) FILTER (structured AND mapped AND supported) / count(*), 9) AS ratio FROM f GROUP BY p_brand",
    "gap_clusters": _FLAGS + " SELECT gap, count(*) AS count FROM (SELECT 'missing:structured' AS gap FROM f WHERE NOT structured UNION ALL SELECT 'missing:mapped' FROM f WHERE NOT mapped UNION ALL SELECT 'missing:supported' FROM f WHERE NOT supported) GROUP BY gap",
    "review_decisions": "SELECT doc_id, CAST(length(text) > 1500 AS INT) AS machine, quality AS human, CASE WHEN quality IS NULL THEN 'UNREVIEWED' WHEN quality = CAST(length(text) > 1500 AS INT) THEN 'CONFIRMED' ELSE 'CHANGED' END AS decision FROM documents LEFT JOIN labels USING (doc_id)",
    "first_seen_types": "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS t0 FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY t0) AS types FROM f GROUP BY user_id",
    "reward_milestones": _C + ", o AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) AS nth, coalesce(lag(best_combo) OVER (PARTITION BY learner ORDER BY ts, event_id), 0) AS before FROM combos), k AS (SELECT event_id, concat_ws(',', CASE WHEN combo IN (3, 5, 8, 10, 15) THEN 'combo' END, CASE WHEN nth % 10 = 0 THEN 'tenth' END, CASE WHEN combo > before THEN 'record' END) AS rewards FROM o) SELECT * FROM k WHERE rewards <> ''",
    "lifetime_totals": "WITH d AS (SELECT user_id, CAST(round(CASE WHEN event_type = 'purchase' THEN -value ELSE value END * 100) AS BIGINT) AS delta FROM events) SELECT user_id, CAST(sum(greatest(delta, 0)) AS BIGINT) AS earned, CAST(sum(least(delta, 0)) AS BIGINT) AS spent, CAST(sum(delta) AS BIGINT) AS balance FROM d GROUP BY user_id",
}
