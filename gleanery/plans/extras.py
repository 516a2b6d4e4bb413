"""Queries on metadata, answers, layout boxes, queues and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import answers, boxes, metadata, urls
from gleanery.operators import layout, links, queues
from gleanery.operators import learner as L
from gleanery.plans.learner import _EV, _W, NOW, _answers, _weights
from gleanery.plans.links import _HOST, _INV
from gleanery.sources.tables import table

#: A part as a file: https://h/2024/tasks-math-7-8-sch-24-25.pdf and the like, out of its columns.
_URL = """concat('https://h.example/', CASE WHEN p_size % 3 = 0 THEN concat(2000 + p_size % 26, '/') WHEN p_size % 3 = 1 THEN 'x/' ELSE '2021-2022/' END,
 element_at(array('tasks-', 'ans-', 'sol-', 'krit-', 'script-', ''), int(p_partkey % 6) + 1), element_at(array('math', 'chem', 'fiz', 'none'), int(p_partkey % 4) + 1), '-', p_partkey % 12, '-',
 p_partkey % 12 + 1, '-', element_at(array('sch', 'mun', 'reg', 'fin', 'zz'), int(p_partkey % 5) + 1), '-', lpad(string(p_size % 30), 2, '0'), '-', lpad(string((p_size % 30) + 1), 2, '0'), '.pdf')"""


def url_metadata_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(_URL).alias("url"))
    return rows.select("p_partkey", "url", metadata.describe(F.col("url")).alias("m")).select("p_partkey", "url", "m.*")


def answer_check(spark: SparkSession, d: str) -> DataFrame:
    """Line items as answers: the discount with a comma and a unit, against the tax with a tolerance."""
    l = table(spark, d, "lineitem")  # noqa: E741
    raw = F.concat(F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(",")), F.when(F.col("l_linenumber") % 2 == 0, " m").otherwise(""))
    value = answers.number(raw, F.lit("m"))
    ok = answers.accepts_number(value, F.col("l_tax"), F.lit(0.02), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return l.select("l_orderkey", "l_linenumber", answers.canonical(raw).alias("canonical"), value.alias("value"), ok.alias("accepted"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes on pages: a page is ten orders, a body an order."""
    x, y = F.col("l_partkey") % 300, (F.col("l_orderkey") % 10) * 70 + F.col("l_linenumber") * 9
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(F.floor(F.col("l_orderkey") / 10).alias("page"), "l_orderkey", "l_linenumber", boxes.box(x, y, x + F.col("l_quantity") * 4, y + 8).alias("box"), (F.col("l_returnflag") == "R").alias("art"))


def body_spans(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_spans(_boxes(spark, d), ["page", "l_orderkey"]).select("page", "l_orderkey", "body.*", "n")


def vertical_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.large_gaps(_boxes(spark, d), ["page"], [F.col("box.y0"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("box.x0"), F.col("box.x1")])
    return rows.select("page", F.col("box.y0").alias("y0"), "gap")


def artifact_binding(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(spark, d)
    bodies = layout.body_spans(rows.where("not art"), ["page", "l_orderkey"]).withColumnRenamed("l_orderkey", "body_id")
    art = rows.where("art").groupBy("page", F.expr("l_orderkey * 100 + l_linenumber").alias("artifact")).agg(F.min("box").alias("box"))
    return layout.bind(art, bodies, ["page"], "artifact", "body_id", 595.0)


def multi_column(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns(_boxes(spark, d), ["page", "l_orderkey"])


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 7).alias("attempts"), "o_orderdate")
    return queues.work_queue(o, 50, ["O", "P"], "priority", "attempts", "o_orderdate", "o_orderkey").select("o_orderkey", "status", "priority", "attempts")


def document_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.get_json_object("props", "$.k").cast("int") + 400).alias("code"), (F.col("event_type") == "purchase").alias("ok"))
    return queues.document_states(e, "user_id", ["ts", "event_id"])


def preparation_plan(spark: SparkSession, d: str) -> DataFrame:
    got = queues.preparation(L.evidence(_answers(spark, d)), _weights(spark), F.expr(NOW), 14)
    return got.withColumn("focus", F.array_join(F.col("focus").cast("array<string>"), ","))


def recent_queue(spark: SparkSession, d: str) -> DataFrame:
    return queues.latest_of(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


def unresolved_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Links whose host has no secure page of its own, by host."""
    inv = links.inventory(table(spark, d, "pages")).select(urls.host(F.col("url")).alias("host"), "url")
    pages = table(spark, d, "pages").where(F.col("url").startswith("https://")).select(urls.host(F.col("url")).alias("host")).distinct()
    return inv.join(pages, "host", "left_anti").groupBy("host").agg(F.count(F.lit(1)).alias("links"))


def diverse_session(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("unit"), F.round("value", 2).alias("rank"))
    return queues.diverse(e, "user_id", ["rank", "event_id"], "unit", "event_id", 12)


QUERIES = {f.__name__: f for f in (url_metadata_cascade, answer_check, body_spans, vertical_gaps, artifact_binding, multi_column, work_queue, document_states, preparation_plan, recent_queue, unresolved_hosts, diverse_session)}

_SQL_URL = """'https://h.example/' || CASE WHEN p_size % 3 = 0 THEN (2000 + p_size % 26) || '/' WHEN p_size % 3 = 1 THEN 'x/' ELSE '2021-2022/' END || ['tasks-', 'ans-', 'sol-', 'krit-', 'script-', ''][p_partkey % 6 + 1] || ['math', 'chem', 'fiz', 'none'][p_partkey % 4 + 1] || '-' || (p_partkey % 12) || '-' || (p_partkey % 12 + 1) || '-' || ['sch', 'mun', 'reg', 'fin', 'zz'][p_partkey % 5 + 1] || '-' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size % 30 + 1 AS VARCHAR), 2, '0') || '.pdf'"""
_BOXES = "WITH b AS (SELECT l_orderkey // 10 AS page, l_orderkey, l_linenumber, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST((l_orderkey % 10) * 70 + l_linenumber * 9 AS DOUBLE) AS y0, l_partkey % 300 + l_quantity * 4 AS x1, CAST((l_orderkey % 10) * 70 + l_linenumber * 9 + 8 AS DOUBLE) AS y1, l_returnflag = 'R' AS art FROM lineitem)"
ORACLE_SQL = {
    # the URLs are built from the columns, so what the cascade must find in them is known from the columns
    "url_metadata_cascade": f"SELECT p_partkey, {_SQL_URL} AS url, CASE p_partkey % 4 WHEN 0 THEN 'mathematics' WHEN 1 THEN 'chemistry' WHEN 2 THEN 'physics' END AS subject, CAST(CASE WHEN p_size % 3 = 0 THEN 2000 + p_size % 26 WHEN p_size % 3 = 1 THEN 2000 + p_size % 30 ELSE 2021 END AS INT) AS season, CASE p_partkey % 5 WHEN 0 THEN 'school' WHEN 1 THEN 'municipal' WHEN 2 THEN 'regional' WHEN 3 THEN 'final' END AS stage, CASE WHEN p_partkey % 4 < 3 THEN (p_partkey % 12) || '–' || (p_partkey % 12 + 1) END AS grade_band, ['tasks', 'answers', 'solutions', 'criteria', 'script', 'other'][p_partkey % 6 + 1] AS role FROM part",
    "answer_check": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_discount AS VARCHAR) || 'm' WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END AS canonical, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS value, CASE WHEN l_linenumber % 2 = 0 THEN abs(l_discount - l_tax) <= 0.02::DOUBLE + 1e-9 ELSE false END AS accepted FROM lineitem",
    "body_spans": _BOXES + " SELECT page, l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY ALL",
    "vertical_gaps": _BOXES + " SELECT page, y0, gap FROM (SELECT page, y0, y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0, l_orderkey, l_linenumber, x0, x1) AS gap FROM b) WHERE gap > 96",
    "artifact_binding": _BOXES + """, s AS (SELECT page, l_orderkey AS body_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE NOT art GROUP BY ALL),
a AS (SELECT page, l_orderkey * 100 + l_linenumber AS artifact, min((x0, y0, x1, y1)) AS k FROM b WHERE art GROUP BY ALL), t AS (SELECT page, artifact, k[1] AS x0, k[2] AS y0, k[3] AS x1, k[4] AS y1 FROM a),
p AS (SELECT artifact, body_id, greatest(0, least(t.x1, s.x1) - greatest(t.x0, s.x0)) / greatest(1, least(t.x1 - t.x0, s.x1 - s.x0)) AS x, greatest(0, s.y0 - t.y1, t.y0 - s.y1) AS gap, t.x1 - t.x0 >= 595 * 0.72 AS wide FROM t JOIN s USING (page)),
q AS (SELECT artifact, body_id, round(greatest(0::DOUBLE, least(0.98::DOUBLE, 0.36::DOUBLE + CASE WHEN x >= 0.5 THEN 0.34::DOUBLE WHEN x >= 0.15 THEN 0.18::DOUBLE WHEN wide THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN gap = 0 THEN 0.22::DOUBLE WHEN gap <= 48 THEN 0.16::DOUBLE WHEN gap <= 120 THEN 0.08::DOUBLE ELSE -0.18::DOUBLE END)), 3) AS score FROM p)
SELECT artifact, body_id, score FROM q WHERE score >= 0.42 QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY score DESC, body_id) = 1""",
    "multi_column": _BOXES + " SELECT page, l_orderkey, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS spread, max((x0 + x1) / 2) - min((x0 + x1) / 2) > 40 AS several FROM b GROUP BY ALL",
    "work_queue": "SELECT o_orderkey, o_orderstatus AS status, CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_custkey % 7 AS attempts FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey % 7 < 5 ORDER BY priority DESC, attempts, o_orderdate, o_orderkey LIMIT 50",
    "document_states": """WITH RECURSIVE e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) + 400 AS code, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, CASE WHEN ok THEN 'DOWNLOADED' WHEN code IN (401, 403, 404, 410) THEN 'FAILED_TERMINAL' ELSE 'FAILED_RETRYABLE' END AS status, 1 AS attempts FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN f.status IN ('DOWNLOADED', 'FAILED_TERMINAL') THEN f.status WHEN ok THEN 'DOWNLOADED' WHEN code IN (401, 403, 404, 410) OR attempts + 1 >= 5 THEN 'FAILED_TERMINAL' ELSE 'FAILED_RETRYABLE' END, CASE WHEN f.status IN ('DOWNLOADED', 'FAILED_TERMINAL') THEN attempts ELSE attempts + 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, status, attempts FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
    "preparation_plan": _EV + _W + f""", pr AS (SELECT l.learner, w.unit, w.weight, greatest(0, greatest(3, ceil(w.weight * 40)) - coalesce(attempts, 0)) AS remaining, CAST(coalesce(next_review <= {NOW.replace('timestamp', 'TIMESTAMP ')}, false) AS INT) AS due, coalesce(mastery, 0.5) AS m FROM (SELECT DISTINCT learner FROM ev) l CROSS JOIN w LEFT JOIN ev ON ev.learner = l.learner AND ev.unit = w.unit),
pg AS (SELECT *, round(remaining + weight * 10 + 8 * due + 10 * greatest(0.0, 0.75 - m), 9) AS gap FROM pr)
SELECT learner, CAST(greatest(5, least(20, ceil(sum(remaining) / 14.0) + least(sum(due), 3))) AS INT) AS questions, CAST(sum(due) AS INT) AS due, array_to_string(list(unit ORDER BY gap DESC, unit)[1:3], ',') AS focus FROM pg GROUP BY learner""",
    "recent_queue": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "unresolved_hosts": _INV + f", o AS (SELECT {_HOST.format(u='url')} AS host FROM inventory) SELECT host, count(*) AS links FROM o WHERE host NOT IN (SELECT {_HOST.format(u='url')} FROM pages WHERE starts_with(url, 'https://')) GROUP BY host",
    "diverse_session": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 5 AS unit, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2), event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS take, [unit] AS recent, 1 AS k FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, t, CASE WHEN t THEN list_append(recent, unit)[-7:] ELSE recent END, k + CAST(t AS INT) FROM (SELECT e.user_id, e.event_id, e.n, e.unit, f.recent, f.k, f.k < 12 AND len(list_filter(f.recent, lambda x: x = e.unit)) < 2 AS t FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, k - 1 AS place, event_id FROM f WHERE take""",
}
