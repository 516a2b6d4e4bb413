"""Queries on edits, preferences and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import edits as E
from gleanery.operators import sheets as S
from gleanery.plans.sheets import _SHEETS, _STARTS, sheet_lines
from gleanery.sources.tables import table

_OPS = ["move", "split", "merge", "create", "delete"]


def edit_replay(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))  # noqa: E741
    starts = l.select("doc", (F.col("n") * 10).alias("start"))
    op = F.element_at(F.array(*map(F.lit, _OPS)), (F.col("p") % 5 + 1).cast("int"))
    log = l.select("doc", (F.col("p") * 1000 + F.col("s") * 10 + F.col("n")).alias("seq"), op.alias("op"), (F.col("n") * 10).alias("at"), (F.col("p") % 97).alias("to")).distinct()
    return E.replayed(starts, log).select("doc", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


def preferred_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    gold = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("value"))
    machine = docs.where("n_chars > 800").select("doc_id", F.col("lang").alias("value"))
    rough = docs.select("doc_id", F.lit("unknown").alias("value"))
    return E.preferred(docs.select("doc_id"), "doc_id", ("gold", gold), ("machine", machine), ("heuristic", rough))


def document_review(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 7
    decision = F.when((k == 0) & (F.col("l_suppkey") % 3 == 0), "REJECTED").when(k < 3, "CONFIRMED").when(k < 5, "CHANGED")
    return E.review_state(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), decision.alias("decision")), "doc")


def distractor_pool(spark: SparkSession, d: str) -> DataFrame:
    return E.distractors(table(spark, d, "part").select("p_partkey"), "p_partkey")


def visuals_in_band(spark: SparkSession, d: str) -> DataFrame:
    lines = sheet_lines(spark, d)
    return E.in_band(lines.select("doc", "page", "pos", "x0", "y0", "x1", "y1"), lines.where(F.col("text").contains("=")), 80.0, 120.0)


def tasks_with_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = S.section_starts(sheet_lines(spark, d)).where("starts")
    head = lines.groupBy("doc").agg(F.min_by("section_type", "pos").alias("first_type"), F.count(F.lit(1)).alias("sections"))
    tasks = S.in_tasks(sheet_lines(spark, d)).where("opens").select("doc", "section", "task", "pos")
    return tasks.join(head, "doc").withColumn("first_type", F.coalesce("first_type", F.lit("-")))


def legacy_units(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    units = part.groupBy(F.col("p_type").alias("skill")).agg(F.min("p_partkey").alias("unit"))
    return table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ["ECONOMY", "PROMO", "none"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("skill")).join(units, "skill", "left").select("s_suppkey", "skill", "unit")


QUERIES = {f.__name__: f for f in (edit_replay, preferred_labels, document_review, distractor_pool, visuals_in_band, tasks_with_sections, legacy_units)}

_STEP = (
    "list_sort(list_distinct(CASE WHEN list_contains(a, e.pl) AND e.op = 'move' THEN list_append(list_filter(a, lambda x: x <> e.pl), e.to_) WHEN list_contains(a, e.pl) AND e.op = 'split' AND list_max(a) > e.pl THEN list_append(a, (e.pl + list_min(list_filter(a, lambda x: x > e.pl))) // 2)"
    " WHEN list_contains(a, e.pl) AND e.op IN ('merge', 'delete') THEN list_filter(a, lambda x: x <> e.pl) WHEN e.op = 'create' THEN list_append(a, e.to_) ELSE a END))"
)
ORACLE_SQL = {
    "edit_replay": f"""WITH RECURSIVE l AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
s AS (SELECT doc, list_sort(list_distinct(list(n * 10))) AS a FROM l GROUP BY doc),
e AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY seq, op, pl, to_) AS k, {{'op': op, 'pl': pl, 'to_': to_}} AS e FROM (SELECT DISTINCT doc, p * 1000 + s * 10 + n AS seq, ['move', 'split', 'merge', 'create', 'delete'][p % 5 + 1] AS op, n * 10 AS pl, p % 97 AS to_ FROM l)),
r AS (SELECT doc, 0 AS k, a FROM s UNION ALL SELECT r.doc, e.k, {_STEP.replace("e.", "e.e.")} FROM r JOIN e ON e.doc = r.doc AND e.k = r.k + 1)
SELECT doc, array_to_string(arg_max(a, k), ',') AS starts FROM r GROUP BY doc""",
    "preferred_labels": "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'gold' WHEN n_chars > 800 AND lang IS NOT NULL THEN 'machine' ELSE 'heuristic' END AS source, CASE WHEN quality IS NOT NULL THEN 'q' || quality WHEN n_chars > 800 AND lang IS NOT NULL THEN lang ELSE 'unknown' END AS value FROM documents LEFT JOIN labels USING (doc_id)",
    "document_review": "SELECT doc, count(*) AS fields, count(d) AS decided, CASE WHEN count_if(d = 'REJECTED') > 0 THEN 'REJECTED' WHEN count(d) = 0 THEN 'UNREVIEWED' WHEN count(d) < count(*) THEN 'IN_REVIEW' ELSE 'COMPLETE' END AS state FROM (SELECT l_orderkey AS doc, CASE WHEN l_partkey % 7 = 0 AND l_suppkey % 3 = 0 THEN 'REJECTED' WHEN l_partkey % 7 < 3 THEN 'CONFIRMED' WHEN l_partkey % 7 < 5 THEN 'CHANGED' END AS d FROM lineitem) GROUP BY doc",
    "distractor_pool": "WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS nth, count(*) OVER () AS n FROM part), w AS (SELECT p_partkey, CAST(unnest([1, 2, 3]) AS INT) AS place, nth, n FROM o) SELECT w.p_partkey, place, o.p_partkey AS other FROM w JOIN o ON o.nth = (w.nth + place) % w.n",
    "visuals_in_band": _SHEETS + ", v AS (SELECT * FROM lines WHERE contains(text, '=')) SELECT l.doc, l.page, l.pos, count(*) AS n, min(least(l.x0, v.x0))::DOUBLE AS x0, min(least(l.y0, v.y0))::DOUBLE AS y0, max(greatest(l.x1, v.x1))::DOUBLE AS x1, max(greatest(l.y1, v.y1))::DOUBLE AS y1 FROM lines l JOIN v ON v.doc = l.doc AND v.page = l.page AND v.y1 >= l.y0 - 80 AND v.y0 <= l.y1 + 120 GROUP BY ALL",
    "tasks_with_sections": _STARTS + ", h AS (SELECT doc, arg_min(st, pos) AS f, count(*) AS sections FROM starts WHERE starts GROUP BY doc) SELECT doc, section, task, pos, coalesce(f, '-') AS first_type, sections FROM owned JOIN h USING (doc) WHERE opens",
    "legacy_units": "SELECT s_suppkey, skill, unit FROM (SELECT s_suppkey, ['ECONOMY', 'PROMO', 'none'][s_suppkey % 3 + 1] AS skill FROM supplier) LEFT JOIN (SELECT p_type AS skill, min(p_partkey) AS unit FROM part GROUP BY 1) USING (skill)",
}
