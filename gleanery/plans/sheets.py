"""Queries on task sheets. The driver's tables hold none, so orders stand in: a customer is a document, and each of its orders a line out of fixed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.operators import sheets as S
from gleanery.sources.tables import table

LINES = [
    "READING", "Task #. Match the headings with the texts", "Task #", "Part #: the map", "a) Say where the river is", "b) Calculate the value of the sum", "#. Some words of an item", "Questions 1-#",
    "WRITING", "Write your essay about the sea", "Writing: criteria", "LISTENING answers", "Use the sum above again", "x^2 + y^2 = #", "The river runs through a quiet town and joins the sea there",
    "A. the first option", "Figure #. The map of the town", "Speaking Set #", "#.2 Prove that the sum is even", "Is the sentence true or false", "ok", "Part #",
]
ROLES = ["", "TASK_SET", "ANSWER_KEY", "LISTENING_SCRIPT", "CRITERIA"]
#: Lines in a partition: orders are dealt out as two numbers, and the lines that they become are sorted several times where they are.
DEALT = 150_000


def sheet_lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    # by what the lines take, not by what Spark sees of the orders; their number stands in the footers of the files
    orders = orders.repartition(max(spark.sparkContext.defaultParallelism, orders.count() // DEALT), "o_custkey")
    rows = orders.withColumn("pos", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    i = (k % len(LINES)).cast("int")
    text = F.replace(F.element_at(F.array(*map(F.lit, LINES)), i + 1), F.lit("#"), (k % 7 + 1).cast("string"))
    x0 = F.when(k % 3 < 2, 72.0).otherwise(330.0)
    y0 = 72.0 + (F.col("pos") % 6) * F.when(F.col("o_custkey") % 2 == 0, 24.0).otherwise(140.0)
    rows = rows.select(F.col("o_custkey").alias("doc"), F.element_at(F.array(*map(F.lit, ROLES)), (F.col("o_custkey") % 5 + 1).cast("int")).alias("role"), F.floor(F.col("pos") / 6).cast("int").alias("page0"), "pos", text.alias("text"), x0.alias("x0"), y0.alias("y0"), F.when(i.isin(0, 8, 11), 14.0).otherwise(11.0).alias("size"), i.isin(0, 8).alias("bold"))
    return rows.select("doc", "role", (F.col("page0") + 1).alias("page"), "pos", "text", "x0", "y0", (F.col("x0") + 40 + F.length("text") * 3.0).alias("x1"), (F.col("y0") + 14).alias("y1"), "size", "bold", F.lit(800.0).alias("height"), F.lit(600.0).alias("width"))


def line_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    role = P.line_role(t, F.lit(False), F.col("y0"), F.col("height"), F.array().cast("array<string>"))
    return sheet_lines(spark, d).withColumn("kind", P.kind(t)).select("doc", "pos", F.coalesce(P.section_type(t), F.lit("-")).alias("section_type"), P.heading_score(t, F.col("size"), F.lit(11.0), F.col("bold")).alias("heading"), role["role"].alias("line_role"), role["confidence"].alias("role_confidence"), F.col("kind"), P.mode(F.col("kind")).alias("mode"), P.writing_label(t).alias("writing"), P.task_number(t).alias("number"), P.task_label(t).alias("label"))


def sheet_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.section_starts(sheet_lines(spark, d)).where("starts").select("doc", "pos", F.coalesce("section_type", F.lit("-")).alias("section_type"), P.section_label(F.col("text"), F.coalesce("section_type", F.lit("UNKNOWN"))).alias("label"))


def sheet_tasks(spark: SparkSession, d: str) -> DataFrame:
    return S.tasks(sheet_lines(spark, d))


def sheet_parts(spark: SparkSession, d: str) -> DataFrame:
    return S.parts(sheet_lines(spark, d))


def sheet_composition(spark: SparkSession, d: str) -> DataFrame:
    lines = sheet_lines(spark, d)
    body = S.tasks(lines).select("doc", "section", "task", F.lit(True).alias("shared"), "body")
    return S.composition(S.parts(lines), body)


def sheet_spans(spark: SparkSession, d: str) -> DataFrame:
    return S.spans(S.blocks(S.in_tasks(sheet_lines(spark, d))))


def answer_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.answer_groups(sheet_lines(spark, d))


def task_bands(spark: SparkSession, d: str) -> DataFrame:
    return S.bands(sheet_lines(spark, d))


def marker_precedence(spark: SparkSession, d: str) -> DataFrame:
    return S.by_marker(sheet_lines(spark, d)).select("doc", "pos", "mark", "piece")


def page_headers(spark: SparkSession, d: str) -> DataFrame:
    return S.page_headers(sheet_lines(spark, d))


def review_sequence(spark: SparkSession, d: str) -> DataFrame:
    return S.review_sequence(S.in_tasks(sheet_lines(spark, d)).select("doc", "section", "task").distinct())


def layout_flatten(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("text", "x0", "y0", "x1", "y1", "size", "bold", F.col("pos").alias("reading"))
    pages = sheet_lines(spark, d).groupBy("doc", "role", "page").agg(F.first("height").alias("height"), F.first("width").alias("width"), F.collect_list(line).alias("lines"))
    nested = pages.groupBy("doc", "role").agg(F.collect_list(F.struct("page", "height", "width", "lines")).alias("pages"))
    return S.flatten(nested).select("doc", "page", "pos", "text", "y0")


def artifact_context(spark: SparkSession, d: str) -> DataFrame:
    lines = sheet_lines(spark, d)
    cells = F.col("pos") * 4
    raw = F.element_at(F.array(F.lit("table"), F.lit("image"), F.lit("drawing")), (F.col("pos") % 3 + 1).cast("int"))
    found = lines.where(F.col("text").contains("=") | F.col("text").contains("option")).select("doc", "page", F.col("pos").alias("artifact"), "x0", "y0", "x1", "y1", raw.alias("raw"), cells.alias("cells"))
    near = S.nearby(found, lines)
    return near.select("doc", "page", "artifact", "nearby", "caption", P.artifact_kind(F.col("raw"), F.lit("UNKNOWN"), F.col("nearby"), F.col("cells")).alias("a")).select("doc", "page", "artifact", "nearby", "caption", "a.*")


QUERIES = {f.__name__: f for f in (line_profile, sheet_sections, sheet_tasks, sheet_parts, sheet_composition, sheet_spans, answer_groups, task_bands, marker_precedence, page_headers, review_sequence, layout_flatten, artifact_context)}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _m(x: str, p: str, across: bool = False) -> str:
    return f"regexp_matches({x}, {_text(f'(?i{"s" if across else ""})' + p)})"


def _g(x: str, p: str, n: int = 1) -> str:
    return f"regexp_extract({x}, {_text('(?i)' + p)}, {n})"


_TASKS = f"({_m('text', P.TASK)} OR {_m('text', P.DECIMAL_TASK)})"
_NUMBER = f"CASE WHEN {_m('text', P.TASK)} THEN {_g('text', P.TASK)} ELSE {_g('text', P.DECIMAL_TASK)} END"


def _kind(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_m(x, p, a)} THEN '{k}'" for k, a, p in P.KINDS) + " ELSE 'UNKNOWN' END"


def _mode(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(map(_text, ks))}) THEN '{m}'" for m, ks in P.MODES.items()) + " ELSE 'UNKNOWN' END"


def _section(x: str) -> str:
    rubric = f"{_m(x, '^writing' + chr(92) + 'b')} AND {_m(x, P.RUBRIC)}"
    rules = [(_m(x, P.GROUP_SECTION), "PART_GROUP"), (f"{rubric} AND {_m(x, P.SCORES)}", "WRITING"), (rubric, "CRITERIA"), *((_m(x, p), k) for k, p in P.SECTIONS)]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k in rules) + " END"


_HITS = f"len(regexp_extract_all(text, {_text(P.FORMULA)}))"
_HEADING = "CASE WHEN text = '' OR len(text) > 90 THEN 0.0 WHEN st IS NOT NULL THEN 1.0 ELSE round((CASE WHEN len(regexp_extract_all(text, '\\p{Lu}')) >= 0.8 * greatest(len(regexp_extract_all(text, '\\p{L}')), 1) THEN 0.35 ELSE 0 END) + (CASE WHEN {median} > 0 AND size >= 1.18 * {median} THEN 0.25 ELSE 0 END) + (CASE WHEN bold THEN 0.15 ELSE 0 END) + (CASE WHEN len(text) <= 40 THEN 0.1 ELSE 0 END), 2) END"


def _role(opens: str) -> str:
    rules = [(opens, "TASK_MARKER", 0.99), ("y0 >= 0.94 * height", "FOOTNOTE", 0.72), (_m("text", P.CAPTION), "CAPTION", 0.92), (_m("text", P.OPTION), "OPTION_LIST", 0.9), (f"{_HITS} >= 2 OR ({_HITS} >= 1 AND len(text) <= 90)", "FORMULA_TEXT", 0.84), (_m("text", P.INSTRUCTION), "INSTRUCTION", 0.88), ("len(text) <= 2", "UNKNOWN", 0.45)]
    return ", ".join("CASE " + " ".join(f"WHEN {c} THEN {_text(r) if k else s}" for c, r, s in rules) + (" ELSE 'BODY_TEXT' END AS line_role" if k else " ELSE 0.8 END AS role_confidence") for k in (1, 0))


_WRITING = f"CASE WHEN {_m('text', P.WRITE)} THEN upper({_g('text', P.WRITE)}[1]) || lower({_g('text', P.WRITE)}[2:]) " + " ".join(f"WHEN {_m('text', rf'{chr(92)}b{w}{chr(92)}b')} THEN '{v}'" for w, v in P.WRITING_WORDS) + " ELSE 'Writing task' END"

_SHEETS = f"""
WITH src AS (SELECT o_orderkey AS k, o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS pos FROM orders),
raw AS (SELECT doc, [{", ".join(map(_text, ROLES))}][doc % 5 + 1] AS role, pos // 6 + 1 AS page, pos, replace([{", ".join(map(_text, LINES))}][k % {len(LINES)} + 1], '#', CAST(k % 7 + 1 AS VARCHAR)) AS text,
  CASE WHEN k % 3 < 2 THEN 72.0 ELSE 330.0 END AS x0, 72.0 + (pos % 6) * (CASE WHEN doc % 2 = 0 THEN 24.0 ELSE 140.0 END) AS y0, CASE WHEN k % {len(LINES)} IN (0, 8, 11) THEN 14.0 ELSE 11.0 END AS size, k % {len(LINES)} IN (0, 8) AS bold, 800.0 AS height, 600.0 AS width FROM src),
lines AS (SELECT *, CAST(x0 + 40 + len(text) * 3.0 AS DOUBLE) AS x1, CAST(y0 + 14 AS DOUBLE) AS y1, {_section("text")} AS st, {_TASKS} AS is_task, {_NUMBER} AS number FROM raw)
"""
_LABEL = "CASE WHEN is_task THEN 'Task ' || number ELSE text[1:80] END"
_SECLABEL = f"CASE WHEN st = 'SPEAKING_SET' THEN 'Speaking Set ' || {_g('text', P.SET)} WHEN st IS NULL AND is_task THEN 'Tasks' ELSE text[1:100] END"
_SKILL = f"st IN ({', '.join(map(_text, P.SKILLS))})"
_STARTS = (
    _SHEETS
    + f""",
s1 AS (SELECT *, min(CASE WHEN {_SKILL} THEN pos END) OVER (PARTITION BY doc) AS skill, max(CASE WHEN st = 'SPEAKING_SET' THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS has_set,
  quantile_disc(size, [0.5]) OVER (PARTITION BY doc) AS unused, list_sort(list(size) OVER (PARTITION BY doc)) AS sizes FROM lines),
s2 AS (SELECT *, sizes[len(sizes) // 2 + 1] AS median, st IS NOT NULL AND NOT (st = 'ANSWERS' AND len(text) > 45) AND NOT coalesce(st = 'CRITERIA' AND pos < skill AND pos < 12, false) AS kept FROM s1),
s3 AS (SELECT *, kept AND (st = 'METHODOLOGY' OR (st = 'CRITERIA' AND {_m("text", P.SCHEME)})) AS lock FROM s2),
s4 AS (SELECT *, coalesce(max(CAST(lock AS INT)) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS locked FROM s3),
s5 AS (SELECT *, kept AND (lock OR NOT ((locked AND ({_SKILL} OR (st = 'CRITERIA' AND {_m("text", P.SCORES)}))) OR ({_SKILL} AND len(text) > 70))) AS keyed FROM s4),
s6 AS (SELECT *, bool_or(keyed) OVER (PARTITION BY doc) AS any_keyed, bool_or(st IS NOT NULL AND len(text) <= 100) OVER (PARTITION BY doc) AS any_short, min(CASE WHEN is_task THEN pos END) OVER (PARTITION BY doc) AS first_task, min(pos) OVER (PARTITION BY doc) AS first_pos FROM s5),
starts AS (SELECT *, coalesce(CASE WHEN role = 'LISTENING_SCRIPT' THEN pos = first_pos WHEN role = 'TASK_SET' AND has_set = 1 THEN st = 'SPEAKING_SET' WHEN role IN ('ANSWER_KEY', 'CRITERIA') AND any_keyed THEN keyed WHEN any_short THEN st IS NOT NULL AND len(text) <= 100
  WHEN first_task IS NOT NULL THEN pos = first_task ELSE {_HEADING.replace("{median}", "median")} >= 0.65 END, false) AS starts FROM s6),
secs AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS section, lead(text) OVER (PARTITION BY doc ORDER BY pos) AS next_text, lead(st) OVER (PARTITION BY doc ORDER BY pos) AS next_st, lead(is_task) OVER (PARTITION BY doc ORDER BY pos) AS next_task, lead(page) OVER (PARTITION BY doc ORDER BY pos) AS next_page, lead(y0) OVER (PARTITION BY doc ORDER BY pos) AS next_y FROM starts),
marks AS (SELECT *, sum(CAST(is_task AS INT)) OVER (PARTITION BY doc, section ORDER BY pos) AS task, sum(CAST(is_task AS INT)) OVER (PARTITION BY doc, section) AS most FROM secs WHERE section > 0),
owned AS (SELECT * EXCLUDE (line), line = 1 AS opens FROM (SELECT *, row_number() OVER (PARTITION BY doc, section, task ORDER BY pos) AS line FROM marks WHERE task > 0 OR most = 0)),
heads AS (SELECT doc, lower(trim(text)) AS norm, count(DISTINCT page) AS pages FROM lines WHERE y0 <= 0.18 * height AND len(trim(text)) >= 4 GROUP BY ALL HAVING count(DISTINCT page) >= 2)
"""
)
_BLOCKS = (
    _STARTS
    + f""",
two AS (SELECT *, 0 AS k FROM owned UNION ALL SELECT * REPLACE (trim({_g("text", P.TASK, 2)}) AS text), 1 AS k FROM owned WHERE opens AND trim({_g("text", P.TASK, 2)}) <> ''),
allblocks AS (SELECT *, {_role("(opens AND k = 0)")} FROM two),
blk AS (SELECT b.* FROM allblocks b LEFT JOIN heads h ON b.doc = h.doc AND lower(trim((CASE WHEN k = 0 THEN b.text END))) = h.norm WHERE b.opens OR h.norm IS NULL)
"""
)
_SPANS = "SELECT doc, section, task, page, round(min(x0), 3) AS x0, round(min(y0), 3) AS y0, round(max(x1), 3) AS x1, round(max(y1), 3) AS y1 FROM {b} WHERE (k = 1 OR NOT opens) AND (k = 1 OR line_role NOT IN ('TASK_MARKER', 'FOOTNOTE')) GROUP BY ALL"
_T = "doc, section, task"
_TASKSQL = (
    _BLOCKS
    + f""",
sp AS (SELECT {_T}, count(*) AS n_pages FROM ({_SPANS.format(b="blk")}) GROUP BY ALL),
gap AS (SELECT {_T}, arg_min(page, (pos, k)) AS gap FROM (SELECT *, lag(page) OVER w AS lp, lag(y1) OVER w AS ly FROM blk WHERE line_role NOT IN ('TASK_MARKER', 'FOOTNOTE') WINDOW w AS (PARTITION BY {_T} ORDER BY pos, k)) WHERE lp = page AND y0 - ly > 96 GROUP BY ALL),
cols AS (SELECT {_T}, list('multi_column_page:' || page) AS cols FROM (SELECT {_T}, page, min(c) < 0.42 * max(width) AND max(c) > 0.58 * max(width) AS two FROM (SELECT *, CASE WHEN x1 - x0 < 0.72 * width THEN (x0 + x1) / 2 END AS c FROM blk) GROUP BY ALL) WHERE two GROUP BY ALL),
body AS (SELECT {_T}, trim(coalesce(string_agg(text, chr(10) ORDER BY pos, k) FILTER (WHERE line_role NOT IN ('TASK_MARKER', 'FOOTNOTE')), '')) AS body, coalesce(min(role_confidence) FILTER (WHERE line_role <> 'TASK_MARKER'), 0.5) AS role_confidence FROM blk GROUP BY ALL),
ends AS (SELECT {_T}, arg_max({{'t': next_text, 's': next_st, 'm': next_task, 'p': next_page, 'page': page}}, pos) AS e, min(page) AS page_start, string_agg(text, chr(10) ORDER BY pos) AS whole FROM owned GROUP BY ALL),
there AS (SELECT {_T}, bool_or(o.page = e.e.p AND h.norm IS NULL AND lower(trim(o.text)) <> 'speaking') AS there, bool_or(NOT o.opens AND {_m("o.text", P.PART)}) AS has_parts FROM owned o JOIN ends e USING (doc, section, task) LEFT JOIN heads h ON h.doc = o.doc AND h.norm = lower(trim(o.text)) GROUP BY ALL),
num AS (SELECT {_T}, TRY_CAST({_g("text", P.ITEM)} AS INT) AS i FROM owned WHERE NOT opens),
itm AS (SELECT {_T}, min(i) AS lo, max(i) AS hi, count(*) AS n FROM (SELECT {_T}, i FROM num WHERE i <= 300 GROUP BY ALL HAVING count(*) <= 3) GROUP BY ALL),
rng AS (SELECT {_T}, TRY_CAST({_g("whole", P.RANGE)} AS INT) AS a, TRY_CAST({_g("whole", P.RANGE, 2)} AS INT) AS b FROM ends),
j AS (SELECT o.doc, o.section, o.task, o.text, o.st, o.is_task, o.number, body, role_confidence, e, page_start, there, has_parts, cols, gap, n_pages, coalesce(a <= b AND b <= 300, false) AS named, a, b, lo, hi, n,
  least(CASE WHEN body = '' THEN 0.42 ELSE 0.97 END, CASE WHEN n_pages > 1 THEN 0.93 ELSE 1 END, CASE WHEN gap IS NOT NULL THEN 0.76 ELSE 1 END, CASE WHEN cols IS NOT NULL THEN 0.82 ELSE 1 END) AS conf
  FROM owned o JOIN body USING (doc, section, task) JOIN ends USING (doc, section, task) JOIN there USING (doc, section, task) JOIN rng USING (doc, section, task) LEFT JOIN itm USING (doc, section, task) LEFT JOIN cols USING (doc, section, task) LEFT JOIN gap USING (doc, section, task) LEFT JOIN sp USING (doc, section, task) WHERE o.opens),
tasks AS (SELECT doc, section, task, 'task_' || sha1(doc || '|' || section || '|' || task)[1:20] AS task_id, CASE WHEN task > 0 THEN {_LABEL} ELSE {_SECLABEL} END AS label, CASE WHEN task > 0 THEN number ELSE '' END AS number, CASE WHEN has_parts THEN 'COMPOSITE' ELSE {_kind("body")} END AS kind,
  page_start, CASE WHEN e.p > page_start AND NOT there THEN e.p - 1 ELSE e.page END AS page_end, body, round(conf, 3) AS boundary_confidence,
  array_to_string(list_sort(list_filter(list_concat(['explicit_task_marker', CASE WHEN e.t IS NULL THEN 'document_end' WHEN e.m THEN 'next_task_marker' WHEN e.s IS NOT NULL THEN 'next_section_boundary' ELSE 'layout_boundary' END, CASE WHEN body = '' THEN 'empty_body' END, CASE WHEN n_pages > 1 THEN 'multi_page_body' END, 'large_layout_gap:' || gap], cols), lambda x: x IS NOT NULL)), ',') AS reasons,
  round(role_confidence, 3) AS role_confidence, round(least(conf, role_confidence), 3) AS confidence, round(least(conf, role_confidence), 3) < 0.78 AS review,
  CASE WHEN named THEN a ELSE lo END AS first_item, CASE WHEN named THEN b ELSE hi END AS last_item, CAST(CASE WHEN named THEN b - a + 1 ELSE n END AS BIGINT) AS n_items, CASE WHEN named THEN 'instruction' WHEN lo IS NOT NULL THEN 'items' END AS range_source FROM j)
"""
)
_SUB = "lower(" + " || ".join(_g("text", P.SUBPART, k) for k in (1, 2, 3)) + ")"
_PARTS = (
    _TASKSQL
    + f""",
pm AS (SELECT *, CASE WHEN NOT opens THEN nullif({_g("text", P.PART)}, '') END AS major, CASE WHEN NOT opens THEN nullif({_SUB}, '') END AS minor FROM owned),
pw AS (SELECT *, count(major) OVER w AS majors, count(minor) OVER w AS minors, wk.kind AS whole_kind FROM pm JOIN (SELECT {_T}, {_kind("whole")} AS kind FROM (SELECT {_T}, replace(whole, chr(10), ' ') AS whole FROM ends)) wk USING (doc, section, task) WINDOW w AS (PARTITION BY {_T})),
pk AS (SELECT *, coalesce(major, CASE WHEN majors = 0 AND minors >= 2 AND whole_kind NOT IN ('SELECT_ONE', 'SELECT_MULTIPLE', 'MULTIPLE_CHOICE_CLOZE', 'MATCHING') THEN minor END) AS mark FROM pw),
pn AS (SELECT *, count(mark) OVER (PARTITION BY {_T} ORDER BY pos) AS part FROM pk),
parts AS (SELECT {_T}, part, 'Part ' || arg_min(mark, pos) AS label, string_agg(text, ' ' ORDER BY pos) AS t, CASE WHEN max(majors) > 0 THEN 0.94 ELSE 0.78 END AS confidence FROM pn WHERE part > 0 GROUP BY {_T}, part)
"""
)


def _real(sql: str, *columns: str) -> str:
    """DuckDB's decimals as doubles."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM ({sql})"


_PID = "'part_' || sha1(doc || '|' || section || '|' || task || '|' || {p})[1:20]"

ORACLE_SQL = {
    "line_profile": _real(_SHEETS + f"SELECT doc, pos, coalesce(st, '-') AS section_type, {_HEADING.replace('{median}', '11.0')} AS heading, {_role('false')}, {_kind('text')} AS kind, {_mode(_kind('text'))} AS mode, {_WRITING} AS writing, number, {_LABEL} AS label FROM lines", "heading", "role_confidence"),
    "sheet_sections": _STARTS + f"SELECT doc, pos, coalesce(st, '-') AS section_type, {_SECLABEL} AS label FROM starts WHERE starts",
    "sheet_tasks": _real(_TASKSQL + f"SELECT * EXCLUDE (kind), kind, {_mode('kind')} AS mode FROM tasks", "boundary_confidence", "role_confidence", "confidence"),
    "sheet_parts": _real(_PARTS + f"SELECT {_T}, part, label, {_kind('t')} AS kind, confidence FROM parts", "confidence"),
    "sheet_composition": _PARTS + f""", many AS (SELECT p.*, body FROM (SELECT *, count(*) OVER (PARTITION BY {_T}) AS n FROM parts) p JOIN tasks USING (doc, section, task) WHERE n >= 2)
SELECT 'task_group_' || sha1(doc || '|' || section || '|' || task)[1:20] AS source, 'OWNS_PART' AS kind, {_PID.format(p="part")} AS target FROM many
UNION ALL SELECT {_PID.format(p="part")}, 'USES_STIMULUS', 'shared_stimulus_' || sha1(doc || '|' || section || '|' || task)[1:20] FROM many
UNION ALL SELECT {_PID.format(p="part")}, 'DEPENDS_ON', {_PID.format(p="(part - 1)")} FROM many WHERE part > 1 AND {_m("body", P.DEPENDENCY)}""",
    "sheet_spans": _real(_BLOCKS + _SPANS.format(b="allblocks"), "x0", "y0", "x1", "y1"),
    "answer_groups": _STARTS + f""", ag AS (SELECT doc, section, pos, list_concat(regexp_extract_all(text, {_text("(?i)" + P.TASK_INSIDE)}, 1), regexp_extract_all(text, {_text("(?i)" + P.ANSWER_TO)}, 1)) AS ns,
  coalesce(min(CASE WHEN {_m("text", P.TASK)} OR {_m("text", P.ANSWER_TO)} THEN pos END) OVER (PARTITION BY doc, section ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(pos) OVER (PARTITION BY doc, section) + 1) AS stop FROM secs WHERE section > 0)
SELECT doc, section, number, min(pos) AS pos, arg_min(stop, pos) AS until FROM (SELECT doc, section, pos, stop, unnest(ns) AS number FROM ag) GROUP BY ALL""",
    "task_bands": _real(_STARTS + f""", whole AS (SELECT {_T}, arg_min({{'page': page, 'y': y0}}, pos) AS f, arg_max({{'p': next_page, 'y': next_y}}, pos) AS l FROM owned GROUP BY ALL),
pg AS (SELECT {_T}, page, max(height) AS h FROM owned GROUP BY ALL), tp AS (SELECT *, CASE WHEN page = f.page THEN f.y ELSE 0.0 END AS top FROM pg JOIN whole USING (doc, section, task))
SELECT {_T}, page, top, CASE WHEN page = l.p THEN greatest(top + 1.0, l.y - 1.0) ELSE h END AS bottom FROM tp""", "top", "bottom"),
    "marker_precedence": _SHEETS + f""", f AS (SELECT *, {_m("text", P.TASK)} AS w, {_m("text", P.ITEM)} AS n, page <> lag(page, 1, -1) OVER (PARTITION BY doc ORDER BY pos) AS p FROM lines),
g AS (SELECT *, bool_or(w) OVER (PARTITION BY doc) AS aw, bool_or(n) OVER (PARTITION BY doc) AS an FROM f)
SELECT doc, pos, CASE WHEN aw THEN 'keyword' WHEN an THEN 'number' ELSE 'page' END AS mark, sum(CAST(CASE WHEN aw THEN w WHEN an THEN n ELSE p END AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS piece FROM g""",
    "page_headers": _STARTS + "SELECT doc, norm, pages FROM heads",
    "review_sequence": _STARTS + """, nd AS (SELECT DISTINCT doc, section, -1 AS task, 's' || section AS node FROM owned UNION ALL SELECT DISTINCT doc, section, task, 's' || section || 't' || task FROM owned)
SELECT doc, row_number() OVER w AS step, node, lag(node) OVER w AS before, lead(node) OVER w AS after FROM nd WINDOW w AS (PARTITION BY doc ORDER BY section, task)""",
    "layout_flatten": _real(_SHEETS + "SELECT doc, page, pos, text, y0 FROM lines", "y0"),
    "artifact_context": _real(_SHEETS + f""", a AS (SELECT *, pos AS artifact, ['table', 'image', 'drawing'][pos % 3 + 1] AS raw, pos * 4 AS cells FROM lines WHERE contains(text, '=') OR contains(text, 'option')),
n AS (SELECT a.doc, a.page, a.artifact, a.raw, a.cells, string_agg(l.text, ' ' ORDER BY l.pos) AS nearby, coalesce(arg_min(CASE WHEN {_m("l.text", P.CAPTION)} THEN l.text END, CASE WHEN {_m("l.text", P.CAPTION)} THEN l.pos END), '') AS caption FROM a JOIN lines l ON l.doc = a.doc AND l.page = a.page AND greatest(l.y0 - a.y1, a.y0 - l.y1, 0) <= 72 GROUP BY ALL),
c AS (SELECT *, CASE WHEN raw = 'table' AND cells >= 16 THEN 'GRID' WHEN raw = 'table' THEN 'TABLE' WHEN {_m("nearby", P.MAP_WORDS)} THEN 'MAP' WHEN {_m("nearby", P.GRAPH_WORDS)} THEN 'GRAPH' WHEN {_m("nearby", P.FIGURE_WORDS)} THEN 'FIGURE' WHEN raw = 'image' THEN 'IMG' ELSE 'DIAGRAM' END AS x FROM n)
SELECT doc, page, artifact, nearby, caption, CASE WHEN x = 'IMG' THEN 'FIGURE' ELSE x END AS kind, CASE x WHEN 'GRID' THEN 0.82 WHEN 'TABLE' THEN 0.91 WHEN 'MAP' THEN 0.88 WHEN 'GRAPH' THEN 0.88 WHEN 'FIGURE' THEN 0.87 WHEN 'IMG' THEN 0.78 ELSE 0.72 END AS confidence,
  CASE x WHEN 'GRID' THEN 'dense_cell_grid' WHEN 'TABLE' THEN 'pdf_table' WHEN 'MAP' THEN 'nearby_map_caption' WHEN 'GRAPH' THEN 'nearby_graph_caption' WHEN 'FIGURE' THEN 'nearby_figure_caption' WHEN 'IMG' THEN 'generic_image' ELSE 'vector_drawing_group' END AS reason FROM c""", "confidence"),
}
