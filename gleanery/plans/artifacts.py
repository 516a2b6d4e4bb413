"""Queries on artifacts of task sheets. Lines are those of `plans.sheets`; each stands for what a page shows beside it: a table, an image, or drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.operators import artifacts as A
from gleanery.operators import proposals as D
from gleanery.operators import sheets as S
from gleanery.plans.sheets import _PARTS, _PID, _SECLABEL, _SPANS, _T, _WRITING, ROLES, _kind, _m, _mode, _real, _text, sheet_lines
from gleanery.sources.folders import checkpointed
from gleanery.sources.tables import table


def visuals(lines: DataFrame) -> DataFrame:
    """Every fourth line is a table, the next an image, the next five drawings; some drawings lie over a table of their size."""
    k, x, y = F.col("pos") % 8, F.col("x0"), F.col("y0")

    def item(name: str, raw: str, left, top, right, bottom, cells):
        box = [c.cast("double").alias(n) for c, n in zip((left, top, right, bottom), ("x0", "y0", "x1", "y1"), strict=True)]
        return F.struct(F.concat(F.lit(name), F.col("pos")).alias("visual"), F.lit(raw).alias("raw"), *box, cells.cast("int").alias("cells"))

    table = item("t", "table", x, y + 4, x + 200, y + 44, F.col("pos") * 3)
    image = item("i", "image", x + 10, y + 2, x + 90, y + 60, F.lit(0))
    drawn = [item(f"d{i}.", "drawing", x + 40 * i, y + 4, x + 40 * i + 40, y + 44, F.lit(0)) for i in range(5)]
    over = item("o", "table", x, y + 4, x + 200, y + 46, F.lit(2))
    found = F.when(k.isin(1, 5), F.array(table)).when(k.isin(2, 6), F.array(image)).when(k == 3, F.array(*drawn)).when(k == 7, F.array(*drawn, over))
    return lines.select("doc", "page", F.explode(found).alias("v")).select("doc", "page", "v.*")


def _found(spark: SparkSession, d: str) -> DataFrame:
    lines = sheet_lines(spark, d)
    return A.artifacts(visuals(lines), lines)


def sheet_artifacts(spark: SparkSession, d: str) -> DataFrame:
    got = _found(spark, d)
    return got.withColumns({"sources": F.array_join("sources", ","), "binding_reasons": F.array_join("binding_reasons", ",")})


def artifact_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = sheet_lines(spark, d)
    steps = S.written(lines)
    tasks = checkpointed(S.tasks(lines, steps))
    # without text of its own a task shares only what it owns
    body = tasks.select("doc", "section", "task", F.lit(False).alias("shared"), "body")
    return S.composition(S.parts(lines, steps), body, A.artifacts(visuals(lines), lines, tasks, steps=steps))


def task_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    lines = sheet_lines(spark, d)
    steps = S.written(lines)
    tasks = checkpointed(S.tasks(lines, steps))
    owned = A.artifacts(visuals(lines), lines, tasks, steps=steps)
    parts = S.parts(lines, steps).groupBy("doc", "section", "task").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return A.reconstructed(tasks, owned, parts).select("doc", "section", "task", "confidence", "review", "n_artifacts")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Every customer: those without orders are documents without lines."""
    k = F.col("c_custkey")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (k % len(ROLES) + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("doc"), F.concat(F.lit("sheet-"), k, F.lit(".pdf")).alias("filename"), role.alias("role"))


def document_proposals(spark: SparkSession, d: str) -> DataFrame:
    got = D.verified(D.proposals(_documents(spark, d), sheet_lines(spark, d)), "proposal")
    return got.withColumn("warnings", F.array_join("warnings", ",")).drop("proposal")


def document_manifests(spark: SparkSession, d: str) -> DataFrame:
    lines = checkpointed(sheet_lines(spark, d))
    seen = lines.select("doc", F.concat(F.lit("s"), F.col("pos") % 3).alias("source_id"), F.concat(F.lit("https://h.example/"), F.col("pos") % 2).alias("url"))
    return D.manifests(D.proposals(_documents(spark, d), lines), D.layout_stats(lines, lines.select("doc", "page").distinct()), seen).drop("manifest")


QUERIES = {f.__name__: f for f in (sheet_artifacts, artifact_edges, task_reconstruction, document_proposals, document_manifests)}

# the SQL joins all visuals of a page with all tasks on it, and reads the kinds' fixed values from the rules' names
_X = "greatest(0, least(v.x1, s.x1) - greatest(v.x0, s.x0)) / greatest(1, least(v.x1 - v.x0, s.x1 - s.x0))"
_GAP = "greatest(0, s.y0 - v.y1, v.y0 - s.y1)"
_ACROSS = f"CASE WHEN {_X} >= 0.5 THEN {{0}} WHEN {_X} >= 0.15 THEN {{1}} WHEN v.x1 - v.x0 >= 0.72 * 600 THEN {{2}} ELSE {{3}} END"
_DOWN = f"CASE WHEN {_GAP} = 0 THEN {{0}} WHEN {_GAP} <= 48 THEN {{1}} WHEN {_GAP} <= 120 THEN {{2}} ELSE {{3}} END"
_SCORE = f"round(greatest(0, least(0.98::DOUBLE, 0.36::DOUBLE + {_ACROSS.format('0.34::DOUBLE', '0.18::DOUBLE', '0.14::DOUBLE', '0')} + {_DOWN.format('0.22::DOUBLE', '0.16::DOUBLE', '0.08::DOUBLE', '-0.18::DOUBLE')})), 3)"
_WHY = f"concat_ws(',', {_ACROSS.format(*map(repr, ('x_overlap', 'partial_x_overlap', 'full_width_asset')), 'NULL')}, {_DOWN.format(*map(repr, ('body_overlap', 'near_body', 'within_task_neighborhood', 'far_from_body')))})"
_RULES = [
    ("raw = 'table' AND tk IN ('TRUE_FALSE', 'TRUE_FALSE_NOT_STATED', 'TABLE_GAP_FILL')", "RESPONSE_TABLE", 0.94, "task_kind_table"),
    ("raw = 'table' AND tk = 'FORM_FILL'", "FORM", 0.92, "form_fill_table"),
    (f"raw = 'table' AND {_m('nearby', P.BANK_WORDS)}", "WORD_BANK", 0.9, "nearby_word_bank_caption"),
    ("raw = 'table' AND cells >= 16", "GRID", 0.82, "dense_cell_grid"),
    ("raw = 'table'", "TABLE", 0.91, "pdf_table"),
    (_m("nearby", P.MAP_WORDS), "MAP", 0.88, "nearby_map_caption"),
    (_m("nearby", P.GRAPH_WORDS), "GRAPH", 0.88, "nearby_graph_caption"),
    (_m("nearby", P.FIGURE_WORDS), "FIGURE", 0.87, "nearby_figure_caption"),
    ("raw = 'image'", "FIGURE", 0.78, "generic_image"),
    ("true", "DIAGRAM", 0.72, "vector_drawing_group"),
]


def _ruled(k: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]!r}{'::DOUBLE' if k == 2 else ''}" for r in _RULES) + " END"


_TYPED = f"""
{{n}}b AS (SELECT v.*, {_SCORE} AS binding, {_WHY} AS binding_reasons FROM {{src}} v JOIN spn s USING (doc, section, task, page) WHERE {_SCORE} >= 0.42),
{{n}}n AS (SELECT b.*, coalesce(string_agg(l.text, ' ' ORDER BY l.pos), '') AS nearby, coalesce(arg_min(CASE WHEN {_m("l.text", P.CAPTION)} THEN l.text END, CASE WHEN {_m("l.text", P.CAPTION)} THEN l.pos END), '') AS caption
  FROM {{n}}b b LEFT JOIN lines l ON l.doc = b.doc AND l.page = b.page AND greatest(l.y0 - b.y1, b.y0 - l.y1, 0) <= 72 GROUP BY ALL),
{{n}}t AS (SELECT n.*, 'artifact_' || sha1(doc || '|' || section || '|' || task || '|' || lower(source))[1:20] AS artifact, {_ruled(1)} AS kind, {_ruled(2)} AS type_confidence, {_ruled(3)} AS type_reason
  FROM {{n}}n n JOIN (SELECT {_T}, kind AS tk FROM tasks) USING (doc, section, task))"""
_INTER = "greatest(0, least(g.x1, t.x1) - greatest(g.x0, t.x0)) * greatest(0, least(g.y1, t.y1) - greatest(g.y0, t.y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_ART = (
    _PARTS
    + f""",
vis AS (SELECT doc, page, 't' || pos AS visual, 'table' AS raw, x0, y0 + 4 AS y0, x0 + 200 AS x1, y0 + 44 AS y1, pos * 3 AS cells FROM lines WHERE pos % 4 = 1
  UNION ALL SELECT doc, page, 'i' || pos, 'image', x0 + 10, y0 + 2, x0 + 90, y0 + 60, 0 FROM lines WHERE pos % 4 = 2
  UNION ALL SELECT doc, page, 'd' || i || '.' || pos, 'drawing', x0 + 40 * i, y0 + 4, x0 + 40 * i + 40, y0 + 44, 0 FROM lines, range(5) r(i) WHERE pos % 4 = 3
  UNION ALL SELECT doc, page, 'o' || pos, 'table', x0, y0 + 4, x0 + 200, y0 + 46, 2 FROM lines WHERE pos % 8 = 7),
wh AS (SELECT {_T}, arg_min({{'page': page, 'y': y0}}, pos) AS f, arg_max({{'p': next_page, 'y': next_y}}, pos) AS l FROM owned GROUP BY ALL),
pg AS (SELECT {_T}, page, max(height) AS h FROM owned GROUP BY ALL),
tp AS (SELECT *, CASE WHEN page = f.page THEN f.y ELSE 0.0 END AS top FROM pg JOIN wh USING (doc, section, task)),
bnd AS (SELECT {_T}, page, top, CASE WHEN page = l.p THEN greatest(top + 1.0, l.y - 1.0) ELSE h END AS bottom FROM tp),
spn AS ({_SPANS.format(b="blk")}),
seen AS (SELECT v.*, section, task FROM vis v JOIN bnd b ON b.doc = v.doc AND b.page = v.page AND least(v.y1, bottom) - greatest(v.y0, top) > 1),
one AS (SELECT {_T}, page, x0, y0, x1, y1, raw, cells, visual AS source, visual AS sources FROM seen WHERE raw <> 'drawing'),{_TYPED.format(n="sg", src="one")},
grp AS (SELECT {_T}, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 'drawing' AS raw, 0 AS cells, 'drawings' || page AS source, string_agg(visual, ',' ORDER BY visual) AS sources FROM seen WHERE raw = 'drawing' GROUP BY {_T}, page HAVING count(*) >= 4),
free AS (SELECT * FROM grp g WHERE {_AREA.format("g")} > 100 AND NOT EXISTS (SELECT 1 FROM sgt t WHERE t.doc = g.doc AND t.section = g.section AND t.task = g.task AND t.page = g.page AND kind IN ('TABLE', 'GRID', 'RESPONSE_TABLE', 'FORM')
  AND {_INTER} >= 0.70 * ({_AREA.format("g")} + {_AREA.format("t")} - {_INTER}))),{_TYPED.format(n="gp", src="free")},
txt AS (SELECT {_T}, page, x0, y0, x1, y1, 'line' || pos || CASE WHEN k = 1 THEN '.1' ELSE '' END AS source, role_confidence FROM blk WHERE line_role = 'FORMULA_TEXT'),
every AS (SELECT {_T}, page, x0, y0, x1, y1, source, sources, artifact, kind, type_confidence, type_reason, binding, binding_reasons, caption, round(least(type_confidence, binding), 3) AS confidence FROM (SELECT * FROM sgt UNION ALL BY NAME SELECT * FROM gpt)
  UNION ALL SELECT {_T}, page, x0, y0, x1, y1, source, source, 'artifact_' || sha1(doc || '|' || section || '|' || task || '|' || source || '|formula')[1:20], 'FORMULA', role_confidence, CASE WHEN source LIKE '%.1' THEN 'inline_task_statement:' ELSE '' END || 'formula_symbols', 0.99, 'owned_text_block', '', round(role_confidence, 3) FROM txt)
"""
)
_KEY = "role IN ('ANSWER_KEY', 'CRITERIA')"
_D = "::DOUBLE"
_PROPOSALS = (
    _PARTS
    + f""",
z1 AS (SELECT *, starts OR (NOT bool_or(starts) OVER (PARTITION BY doc) AND pos = min(pos) OVER (PARTITION BY doc)) AS begins FROM starts),
z2 AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM z1),
z3 AS (SELECT z.doc, z.sec AS section, arg_min({{'text': z.text, 'st': z.st, 'page': z.page, 'is_task': is_task}}, z.pos) AS f, arg_max(z.page, z.pos) AS last_page, any_value(z.role) AS role, max(CASE WHEN h.norm IS NULL AND lower(trim(z.text)) <> 'speaking' THEN z.page END) AS filled
  FROM z2 z LEFT JOIN heads h ON h.doc = z.doc AND h.norm = lower(trim(z.text)) WHERE z.sec > 0 GROUP BY z.doc, z.sec),
z4 AS (SELECT *, f.page AS page_start, f.text AS text, f.is_task AS is_task, lead(f.page) OVER (PARTITION BY doc ORDER BY section) AS np, CASE WHEN role = 'LISTENING_SCRIPT' THEN 'TRANSCRIPTION' WHEN {_KEY} AND f.st = 'WRITING' THEN 'CRITERIA' ELSE f.st END AS st FROM z3),
sx AS (SELECT doc, role, section, CASE WHEN role = 'LISTENING_SCRIPT' THEN 'Transcription' ELSE {_SECLABEL} END AS label, coalesce(st, 'UNKNOWN') AS semantic_type,
  CASE WHEN role = 'LISTENING_SCRIPT' THEN 'SCRIPT' WHEN {_KEY} AND st IN ('CRITERIA', 'METHODOLOGY') THEN 'CRITERIA' WHEN {_KEY} THEN 'ANSWERS' END AS content_role,
  page_start, CASE WHEN np > page_start AND NOT coalesce(filled >= np, false) THEN np - 1 ELSE last_page END AS page_end, last_page, CASE WHEN role = 'LISTENING_SCRIPT' THEN 0.96{_D} WHEN st IS NULL THEN 0.58{_D} ELSE 0.98{_D} END AS confidence FROM z4),
px AS (SELECT {_T}, list({{'label': label, 'kind': kind, 'confidence': confidence{_D}}} ORDER BY part) AS parts FROM (SELECT {_T}, part, label, {_kind("t")} AS kind, confidence FROM parts) GROUP BY ALL),
n1 AS (SELECT t.doc, t.section, t.task, t.label, t.number, role = 'LISTENING_SCRIPT' AS script, semantic_type IN ('SPEAKING_SET', 'SPEAKING') AND role <> 'LISTENING_SCRIPT' AS oral, CASE WHEN role = 'LISTENING_SCRIPT' THEN 'TRANSCRIPT_SEGMENT' WHEN semantic_type IN ('SPEAKING_SET', 'SPEAKING') THEN 'ORAL_RESPONSE' WHEN p.parts IS NOT NULL THEN 'COMPOSITE' ELSE t.kind END AS kind,
  t.page_start, t.page_end, t.confidence{_D} AS rec, first_item, last_item, p.parts FROM tasks t JOIN sx s USING (doc, section) LEFT JOIN px p USING (doc, section, task) WHERE t.task > 0 AND NOT {_KEY}),
ag AS (SELECT doc, section, pos, page, list_concat(regexp_extract_all(text, {_text("(?i)" + P.TASK_INSIDE)}, 1), regexp_extract_all(text, {_text("(?i)" + P.ANSWER_TO)}, 1)) AS ns FROM secs WHERE section > 0),
gx AS (SELECT doc, section, number, min(pos) AS pos, min(page) AS page FROM (SELECT doc, section, pos, page, unnest(ns) AS number FROM ag) GROUP BY ALL),
g1 AS (SELECT g.*, last_page, row_number() OVER (PARTITION BY g.doc, g.section ORDER BY pos, number) AS nth FROM gx g JOIN sx s USING (doc, section) WHERE {_KEY} AND semantic_type IN ('LISTENING', 'READING', 'USE_OF_ENGLISH', 'PART_GROUP')),
many AS (SELECT doc, section, CAST(task AS INT) AS nth, label, number, kind, CASE WHEN script THEN 'NONE' ELSE {_mode("kind")} END AS mode, page_start, page_end, CASE WHEN script THEN 0.96{_D} ELSE 0.97{_D} END AS confidence, rec, CASE WHEN NOT script AND NOT oral THEN first_item END AS first_item, CASE WHEN NOT script AND NOT oral THEN last_item END AS last_item, CASE WHEN script OR oral OR parts IS NULL THEN [] ELSE parts END AS parts FROM n1
  UNION ALL SELECT doc, section, nth, 'Task ' || number, number, 'ANSWER_GROUP', 'UNKNOWN', page, last_page, 0.91{_D}, NULL, NULL, NULL, [] FROM g1),
b0 AS (SELECT doc, section, body AS text FROM tasks WHERE task = 0),
w1 AS (SELECT s.*, coalesce(b.text, '') AS text, EXISTS (SELECT 1 FROM many m WHERE m.doc = s.doc AND m.section = s.section) AS has FROM sx s LEFT JOIN b0 b USING (doc, section)),
w2 AS (SELECT *, CASE WHEN role = 'LISTENING_SCRIPT' THEN CASE WHEN NOT has THEN {{'l': 'Transcript segment', 'k': 'TRANSCRIPT_SEGMENT', 'c': 0.82{_D}}} END
  WHEN {_KEY} THEN CASE WHEN semantic_type = 'CRITERIA' THEN {{'l': 'Rubric / rationale', 'k': 'CRITERION_GROUP', 'c': 0.84{_D}}} WHEN semantic_type = 'METHODOLOGY' THEN {{'l': 'Methodology block', 'k': 'OTHER', 'c': 0.82{_D}}} WHEN semantic_type IN ('LISTENING', 'READING', 'USE_OF_ENGLISH', 'PART_GROUP') AND NOT has THEN {{'l': 'Answers', 'k': 'ANSWER_GROUP', 'c': 0.76{_D}}} END
  WHEN has THEN NULL WHEN semantic_type = 'WRITING' AND role = 'TASK_SET' THEN {{'l': {_WRITING}, 'k': {_kind("text")}, 'c': 0.92{_D}}} WHEN semantic_type = 'TRANSCRIPTION' THEN {{'l': 'Transcript segment', 'k': 'TRANSCRIPT_SEGMENT', 'c': 0.68{_D}}}
  WHEN semantic_type = 'ANSWERS' THEN {{'l': 'Answer group', 'k': 'ANSWER_GROUP', 'c': 0.68{_D}}} WHEN semantic_type = 'CRITERIA' THEN {{'l': 'Criterion group', 'k': 'CRITERION_GROUP', 'c': 0.68{_D}}} WHEN semantic_type = 'METHODOLOGY' THEN {{'l': 'Methodology block', 'k': 'OTHER', 'c': 0.68{_D}}} END AS w FROM w1),
all_tasks AS (SELECT * FROM many UNION ALL SELECT doc, section, 0, w.l, '', w.k, {_mode("w.k")}, page_start, last_page, w.c, NULL, NULL, NULL, [] FROM w2 WHERE w IS NOT NULL),
tl AS (SELECT doc, section, count(*) AS n, list({{'label': label, 'number': number, 'kind': kind, 'mode': mode, 'page_start': page_start, 'page_end': page_end, 'confidence': confidence, 'reconstruction': rec, 'review': rec < 0.78, 'first_item': first_item, 'last_item': last_item, 'parts': parts, 'artifacts': []}} ORDER BY nth) AS ts FROM all_tasks GROUP BY ALL),
sl AS (SELECT doc, count(*) AS n_sections, coalesce(sum(n), 0) AS n_tasks, list({{'section': section, 'label': label, 'semantic_type': semantic_type, 'content_role': content_role, 'page_start': page_start, 'page_end': page_end, 'confidence': confidence, 'tasks': coalesce(ts, [])}} ORDER BY section) AS ss FROM sx LEFT JOIN tl USING (doc, section) GROUP BY doc),
dl AS (SELECT c_custkey AS doc, [{", ".join(map(_text, ROLES))}][c_custkey % {len(ROLES)} + 1] AS role FROM customer),
dj AS (SELECT doc, coalesce(n_sections, 0) AS n_sections, CAST(coalesce(n_tasks, 0) AS BIGINT) AS n_tasks, CASE WHEN ss IS NULL THEN ['no_text_lines'] WHEN n_tasks = 0 THEN ['no_explicit_tasks'] ELSE [] END AS warnings, role, ss FROM dl LEFT JOIN sl USING (doc)),
pj AS (SELECT doc, n_sections, n_tasks, warnings, to_json({{'schema_version': 'structure-proposal.v3', 'document': CAST(doc AS VARCHAR), 'filename': 'sheet-' || doc || '.pdf', 'document_role': role, 'sections': coalesce(ss, []), 'warnings': warnings}})::VARCHAR AS proposal FROM dj)
"""
)
_MANIFESTS = f"""
pc AS (SELECT doc, page, sum(len(trim(text))) AS n FROM lines GROUP BY ALL),
st AS (SELECT doc, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars, count_if(n >= 20) AS filled, list(CAST(n AS BIGINT) ORDER BY page) AS chars_by_page FROM pc GROUP BY doc),
oc AS (SELECT doc, list_sort(list({{'source_id': s, 'url': u}})) AS occ FROM (SELECT DISTINCT doc, 's' || (pos % 3) AS s, 'https://h.example/' || (pos % 2) AS u FROM lines) GROUP BY doc),
mj AS (SELECT p.doc, p.proposal, coalesce(chars < greatest(80, 20 * pages), true) AS ocr, coalesce(pages, 0) AS pages, coalesce(chars, 0) AS chars, coalesce(filled, 0) AS filled, coalesce(chars_by_page, []) AS cbp, coalesce(occ, []) AS occ FROM pj p LEFT JOIN st USING (doc) LEFT JOIN oc USING (doc)),
mm AS (SELECT doc, CASE WHEN ocr THEN 'needs_ocr' ELSE 'layout_ready' END AS status, CASE WHEN ocr THEN 'ocr' ELSE 'document_triage' END AS next_stage, * EXCLUDE (doc) FROM mj)
SELECT doc, status, next_stage, sha256(to_json({{'schema_version': 'parsed-document.v2', 'document': CAST(doc AS VARCHAR), 'status': status, 'pipeline_version': 'layout-pipeline.v1', 'proposal_sha256': CASE WHEN NOT ocr THEN sha256(proposal) END,
  'stats': {{'pages': pages, 'chars': chars, 'filled': filled, 'chars_by_page': cbp, 'needs_ocr': ocr}}, 'occurrences': occ, 'next_stage': next_stage}})::VARCHAR) AS digest FROM mm"""
_REAL = ("x0", "y0", "x1", "y1", "type_confidence", "binding", "confidence")
_STIM = "'shared_stimulus_' || sha1(doc || '|' || section || '|' || task)[1:20]"

ORACLE_SQL = {
    "document_proposals": _PROPOSALS + "SELECT doc, sha256(proposal) AS digest, n_sections, n_tasks, array_to_string(warnings, ',') AS warnings, true AS intact FROM pj",
    "document_manifests": _PROPOSALS + "," + _MANIFESTS,
    "sheet_artifacts": _real(_ART + "SELECT * FROM every", *_REAL),
    "artifact_edges": _ART + f""", many AS (SELECT p.*, body, EXISTS (SELECT 1 FROM every e WHERE e.doc = p.doc AND e.section = p.section AND e.task = p.task) AS own FROM (SELECT *, count(*) OVER (PARTITION BY {_T}) AS n FROM parts) p JOIN tasks USING (doc, section, task) WHERE n >= 2)
SELECT 'task_group_' || sha1(doc || '|' || section || '|' || task)[1:20] AS source, 'OWNS_PART' AS kind, {_PID.format(p="part")} AS target FROM many
UNION ALL SELECT {_PID.format(p="part")}, 'USES_STIMULUS', {_STIM} FROM many WHERE own
UNION ALL SELECT {_PID.format(p="part")}, 'DEPENDS_ON', {_PID.format(p="(part - 1)")} FROM many WHERE part > 1 AND {_m("body", P.DEPENDENCY)}
UNION ALL SELECT {_STIM}, 'USES_ARTIFACT', artifact FROM (SELECT DISTINCT {_T}, artifact FROM many JOIN every USING (doc, section, task))""",
    "task_reconstruction": _real(
        _ART
        + f""", own AS (SELECT {_T}, count(*) AS n, min(binding) AS bind, min(confidence) AS weakest FROM every GROUP BY ALL), comp AS (SELECT {_T} FROM parts GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT t.doc, t.section, t.task, round(least(t.confidence, coalesce(bind, 1), CASE WHEN c.doc IS NOT NULL THEN 0.84 ELSE 1 END), 3) AS confidence, weakest, coalesce(n, 0) AS n_artifacts FROM tasks t LEFT JOIN own USING (doc, section, task) LEFT JOIN comp c USING (doc, section, task))
SELECT {_T}, confidence, confidence < 0.78 OR coalesce(weakest < 0.65, false) AS review, n_artifacts FROM r""",
        "confidence",
    ),
}
