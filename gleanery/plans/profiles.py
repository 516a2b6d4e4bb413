"""Queries on file-name profiles, spoken reasoning and bundles. Names, transcripts and assets are built from columns, so SQL knows the results from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import filenames as N
from gleanery.functions import reasoning as R
from gleanery.operators import bundles as B
from gleanery.sources.tables import table

PREFIXES = ["tasks-", "ans-", "script-", "criteria-", "sol-", "x-"]
CODES = ["engl", "russ", "math", "geog", "phys", "none"]
GRADES, TOURS, STAGES, REGIONS = ["9-11", "7", "x"], ["pism", "ustn", "teor", "zz"], ["mun", "reg", "fin"], ["lenobl", "omsk", "spb", "zz9"]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = [_pick(CODES, F.floor(k / 6)), _pick(GRADES, k), _pick(TOURS, k), _pick(STAGES, s), _pick(REGIONS, s), two(s % 30), two(s % 30 + 1)]
    name = F.concat(_pick(PREFIXES, k), F.concat_ws("-", *parts), F.when(s % 7 == 0, ".doc").otherwise(".pdf"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


def file_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d).withColumn("profile", N.profile(F.col("name")))
    of = lambda k, part: F.col(f"profile.{k}.{part}")
    return rows.select(
        "p_partkey",
        "name",
        *[of(k, "value").alias(k) for k in N.SURE],
        F.concat_ws("|", *[of(k, "confidence").cast("string") for k in N.SURE]).alias("confidences"),
        F.regexp_extract(of("stage", "evidence.snippet"), 'token "(.*)"', 1).alias("stage_sign"),
        F.concat_ws(",", N.doubtful(F.col("profile"))).alias("doubtful"),
    )


RUBRICS = {"ratio": R.Rubric("10", [[{"15/3=5"}, {"5*2=10", "2*5=10"}], [{"15*2/3=10", "15/3*2=10"}]])}


def reasoning_outcomes(spark: SparkSession, d: str) -> DataFrame:
    a, b, n = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_partkey") % 9
    said = [
        (0, F.lit("  ")),
        (1, F.concat(a, F.lit(" times "), b, F.lit(" equals "), a * b)),
        (2, F.concat(F.lit("10 / 5 = 2, "), a, F.lit(" * "), b, F.lit(" = "), a * b + 1)),
        (3, F.lit("Fifteen divided by three is equal to five, пять умножить на два равно десять")),
        (4, F.lit("The answer is 10.")),
        (5, F.concat(F.lit("some rule of "), a)),
        (6, F.concat(F.lit("15 × 2 ÷ 3 = 10 and "), a, F.lit(" / 0 = 0"))),
        (7, F.concat(F.lit("15 / 3 * 2 ＝ 10; "), a, F.lit(" * 2 / 2 = "), a)),
    ]
    text = F.lit("15 / 3 = 5")
    for k, t in said:
        text = F.when(n == k, t).otherwise(text)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 4 == 0, "mix").otherwise("ratio").alias("question"), (F.col("l_returnflag") != "R").alias("correct"), text.alias("text"))
    got = R.assess(F.col("question"), F.col("correct"), F.col("text"), RUBRICS)
    return rows.withColumn("a", got).select("l_orderkey", "l_linenumber", "text", "a.status", F.size("a.evidence").cast("long").alias("evidence"), F.concat_ws(";", "a.contradictions").alias("contradictions"))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    role = _pick(["TASK_SET", "ANSWER_KEY", "LISTENING_SCRIPT", "CRITERIA", "TASK_SET", ""], F.floor(k / 2))
    audio = F.when(k % 7 == 0, F.concat(F.lit("rec"), k))
    return table(spark, d, "part").select(k.alias("asset"), F.concat(F.lit("set"), s, F.lit("-"), k % 5).alias("bundle"), role.alias("role"), audio.alias("audio"))


def bundle_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.edges(_assets(spark, d))


def bundle_exceptions(spark: SparkSession, d: str) -> DataFrame:
    assets = _assets(spark, d)
    k = F.col("asset")
    section = F.when(k % 4 == 0, "Listening A").otherwise("Reading")
    labels = assets.select(k.alias("doc"), section.alias("section"), F.explode(F.array(F.lit("Task 1"), F.when(k % 5 == 2, " task 1 ").otherwise("Task 2"), F.lit(""))).alias("task"))
    # a review has added a second scoring edge to bundles of odd sizes
    edges = B.edges(assets)
    more = edges.where("kind = 'SCORED_BY'").join(assets.where("asset % 2 = 1").select("bundle").distinct(), "bundle", "left_semi")
    return B.exceptions(assets.select(k.alias("doc"), "bundle"), B.flags(assets), labels, B.shared_criteria(edges.unionByName(more)))


QUERIES = {f.__name__: f for f in (file_profiles, reasoning_outcomes, bundle_edges, bundle_exceptions)}


def _at(values: list[str], at: str) -> str:
    return f"[{', '.join(f'{v!r}' for v in values)}][({at}) % {len(values)} + 1]"


_PART = f"""
WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey // 6 AS c FROM part),
n AS (SELECT *, {_at(PREFIXES, "k")} || {_at(CODES, "c")} || '-' || {_at(GRADES, "k")} || '-' || {_at(TOURS, "k")} || '-' || {_at(STAGES, "s")} || '-' || {_at(REGIONS, "s")} || '-' || lpad(CAST(s % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(s % 30 + 1 AS VARCHAR), 2, '0') AS base, s % 7 <> 0 AS pdf FROM p),
v AS (SELECT *, base || CASE WHEN pdf THEN '.pdf' ELSE '.doc' END AS name, {_at(["TASK_SET", "ANSWER_KEY", "LISTENING_SCRIPT", "CRITERIA", "ANSWER_KEY", "OTHER"], "k")} AS role, {_at([N.SUBJECTS.get(c, "OTHER") for c in CODES], "c")} AS subject,
  CASE WHEN pdf THEN '20' || lpad(CAST(s % 30 AS VARCHAR), 2, '0') || '/' || lpad(CAST(s % 30 + 1 AS VARCHAR), 2, '0') ELSE 'UNKNOWN' END AS academic_year, CASE WHEN c % 6 < 5 AND k % 3 < 2 THEN {_at(["9-11", "7", ""], "k")} ELSE 'UNKNOWN' END AS grades,
  {_at(["MUNICIPAL", "REGIONAL", "UNKNOWN"], "s")} AS stage, {_at(["WRITTEN", "ORAL", "WRITTEN", "UNKNOWN"], "k")} AS tour, CASE WHEN pdf AND s % 3 < 2 THEN {_at([N.REGIONS["lenobl"], N.REGIONS["omsk"], N.REGIONS["spb"], "ZZ9"], "s")} ELSE 'UNKNOWN' END AS region FROM n),
f AS (SELECT *, CASE WHEN subject = '{N.SUBJECTS[CODES[0]]}' THEN 'UNKNOWN' ELSE 'RU' END AS language, 'VSOSh' AS competition, regexp_replace(base, '^(tasks|ans|script|criteria)-', '') AS problemset,
  CASE WHEN subject = 'OTHER' THEN '0.45' ELSE '0.99' END AS s1, CASE WHEN subject = '{N.SUBJECTS[CODES[0]]}' THEN '0.35' ELSE '0.78' END AS s2, CASE WHEN academic_year = 'UNKNOWN' THEN '0.45' ELSE '0.98' END AS s3, CASE WHEN grades = 'UNKNOWN' THEN '0.45' ELSE '0.98' END AS s4,
  CASE WHEN stage = 'UNKNOWN' THEN '0.55' ELSE '0.97' END AS s6, CASE WHEN tour = 'UNKNOWN' THEN '0.55' ELSE '0.94' END AS s7, CASE WHEN region = 'UNKNOWN' THEN '0.52' ELSE '0.88' END AS s8 FROM v)
"""
_STATED = """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, l_linenumber AS b, l_partkey % 9 AS n, l_suppkey % 4 > 0 AS known, l_returnflag <> 'R' AS correct FROM lineitem),
t AS (SELECT *, CASE n WHEN 0 THEN '  ' WHEN 1 THEN a || ' times ' || b || ' equals ' || (a * b) WHEN 2 THEN '10 / 5 = 2, ' || a || ' * ' || b || ' = ' || (a * b + 1) WHEN 3 THEN 'Fifteen divided by three is equal to five, пять умножить на два равно десять' WHEN 4 THEN 'The answer is 10.' WHEN 5 THEN 'some rule of ' || a
  WHEN 6 THEN '15 × 2 ÷ 3 = 10 and ' || a || ' / 0 = 0' WHEN 7 THEN '15 / 3 * 2 ＝ 10; ' || a || ' * 2 / 2 = ' || a ELSE '15 / 3 = 5' END AS text FROM l)
SELECT l_orderkey, l_linenumber, text,
  CASE WHEN n = 0 OR (known AND n = 4) THEN CASE WHEN correct THEN 'correct_unsubstantiated' ELSE 'incomplete' END WHEN NOT known OR n = 5 THEN 'uncertain_semantics' WHEN n IN (2, 6) THEN 'incorrect_reasoning' WHEN n IN (3, 7) THEN 'correct_supported' ELSE 'incomplete' END AS status,
  CASE WHEN NOT known OR n IN (0, 4, 5) THEN 0 WHEN n IN (3, 7) THEN 2 ELSE 1 END AS evidence,
  CASE WHEN NOT known THEN '' WHEN n = 2 THEN a || ' * ' || b || ' = ' || (a * b + 1) WHEN n = 6 THEN a || ' / 0 = 0' ELSE '' END AS contradictions FROM t
"""
_BUNDLES = f"""
WITH a AS (SELECT p_partkey AS asset, 'set' || p_size || '-' || (p_partkey % 5) AS bundle, {_at(["TASK_SET", "ANSWER_KEY", "LISTENING_SCRIPT", "CRITERIA", "TASK_SET", ""], "p_partkey // 2")} AS role, CASE WHEN p_partkey % 7 = 0 THEN 'rec' || p_partkey END AS audio FROM part),
f AS (SELECT bundle, count(DISTINCT asset) AS files, arg_min(audio, asset) FILTER (WHERE audio IS NOT NULL) AS media, bool_or(role = 'TASK_SET') AS t, bool_or(role = 'ANSWER_KEY') AS w, bool_or(role = 'CRITERIA') AS c, bool_or(role = 'LISTENING_SCRIPT') AS s, count(audio) > 0 AS h FROM a GROUP BY bundle)
"""
_SET, _MEDIA = "'problemset_' || sha1(bundle)[1:20]", "'media_' || sha1(media)[1:20]"

ORACLE_SQL = {
    "file_profiles": _PART
    + f"""SELECT k AS p_partkey, name, {", ".join(N.SURE)}, concat_ws('|', '0.99', s1, s2, s3, s4, '0.72', s6, s7, s8, '0.91') AS confidences, CASE WHEN s % 3 < 2 THEN {_at(STAGES, "s")} ELSE '' END AS stage_sign,
  concat_ws(',', CASE WHEN s1 < '0.6' THEN 'subject' END, CASE WHEN s2 < '0.6' THEN 'language' END, CASE WHEN s3 < '0.6' THEN 'academic_year' END, CASE WHEN s4 < '0.6' THEN 'grades' END, CASE WHEN s6 < '0.6' THEN 'stage' END, CASE WHEN s7 < '0.6' THEN 'tour' END, CASE WHEN s8 < '0.6' THEN 'region' END) AS doubtful FROM f""",
    "reasoning_outcomes": _STATED,
    "bundle_edges": _BUNDLES
    + f"""SELECT bundle, {_SET} AS source, 'CONTAINS_ASSET' AS kind, 'asset_' || sha1(CAST(asset AS VARCHAR))[1:20] AS target, CAST(CASE WHEN files > 1 THEN 0.96 ELSE 0.78 END AS DOUBLE) AS confidence, 'bundle_key' AS method FROM (SELECT DISTINCT bundle, asset FROM a) JOIN f USING (bundle)
UNION ALL SELECT bundle, {_SET}, 'CONTAINS_MEDIA', {_MEDIA}, 0.99::DOUBLE, 'source_filename_contract' FROM f WHERE h
UNION ALL SELECT bundle, 'Task set', 'HAS_ANSWER', 'Answer set', 0.94::DOUBLE, 'problemset_structure' FROM f WHERE t AND w
UNION ALL SELECT bundle, 'Writing', 'SCORED_BY', 'Criterion rubric', 0.88::DOUBLE, 'problemset_structure' FROM f WHERE t AND c
UNION ALL SELECT bundle, 'Listening', 'USES_TRANSCRIPT', 'Transcript', 0.91::DOUBLE, 'problemset_structure' FROM f WHERE t AND s
UNION ALL SELECT bundle, 'Listening', 'USES_AUDIO', {_MEDIA}, 0.99::DOUBLE, 'problemset_media_link' FROM f WHERE t AND h""",
    "bundle_exceptions": _BUNDLES
    + """, sh AS (SELECT DISTINCT bundle FROM a JOIN f USING (bundle) WHERE t AND c AND asset % 2 = 1), d AS (SELECT asset AS doc, f.*, asset % 4 = 0 AS listening, asset % 5 = 2 AS twice, f.bundle IN (SELECT bundle FROM sh) AS shared FROM a JOIN f USING (bundle))
SELECT doc, CAST(nth AS INT) AS nth, exception, CASE WHEN nth = 7 THEN 'task 1' ELSE '' END AS detail FROM (
  SELECT doc, 1 AS nth, 'task_without_answer' AS exception FROM d WHERE t AND NOT w UNION ALL SELECT doc, 2, 'answer_without_task' FROM d WHERE w AND NOT t UNION ALL SELECT doc, 3, 'script_without_task' FROM d WHERE s AND NOT t
  UNION ALL SELECT doc, 4, 'listening_without_audio' FROM d WHERE listening AND NOT h UNION ALL SELECT doc, 5, 'audio_without_task' FROM d WHERE h AND NOT t UNION ALL SELECT doc, 6, 'incomplete_bundle' FROM d WHERE files = 1 AND NOT h
  UNION ALL SELECT doc, 7, 'ambiguous_numbering' FROM d WHERE twice UNION ALL SELECT doc, 8, 'criterion_of_several_tasks' FROM d WHERE shared)""",
}
