"""Queries on documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.functions import texts
from gleanery.operators import documents as D
from gleanery.plans.sheets import _kind, _mode
from gleanery.sources.tables import table

def _marker() -> Column:
    """Section markers of the driver's invented prose: lines of under 40 characters."""
    return F.length("line") < 40


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.content_status(table(spark, d, "documents").select("doc_id", "text"), [F.col("doc_id")]).select("doc_id", "sha", "status")


def mirror_rollup(spark: SparkSession, d: str) -> DataFrame:
    return D.mirrors(table(spark, d, "documents"), "doc_id", "source")


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.quality(F.col("text")).alias("q")).select("doc_id", "q.*")


def needs_ocr(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(table(spark, d, "documents"))
    chars = F.length(F.trim("line"))
    by = rows.groupBy("doc_id").agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("parts"), F.count_if(chars >= 20).alias("filled"))
    return by.withColumn("needs_ocr", F.col("chars") < F.greatest(F.lit(80), 20 * F.col("parts")))


def candidate_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = D.lines(table(spark, d, "documents"))
    c = texts.confidence(F.col("line"), F.lit(False), F.col("line").contains("|"), F.col("line").rlike(r"^\s*\d+[.)]"))
    return rows.select("doc_id", "pos", c.alias("c")).select("doc_id", "pos", F.round("c.score", 6).alias("score"), "c.status", "c.reasons")


def kind_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", P.kind(F.col("text")).alias("kind"))
    return rows.withColumn("mode", P.mode(F.col("kind")))


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return D.segments(D.lines(table(spark, d, "documents")), _marker(), "doc_id", "pos").select("doc_id", "pos", "segment")


def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = D.segments(D.lines(table(spark, d, "documents")), _marker(), "doc_id", "pos")
    return D.segment_summary(rows, "doc_id", "pos", "line")


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.repeated_lines(D.lines(table(spark, d, "documents")), "doc_id", "line")


def exchange_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = D.segments(table(spark, d, "conversations"), F.col("role") == "user", "conv_id", "turn")
    return rows.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("role") == "assistant").alias("answers"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    order = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return docs.withColumn("nth", F.row_number().over(order)).where("nth <= 10")


def item_range(spark: SparkSession, d: str) -> DataFrame:
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(numbers).alias("n")).where("n between 0 and 300")
    per = rows.groupBy("doc_id", "n").count().where("count <= 3")
    return per.groupBy("doc_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("observed"))


def evidence_contained(spark: SparkSession, d: str) -> DataFrame:
    """Whether the opening words of each turn come up in the next one, case aside."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 6).alias("evidence"), after.alias("stimulus"))
    return rows.select("conv_id", "turn", F.coalesce(F.contains(F.lower("stimulus"), F.lower("evidence")), F.lit(False)).alias("contained"))


QUERIES = {f.__name__: f for f in (content_dedup, mirror_rollup, text_quality, needs_ocr, candidate_confidence, kind_classify, line_segments, segment_rollup, repeated_lines, exchange_segments, stratified_sample, item_range, evidence_contained)}

_LINES = "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM s)"
_SEG = _LINES + ", g AS (SELECT *, sum(CAST(length(line) < 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM l)"
_BROKEN = r"regexp_matches({x}, '[�□]|\?{{3,}}')"
_CLEAN = r"trim(regexp_replace(regexp_replace({x}, '([A-Za-zА-Яа-яЁё])-\s*\n\s*([A-Za-zА-Яа-яЁё])', '\1\2', 'g'), '\s+', ' ', 'g'))"
_RULES = [("length(trim(line)) < 40", texts.SHORT, "very_short_text"), (_BROKEN.format(x="line"), texts.BAD, "broken_glyphs"), ("contains(line, '|')", texts.DRAWING, "vector_drawing"), (f"(regexp_matches(line, '{texts.FORMULA}') AND length(line) < 90)", texts.MATH, "formula_heavy"), (r"NOT regexp_matches(line, '^\s*\d+[.)]')", texts.UNNUMBERED, "task_boundary_uncertain")]
_SCORE = f"greatest(0.0, least(1.0, CAST({texts.START} AS DOUBLE)" + "".join(f" - CASE WHEN {c} THEN CAST({v} AS DOUBLE) ELSE 0 END" for c, v, _ in _RULES) + "))"
_REASONS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _RULES) + ")"

ORACLE_SQL = {
    "content_dedup": "SELECT doc_id, sha256(text) AS sha, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'DOWNLOADED' ELSE 'DUPLICATE' END AS status FROM documents",
    "mirror_rollup": "SELECT sha256(text) AS sha, count(*) AS observations, count(DISTINCT source) AS mirrors, min(doc_id) AS first_key FROM documents GROUP BY 1",
    "text_quality": f"SELECT doc_id, CAST(length(trim(text)) AS INT) AS chars, {_BROKEN.format(x='text')} AS suspicious, length(trim(text)) < 8 AS looks_empty FROM documents",
    "needs_ocr": _LINES + " SELECT doc_id, CAST(sum(length(trim(line))) AS BIGINT) AS chars, count(*) AS parts, count(*) FILTER (length(trim(line)) >= 20) AS filled, sum(length(trim(line))) < greatest(80, 20 * count(*)) AS needs_ocr FROM l GROUP BY doc_id",
    "candidate_confidence": _LINES + f" SELECT doc_id, CAST(pos AS INT) AS pos, round(score, 6) AS score, CASE WHEN score >= 0.90 THEN 'accepted' WHEN score >= 0.65 THEN 'needs_llm' ELSE 'needs_human' END AS status, CASE WHEN reasons = '' THEN 'clean_text' ELSE reasons END AS reasons FROM (SELECT doc_id, pos, {_SCORE} AS score, {_REASONS} AS reasons FROM l)",
    "kind_classify": f"SELECT *, {_mode("kind")} AS mode FROM (SELECT conv_id, turn, {_kind(_CLEAN.format(x="text"))} AS kind FROM conversations)",
    "line_segments": _SEG + " SELECT doc_id, CAST(pos AS INT) AS pos, CAST(segment AS BIGINT) AS segment FROM g",
    "segment_rollup": _SEG + " SELECT doc_id, CAST(segment AS BIGINT) AS segment, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos, count(*) AS n_rows, CAST(sum(length(line)) AS BIGINT) AS n_chars, arg_min(line, pos) AS head FROM g GROUP BY doc_id, segment",
    "repeated_lines": _LINES + r" SELECT lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS norm, count(DISTINCT doc_id) AS n_keys, count(*) AS n_rows FROM l WHERE length(trim(regexp_replace(line, '\s+', ' ', 'g'))) >= 4 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2",
    "exchange_segments": "WITH g AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations) SELECT conv_id, CAST(segment AS BIGINT) AS segment, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (role = 'assistant') AS answers FROM g GROUP BY conv_id, segment",
    "stratified_sample": "SELECT doc_id, lang, CAST(nth AS INT) AS nth FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM documents) WHERE nth <= 10",
    "item_range": r"WITH n AS (SELECT doc_id, TRY_CAST(unnest(regexp_extract_all(text, '(\d+)', 1)) AS INT) AS n FROM documents), p AS (SELECT doc_id, n, count(*) AS c FROM n WHERE n BETWEEN 0 AND 300 GROUP BY ALL) SELECT doc_id, min(n) AS lo, max(n) AS hi, count(*) AS observed FROM p WHERE c <= 3 GROUP BY doc_id",
    "evidence_contained": "SELECT conv_id, turn, coalesce(contains(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), lower(text[1:6])), false) AS contained FROM conversations",
}
