"""Queries on answers (out of `events`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import learner as L
from gleanery.sources.tables import table

NOW = "timestamp'2024-01-31 00:00:00'"
LAST_DAY = "date'2024-01-30'"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return L.from_events(table(spark, d, "events"))


def _weights(spark: SparkSession) -> DataFrame:
    """Unit u of 10 weighs (u + 1) / 55; unit 9 none."""
    return spark.range(10).select(F.col("id").cast("int").alias("unit"), F.when(F.col("id") < 9, (F.col("id") + 1) / 55.0).otherwise(0.0).alias("weight"))


def evidence_counters(spark: SparkSession, d: str) -> DataFrame:
    return L.evidence(_answers(spark, d)).select("learner", "unit", "attempts", "n_correct", "mistakes", "interval_days", F.round("mastery", 9).alias("mastery"))


def mastery_state(spark: SparkSession, d: str) -> DataFrame:
    ev = L.evidence(_answers(spark, d))
    return ev.select("learner", "unit", L.state(F.col("attempts"), F.col("mastery")).alias("state"))


def due_reviews(spark: SparkSession, d: str) -> DataFrame:
    ev = L.evidence(_answers(spark, d))
    return ev.where(F.col("next_review") <= F.expr(NOW)).select("learner", "unit", "interval_days", F.col("next_review").cast("timestamp_ntz").alias("next_review"))


def combo_runs(spark: SparkSession, d: str) -> DataFrame:
    return L.combos(_answers(spark, d)).select("event_id", "learner", "combo", "best_combo", "xp_gain", "xp", F.floor(1 + F.col("xp") / L.LEVEL_XP).cast("int").alias("level"))


def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    return L.daily(_answers(spark, d)).withColumn("day", F.col("day").cast("string"))


def learner_activity(spark: SparkSession, d: str) -> DataFrame:
    """Purchases stand for completed sessions; every third k gives crystals, some take them away."""
    answers = _answers(spark, d)
    k = F.col("unit")
    rows = L.combos(answers).where(F.col("event_id") % 11 > 0).select("learner", "ts", "event_id", "correct", F.col("xp_gain").alias("xp"), (k % 3 - 1).alias("crystals"), F.col("combo").cast("long").alias("combo"), F.concat(F.lit("p"), k % 4).alias("pack"))
    sessions = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("learner"), F.col("ts").cast("timestamp").alias("ts"))
    return L.activity(rows, sessions).withColumn("day", F.col("day").cast("string"))


def recent_days_filled(spark: SparkSession, d: str) -> DataFrame:
    return L.filled_days(L.daily(_answers(spark, d)), F.expr(LAST_DAY)).select("learner", F.col("day").cast("string").alias("day"), "answered", "n_correct", "xp", "best_combo")


def month_summary(spark: SparkSession, d: str) -> DataFrame:
    days = L.daily(_answers(spark, d))
    return days.groupBy("learner", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("answered").alias("answered"), F.sum("n_correct").alias("n_correct"), F.count(F.lit(1)).alias("active_days"), F.max("best_combo").alias("best_combo"))


def duration_buckets(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    bucket = F.when(v < 5, "under_5s").when(v < 15, "under_15s").when(v < 45, "under_45s").otherwise("over_45s")
    return _answers(spark, d).groupBy(bucket.alias("bucket"), "correct").count()


def ledger_fold(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    delta = F.when(F.col("event_type") == "purchase", -k).otherwise(k % 7)
    entries = table(spark, d, "events").select(F.col("user_id").alias("learner"), "ts", "event_id", delta.cast("long").alias("delta"))
    return L.ledger(entries)


def readiness(spark: SparkSession, d: str) -> DataFrame:
    got = L.readiness(L.evidence(_answers(spark, d)), _weights(spark), F.expr(NOW))
    return got.withColumn("weakest", F.array_join(F.col("weakest").cast("array<string>"), ","))


def adaptive_rank(spark: SparkSession, d: str) -> DataFrame:
    """Question u asks unit u, which needs the two units before it."""
    q = spark.range(10).select(F.col("id").alias("question"), F.col("id").cast("int").alias("unit"), F.filter(F.array((F.col("id") - 1).cast("int"), (F.col("id") - 2).cast("int")), lambda x: x >= 0).alias("prerequisites"))
    return L.adaptive_rank(q, L.evidence(_answers(spark, d)), _weights(spark), F.expr(NOW))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).groupBy("learner", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("learner", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


QUERIES = {f.__name__: f for f in (evidence_counters, mastery_state, due_reviews, combo_runs, daily_activity, learner_activity, recent_days_filled, month_summary, duration_buckets, ledger_fold, readiness, adaptive_rank, session_windows)}

_A = "WITH RECURSIVE a AS (SELECT user_id AS learner, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS unit, event_type <> 'error' AS correct, ts, event_id, value FROM events)"
_EV = (
    _A
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY learner, unit ORDER BY ts, event_id) AS n FROM a),
f AS (SELECT learner, unit, n, CASE WHEN correct THEN 0 ELSE 2 END AS mistakes, CASE WHEN correct THEN 1 ELSE 0 END AS interval_days FROM s WHERE n = 1
  UNION ALL SELECT s.learner, s.unit, s.n, CASE WHEN s.correct THEN greatest(0, f.mistakes - 1) ELSE least(8, f.mistakes + 2) END,
    CASE WHEN NOT s.correct THEN 0 WHEN f.interval_days < 1 THEN 1 WHEN f.interval_days < 3 THEN 3 WHEN f.interval_days < 7 THEN 7 WHEN f.interval_days < 14 THEN 14 ELSE 30 END
  FROM f JOIN s ON s.learner = f.learner AND s.unit = f.unit AND s.n = f.n + 1),
g AS (SELECT learner, unit, count(*) AS attempts, count(*) FILTER (correct) AS n_correct, max(ts) AS last_seen FROM a GROUP BY ALL),
ev AS (SELECT g.*, mistakes, interval_days, (n_correct + 1.0::DOUBLE) / (attempts + 2.0::DOUBLE) AS mastery, last_seen + CASE WHEN interval_days > 0 THEN to_hours(interval_days * 24) ELSE to_hours(6) END AS next_review FROM g JOIN f ON f.learner = g.learner AND f.unit = g.unit AND f.n = g.attempts)"""
)
_C = (
    _A
    + """, i AS (SELECT *, sum(CAST(NOT correct AS INT)) OVER (PARTITION BY learner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM a),
c AS (SELECT *, CASE WHEN correct THEN CAST(sum(CAST(correct AS INT)) OVER (PARTITION BY learner, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) ELSE 0 END AS combo FROM i),
x AS (SELECT *, CASE WHEN correct THEN 10 + 2 * least(combo, 10) ELSE 2 END AS xp_gain FROM c),
combos AS (SELECT *, max(combo) OVER (PARTITION BY learner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best_combo, CAST(sum(xp_gain) OVER (PARTITION BY learner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS xp FROM x),
days AS (SELECT learner, CAST(ts AS DATE) AS day, count(*) AS answered, count(*) FILTER (correct) AS n_correct, CAST(sum(xp_gain) AS BIGINT) AS xp, CAST(max(combo) AS BIGINT) AS best_combo FROM combos GROUP BY ALL)"""
)
_W = ", w AS (SELECT CAST(u AS INT) AS unit, CASE WHEN u < 9 THEN (u + 1) / 55.0::DOUBLE ELSE 0.0 END AS weight FROM range(10) t(u))"
ORACLE_SQL = {
    "evidence_counters": _EV + " SELECT learner, unit, attempts, n_correct, mistakes, interval_days, round(mastery, 9) AS mastery FROM ev",
    "mastery_state": _EV + " SELECT learner, unit, CASE WHEN attempts = 0 THEN 'UNSEEN' WHEN attempts < 3 THEN 'NEW' WHEN mastery < 0.55 THEN 'WEAK' WHEN mastery < 0.76 THEN 'GROWING' ELSE 'CONFIDENT' END AS state FROM ev",
    "due_reviews": _EV + f" SELECT learner, unit, interval_days, next_review FROM ev WHERE next_review <= {NOW.replace('timestamp', 'TIMESTAMP ')}",
    "combo_runs": _C + " SELECT event_id, learner, CAST(combo AS BIGINT) AS combo, CAST(best_combo AS BIGINT) AS best_combo, CAST(xp_gain AS BIGINT) AS xp_gain, xp, CAST(1 + xp // 350 AS INT) AS level FROM combos",
    "daily_activity": _C + " SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM days",
    "learner_activity": _C
    + """, r AS (SELECT *, CAST(ts AS DATE) AS day, 'p' || (unit % 4) AS pack FROM combos WHERE event_id % 11 > 0), w AS (SELECT learner, day, count(*) AS answered, count(*) FILTER (correct) AS n_correct, CAST(sum(xp_gain) AS BIGINT) AS xp, CAST(sum(greatest(unit % 3 - 1, 0)) AS BIGINT) AS crystals, CAST(max(combo) AS BIGINT) AS best_combo, arg_max(pack, (ts, event_id)) AS last_pack FROM r GROUP BY ALL),
z AS (SELECT user_id AS learner, CAST(ts AS DATE) AS day, count(*) AS sessions FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT learner, CAST(day AS VARCHAR) AS day, coalesce(answered, 0) AS answered, coalesce(n_correct, 0) AS n_correct, coalesce(xp, 0) AS xp, coalesce(crystals, 0) AS crystals, coalesce(best_combo, 0) AS best_combo, last_pack, coalesce(sessions, 0) AS sessions FROM w FULL JOIN z USING (learner, day)""",
    "recent_days_filled": _C + ", g AS (SELECT learner, CAST(day AS DATE) AS day FROM (SELECT DISTINCT learner FROM days), range(DATE '2024-01-24', DATE '2024-01-31', INTERVAL 1 DAY) t(day)) SELECT learner, CAST(day AS VARCHAR) AS day, coalesce(answered, 0) AS answered, coalesce(n_correct, 0) AS n_correct, coalesce(xp, 0) AS xp, coalesce(best_combo, 0) AS best_combo FROM g LEFT JOIN days USING (learner, day)",
    "month_summary": _C + " SELECT learner, strftime(day, '%Y-%m') AS month, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(n_correct) AS BIGINT) AS n_correct, count(*) AS active_days, max(best_combo) AS best_combo FROM days GROUP BY ALL",
    "duration_buckets": _A + " SELECT CASE WHEN value < 5 THEN 'under_5s' WHEN value < 15 THEN 'under_15s' WHEN value < 45 THEN 'under_45s' ELSE 'over_45s' END AS bucket, correct, count(*) AS count FROM a GROUP BY ALL",
    "ledger_fold": """WITH RECURSIVE e AS (SELECT user_id AS learner, event_id, CASE WHEN event_type = 'purchase' THEN -CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT learner, event_id, delta, n, delta >= 0 AS accepted, greatest(delta, 0) AS balance FROM e WHERE n = 1
  UNION ALL SELECT e.learner, e.event_id, e.delta, e.n, f.balance + e.delta >= 0, CASE WHEN f.balance + e.delta >= 0 THEN f.balance + e.delta ELSE f.balance END FROM f JOIN e ON e.learner = f.learner AND e.n = f.n + 1)
SELECT learner, event_id, delta, accepted, balance FROM f""",
    "readiness": _EV + _W + f""", r AS (SELECT l.learner, w.unit, w.weight, least(1.0, coalesce(attempts, 0) / 5.0::DOUBLE) AS sure, CASE WHEN coalesce(attempts, 0) = 0 THEN 0.5 ELSE mastery END AS m, coalesce(attempts, 0) > 0 AND next_review <= {NOW.replace('timestamp', 'TIMESTAMP ')} AS due FROM (SELECT DISTINCT learner FROM ev) l CROSS JOIN w LEFT JOIN ev ON ev.learner = l.learner AND ev.unit = w.unit WHERE w.weight > 0),
t AS (SELECT *, CASE WHEN due THEN greatest(0.0, m * sure + 0.35 * (1 - sure) - 0.05) ELSE m * sure + 0.35 * (1 - sure) END AS est FROM r)
SELECT learner, CAST(floor(100 * greatest(0.0, least(1.0, sum(weight * est) / sum(weight))) + 0.5) AS INT) AS readiness, CAST(floor(100 * greatest(0.0, least(1.0, sum(weight * sure) / sum(weight))) + 0.5) AS INT) AS confidence, array_to_string(list(unit ORDER BY round(est, 9), unit)[1:3], ',') AS weakest FROM t GROUP BY learner""",
    "adaptive_rank": _EV + _W + f""", p AS (SELECT l.learner, u AS question, CAST(u AS INT) AS unit FROM (SELECT DISTINCT learner FROM ev) l, range(10) t(u)),
b AS (SELECT p.learner, p.question, avg(greatest(0.0, 0.65 - coalesce(mastery, 0.5))) AS blocked FROM p, range(1, 3) k(k) LEFT JOIN ev ON ev.learner = p.learner AND ev.unit = p.unit - k WHERE p.unit - k >= 0 GROUP BY ALL)
SELECT p.learner, p.question, round(coalesce(mastery, 0.5) - 0.08 * least(coalesce(mistakes, 0), 4) + 1.5 * coalesce(blocked, 0) - CASE WHEN next_review <= {NOW.replace('timestamp', 'TIMESTAMP ')} THEN 0.22 ELSE 0 END - 0.25 * weight, 9) AS priority
FROM p LEFT JOIN ev ON ev.learner = p.learner AND ev.unit = p.unit LEFT JOIN b ON b.learner = p.learner AND b.question = p.question JOIN w ON w.unit = p.unit""",
    "session_windows": _A + ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY learner ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM a), s AS (SELECT *, sum(fresh) OVER (PARTITION BY learner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT learner, min(ts) AS started, count(*) AS n FROM s GROUP BY learner, k",
}
