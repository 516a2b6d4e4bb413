"""Queries on shards, queues and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources import exports as X
from gleanery.sources.tables import table


def shard_places(spark: SparkSession, d: str) -> DataFrame:
    rows = X.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return rows.select("o_orderkey", F.floor(F.col("nth") / 100).alias("shard"), "nth")


def shard_changes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1000 == 7, "X").otherwise(F.col("o_orderstatus")))
    return X.shard_changes(X.shard_digests(o, "o_orderkey"), X.shard_digests(new, "o_orderkey"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("needs_llm").alias("status"))
    return X.review_queue(tasks, table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", "status", prompt="v1")


def annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.max("props").alias("props"))
    return e.select("user_id", X.csv_lines(e, "user_id", "types", "props").alias("line"))


def event_envelopes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select("l_orderkey", (F.col("l_linenumber") + F.col("l_partkey") * 10).alias("id"), "l_suppkey")
    got = X.envelopes(rows.distinct(), "l_orderkey", "id", schema="v1")
    return got.select("l_orderkey", F.get_json_object("envelope", "$.n").cast("long").alias("n"), F.get_json_object("envelope", "$.records[0].id").cast("long").alias("first"), F.get_json_object("envelope", "$.schema").alias("schema"))


def word_forms(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.lower("p_brand").alias("lemma"), F.split("p_name", " ").alias("forms"), F.col("p_partkey").alias("nth"))
    return X.word_forms(part)


QUERIES = {f.__name__: f for f in (shard_places, shard_changes, review_queue, annotation_lines, event_envelopes, word_forms)}

ORACLE_SQL = {
    "shard_places": "SELECT o_orderkey, nth // 100 AS shard, nth FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS nth FROM orders)",
    "shard_changes": "WITH s AS (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS INT) AS shard FROM orders) SELECT shard, CASE WHEN bool_or(o_orderkey % 1000 = 7) THEN 'changed' ELSE 'same' END AS change FROM s GROUP BY shard",
    "review_queue": "SELECT doc_id, 'needs_llm' AS status, lang, source, 'v1' AS prompt FROM labels JOIN documents USING (doc_id) WHERE quality <> 1",
    "annotation_lines": """SELECT user_id, user_id || ',' || array_to_string(list_sort(list(DISTINCT event_type)), '|') || ',"' || replace(max(props), '"', '""') || '"' AS line FROM events GROUP BY user_id""",
    "event_envelopes": "SELECT l_orderkey, count(*) AS n, min(id) AS first, 'v1' AS schema FROM (SELECT DISTINCT l_orderkey, l_linenumber + l_partkey * 10 AS id, l_suppkey FROM lineitem) GROUP BY l_orderkey",
    "word_forms": "WITH f AS (SELECT lower(p_brand) AS lemma, p_partkey AS nth, unnest(list_distinct(list_concat([lower(p_brand)], string_split(p_name, ' ')))) AS form FROM part) SELECT form, arg_max(lemma, nth) AS lemma, max(nth) AS nth FROM f GROUP BY form",
}
