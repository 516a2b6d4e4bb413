"""Constraint queries over the driver tables, and standard forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators import quality as Q
from gleanery.sources.tables import table


def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    return Q.unique(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha")), ["sha"])


def dq_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    return Q.foreign_key(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id").select("doc_id")


def dq_enum(spark: SparkSession, d: str) -> DataFrame:
    return Q.allowed(table(spark, d, "events"), "event_type", ["click", "view", "error"]).groupBy("event_type").count()


def dq_range(spark: SparkSession, d: str) -> DataFrame:
    return Q.within(table(spark, d, "lineitem"), "l_discount", 0.0, 0.08).select("l_orderkey", "l_linenumber", "l_discount")


def dq_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.lit(0.25).alias("w"))
    return Q.weight_sums(rows, ["l_orderkey"], "w")


def dq_one_owner(spark: SparkSession, d: str) -> DataFrame:
    return Q.one_owner(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), "source"), "sha", "source")


def dq_implies(spark: SparkSession, d: str) -> DataFrame:
    return Q.implies(table(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000).select("o_orderkey")


def dq_distribution(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([("A", 1000), ("N", 1000), ("X", 5)], "value string, n long")
    return Q.distribution(table(spark, d, "lineitem"), "l_returnflag", want)


def prerequisite_closure(spark: SparkSession, d: str) -> DataFrame:
    """Customer c comes after customer c div 3: a tree of a few levels."""
    c = table(spark, d, "customer").where("c_custkey > 0").select("c_custkey", F.floor(F.col("c_custkey") / 3).alias("before"))
    return Q.closure(c, "c_custkey", "before")


def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in rings of four, and chains."""
    s = F.col("s_suppkey")
    nxt = F.when(s < 40, F.when(s % 4 == 3, s - 3).otherwise(s + 1)).otherwise(s - 1)
    return Q.on_cycle(table(spark, d, "supplier").select("s_suppkey", nxt.alias("next")), "s_suppkey", "next")


def setops(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    early, late = o.where("o_orderdate < '1997-01-01'").select("o_custkey"), o.where("o_orderdate >= '1997-01-01'").select("o_custkey")
    both, lost = early.intersect(late).withColumn("kind", F.lit("both")), early.subtract(late).withColumn("kind", F.lit("early only"))
    return both.unionByName(lost).groupBy("kind").count()


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(net), 2).alias("net"))


def top_customers(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    spent = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = spent.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("n_name").orderBy(F.desc("spent"), "c_custkey"))).where("place <= 3").select("n_name", "place", "c_custkey", "spent")


QUERIES = {f.__name__: f for f in (dq_unique, dq_foreign_key, dq_enum, dq_range, dq_weights, dq_one_owner, dq_implies, dq_distribution, prerequisite_closure, cycle_check, setops, pricing_summary, top_customers)}
ORACLE_SQL = {
    "dq_unique": "SELECT sha256(text) AS sha, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1",
    "dq_foreign_key": "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "dq_enum": "SELECT event_type, count(*) AS count FROM events WHERE event_type NOT IN ('click', 'view', 'error') GROUP BY 1",
    "dq_range": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT l_discount BETWEEN 0.0 AND 0.08",
    "dq_weights": "SELECT l_orderkey, sum(0.25::DOUBLE) AS total FROM lineitem GROUP BY 1 HAVING abs(sum(0.25::DOUBLE) - 1) > 1e-6",
    "dq_one_owner": "SELECT sha256(text) AS sha, count(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "dq_implies": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 100000",
    "dq_distribution": "WITH g AS (SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1), w(value, wanted) AS (VALUES ('A', 1000), ('N', 1000), ('X', 5)) SELECT coalesce(g.value, w.value) AS value, coalesce(n, 0) AS n, CAST(coalesce(wanted, 0) AS BIGINT) AS wanted FROM g FULL JOIN w ON g.value = w.value WHERE coalesce(n, 0) <> coalesce(wanted, 0)",
    "prerequisite_closure": "WITH RECURSIVE e AS (SELECT c_custkey AS node, c_custkey // 3 AS ancestor FROM customer WHERE c_custkey > 0), r AS (SELECT * FROM e UNION SELECT r.node, e.ancestor FROM r JOIN e ON e.node = r.ancestor) SELECT node, ancestor FROM r",
    "cycle_check": "WITH RECURSIVE e AS (SELECT s_suppkey AS a, CASE WHEN s_suppkey < 40 THEN CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey - 3 ELSE s_suppkey + 1 END ELSE s_suppkey - 1 END AS b FROM supplier), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node FROM r WHERE a = b",
    "setops": "WITH e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1997-01-01'), l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1997-01-01') SELECT CASE WHEN o_custkey IN (SELECT o_custkey FROM l) THEN 'both' ELSE 'early only' END AS kind, count(*) AS count FROM e GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY ALL",
    "top_customers": "WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) SELECT n_name, CAST(place AS INT) AS place, c_custkey, spent FROM (SELECT n_name, c_custkey, spent, row_number() OVER (PARTITION BY n_name ORDER BY spent DESC, c_custkey) AS place FROM s JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 3",
}
