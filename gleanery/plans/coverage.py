"""Queries on coverage, registries, bundles and evaluation, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import coverage as C
from gleanery.sources.tables import table


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as observations: a priority of '4-NOT SPECIFIED' is an unknown competition, an odd day an unknown stage."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.year("o_orderdate").alias("season"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("competition"),
        F.when(F.dayofmonth("o_orderdate") % 2 == 0, F.quarter("o_orderdate")).alias("stage"), F.col("o_orderstatus").alias("status"), "o_custkey",
    )


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.histogram(_observed(spark, d), "competition")


def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d).where("competition is not null and stage is not null")
    got = C.cells(rows, ["competition", "season", "stage"], {"statuses": "status"}, "o_orderkey")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return got.select("competition", "season", "stage", "n_rows", text.alias("statuses"), F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


def unclassified_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d).withColumn("missing", C.missing(["competition", "stage"]))
    return rows.where("missing <> ''").groupBy("missing").count()


def coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d).where("competition is not null")
    return rows.groupBy("season").pivot("competition", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]).count().na.fill(0)


def presence_lattice(spark: SparkSession, d: str) -> DataFrame:
    seen = _observed(spark, d).where("competition is not null").withColumn("state", F.when(F.col("status") == "F", "raw").when(F.col("status") == "O", "located").otherwise("unknown"))
    catalog = seen.select("competition").distinct().crossJoin(spark.range(1992, 2006).select(F.col("id").cast("int").alias("season")))
    return C.presence(catalog, seen, ["competition", "season"], "state")


def registry_join(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    wide = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return wide.select("s_suppkey", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"), F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


def entitlement_wildcard(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    rows = [(1, "Brand#2", None, None), (2, None, "ECONOMY", 11), (3, None, "PROMO", None), (4, "Brand#17", "ECONOMY", None), (5, None, None, 50)]
    grants = spark.createDataFrame(rows, "grant int, p_brand string, p_type string, p_size int")
    return C.wildcard_match(packs, grants, ["p_brand", "p_type", "p_size"], "grant").select("p_partkey", "grant")


def problemset_groups(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.split("p_name", " ")[0].alias("role"))
    return C.bundles(parts, ["p_brand", "p_type"], "role", "p_partkey").withColumn("roles", F.array_join("roles", ","))


def calibration_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    machine = docs.select("doc_id", "lang", (F.length("text") >= 1000).cast("int").alias("machine"))
    return C.binary_metrics(labels.join(machine, "doc_id"), "quality", "machine", ["lang"]).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


def positional_pairing(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    side = lambda flag: l.where(f"l_returnflag = '{flag}'").select("l_orderkey", (F.col("l_linenumber") + 10 * F.col("l_partkey")).alias("pos"))
    return C.paired(side("A"), side("R"), ["l_orderkey"], "pos")


def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d)
    return rows.cube("competition", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


QUERIES = {f.__name__: f for f in (status_histogram, coverage_cells, unclassified_reasons, coverage_pivot, presence_lattice, registry_join, entitlement_wildcard, problemset_groups, calibration_metrics, positional_pairing, cube_rollup)}

_OBS = "WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS season, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS competition, CASE WHEN day(o_orderdate) % 2 = 0 THEN CAST(quarter(o_orderdate) AS INT) END AS stage, o_orderstatus AS status FROM orders)"
ORACLE_SQL = {
    "status_histogram": _OBS + " SELECT coalesce(competition, 'UNKNOWN') AS competition, count(*) AS count FROM o GROUP BY 1",
    "coverage_cells": _OBS + ", k AS (SELECT * FROM o WHERE competition IS NOT NULL AND stage IS NOT NULL), h AS (SELECT competition, season, stage, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT competition, season, stage, status, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL), e AS (SELECT competition, season, stage, count(*) AS n_rows, array_to_string(list_sort(list(o_orderkey))[1:4], ',') AS examples FROM k GROUP BY ALL) SELECT * FROM e JOIN h USING (competition, season, stage)",
    "unclassified_reasons": _OBS + " SELECT concat_ws(',', CASE WHEN competition IS NULL THEN 'competition' END, CASE WHEN stage IS NULL THEN 'stage' END) AS missing, count(*) AS count FROM o WHERE competition IS NULL OR stage IS NULL GROUP BY 1",
    "coverage_pivot": _OBS + " SELECT season, " + ", ".join(f"count(*) FILTER (competition = '{c}') AS \"{c}\"" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")) + " FROM o WHERE competition IS NOT NULL GROUP BY season",
    "presence_lattice": _OBS + ", s AS (SELECT competition, season, CASE status WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END AS r, 1 AS n FROM o WHERE competition IS NOT NULL), c AS (SELECT DISTINCT competition FROM s), u AS (SELECT competition, CAST(y AS INT) AS season, 1 AS r, 0 AS n FROM c, range(1992, 2006) t(y) UNION ALL SELECT * FROM s) SELECT competition, season, ['unknown', 'catalogued', 'located', 'raw'][max(r) + 1] AS state, CAST(sum(n) AS BIGINT) AS observations FROM u GROUP BY ALL",
    "registry_join": "SELECT s_suppkey, coalesce(n_name, 'UNKNOWN') AS nation, coalesce(r_name, 'UNKNOWN') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "entitlement_wildcard": "WITH g(g, b, t, s) AS (VALUES (1, 'Brand#2', NULL, NULL), (2, NULL, 'ECONOMY', 11), (3, NULL, 'PROMO', NULL), (4, 'Brand#17', 'ECONOMY', NULL), (5, NULL, NULL, 50)) SELECT p_partkey, CAST(min(g) AS INT) AS \"grant\" FROM part LEFT JOIN g ON (b IS NULL OR b = p_brand) AND (t IS NULL OR t = p_type) AND (s IS NULL OR s = p_size) GROUP BY p_partkey",
    "problemset_groups": "SELECT 'set_' || substring(sha1(lower(p_brand || '|' || p_type)), 1, 20) AS bundle_id, p_brand, p_type, count(*) AS assets, array_to_string(list_sort(list(DISTINCT string_split(p_name, ' ')[1])), ',') AS roles, min(p_partkey) AS first_asset, count(DISTINCT string_split(p_name, ' ')[1]) > 1 AS complementary FROM part GROUP BY p_brand, p_type",
    "calibration_metrics": "WITH j AS (SELECT lang, quality = 1 AS g, length(text) >= 1000 AS m FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (g AND m) AS tp, count(*) FILTER (NOT g AND m) AS fp, count(*) FILTER (g AND NOT m) AS fn, count(*) FILTER (NOT g AND NOT m) AS tn FROM j GROUP BY lang) SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM c",
    "positional_pairing": "WITH s AS (SELECT l_orderkey, l_returnflag AS f, l_linenumber + 10 * l_partkey AS pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber + 10 * l_partkey) AS nth FROM lineitem), a AS (SELECT * FROM s WHERE f = 'A'), r AS (SELECT * FROM s WHERE f = 'R') SELECT coalesce(a.l_orderkey, r.l_orderkey) AS l_orderkey, CAST(coalesce(a.nth, r.nth) AS INT) AS nth, a.pos AS gold, r.pos AS machine FROM a FULL JOIN r ON a.l_orderkey = r.l_orderkey AND a.nth = r.nth",
    "cube_rollup": _OBS + " SELECT competition, status, count(*) AS n, CAST(grouping(competition, status) AS BIGINT) AS g FROM o GROUP BY CUBE (competition, status)",
}
