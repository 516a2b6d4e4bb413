"""Queries on pages and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import links
from gleanery.sources.tables import table


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return links.inventory(table(spark, d, "pages"))


def link_inventory(spark: SparkSession, d: str) -> DataFrame:
    return _inventory(spark, d).select("id", "url", "parent_url", "anchor_text", "resource_id", F.col("hint.file_candidate").alias("file_candidate"), F.col("hint.type_hint").alias("type_hint"), "heuristic_score")


def resource_index(spark: SparkSession, d: str) -> DataFrame:
    return links.resource_index(_inventory(spark, d))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalize(u).alias("normalized"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.resource_id(u).alias("resource_id"), urls.document_id(u).alias("document_id"))


def host_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _inventory(spark, d).withColumn("host", urls.host(F.col("url")))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("resource_id").alias("resources"), F.countDistinct("parent_url").alias("pages"), F.max("heuristic_score").alias("best_score"))


def frontier_interleave(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    slotted = links.interleave(pages.withColumn("host", urls.host(F.col("url"))), F.col("url").contains("?"), [F.col("page_id")], by=["host"])
    return slotted.select("host", "page_id", "slot")


def per_host_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _inventory(spark, d).select("id", urls.host(F.col("url")).alias("host"), F.col("hint.priority").alias("priority"))
    return links.within_budget(rows, "host", [F.desc("priority"), F.col("id")])


def anchor_heading_context(spark: SparkSession, d: str) -> DataFrame:
    return links.heading_context(table(spark, d, "pages"))


def source_merge_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    old = orders.where("o_orderkey % 2 = 0").select("o_custkey").distinct()
    new = orders.where("o_orderkey % 2 = 1").select("o_custkey")
    return links.merge_new(old, new, "o_custkey")


def checkpoint_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    part = lambda k: orders.where(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderdate").alias("updated"), F.col("m.o_orderkey").alias("o_orderkey"))
    return links.latest(part(0), part(1), "o_custkey", "updated")


QUERIES = {f.__name__: f for f in (link_inventory, resource_index, url_normalize, host_rollup, frontier_interleave, per_host_budget, anchor_heading_context, source_merge_anti, checkpoint_latest_wins)}

_NORM = r"CASE WHEN lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' THEN lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) ELSE '' END"
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', '')"
_PATH = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ANCHOR = """'(?is)<a(\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*)>(.*?)</a>'"""
_TARGET = """'(?i)(?:^|[^-\\w:])href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>]+))'"""


def _has(expr: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_NAMES = "json('" + urls.NAMED.replace("'", "''") + "')"
_UN = (
    "array_to_string(list_transform(regexp_extract_all({x}, '&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&'), lambda c: CASE WHEN starts_with(c, '&#x') OR starts_with(c, '&#X') THEN chr(CAST('0x' || c[4:-2] AS INT))"
    " WHEN starts_with(c, '&#') THEN chr(CAST(c[3:-2] AS INT)) WHEN starts_with(c, '&') AND len(c) > 1 THEN coalesce(names ->> c[2:-2], c) ELSE c END), '')"
)
_FILE = "(" + " OR ".join([*(f"ends_with(lower(p), '{x}')" for x in urls.FILE_ENDINGS), *(f"contains(lower(p), '{x}')" for x in urls.DOWNLOAD_PATHS)]) + ")"
_KINDS = ", ".join(f"{_has('prim', ws)} AS has_{k}" for k, ws in links.HINT_WORDS.items())
_INV = rf"""
WITH ents AS (SELECT {_NAMES} AS names),
z AS (SELECT url AS page_url, unnest(list_zip(regexp_extract_all(html, {_ANCHOR}, 1), regexp_extract_all(html, {_ANCHOR}, 2), range(len(regexp_extract_all(html, {_ANCHOR}, 1))))) AS a FROM pages),
t AS (SELECT page_url, a, regexp_extract(a[1], {_TARGET}, 1) || regexp_extract(a[1], {_TARGET}, 2) || regexp_extract(a[1], {_TARGET}, 3) AS raw FROM z),
h AS (SELECT page_url, a[3] AS pos, {_UN.format(x="raw")} AS href, substring(trim(regexp_replace({_UN.format(x="regexp_replace(a[2], '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')), 1, 250) AS anchor_text FROM t, ents WHERE raw <> ''),
r AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS abs FROM h),
n AS (SELECT *, {_NORM.format(u="abs")} AS url, {_NORM.format(u="page_url")} AS parent_url FROM r),
i AS (SELECT *, substring(sha256(parent_url || chr(10) || parent_url || chr(10) || url), 1, 24) AS id, substring(sha256(url), 1, 24) AS resource_id, {_PATH.format(u="url")} AS p, lower(anchor_text || '  ' || {_PATH.format(u="url")}) AS prim FROM n WHERE url <> ''),
k AS (SELECT *, {_KINDS}, {_FILE} AS file_candidate, {_has("prim", links.NAVIGATION_WORDS)} AS nav, ({" + ".join(f"CAST(contains(lower(anchor_text || '   ' || url), '{w}') AS INT)" for w in links.SCORE_WORDS)}) AS heuristic_score,
  row_number() OVER (PARTITION BY id ORDER BY page_url, pos) AS nth FROM i),
inv AS (SELECT *, CASE WHEN CAST(has_task AS INT) + CAST(has_solution AS INT) + CAST(has_criteria AS INT) > 1 THEN 'review' WHEN has_criteria THEN 'criteria' WHEN has_solution THEN 'solution' WHEN has_task THEN 'task' WHEN has_archive THEN 'archive' ELSE 'review' END AS type_hint FROM k WHERE nth = 1),
inventory AS (SELECT *, CASE WHEN file_candidate THEN 3 WHEN nav THEN 0 WHEN type_hint <> 'review' THEN 2 ELSE 1 END AS priority FROM inv)
"""

ORACLE_SQL = {
    "link_inventory": _INV + "SELECT id, url, parent_url, anchor_text, resource_id, file_candidate, type_hint, heuristic_score FROM inventory",
    "resource_index": _INV + "SELECT resource_id, arg_min(url, (parent_url, pos)) AS url, arg_min(id, (parent_url, pos)) AS first_link_id, arg_min(parent_url, (parent_url, pos)) AS first_parent_url, arg_min(anchor_text, (parent_url, pos)) AS first_anchor, count(*) AS occurrences FROM inventory GROUP BY resource_id",
    "url_normalize": f"SELECT page_id, n AS normalized, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path, CASE WHEN n = '' THEN '' ELSE substring(sha256(n), 1, 24) END AS resource_id, substring(sha1(trim(regexp_replace(url, '#.*$', ''))), 1, 20) AS document_id FROM (SELECT page_id, url, {_NORM.format(u='url')} AS n FROM pages)",
    "host_rollup": _INV + f"SELECT {_HOST.format(u='url')} AS host, count(*) AS links, count(DISTINCT resource_id) AS resources, count(DISTINCT parent_url) AS pages, max(heuristic_score) AS best_score FROM inventory GROUP BY 1",
    "frontier_interleave": f"WITH a AS (SELECT page_id, {_HOST.format(u='url')} AS host, contains(url, '?') AS imp FROM pages), b AS (SELECT *, row_number() OVER (PARTITION BY host, imp ORDER BY page_id) AS r FROM a) SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN imp THEN (r - 1) // 4 ELSE r - 1 END, CASE WHEN imp THEN 0 ELSE 1 END, r) AS slot FROM b",
    "per_host_budget": _INV + f", b AS (SELECT id, {_HOST.format(u='url')} AS host, priority FROM inventory) SELECT id, host, priority FROM b QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority DESC, id) <= 12",
    "anchor_heading_context": r"""
WITH z AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '(?is)<(h[1-6]|li|p)(?:\s[^>]*)?>([^<]*)', 1), regexp_extract_all(html, '(?is)<(h[1-6]|li|p)(?:\s[^>]*)?>([^<]*)', 2), range(len(regexp_extract_all(html, '(?is)<(h[1-6]|li|p)(?:\s[^>]*)?>([^<]*)', 1))))) AS a FROM pages),
t AS (SELECT page_id, CAST(a[3] AS INT) AS pos, lower(a[1]) AS tag, substring(trim(regexp_replace(a[2], '\s+', ' ', 'g')), 1, 250) AS text FROM z),
h AS (SELECT *, last_value(CASE WHEN starts_with(tag, 'h') THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM t)
SELECT page_id, pos, tag, text, heading FROM h WHERE tag IN ('li', 'p')""",
    "source_merge_anti": "SELECT DISTINCT o_custkey FROM orders",
    "checkpoint_latest_wins": "SELECT o_custkey, max(o_orderdate) AS updated, arg_max(o_orderkey, (o_orderdate, o_orderkey % 2, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
}
