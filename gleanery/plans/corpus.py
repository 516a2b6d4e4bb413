"""Queries on discovery networks and candidates: nations stand for competitions, suppliers for their archives, orders for what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.functions import texts
from gleanery.operators import candidates as C
from gleanery.operators import network as N
from gleanery.operators.proposals import layout_stats
from gleanery.plans.artifacts import visuals
from gleanery.plans.sheets import _SHEETS, _g, _m, _real, sheet_lines
from gleanery.sources.folders import checkpointed
from gleanery.sources.tables import table


def _competitions(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    links = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(s, F.concat(F.lit("HTTPS://S"), s % 7, F.lit(".example/arch/"), s % 11).alias("url"), F.concat(F.lit("Archive "), s % 3).alias("title")))), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias("archive_links"))
    rows = table(spark, d, "nation").join(links, n == F.col("n"), "left")
    return rows.select(n.alias("id"), n.alias("nth"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("src"), n), F.concat(F.lit("src"), (n + 1) % 25)).alias("source_ids"), F.when(n % 10 == 3, F.array(F.lit("vosh_"), F.concat(F.lit("v"), n))).otherwise(F.array().cast("array<string>")).alias("prefixes"), F.coalesce("archive_links", F.array().cast("array<struct<url:string,title:string>>")).alias("archive_links"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.when(k % 17 == 0, " ftp://x ").otherwise(F.concat(F.lit("https://O"), c % 13, F.lit(".example/d/"), k, F.lit("#f")))
    source = F.when(k % 5 == 0, F.concat(F.lit("vosh_"), k)).when(k % 5 == 1, "none").otherwise(F.concat(F.lit("src"), c % 30))
    sha = F.when(k % 4 == 0, "bad").otherwise(F.upper(F.sha2((c % 40).cast("string"), 256)))
    status = F.element_at(F.array(*map(F.lit, ["DOWNLOADED", "PENDING", "DUPLICATE"])), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(
        url.alias("url"), F.when(k % 6 > 0, F.concat(F.lit("doc"), k)).alias("document_id"), source.alias("source_id"), sha.alias("sha256"), status.alias("status"), F.concat(F.lit("t"), k % 2).alias("content_type"), k.alias("bytes"),
        F.when(k % 3 > 0, F.concat(F.lit("https://p"), c % 5, F.lit(".example/"))).alias("discovered_from"), F.when(k % 7 > 0, "s").alias("subject"), F.when(k % 8 > 0, 2020).alias("season"), F.lit("school").alias("stage"),
    )


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return N.observed(_observations(spark, d), _competitions(spark, d), "RU")


def network_sites(spark: SparkSession, d: str) -> DataFrame:
    return N.sites(N.archives(_competitions(spark, d)), _seen(spark, d))


def network_archives(spark: SparkSession, d: str) -> DataFrame:
    got = N.archives(_competitions(spark, d))
    return got.withColumns({"titles": F.array_join("titles", ","), "competitions": F.array_join(F.col("competitions").cast("array<string>"), ",")})


def network_assets(spark: SparkSession, d: str) -> DataFrame:
    return N.assets(_seen(spark, d))


def network_edges(spark: SparkSession, d: str) -> DataFrame:
    return N.edges(N.archives(_competitions(spark, d)), _seen(spark, d))


def unresolved_observations(spark: SparkSession, d: str) -> DataFrame:
    return N.unresolved(_seen(spark, d)).select("id", "url", "missing")


def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of old orders are known; all orders were found again."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders")
    url = lambda c: F.concat(F.lit("https://h.example/"), c)
    known = rows.where("o_orderstatus = 'F'").select(F.concat(F.lit("doc"), k).alias("document_id"), url(k).alias("url"), F.lit("DOWNLOADED").alias("status"), (k % 4).cast("int").alias("attempts"), F.lit("2024").alias("first_seen"))
    found = rows.select(F.concat(F.lit("doc"), k).alias("document_id"), url(k * 2).alias("url"))
    return N.added(known, found, F.lit("2025"))


def _occurrences(lines: DataFrame) -> DataFrame:
    return lines.select("doc", F.concat(F.lit("s"), F.col("pos") % 3).alias("source_id"), F.lit("https://h.example/").alias("url"))


def candidate_payloads(spark: SparkSession, d: str) -> DataFrame:
    lines = checkpointed(sheet_lines(spark, d))
    got = C.payloads(lines, visuals(lines), _occurrences(lines))
    crop = lambda a: F.when(F.size("crops") > 0, a(F.col("crops")[0]))
    return got.select("doc", "candidate", "number", "method", "confidence", F.sha2("statement", 256).alias("statement"), F.size("spans").alias("pages"), F.size("crops").alias("n_crops"), crop(lambda x: x["n"]).alias("first_visuals"), crop(lambda x: x["y0"]).alias("first_y0"), crop(lambda x: x["y1"]).alias("first_y1"), (F.sha2("payload", 256) == F.col("digest")).alias("intact"))


def candidate_manifests(spark: SparkSession, d: str) -> DataFrame:
    lines = checkpointed(sheet_lines(spark, d))
    return C.manifests(C.payloads(lines, visuals(lines), _occurrences(lines)), layout_stats(lines, lines.select("doc", "page").distinct()))


def page_fragments(spark: SparkSession, d: str) -> DataFrame:
    lines = checkpointed(sheet_lines(spark, d))
    got = C.page_fragments(lines, visuals(lines))
    return got.withColumn("text", F.sha2("text", 256))


SOURCES = ["src5", "vosh_engl_x", "vosh_2024_math_school_sirius_11", "olimpiada_ru_inf_school_archive", "none"]


def identified_urls(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files, most of whose names say something; their sources say some more."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    name = F.concat(pick(["tasks-", "ans-", ""], k), pick(["math", "chem", "none"], F.floor(k / 3)), F.when(s % 2 == 0, F.concat(F.lit("-"), s % 9 + 1)).otherwise(""), pick(["-sch", "-mun", ""], s), F.lit("-x.pdf"))
    url = F.concat(F.lit("https://h.example/"), F.when(k % 2 == 0, "2021/").otherwise(""), name)
    rows = table(spark, d, "part").select("p_partkey", url.alias("url"), pick(SOURCES, k).alias("source_id"))
    return N.identified(rows, _competitions(spark, d))


QUERIES = {f.__name__: f for f in (network_sites, network_archives, network_assets, network_edges, unresolved_observations, pending_documents, candidate_payloads, candidate_manifests, page_fragments, identified_urls)}


def _id(kind: str, value: str) -> str:
    return f"'{kind}_' || sha256({value})[1:24]"


_NETWORK = f"""
WITH s AS (SELECT s_nationkey AS c, s_suppkey AS k, 'https://s' || (s_suppkey % 7) || '.example/arch/' || (s_suppkey % 11) AS url, 's' || (s_suppkey % 7) || '.example' AS host, 'Archive ' || (s_suppkey % 3) AS title FROM supplier),
n1 AS (SELECT src, min(c) AS c FROM (SELECT 'src' || n_nationkey AS src, n_nationkey AS c FROM nation UNION ALL SELECT 'src' || ((n_nationkey + 1) % 25), n_nationkey FROM nation) GROUP BY src),
o0 AS (SELECT o_orderkey AS k, o_custkey AS cu, CASE WHEN o_orderkey % 5 = 0 THEN 'vosh_' || o_orderkey WHEN o_orderkey % 5 = 1 THEN 'none' ELSE 'src' || (o_custkey % 30) END AS src, o_orderkey % 17 > 0 AS web, CASE WHEN o_orderkey % 17 = 0 THEN 'ftp://x' ELSE 'https://o' || (o_custkey % 13) || '.example/d/' || o_orderkey END AS url FROM orders),
o1 AS (SELECT o0.*, CASE WHEN web THEN coalesce(n1.c, CASE WHEN starts_with(o0.src, 'vosh_') THEN 3 END) END AS competition, CASE WHEN web THEN 'o' || (cu % 13) || '.example' END AS host, CASE WHEN k % 3 > 0 THEN 'p' || (cu % 5) || '.example' END AS phost,
  CASE WHEN k % 4 > 0 THEN 'sha256:' || sha256(CAST(cu % 40 AS VARCHAR)) END AS asset, CASE WHEN web AND k % 7 > 0 THEN 's' END AS subject, CASE WHEN web AND k % 8 > 0 THEN 2020 END AS season, CASE WHEN web THEN 'school' END AS stage FROM o0 LEFT JOIN n1 USING (src)),
o AS (SELECT *, {_id("observation", f"'RU|' || CASE WHEN k % 6 > 0 THEN 'doc' || k ELSE {_id('legacydoc', 'url')} END || '|' || url")} AS id FROM o1)
"""
_METHOD = "CASE mark WHEN 'keyword' THEN 'keyword_heading' WHEN 'number' THEN 'numbered_line' ELSE 'page_fragment' END"
_CANDIDATES = (
    _SHEETS
    + f""", f AS (SELECT *, {_m("text", P.TASK)} AS w, {_m("text", P.ITEM)} AS n, page <> lag(page, 1, -1) OVER (PARTITION BY doc ORDER BY pos) AS p FROM lines),
g AS (SELECT *, bool_or(w) OVER (PARTITION BY doc) AS aw, bool_or(n) OVER (PARTITION BY doc) AS an FROM f),
h AS (SELECT *, CASE WHEN aw THEN 'keyword' WHEN an THEN 'number' ELSE 'page' END AS mark, sum(CAST(CASE WHEN aw THEN w WHEN an THEN n ELSE p END AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS piece FROM g),
c AS (SELECT *, sha256(CAST(doc AS VARCHAR))[1:16] || '-' || CASE WHEN mark = 'page' THEN 'p' || lpad(CAST(page AS VARCHAR), 4, '0') ELSE 't' || lpad(CAST(piece AS VARCHAR), 4, '0') END AS candidate, CASE mark WHEN 'keyword' THEN {_g("text", P.TASK)} WHEN 'number' THEN {_g("text", P.ITEM)} END AS num FROM h WHERE piece > 0),
hd AS (SELECT doc, candidate, any_value(mark) AS mark, arg_min(num, pos) AS number, trim(string_agg(text, chr(10) ORDER BY pos)) AS statement, count(DISTINCT page) AS pages FROM c GROUP BY ALL),
sp AS (SELECT doc, candidate, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY ALL),
vis AS (SELECT doc, page, y0 + 4 AS y0, y0 + 44 AS y1 FROM lines WHERE pos % 4 = 1 UNION ALL SELECT doc, page, y0 + 2, y0 + 60 FROM lines WHERE pos % 4 = 2
  UNION ALL SELECT doc, page, y0 + 4, y0 + 44 FROM lines, range(5) r(i) WHERE pos % 4 = 3 UNION ALL SELECT doc, page, y0 + 4, y0 + 46 FROM lines WHERE pos % 8 = 7),
cr AS (SELECT s.doc, s.candidate, s.page, count(*) AS n, greatest(0, min(least(s.y0, v.y0)) - 10) AS cy0, least(800, max(greatest(s.y1, v.y1)) + 10) AS cy1 FROM sp s JOIN vis v ON v.doc = s.doc AND v.page = s.page AND v.y1 >= s.y0 - 80 AND v.y0 <= s.y1 + 120 GROUP BY ALL),
cl AS (SELECT doc, candidate, count(*) AS n_crops, arg_min(n, page) AS n, arg_min(cy0, page) AS cy0, arg_min(cy1, page) AS cy1 FROM cr GROUP BY ALL)
"""
)

ORACLE_SQL = {
    "network_sites": _NETWORK
    + f""", e AS (SELECT host, true AS a, 0 AS n FROM s UNION ALL SELECT host, false, 1 FROM o WHERE host IS NOT NULL UNION ALL SELECT phost, false, 0 FROM o WHERE phost IS NOT NULL)
SELECT {_id("site", "host")} AS id, host AS hostname, bool_or(a) AS has_archive_link, CAST(sum(n) AS BIGINT) AS observed_urls FROM e GROUP BY host""",
    "network_archives": _NETWORK
    + f""", t AS (SELECT url, string_agg(title, ',' ORDER BY c, k) AS titles FROM (SELECT url, title, (min((c, k)))[1] AS c, (min((c, k)))[2] AS k FROM s GROUP BY ALL) GROUP BY url),
i AS (SELECT url, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS competitions FROM (SELECT DISTINCT url, c FROM s) GROUP BY url)
SELECT {_id("archive", "url")} AS id, url, regexp_extract(url, '//([^/]*)', 1) AS host, titles, competitions FROM t JOIN i USING (url)""",
    "network_assets": _NETWORK + " SELECT asset AS id, count(DISTINCT id) AS mirrors, bool_or(k % 3 <> 1) AS has_raw_download, arg_min('t' || (k % 2), (url, id)) AS content_type, arg_min(k, (url, id)) AS bytes FROM o WHERE asset IS NOT NULL GROUP BY asset",
    "network_edges": _NETWORK
    + f""" SELECT {_id("site", "host")} AS source, 'HOSTS' AS kind, {_id("archive", "url")} AS target FROM s UNION SELECT {_id("archive", "url")}, 'ARCHIVE_OF', 'competition_' || c FROM s
UNION SELECT id, 'AT_SITE', {_id("site", "host")} FROM o WHERE host IS NOT NULL UNION SELECT id, 'FOUND_ON', {_id("page", "'https://' || phost || '/'")} FROM o WHERE phost IS NOT NULL
UNION SELECT id, 'HAS_ASSET', asset FROM o WHERE asset IS NOT NULL UNION SELECT id, 'BELONGS_TO', 'competition_' || competition FROM o WHERE competition IS NOT NULL""",
    "unresolved_observations": _NETWORK + ", m AS (SELECT id, url, concat_ws(',', CASE WHEN competition IS NULL THEN 'competition' END, CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN season IS NULL THEN 'season' END, CASE WHEN stage IS NULL THEN 'stage' END) AS missing FROM o) SELECT * FROM m WHERE missing <> ''",
    "page_fragments": _real(
        _SHEETS
        + f""", n AS (SELECT *, {_g("text", C.START)} AS num FROM lines), o AS (SELECT *, sum(CAST(num <> '' AS INT)) OVER (PARTITION BY doc, page ORDER BY pos) AS nth, bool_or(num <> '') OVER (PARTITION BY doc, page) AS some_ FROM n),
q AS (SELECT doc, page, nth, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, trim(string_agg(text, chr(10) ORDER BY pos)) AS text, arg_min(num, pos) AS num FROM o WHERE nth > 0 OR NOT some_ GROUP BY ALL),
vis AS (SELECT doc, page, 'image' AS raw, x0 + 10 AS x0, y0 + 2 AS y0, x0 + 90 AS x1, y0 + 60 AS y1 FROM lines WHERE pos % 4 = 2 UNION ALL SELECT doc, page, 'drawing', x0 + 40 * i, y0 + 4, x0 + 40 * i + 40, y0 + 44 FROM lines, range(5) r(i) WHERE pos % 4 = 3),
nr AS (SELECT q.doc, q.page, q.nth, bool_or(raw = 'image') AS image, bool_or(raw = 'drawing') AS drawing, min(v.x0) AS vx0, min(v.y0) AS vy0, max(v.x1) AS vx1, max(v.y1) AS vy1 FROM q JOIN vis v ON v.doc = q.doc AND v.page = q.page
  AND least(600, v.x1) - v.x0 > 0 AND least(least(800, q.y1 + 80), v.y1) - greatest(greatest(0, q.y0 - 8), v.y0) > 0 AND (least(600, v.x1) - v.x0) * (least(least(800, q.y1 + 80), v.y1) - greatest(greatest(0, q.y0 - 8), v.y0)) > 1 GROUP BY ALL),
z AS (SELECT q.*, coalesce(image, false) AS image, coalesce(drawing, false) AS drawing, greatest(0, least(x0, coalesce(vx0, x0)) - 12) AS bx0, greatest(0, least(y0, coalesce(vy0, y0)) - 12) AS by0, least(600, greatest(x1, coalesce(vx1, x1)) + 12) AS bx1, least(800, greatest(y1, coalesce(vy1, y1)) + 12) AS by1 FROM q LEFT JOIN nr USING (doc, page, nth)),
r AS (SELECT *, len(text) < 40 AS a, regexp_matches(text, '[�□]|\\?{{3,}}') AS b, regexp_matches(text, '{texts.FORMULA}') AND len(text) < 90 AS e, num = '' AS f FROM z),
y AS (SELECT *, round(greatest(0::DOUBLE, 0.97::DOUBLE - CASE WHEN a THEN 0.28::DOUBLE ELSE 0 END - CASE WHEN b THEN 0.32::DOUBLE ELSE 0 END - CASE WHEN image THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN drawing THEN 0.14::DOUBLE ELSE 0 END - CASE WHEN e THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN f THEN 0.18::DOUBLE ELSE 0 END), 6) AS score FROM r)
SELECT doc, page, CAST(nth AS INT) AS nth, nullif(num, '') AS number, sha256(text) AS text, bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1, image, drawing, score, CASE WHEN score >= 0.9 THEN 'accepted' WHEN score >= 0.65 THEN 'needs_llm' ELSE 'needs_human' END AS status,
  coalesce(nullif(concat_ws(',', CASE WHEN a THEN 'very_short_text' END, CASE WHEN b THEN 'broken_glyphs' END, CASE WHEN image THEN 'embedded_image' END, CASE WHEN drawing THEN 'vector_drawing' END, CASE WHEN e THEN 'formula_heavy' END, CASE WHEN f THEN 'task_boundary_uncertain' END), ''), 'clean_text') AS reasons FROM y""",
        "x0", "y0", "x1", "y1", "score",
    ),
    "identified_urls": f"""WITH p AS (SELECT p_partkey, p_partkey AS k, p_size AS s, [{", ".join(map(repr, SOURCES))}][p_partkey % {len(SOURCES)} + 1] AS source_id FROM part)
SELECT p_partkey, 'https://h.example/' || CASE WHEN k % 2 = 0 THEN '2021/' ELSE '' END || ['tasks-', 'ans-', ''][k % 3 + 1] || ['math', 'chem', 'none'][(k // 3) % 3 + 1] || CASE WHEN s % 2 = 0 THEN '-' || (s % 9 + 1) ELSE '' END || ['-sch', '-mun', ''][s % 3 + 1] || '-x.pdf' AS url, source_id,
  CASE WHEN source_id = 'src5' THEN 4 WHEN starts_with(source_id, 'vosh_') THEN 3 END AS competition, CASE (k // 3) % 3 WHEN 0 THEN 'mathematics' WHEN 1 THEN 'chemistry' ELSE CASE k % 5 WHEN 1 THEN '{N.metadata.SUBJECTS["engl"]}' WHEN 2 THEN 'mathematics' WHEN 3 THEN 'informatics' END END AS subject, CASE WHEN k % 2 = 0 THEN 2021 END AS season,
  CASE s % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'municipal' ELSE CASE WHEN k % 5 IN (2, 3) THEN 'school' END END AS stage, CASE WHEN (k // 3) % 3 < 2 AND s % 2 = 0 THEN CAST(s % 9 + 1 AS VARCHAR) ELSE 'не указан' END AS grade_band, ['tasks', 'answers', 'other'][k % 3 + 1] AS role FROM p""",
    "pending_documents": "SELECT 'doc' || o_orderkey AS document_id, 'https://h.example/' || CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_orderkey * 2 END AS url, CASE WHEN o_orderstatus = 'F' THEN 'DOWNLOADED' ELSE 'PENDING' END AS status, CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 ELSE 0 END AS INT) AS attempts, CASE WHEN o_orderstatus = 'F' THEN '2024' ELSE '2025' END AS first_seen FROM orders",
    "candidate_payloads": _real(
        _CANDIDATES + f" SELECT doc, candidate, number, {_METHOD} AS method, CASE mark WHEN 'keyword' THEN 0.97 WHEN 'number' THEN 0.86 ELSE 0.45 END AS confidence, sha256(statement) AS statement, pages, coalesce(n_crops, 0) AS n_crops, n AS first_visuals, cy0 AS first_y0, cy1 AS first_y1, true AS intact FROM hd LEFT JOIN cl USING (doc, candidate)",
        "confidence", "first_y0", "first_y1",
    ),
    "candidate_manifests": _CANDIDATES
    + """, pc AS (SELECT doc, page, sum(len(trim(text))) AS n FROM lines GROUP BY ALL), st AS (SELECT doc, sum(n) < greatest(80, 20 * count(*)) AS ocr FROM pc GROUP BY doc),
z AS (SELECT doc, count(*) AS n, sum(coalesce(n_crops, 0)) AS v FROM hd LEFT JOIN cl USING (doc, candidate) GROUP BY doc)
SELECT doc, CASE WHEN ocr THEN 'needs_ocr' ELSE 'parsed_candidates' END AS status, CAST(CASE WHEN ocr THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS candidates, CAST(CASE WHEN ocr THEN 0 ELSE coalesce(v, 0) END AS BIGINT) AS visual_assets FROM st LEFT JOIN z USING (doc)""",
}
