"""Queries on answer keys, searches, stage sections and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import answer_keys as K
from gleanery.operators import graphs as G
from gleanery.operators import links as L
from gleanery.operators import repairs as R
from gleanery.plans.links import _HOST, _INV, _NORM
from gleanery.sources.folders import checkpointed
from gleanery.sources.tables import table


def price_inversions(spark: SparkSession, d: str) -> DataFrame:
    """How far each supplier's lines are from the order of their prices."""
    return K.inversions(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice")


def _digits(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k, F.array((s % 4).cast("int"), (k % 5).cast("int"), (k % 3).cast("int"), (s % 7).cast("int")).alias("digits"))


def even_orders(spark: SparkSession, d: str) -> DataFrame:
    """Even numbers of four digits that each part's digits make."""
    return K.count_orders(_digits(spark, d), "p_partkey", F.col("digits"), lambda o: (o[0] != 0) & (o[3] % 2 == 0))


def even_choices(spark: SparkSession, d: str) -> DataFrame:
    """Ways to choose two of each part's digits with an even sum."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return K.count_choices(_digits(spark, d), "p_partkey", F.col("digits"), F.lit(2), lambda xs: total(xs) % 2 == 0)


def key_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Answers given by a rule that forgets that numbers have no leading zero, held against those counted."""
    rows = _digits(spark, d)
    given = K.count_orders(rows, "p_partkey", F.col("digits"), lambda o: o[3] % 2 == 0)
    return K.disagreements(given, K.count_orders(rows, "p_partkey", F.col("digits"), lambda o: (o[0] != 0) & (o[3] % 2 == 0)), "p_partkey", "orders")


def move_distances(spark: SparkSession, d: str) -> DataFrame:
    """Least steps from each size to the numbers up to 200 by adding 3, doubling and taking 1 away, five at most."""
    roots = table(spark, d, "part").select(F.col("p_size").alias("root"), F.col("p_size").alias("node")).distinct()
    return G.search(roots, G.by_moves(lambda x: [x + 3, x * 2, x - 1], lambda x: (x >= 0) & (x <= 200)), 5)


def site_crawl(spark: SparkSession, d: str) -> DataFrame:
    """What three steps from each page reach on its own host."""
    pages = table(spark, d, "pages")
    roots = pages.select(urls.normalize(F.col("url")).alias("node")).where("node <> ''").distinct()
    return G.crawl(checkpointed(L.inventory(pages).select("parent_url", "url")), roots, 3)


# page k's links become an archive: each may have a heading before it, and names documents or pages
HEADINGS = ["<h3> Школьный  <i>этап</i></h3>", "<h2>Archive</h2>", "<h4 class=x>Муниципальный этап</h4>", ""]
SECTIONS = ["<h2>Problems 2024</h2>", "", "<h4>Marking\n <i>criteria</i></h4>", "<h5>Answers</h5>"]
ENDINGS = [".pdf", "-sch-1.pdf", "/page", ".zip"]


def stage_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), F.lit(1)).alias("hrefs"))
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    link = lambda h, i: F.concat(pick(HEADINGS, F.col("page_id") + i * 3), F.lit("<a class='y' href=\""), h, pick(ENDINGS, F.col("page_id") + i * 2 + F.floor(i / 2)), F.lit('">x</a>'))
    return L.stage_links(pages.select("url", F.concat(F.lit("<p>"), F.array_join(F.transform("hrefs", link), "\n")).alias("html")))


def link_context(spark: SparkSession, d: str) -> DataFrame:
    """Links of archives that have titles and stand below headings, with the words that hint at what they are."""
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), F.lit(1)).alias("hrefs"))
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    title = lambda i: pick(["", " title='Past papers'", ' title="solutions &amp; more"'], F.col("page_id") + i)
    link = lambda h, i: F.concat(pick(SECTIONS, F.col("page_id") + i * 3), F.lit('<a href="'), h, pick(ENDINGS, i), F.lit('"'), title(i), F.lit(">x</a>"))
    rows = L.inventory(pages.select("url", F.concat(F.lit("<p>"), F.array_join(F.transform("hrefs", link), "\n")).alias("html")))
    evidence = F.array_join(F.transform(F.map_entries("hint.evidence"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ",")
    return rows.select("id", "title", "heading", F.col("hint.type_hint").alias("type_hint"), F.col("hint.file_candidate").alias("file_candidate"), evidence.alias("evidence"), "heuristic_score")


def _broken(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://h.example/?item="), k % 50, F.when(k % 3 == 0, "§ion=").otherwise("&section="), k % 7)
    unit = F.concat(F.lit("unit."), k % 9)
    return table(spark, d, "orders").select(k, url.alias("url"), unit.alias("unit"), (k % 40).alias("balance"), (k % 30).alias("earned"), (k % 5).alias("spent"))


def _repaired(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    passes = [R.entity_urls("url"), R.renamed_units("unit", {"unit.1": "arith.1", "unit.4": "arith.4"}), R.balanced_ledger("balance", "earned", "spent")]
    rows, log = R.apply(_broken(spark, d), "o_orderkey", passes)
    # a second run over what the first has made and told changes nothing
    return R.apply(checkpointed(rows), "o_orderkey", passes, checkpointed(log))


def repaired_rows(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d)[0]


def repair_log(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d)[1]


def queued_again(spark: SparkSession, d: str) -> DataFrame:
    """Customers' pages whose links are broken, but for those that are queued."""
    orders = table(spark, d, "orders")
    page = F.concat(F.lit("https://h.example/c"), F.col("o_custkey"))
    found = _broken(spark, d).join(orders.select("o_orderkey", page.alias("parent_url"), F.when(F.col("o_custkey") % 2 == 0, F.lit("https://h.example/")).alias("source_url")), "o_orderkey")
    queued = orders.where("o_orderkey % 5 = 0").select(page.alias("url")).distinct()
    return R.to_visit_again(found, queued)


QUERIES = {f.__name__: f for f in (price_inversions, even_orders, even_choices, key_disagreements, move_distances, site_crawl, stage_links, link_context, repaired_rows, repair_log, queued_again)}

_DIGITS = "WITH p AS (SELECT p_partkey, [p_size % 4, p_partkey % 5, p_partkey % 3, p_size % 7] AS x FROM part)"
_ORDERS = (
    _DIGITS
    + """, i AS (SELECT a, b, c, d FROM range(1, 5) s(a), range(1, 5) t(b), range(1, 5) u(c), range(1, 5) v(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
o AS (SELECT DISTINCT p_partkey, x[a] AS q, x[b] AS r, x[c] AS s, x[d] AS t FROM p, i), n AS (SELECT p_partkey, count_if(q <> 0 AND t % 2 = 0) AS orders, count_if(t % 2 = 0) AS loose FROM o GROUP BY 1)"""
)


def _at(values: list[str], at: str) -> str:
    return f"[{', '.join(f"'{v}'" for v in values)}][({at}) % {len(values)} + 1]"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BROKEN = "WITH b AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 = 0 AS bad, 'https://h.example/?item=' || (o_orderkey % 50) AS head, o_orderkey % 7 AS tail, 'unit.' || (o_orderkey % 9) AS unit, o_orderkey % 40 AS balance, o_orderkey % 30 AS earned, o_orderkey % 5 AS spent FROM orders)"
ORACLE_SQL = {
    "price_inversions": """WITH l AS (SELECT l_suppkey AS s, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
c AS (SELECT a.s, count(*) AS c FROM l a JOIN l b ON a.s = b.s AND a.n < b.n AND a.v > b.v GROUP BY a.s)
SELECT l.s AS l_suppkey, count(*) AS n, coalesce(any_value(c), 0) AS inversions FROM l LEFT JOIN c USING (s) GROUP BY l.s""",
    "even_orders": _ORDERS + " SELECT p_partkey, orders FROM n",
    "even_choices": _DIGITS + " SELECT p_partkey, count_if((x[a] + x[b]) % 2 = 0) AS choices FROM p, range(1, 5) s(a), range(1, 5) t(b) WHERE a < b GROUP BY p_partkey",
    "key_disagreements": _ORDERS + " SELECT p_partkey, loose AS given, orders AS found FROM n WHERE loose <> orders",
    "move_distances": """WITH RECURSIVE r AS (SELECT DISTINCT p_size AS root, p_size AS node, 0 AS depth FROM part
  UNION SELECT root, CAST(m AS INT), depth + 1 FROM (SELECT root, depth, unnest([node + 3, node * 2, node - 1]) AS m FROM r WHERE depth < 5) WHERE m BETWEEN 0 AND 200)
SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL""",
    "site_crawl": _INV.replace("WITH ents", "WITH RECURSIVE ents", 1)
    + f""", e AS (SELECT DISTINCT parent_url, url FROM inventory WHERE {_HOST.format(u='parent_url')} = {_HOST.format(u='url')}), rt AS (SELECT DISTINCT {_NORM.format(u='url')} AS node FROM pages),
w AS (SELECT node AS root, node, 0 AS depth FROM rt WHERE node <> '' UNION SELECT w.root, e.url, w.depth + 1 FROM w JOIN e ON e.parent_url = w.node WHERE w.depth < 3)
SELECT root, node, min(depth) AS depth FROM w GROUP BY ALL""",
    "stage_links": f"""WITH p AS (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS hs FROM pages),
t AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM p),
s AS (SELECT *, {_at(ENDINGS, "page_id + i * 2 + i // 2")} AS e, last_value(CASE (page_id + i * 3) % 4 WHEN 0 THEN true WHEN 2 THEN false END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS inside FROM t),
f AS (SELECT url AS page_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h || e AS found, bool_or(coalesce(inside, false)) AS inside, bool_or(e = '-sch-1.pdf' OR regexp_matches(lower(h), '(^|[^a-z])sch($|[^a-z])|school')) AS named FROM s WHERE e <> '/page' GROUP BY ALL)
SELECT page_url, found AS url, CASE WHEN inside THEN 'section' ELSE 'name' END AS "by" FROM f WHERE inside OR named""",
    "link_context": f"""WITH p AS (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS hs FROM pages),
t AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM p),
s AS (SELECT *, {_at(ENDINGS, "i")} AS e, {_at(["", "Past papers", "solutions & more"], "page_id + i")} AS title, coalesce(last_value(CASE (page_id + i * 3) % 4 WHEN 0 THEN 'Problems 2024' WHEN 2 THEN 'Marking criteria' END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i), '') AS heading FROM t),
f AS (SELECT *, {_NORM.format(u='url')} AS page, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h || e AS found, row_number() OVER (PARTITION BY {_NORM.format(u='url')}, h || e ORDER BY url, i) AS nth, e <> '/page' AS file FROM s),
w AS (SELECT *, lower('x ' || title || ' ' || h || e || CASE WHEN file THEN chr(10) || heading ELSE '' END) AS sought, lower('x ' || title || ' ' || heading || ' ' || found) AS scored FROM f WHERE nth = 1),
k AS (SELECT *, {", ".join(f"list_filter([{', '.join(_quoted(x) for x in dict.fromkeys(ws))}], lambda z: contains(sought, z))[1:3] AS w_{kind}" for kind, ws in L.HINT_WORDS.items())} FROM w)
SELECT substring(sha256(page || chr(10) || page || chr(10) || found), 1, 24) AS id, title, heading, CASE WHEN CAST(len(w_task) > 0 AS INT) + CAST(len(w_solution) > 0 AS INT) + CAST(len(w_criteria) > 0 AS INT) > 1 THEN 'review' WHEN len(w_criteria) > 0 THEN 'criteria' WHEN len(w_solution) > 0 THEN 'solution' WHEN len(w_task) > 0 THEN 'task' WHEN len(w_archive) > 0 THEN 'archive' ELSE 'review' END AS type_hint,
  file AS file_candidate, concat_ws(',', {", ".join(f"CASE WHEN len(w_{kind}) > 0 THEN '{kind}=' || array_to_string(w_{kind}, '+') END" for kind in L.HINT_WORDS)}) AS evidence, {" + ".join(f"CAST(contains(scored, '{x}') AS INT)" for x in L.SCORE_WORDS)} AS heuristic_score FROM k""",
    "repaired_rows": _BROKEN + " SELECT o_orderkey, head || '&section=' || tail AS url, CASE unit WHEN 'unit.1' THEN 'arith.1' WHEN 'unit.4' THEN 'arith.4' ELSE unit END AS unit, balance, greatest(earned, balance + spent) AS earned, spent FROM b",
    "repair_log": _BROKEN
    + """ SELECT CAST(o_orderkey AS VARCHAR) AS key, 'entity_urls' AS repair, 2 AS version, 'url' AS field, head || '§ion=' || tail AS before, head || '&section=' || tail AS after FROM b WHERE bad
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'renamed_units', 1, 'unit', unit, replace(unit, 'unit', 'arith') FROM b WHERE unit IN ('unit.1', 'unit.4')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'balanced_ledger', 1, 'earned', CAST(earned AS VARCHAR), CAST(balance + spent AS VARCHAR) FROM b WHERE balance > earned - spent""",
    "queued_again": _BROKEN + """ SELECT 'https://h.example/c' || o_custkey AS url, CASE WHEN o_custkey % 2 = 0 THEN 'https://h.example/' ELSE 'https://h.example/c' || o_custkey END AS root, 0 AS depth FROM (SELECT DISTINCT o_custkey FROM b WHERE bad) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)""",
}
