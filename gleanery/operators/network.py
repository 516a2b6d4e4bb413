"""The network of a discovery: sites, archives, competitions, observations and assets, and the edges between them.

Competitions are rows (id, nth, name, source_ids, prefixes, archive_links: array of struct(url, title)): `nth` is their order, `prefixes` say which
source ids are theirs where no competition names them. Observations are rows (url, document_id, source_id, sha256, status, content_type, bytes,
discovered_from, subject, season, stage). URLs that are none keep their text and have no site; digests that are none name no asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import metadata, urls

# Statuses of files that are held, and what a competition, subject, season and stage make of an observation.
FETCHED = ("DOWNLOADED", "DUPLICATE")
ATTRIBUTES = ("competition", "subject", "season", "stage")


def node_id(kind: str, value: Column) -> Column:
    """kind_ and 24 hex digits of SHA-256."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(value, 256), 1, 24))


def with_competition(rows: DataFrame, competitions: DataFrame, source: str = "source_id") -> DataFrame:
    """`rows` with `competition`: the first in order that names their source, else the first whose prefix the source begins with.

    Names are joined by equality. Prefixes are joined by the beginnings of the sources that are as long as some prefix is, so by equality too.
    """
    named = competitions.select(F.explode("source_ids").alias("_s"), F.struct("nth", "id").alias("_c")).groupBy("_s").agg(F.min("_c.nth").alias("_n"), F.min_by("_c.id", "_c.nth").alias("_named"))
    begun = competitions.select(F.explode("prefixes").alias("_p"), "nth", "id").where("_p <> ''")
    begun = begun.groupBy("_p").agg(F.min("nth").alias("_pn"), F.min_by("id", "nth").alias("_id"))
    sources = rows.select(F.col(source).alias("_s")).where("_s is not null").distinct()
    lengths = begun.select(F.length("_p").alias("_l")).distinct().agg(F.collect_list("_l").alias("_ls"))
    starts = sources.crossJoin(F.broadcast(lengths)).select("_s", F.explode("_ls").alias("_l")).select("_s", F.expr("substring(_s, 1, _l)").alias("_p"))
    found = starts.join(begun, "_p").groupBy("_s").agg(F.min_by("_id", "_pn").alias("_begun"))
    known = sources.join(named, "_s", "left").join(found, "_s", "left").select("_s", F.coalesce("_named", "_begun").alias("competition"))
    return rows.drop("competition").join(known, F.col(source) == F.col("_s"), "left").drop("_s")


# Beginnings of sources that name a subject where a file's name does not, sources whose documents are all of the school's stage, and no grades.
SUBJECT_SOURCES = [("vosh_engl", "engl"), ("olimpiada_ru_math_school", "math"), ("vosh_2024_math_school", "math"), ("olimpiada_ru_inf_school", "inf"), ("vosh_2024_inf_school", "inf")]
SCHOOL_SOURCES = ("olimpiada_ru_math_school_archive", "olimpiada_ru_inf_school_archive", "vosh_2024_math_school_sirius_11", "vosh_2024_inf_school_sirius_10_11")
NO_GRADES = "не указан"


def identified(rows: DataFrame, competitions: DataFrame, url: str = "url", source: str = "source_id") -> DataFrame:
    """`rows` with competition, subject, season, stage, grade_band and role: of a file's URL, and of its source where the URL does not say."""
    found = with_competition(rows, competitions, source).withColumn("_m", metadata.describe(F.col(url)))
    by_source = F.lit(None).cast("string")
    for prefix, short in reversed(SUBJECT_SOURCES):
        by_source = F.when(F.col(source).startswith(prefix), metadata.SUBJECTS[short]).otherwise(by_source)
    stage = F.coalesce("_m.stage", F.when(F.col(source).isin(*SCHOOL_SOURCES), "school"))
    named = {"subject": F.coalesce("_m.subject", by_source), "season": F.col("_m.season"), "stage": stage, "grade_band": F.coalesce("_m.grade_band", F.lit(NO_GRADES)), "role": F.col("_m.role")}
    return found.withColumns(named).drop("_m")


def observed(observations: DataFrame, competitions: DataFrame, segment: str) -> DataFrame:
    """Observations with their ids: (id, url, site, page, asset, competition, subject, season, stage, status, content_type, bytes)."""
    rows = with_competition(observations, competitions)
    clean = urls.normalize(F.coalesce("url", F.lit("")))
    url = F.when(clean != "", clean).otherwise(F.trim(F.coalesce("url", F.lit(""))))
    rows = rows.withColumns({"_clean": clean, "_url": url})
    document = F.when(F.coalesce("document_id", F.lit("")) != "", F.col("document_id")).otherwise(node_id("legacydoc", F.col("_url")))
    parent = urls.normalize(F.coalesce("discovered_from", F.lit("")))
    sha = F.lower(F.coalesce("sha256", F.lit("")))
    site = F.col("_clean") != ""
    return rows.select(
        node_id("observation", F.concat_ws("|", F.lit(segment), document, "_url")).alias("id"),
        F.col("_url").alias("url"),
        F.when(site, node_id("site", urls.host(F.col("_clean")))).alias("site"),
        F.when(parent != "", node_id("page", parent)).alias("page"),
        F.when(parent != "", urls.host(parent)).alias("parent_host"),
        F.when(site, urls.host(F.col("_clean"))).alias("host"),
        F.when(sha.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("sha256:"), sha)).alias("asset"),
        *[F.when(site, F.col(c)).alias(c) for c in ATTRIBUTES],
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        "content_type",
        "bytes",
    )


def archives(competitions: DataFrame) -> DataFrame:
    """Rows (id, url, host, titles, competitions) of the archives that competitions link to; titles and competitions in the order in which they first came."""
    flat = competitions.select("id", "nth", F.posexplode("archive_links").alias("k", "l")).select("id", "nth", "k", urls.normalize(F.col("l.url")).alias("url"), F.col("l.title").alias("title")).where("url <> ''")
    first = lambda c: flat.groupBy("url", c).agg(F.min(F.struct("nth", "k")).alias("at")).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias(f"{c}s"))
    got = first("title").join(first("id"), "url")
    return got.select(node_id("archive", F.col("url")).alias("id"), "url", urls.host(F.col("url")).alias("host"), F.col("titles"), F.col("ids").alias("competitions"))


def sites(held: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (id, hostname, has_archive_link, observed_urls): hosts of archives, of observations and of the pages that led to them."""
    host = lambda df, c, archive, n: df.where(F.col(c).isNotNull()).select(F.col(c).alias("hostname"), F.lit(archive).alias("_a"), F.lit(n).alias("_n"))
    every = host(held, "host", True, 0).unionByName(host(seen, "host", False, 1)).unionByName(host(seen, "parent_host", False, 0))
    got = every.groupBy("hostname").agg(F.bool_or("_a").alias("has_archive_link"), F.sum("_n").cast("long").alias("observed_urls"))
    return got.select(node_id("site", F.col("hostname")).alias("id"), "hostname", "has_archive_link", "observed_urls")


def assets(seen: DataFrame) -> DataFrame:
    """Rows (id, mirrors, has_raw_download, content_type, bytes) of the files that observations name; type and size are those of the first observation by URL."""
    first = lambda c: F.min_by(c, F.struct("url", "id")).alias(c)
    rows = seen.where(F.col("asset").isNotNull()).groupBy("asset")
    return rows.agg(F.countDistinct("id").alias("mirrors"), F.bool_or(F.col("status").isin(*FETCHED)).alias("has_raw_download"), first("content_type"), first("bytes")).withColumnRenamed("asset", "id")


def edges(held: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct rows (source, kind, target) between the nodes."""
    made = lambda df, a, kind, b: df.select(a.alias("source"), F.lit(kind).alias("kind"), b.alias("target")).where("source is not null and target is not null")
    competition = F.concat(F.lit("competition_"), F.col("c").cast("string"))
    out = made(held, node_id("site", F.col("host")), "HOSTS", F.col("id"))
    out = out.unionByName(made(held.withColumn("c", F.explode("competitions")), F.col("id"), "ARCHIVE_OF", competition))
    # an observation's edges come of its row, so that it is read, and its ids are made, once
    own = (("AT_SITE", F.col("site")), ("FOUND_ON", F.col("page")), ("HAS_ASSET", F.col("asset")), ("BELONGS_TO", F.concat(F.lit("competition_"), F.col("competition").cast("string"))))
    each = seen.select(F.col("id").alias("source"), F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), target.alias("target")) for kind, target in own])).alias("e"))
    return out.unionByName(each.select("source", "e.kind", "e.target").where("source is not null and target is not null")).distinct()


def unresolved(seen: DataFrame) -> DataFrame:
    """Observations that lack one of the four attributes, with `missing`, their names."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ATTRIBUTES])), ",")
    return seen.withColumn("missing", missing).where("missing <> ''")


def added(existing: DataFrame, found: DataFrame, stamp: Column) -> DataFrame:
    """`existing` rows (document_id, url, status, attempts, first_seen) and a pending one for each found document (document_id, url) that is not among them."""
    new = found.groupBy("document_id").agg(F.min("url").alias("url")).join(existing.select("document_id"), "document_id", "left_anti")
    pending = new.select("document_id", "url", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), stamp.alias("first_seen"))
    return existing.select("document_id", "url", "status", "attempts", "first_seen").unionByName(pending)
