"""Discovery networks and candidates: cases with known results."""

import json

from pyspark.sql import functions as F

from gleanery.operators import candidates as C
from gleanery.operators import network as N
from tests.test_artifacts import VISUALS
from tests.test_sheets import SCHEMA

COMPETITIONS = "id string, nth int, name string, source_ids array<string>, prefixes array<string>, archive_links array<struct<url:string,title:string>>"
OBSERVATIONS = "url string, document_id string, source_id string, sha256 string, status string, content_type string, bytes long, discovered_from string, subject string, season int, stage string"


def test_network(spark):
    comps = spark.createDataFrame([("late", 2, "L", ["a", "b"], ["x_", "x_long"], [("https://H.org/arch", "T2"), ("mailto:x", "no")]), ("first", 1, "F", ["b"], [], [("https://h.org/arch#f", "T1"), ("https://h.org/arch", "T1")]), ("none", 3, "N", None, None, None)], COMPETITIONS)
    sha = "A" * 64
    rows = [
        ("https://H.org/1#x", "d1", "b", sha, "DOWNLOADED", "pdf", 5, "https://p.org/", "m", 2020, "s"),
        ("https://h.org/2", "d2", "x_long1", sha.lower(), "PENDING", None, None, None, None, 2020, "s"),
        ("ftp://h.org/3", None, "a", "bad", None, None, None, "not a page", "m", 2020, "s"),
        (None, "", None, None, None, None, None, None, None, None, None),
    ]
    seen = N.observed(spark.createDataFrame(rows, OBSERVATIONS), comps, "RU")
    got = {r["url"]: r for r in seen.collect()}
    assert (got["https://h.org/1"]["competition"], got["https://h.org/2"]["competition"], got["ftp://h.org/3"]["competition"]) == ("first", "late", None)
    assert got["https://h.org/1"]["asset"] == got["https://h.org/2"]["asset"] == f"sha256:{sha.lower()}" and got["ftp://h.org/3"]["site"] is None and got[""]["status"] == "UNKNOWN"
    held = N.archives(comps)
    assert [(r["url"], r["titles"], r["competitions"]) for r in held.collect()] == [("https://h.org/arch", ["T1", "T2"], ["first", "late"])]
    assert {(r["hostname"], r["has_archive_link"], r["observed_urls"]) for r in N.sites(held, seen).collect()} == {("h.org", True, 2), ("p.org", False, 0)}
    assert [tuple(r)[1:] for r in N.assets(seen).collect()] == [(2, True, "pdf", 5)]
    kinds = sorted(r["kind"] for r in N.edges(held, seen).collect())
    assert kinds == sorted(["HOSTS", "ARCHIVE_OF", "ARCHIVE_OF", "AT_SITE", "AT_SITE", "FOUND_ON", "HAS_ASSET", "HAS_ASSET", "BELONGS_TO", "BELONGS_TO"])
    assert {(r["url"], r["missing"]) for r in N.unresolved(seen).collect()} == {("https://h.org/2", "subject"), ("ftp://h.org/3", "competition,subject,season,stage"), ("", "competition,subject,season,stage")}


def test_pending_rows(spark):
    old = spark.createDataFrame([("d1", "u1", "DOWNLOADED", 3, "t0")], "document_id string, url string, status string, attempts int, first_seen string")
    new = spark.createDataFrame([("d1", "v"), ("d2", "w"), ("d2", "a")], "document_id string, url string")
    assert sorted(map(tuple, N.added(old, new, F.lit("t1")).collect())) == [("d1", "u1", "DOWNLOADED", 3, "t0"), ("d2", "a", "PENDING", 0, "t1")]


def test_candidates(spark):
    """Keyword markers, numbered lines and pages, with what stands near them."""

    def lines(doc, *texts, page=1):
        return [(doc, "", page, i, t, 72.0, 72.0 + 24 * i, 372.0, 84.0 + 24 * i, 11.0, False, 842.0, 595.0) for i, t in enumerate(texts)]

    rows = lines(1, "Title", "Task 1. Read", "some words", "Task 2. Write") + lines(2, "before", "1. one", "2. two") + lines(3, "plain text") + [(3, "", 2, 1, "second page", 72.0, 72.0, 372.0, 84.0, 11.0, False, 842.0, 595.0)]
    shown = spark.createDataFrame([(1, 1, "v", "image", 0.0, 100.0, 590.0, 110.0, 0), (1, 1, "tiny", "drawing", 72.0, 100.0, 74.0, 101.0, 0), (3, 2, "far", "image", 0.0, 400.0, 9.0, 410.0, 0)], VISUALS)
    seen = spark.createDataFrame([(1, "s", "u"), (1, "s", "u")], "doc int, source_id string, url string")
    frame = spark.createDataFrame(rows, SCHEMA)
    found = C.payloads(frame, shown, seen)
    got = [(r["doc"], r["candidate"][16:], r["number"], r["method"], r["confidence"], r["statement"], len(r["crops"])) for r in found.orderBy("doc", "candidate").collect()]
    assert got == [
        (1, "-t0001", "1", "keyword_heading", 0.97, "Task 1. Read\nsome words", 1), (1, "-t0002", "2", "keyword_heading", 0.97, "Task 2. Write", 1),
        (2, "-t0001", "1", "numbered_line", 0.86, "1. one", 0), (2, "-t0002", "2", "numbered_line", 0.86, "2. two", 0),
        (3, "-p0001", None, "page_fragment", 0.45, "plain text", 0), (3, "-p0002", None, "page_fragment", 0.45, "second page", 0),
    ]
    first = json.loads(found.where("doc = 1").orderBy("candidate").first()["payload"])
    assert first["candidate_type"] == "task" and first["parser"]["requires_model_verification"] and first["provenance"]["source_occurrences"] == [{"source_id": "s", "url": "u"}]
    assert first["assets"][0]["x0"] == 0.0 and first["assets"][0]["x1"] == 595.0 and first["assets"][0]["n"] == 1
    again = C.payloads(frame.repartition(5, "pos"), shown, seen)
    assert {r["digest"] for r in again.collect()} == {r["digest"] for r in found.collect()}
    stats = spark.createDataFrame([(1, False), (2, True), (9, False)], "doc int, needs_ocr boolean")
    assert {tuple(r) for r in C.manifests(found, stats).collect()} == {(1, "parsed_candidates", 2, 2), (2, "needs_ocr", 0, 0), (9, "parsed_candidates", 0, 0)}
