"""Proposals and manifests: equal bytes at any partitioning, tampering, and small cases."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import proposals as D
from tests.test_sheets import SCHEMA

DOCS = "doc int, filename string, role string"


@pytest.fixture(scope="module")
def sheet(spark):
    def make(lines, role="", doc=1):
        rows = [(doc, role, 1, i, t, 72.0, 72.0 + 24 * i, 372.0, 84.0 + 24 * i, 11.0, False, 842.0, 595.0) for i, t in enumerate(lines)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


CASES = {
    1: ("", ["READING", "Task 1. Prove it", "Part 1. the first", "Part 2. the second", "Speaking Set 2", "Task 1. Talk about it"]),
    2: ("LISTENING_SCRIPT", ["The Transcript", "Task 1. First script.", "Speaker: hello", "Task 2. Second."]),
    3: ("ANSWER_KEY", ["Listening", "Task 1: a b c", "Task 2: d e", "Task 1 again", "Writing: criteria", "some points"]),
    4: ("", ["1. one", "2. two"]),
    5: ("TASK_SET", []),
}


def test_sections_and_tasks(spark, sheet):
    """Parts, oral sets, scripts, keys, lines without a section, and a document without lines."""
    lines = sheet(*CASES[1][::-1])
    for d, (role, text) in CASES.items():
        if d > 1 and text:
            lines = lines.unionByName(sheet(text, role, d))
    docs = spark.createDataFrame([(d, f"{d}.pdf", role) for d, (role, _) in CASES.items()], DOCS)
    got = {r["doc"]: json.loads(r["proposal"]) for r in D.proposals(docs, lines).collect()}
    told = lambda d, *keys: [(*(s[k] for k in keys), [(t["label"], t["kind"], t["mode"]) for t in s["tasks"]]) for s in got[d]["sections"]]
    assert told(1, "label", "semantic_type") == [("READING", "READING", [("Task 1", "COMPOSITE", "MIXED")]), ("Speaking Set 2", "SPEAKING_SET", [("Task 1", "ORAL_RESPONSE", "SPEECH")])]
    assert [len(s["tasks"][0]["parts"]) for s in got[1]["sections"]] == [2, 0]
    assert got[1]["warnings"] == [] and got[1]["schema_version"] == "structure-proposal.v3"
    assert told(2, "semantic_type", "content_role") == [("TRANSCRIPTION", "SCRIPT", [("Task 1", "TRANSCRIPT_SEGMENT", "NONE"), ("Task 2", "TRANSCRIPT_SEGMENT", "NONE")])]
    assert told(3, "semantic_type", "content_role") == [
        ("LISTENING", "ANSWERS", [("Task 1", "ANSWER_GROUP", "UNKNOWN"), ("Task 2", "ANSWER_GROUP", "UNKNOWN")]),
        ("CRITERIA", "CRITERIA", [("Rubric / rationale", "CRITERION_GROUP", "UNKNOWN")]),
    ]
    assert told(4, "semantic_type", "confidence") == [("UNKNOWN", 0.58, [])] and got[4]["warnings"] == ["no_explicit_tasks"]
    assert (got[5]["sections"], got[5]["warnings"]) == ([], ["no_text_lines"])


def test_equal_bytes_and_tampering(spark, sheet, tmp_path):
    lines = sheet(["READING", "Task 1. Choose", "A. one", "B. two", "Task 2. Match", "x = 2"])
    for d in range(2, 6):
        lines = lines.unionByName(sheet(["Task 1. Write an essay", "about it"], doc=d))
    docs = spark.createDataFrame([(d, f"{d}.pdf", "") for d in range(1, 7)], DOCS)
    first = D.proposals(docs, lines)
    second = D.proposals(docs.repartition(4), lines.repartition(5, "pos"))
    assert {tuple(r) for r in first.select("doc", "proposal", "digest").collect()} == {tuple(r) for r in second.select("doc", "proposal", "digest").collect()}
    path = str(tmp_path / "proposals")
    first.write.parquet(path)
    kept = spark.read.parquet(path)
    assert D.verified(kept, "proposal").where("not intact").isEmpty()
    changed = kept.withColumn("proposal", F.when(F.col("doc") == 3, F.replace("proposal", F.lit("Task 1"), F.lit("Task 9"))).when(F.col("doc") == 4, F.lit(None)).otherwise(F.col("proposal")))
    assert sorted(r["doc"] for r in D.verified(changed, "proposal").where("not intact").collect()) == [3, 4]


def test_manifests(spark, sheet):
    long = ["Task 1. " + "words " * 20, "and more of them " * 3]
    lines = sheet(long).unionByName(sheet(["short"], doc=2))
    docs = spark.createDataFrame([(1, "a.pdf", ""), (2, "b.pdf", ""), (3, "c.pdf", "")], DOCS)
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc int, page int")
    seen = spark.createDataFrame([(1, "s", "u"), (1, "s", "u"), (1, "r", "v")], "doc int, source_id string, url string")
    got = {r["doc"]: r for r in D.manifests(D.proposals(docs, lines), D.layout_stats(lines, pages), seen).collect()}
    assert [(got[d]["status"], got[d]["next_stage"]) for d in (1, 2, 3)] == [("layout_ready", "document_triage"), ("needs_ocr", "ocr"), ("needs_ocr", "ocr")]
    one = json.loads(got[1]["manifest"])
    assert one["stats"]["pages"] == 2 and one["stats"]["chars_by_page"][1] == 0 and one["occurrences"] == [{"source_id": "r", "url": "v"}, {"source_id": "s", "url": "u"}]
    assert one["proposal_sha256"] and json.loads(got[2]["manifest"])["proposal_sha256"] is None
