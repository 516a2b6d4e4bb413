"""Whole documents as one canonical JSON value: sections, their tasks, parts and artifacts, with a digest; and the manifest of a parsed document.

All lists are sorted and all fields named in a fixed order, nulls included, so equal documents give equal bytes at any partitioning. A
document's structure is one row: documents are task sheets and small. A document without lines has no sections and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.operators import sheets as S
from gleanery.sources.folders import checkpointed

PROPOSAL, MANIFEST, PIPELINE = "structure-proposal.v3", "parsed-document.v2", "layout-pipeline.v1"
# Sections that are one task where they have none of their own, with its label, kind and confidence.
WHOLE = {
    "TRANSCRIPTION": ("Transcript segment", "TRANSCRIPT_SEGMENT", 0.68),
    "ANSWERS": ("Answer group", "ANSWER_GROUP", 0.68),
    "CRITERIA": ("Criterion group", "CRITERION_GROUP", 0.68),
    "METHODOLOGY": ("Methodology block", "OTHER", 0.68),
}
# The same for sections of keys and criteria, and the sections whose answers are grouped by task there.
KEYED = {"CRITERIA": ("Rubric / rationale", "CRITERION_GROUP", 0.84), "METHODOLOGY": ("Methodology block", "OTHER", 0.82)}
GROUPED = ("LISTENING", "READING", "USE_OF_ENGLISH", "PART_GROUP")
SECTION, NAMELESS, SCRIPT, TASK, ANSWER, ANSWERS, WRITING, SEGMENT = 0.98, 0.58, 0.96, 0.97, 0.91, 0.76, 0.92, 0.82
# Characters of a page that is not empty, and what a document needs to go without character recognition.
FILLED, LEAST, A_PAGE = 20, 80, 20
_S = ["doc", "section"]
_T = [*_S, "task"]


def canonical(value: Column) -> Column:
    """A struct as JSON with all its fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def sections(lines: DataFrame) -> DataFrame:
    """Rows (doc, role, section, label, semantic_type, content_role, page_start, page_end, last_page, confidence); lines without a section start are one."""
    by_doc = W.partitionBy("doc")
    rows = S.section_starts(lines)
    rows = rows.withColumn("_none", ~F.max("starts").over(by_doc)).withColumn("starts", F.col("starts") | (F.col("_none") & (F.col("pos") == F.min("pos").over(by_doc))))
    rows = rows.withColumn("section", F.sum(F.col("starts").cast("int")).over(by_doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).where("section > 0")
    headers = S.page_headers(lines).select("doc", "norm", F.lit(True).alias("_head"))
    rows = rows.withColumn("norm", S.normal(F.col("text"))).join(headers, ["doc", "norm"], "left")
    stands = F.col("_head").isNull() & (F.col("norm") != "speaking")
    first = F.min_by(F.struct("role", "text", "section_type", "page"), "pos").alias("_f")
    got = rows.groupBy(*_S).agg(first, F.max_by("page", "pos").alias("last_page"), F.max(F.when(stands, F.col("page"))).alias("_filled"))
    after = F.lead(F.col("_f.page")).over(W.partitionBy("doc").orderBy("section"))
    got = got.withColumns({"role": F.coalesce("_f.role", F.lit("")), "_next": after, "page_start": F.col("_f.page")})
    # a section ends before the page on which the next one begins, unless something of its own stands there
    end = F.when((F.col("_next") > F.col("page_start")) & ~F.coalesce(F.col("_filled") >= F.col("_next"), F.lit(False)), F.col("_next") - 1).otherwise(F.col("last_page"))
    key = F.col("role").isin("ANSWER_KEY", "CRITERIA")
    kind = F.coalesce("_f.section_type", F.lit("UNKNOWN"))
    kind = F.when(F.col("role") == "LISTENING_SCRIPT", "TRANSCRIPTION").when(key & (kind == "WRITING"), "CRITERIA").otherwise(kind)
    got = got.withColumns({"page_end": end, "semantic_type": kind})
    content = F.when(F.col("role") == "LISTENING_SCRIPT", "SCRIPT").when(key & F.col("semantic_type").isin("CRITERIA", "METHODOLOGY"), "CRITERIA").when(key, "ANSWERS")
    label = F.when(F.col("role") == "LISTENING_SCRIPT", "Transcription").otherwise(P.section_label(F.col("_f.text"), F.col("semantic_type")))
    sure = F.when(F.col("role") == "LISTENING_SCRIPT", SCRIPT).when(F.col("semantic_type") == "UNKNOWN", NAMELESS).otherwise(SECTION)
    return got.select("doc", "role", "section", label.alias("label"), "semantic_type", content.alias("content_role"), "page_start", "page_end", "last_page", sure.alias("confidence"))


def _whole(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """Sections that are one task, with `must`: whether they are so even where they have tasks."""
    role, kind = F.col("role"), F.col("semantic_type")
    made = lambda t: F.struct(F.lit(t[0]).alias("label"), F.lit(t[1]).alias("kind"), F.lit(t[2]).alias("confidence"), F.lit(True).alias("must"))
    later = lambda label, k, sure: F.struct(label.alias("label"), k.alias("kind"), F.lit(sure).alias("confidence"), F.lit(False).alias("must"))
    text = F.coalesce("body", F.lit(""))
    keys = F.when(kind.isin(*GROUPED), later(F.lit("Answers"), F.lit("ANSWER_GROUP"), ANSWERS))
    for k, t in KEYED.items():
        keys = keys.when(kind == k, made(t))
    others = F.when((kind == "WRITING") & (role == "TASK_SET"), later(P.writing_label(text), P.kind(text), WRITING))
    for k, (label, of, sure) in WHOLE.items():
        others = others.when(kind == k, later(F.lit(label), F.lit(of), sure))
    script = later(F.lit("Transcript segment"), F.lit("TRANSCRIPT_SEGMENT"), SEGMENT)
    one = F.when(role == "LISTENING_SCRIPT", script).when(role.isin("ANSWER_KEY", "CRITERIA"), keys).otherwise(others)
    got = found.join(bodies, _S, "left").withColumn("_w", one).where("_w is not null")
    return got.select(*_S, "_w.*", "page_start", F.col("last_page").alias("page_end"))


def structures(lines: DataFrame, owned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sections, and tasks as rows (doc, section, nth, t): the struct of a task with its parts and artifacts."""
    lines = checkpointed(lines)
    found = checkpointed(sections(lines))
    script, key = F.col("role") == "LISTENING_SCRIPT", F.col("role").isin("ANSWER_KEY", "CRITERIA")
    parts = S.parts(lines).groupBy(*_T).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "label", "kind", "confidence"))), lambda p: F.struct(p["label"].alias("label"), p["kind"].alias("kind"), p["confidence"].alias("confidence"))).alias("parts"))
    tasks = S.tasks(lines).where("task > 0").join(found.select(*_S, "role", "semantic_type"), _S).where(~key).join(parts, _T, "left")
    oral = ~script & F.col("semantic_type").isin("SPEAKING_SET", "SPEAKING")
    plain = oral | script
    kind = F.when(script, "TRANSCRIPT_SEGMENT").when(oral, "ORAL_RESPONSE").when(F.col("parts").isNotNull(), "COMPOSITE").otherwise(F.col("kind"))
    own_parts = F.when(plain | F.col("parts").isNull(), F.array().cast("array<struct<label:string,kind:string,confidence:double>>")).otherwise(F.col("parts"))
    if owned is None:
        tasks = tasks.withColumn("artifacts", F.array().cast("array<struct<id:string,kind:string,page:int,confidence:double>>"))
    else:
        item = F.struct(F.col("page").cast("int").alias("page"), "y0", "x0", F.col("artifact").alias("id"), "kind", "confidence")
        lists = owned.groupBy(*_T).agg(F.array_sort(F.collect_list(item)).alias("_a"), F.min("binding").alias("_bind"))
        tasks = tasks.join(lists, _T, "left")
        shown = F.transform(F.coalesce("_a", F.array()), lambda a: F.struct(a["id"].alias("id"), a["kind"].alias("kind"), a["page"].alias("page"), a["confidence"].alias("confidence")))
        tasks = tasks.withColumns({"artifacts": shown, "confidence": F.round(F.least("confidence", F.coalesce("_bind", F.lit(1.0))), 3)})
    tasks = tasks.withColumns({"kind": kind, "parts": own_parts})
    tasks = tasks.withColumn("mode", F.when(script, "NONE").otherwise(P.mode(F.col("kind"))))
    sure = F.when(script, SCRIPT).otherwise(TASK)
    items = lambda c: F.when(~plain, F.col(c))
    numbered = tasks.select(*_S, F.col("task").cast("int").alias("nth"), _task("label", "number", F.col("kind"), F.col("mode"), "page_start", "page_end", sure, F.col("confidence"), items("first_item"), items("last_item"), F.col("parts"), F.col("artifacts")))
    none = F.lit(None).cast("int")
    no_parts, no_artifacts = F.array().cast("array<struct<label:string,kind:string,confidence:double>>"), F.array().cast("array<struct<id:string,kind:string,page:int,confidence:double>>")
    place = lines.select("doc", "pos", F.col("page").alias("page_start"))
    groups = S.answer_groups(lines).join(found.where(key & F.col("semantic_type").isin(*GROUPED)).select(*_S, F.col("last_page").alias("page_end")), _S).join(place, ["doc", "pos"])
    nth = F.row_number().over(W.partitionBy(*_S).orderBy("pos", "number"))
    groups = groups.select(*_S, nth.alias("nth"), _task(F.concat(F.lit("Task "), "number"), "number", F.lit("ANSWER_GROUP"), F.lit("UNKNOWN"), "page_start", "page_end", F.lit(ANSWER), F.lit(None).cast("double"), none, none, no_parts, no_artifacts))
    several = checkpointed(numbered.unionByName(groups))
    bodies = S.tasks(lines).where("task = 0").select(*_S, "body")
    whole = _whole(found, bodies).join(several.select(*_S).distinct().withColumn("_has", F.lit(True)), _S, "left").where("must or _has is null")
    whole = whole.select(*_S, F.lit(0).alias("nth"), _task("label", F.lit(""), F.col("kind"), P.mode(F.col("kind")), "page_start", "page_end", F.col("confidence"), F.lit(None).cast("double"), none, none, no_parts, no_artifacts))
    return found, several.unionByName(whole)


def _task(label, number, kind: Column, mode: Column, start: str, end: str, sure: Column, rebuilt: Column, first: Column, last: Column, parts: Column, artifacts: Column) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    fields = {
        "label": col(label), "number": col(number), "kind": kind, "mode": mode, "page_start": col(start).cast("int"), "page_end": col(end).cast("int"),
        "confidence": sure, "reconstruction": rebuilt, "review": rebuilt < S.REVIEW, "first_item": first, "last_item": last, "parts": parts, "artifacts": artifacts,
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()]).alias("t")


def proposals(documents: DataFrame, lines: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Rows (doc, proposal, digest, n_sections, n_tasks, warnings) of documents (doc, filename, role); `owned`: their artifacts."""
    found, tasks = structures(lines, owned)
    lists = tasks.groupBy(*_S).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "t"))), lambda x: x["t"]).alias("tasks"))
    rows = found.join(lists, _S, "left")
    empty = F.array().cast(lists.schema["tasks"].dataType)
    one = F.struct("section", "label", "semantic_type", "content_role", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), "confidence", F.coalesce("tasks", empty).alias("tasks"))
    by_doc = rows.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("sections"), F.sum(F.size(F.coalesce("tasks", empty))).alias("n_tasks"))
    got = documents.select("doc", "filename", "role").join(by_doc, "doc", "left")
    held = F.coalesce("sections", F.array().cast(by_doc.schema["sections"].dataType))
    warnings = F.when(F.col("sections").isNull(), F.array(F.lit("no_text_lines"))).when(F.col("n_tasks") == 0, F.array(F.lit("no_explicit_tasks"))).otherwise(F.array().cast("array<string>"))
    body = F.struct(F.lit(PROPOSAL).alias("schema_version"), F.col("doc").cast("string").alias("document"), "filename", F.col("role").alias("document_role"), held.alias("sections"), warnings.alias("warnings"))
    got = got.withColumns({"proposal": canonical(body), "n_sections": F.size(held).cast("long"), "warnings": warnings, "n_tasks": F.coalesce("n_tasks", F.lit(0)).cast("long")})
    return got.withColumn("digest", F.sha2("proposal", 256)).select("doc", "proposal", "digest", "n_sections", "n_tasks", "warnings")


def layout_stats(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc, pages, chars, filled, chars_by_page, needs_ocr) of documents' pages (doc, page): characters of lines, and pages with enough of them."""
    by_page = lines.groupBy("doc", "page").agg(F.sum(F.length(F.trim("text"))).alias("n"))
    rows = pages.join(by_page, ["doc", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda x: x["n"])
    got = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chars"), F.count_if(F.col("n") >= FILLED).alias("filled"), in_order.alias("chars_by_page"))
    return got.withColumn("needs_ocr", F.col("chars") < F.greatest(F.lit(LEAST), A_PAGE * F.col("pages")))


def manifests(found: DataFrame, stats: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Rows (doc, status, next_stage, manifest, digest) of proposals, layout stats and occurrences (doc, source_id, url).

    A document that needs character recognition keeps no structure; one without stats counts as such.
    """
    seen = occurrences.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("source_id", "url"))).alias("occurrences"))
    got = found.join(stats, "doc", "left").join(seen, "doc", "left")
    ocr = F.coalesce("needs_ocr", F.lit(True))
    status, following = F.when(ocr, "needs_ocr").otherwise("layout_ready"), F.when(ocr, "ocr").otherwise("document_triage")
    zero = F.lit(0).cast("long")
    numbers = F.struct(F.coalesce("pages", zero).alias("pages"), F.coalesce("chars", zero).alias("chars"), F.coalesce("filled", zero).alias("filled"), F.coalesce("chars_by_page", F.array().cast("array<long>")).alias("chars_by_page"), ocr.alias("needs_ocr"))
    body = F.struct(
        F.lit(MANIFEST).alias("schema_version"),
        F.col("doc").cast("string").alias("document"),
        status.alias("status"),
        F.lit(PIPELINE).alias("pipeline_version"),
        F.when(~ocr, F.col("digest")).alias("proposal_sha256"),
        numbers.alias("stats"),
        F.coalesce("occurrences", F.array().cast("array<struct<source_id:string,url:string>>")).alias("occurrences"),
        following.alias("next_stage"),
    )
    got = got.withColumns({"status": status, "next_stage": following, "manifest": canonical(body)})
    return got.select("doc", "status", "next_stage", "manifest", F.sha2("manifest", 256).alias("digest"))


def verified(rows: DataFrame, body: str, digest: str = "digest") -> DataFrame:
    """`rows` with `intact`: whether the digest is that of the bytes; null bodies or digests are not."""
    return rows.withColumn("intact", F.coalesce(F.sha2(F.col(body), 256) == F.col(digest), F.lit(False)))
