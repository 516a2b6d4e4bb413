"""Structure of task sheets: lines of a layout, sections, tasks with their bodies, parts, answer groups, bands and page headers.

Lines are rows (doc, role, page, pos, text, x0, y0, x1, y1, size, bold, height, width): `pos` numbers a document's lines from 0 in reading
order, `role` is the document's role, and height and width are the page's. One document's lines are one window partition; documents are
many and small, so nothing larger than a document meets in a task. Null texts are lines without text; a document without lines has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gleanery.functions import profile as P
from gleanery.operators.structure import stable_id
from gleanery.sources.folders import checkpointed


#: Below this, or with an artifact below that, a task is reviewed.
REVIEW, ARTIFACT = 0.78, 0.65


def _doc() -> WindowSpec:
    return W.partitionBy("doc")


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition).over(_doc()), F.lit(False))


def flatten(layout: DataFrame) -> DataFrame:
    """Lines of documents (doc, role, pages: array of struct(page, height, width, lines: array of struct(text, x0, y0, x1, y1, size, bold, reading)))."""
    pages = layout.select("doc", "role", F.explode("pages").alias("p"))
    rows = pages.select("doc", "role", "p.page", "p.height", "p.width", F.explode("p.lines").alias("l")).select("doc", "role", "page", "height", "width", "l.*")
    rows = rows.withColumn("text", F.trim("text")).where("text <> ''")
    reading = _doc().orderBy("page", "reading", F.round("y0", 2), "x0")
    return rows.withColumn("pos", F.row_number().over(reading) - 1).drop("reading")


def page_headers(lines: DataFrame, top: float = 0.18, least: int = 4) -> DataFrame:
    """Rows (doc, norm, pages): normalised texts in the top band of two pages or more."""
    rows = lines.withColumn("norm", normal(F.col("text"))).where((F.col("y0") <= top * F.col("height")) & (F.length("norm") >= least))
    return rows.groupBy("doc", "norm").agg(F.countDistinct("page").alias("pages")).where("pages >= 2")


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def section_starts(lines: DataFrame) -> DataFrame:
    """`lines` with section_type and `starts`: whether a section begins, by the document's role, headings, task markers or looks."""
    t, size = F.trim("text"), F.col("size")
    rows = lines.withColumns({"section_type": P.section_type(F.col("text")), "_n": F.length(t), "_task": P.is_task(F.col("text"))})
    kind, skill = F.col("section_type"), F.col("section_type").isin(*P.SKILLS)
    by_size = W.partitionBy("doc", F.col("size") > 0).orderBy("size", "pos")
    rows = rows.withColumns({"_skill": F.min(F.when(skill, F.col("pos"))).over(_doc()), "_sized": F.count_if(size > 0).over(_doc()), "_nth": F.row_number().over(by_size)})
    median = F.coalesce(F.max(F.when((size > 0) & (F.col("_nth") == F.floor(F.col("_sized") / 2) + 1), size)).over(_doc()), F.lit(0.0))
    early = (kind == "CRITERIA") & (F.col("pos") < F.col("_skill")) & (F.col("pos") < 12)
    rows = rows.withColumns({"_median": median, "_kept": F.coalesce(kind.isNotNull() & ~((kind == "ANSWERS") & (F.col("_n") > 45)) & ~F.coalesce(early, F.lit(False)), F.lit(False))})
    lock = F.col("_kept") & ((kind == "METHODOLOGY") | ((kind == "CRITERIA") & P.found(t, P.SCHEME)))
    rows = rows.withColumn("_lock", F.coalesce(lock, F.lit(False)))
    rows = rows.withColumn("_locked", F.coalesce(F.max("_lock").over(_doc().orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    prose = F.col("_locked") & (skill | ((kind == "CRITERIA") & P.found(t, P.SCORES))) | (skill & (F.col("_n") > 70))
    rows = rows.withColumn("_keyed", F.col("_kept") & (F.col("_lock") | ~F.coalesce(prose, F.lit(False))))
    short = kind.isNotNull() & (F.col("_n") <= 100)
    role = F.coalesce("role", F.lit(""))
    starts = (
        F.when(role == "LISTENING_SCRIPT", F.col("pos") == F.min("pos").over(_doc()))
        .when((role == "TASK_SET") & _any(kind == "SPEAKING_SET"), F.coalesce(kind == "SPEAKING_SET", F.lit(False)))
        .when(role.isin("ANSWER_KEY", "CRITERIA") & _any(F.col("_keyed")), F.col("_keyed"))
        .when(_any(short), short)
        .when(_any(F.col("_task")), F.coalesce(F.col("pos") == F.min(F.when(F.col("_task"), F.col("pos"))).over(_doc()), F.lit(False)))
        .otherwise(P.heading_score(F.col("text"), size, F.col("_median"), F.col("bold")) >= 0.65)
    )
    return rows.withColumn("starts", F.coalesce(starts, F.lit(False))).select(*lines.columns, "section_type", "starts")


def in_tasks(lines: DataFrame) -> DataFrame:
    """Lines of tasks with `section`, `task` and `opens`: from a task marker up to the next or the section's end. A section without markers is one task, 0."""
    rows = section_starts(lines).withColumn("section", F.sum(F.col("starts").cast("int")).over(_doc().orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).where("section > 0")
    marked = P.is_task(F.col("text"))
    own = W.partitionBy("doc", "section")
    rows = rows.withColumn("task", F.sum(marked.cast("int")).over(own.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_most", F.max("task").over(own)).where("task > 0 or _most = 0").drop("_most")
    return rows.withColumn("opens", F.row_number().over(W.partitionBy("doc", "section", "task").orderBy("pos")) == 1)


_TASK = ["doc", "section", "task"]


def blocks(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Blocks of tasks, with `block_role`, `role_confidence` and `role_reason`: a task's lines, and what follows the marker in its own line (k = 1).

    Texts of `headers` (doc, norm) are left out, but where they open a task.
    """
    if headers is not None:
        rows = rows.withColumn("norm", normal(F.col("text"))).join(headers.select("doc", "norm", F.lit(True).alias("_head")), ["doc", "norm"], "left").where("opens or _head is null").drop("norm", "_head")
    inline = F.when(F.col("opens"), P.group(F.col("text"), P.TASK, 2)).otherwise("")
    each = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("text")), F.struct(F.lit(1).alias("k"), F.trim(inline).alias("text")))
    rows = rows.withColumn("_b", F.explode(F.filter(each, lambda b: (b["k"] == 0) | (b["text"] != ""))))
    rows = rows.withColumns({"k": F.col("_b.k"), "text": F.col("_b.text")}).drop("_b")
    role = P.line_role(F.col("text"), F.col("opens") & (F.col("k") == 0), F.col("y0"), F.col("height"), F.array().cast("array<string>"))
    rows = rows.withColumn("_r", role)
    return rows.withColumns({"block_role": F.col("_r.role"), "role_confidence": F.col("_r.confidence"), "role_reason": F.when(F.col("k") == 1, F.concat(F.lit("inline_task_statement:"), "_r.reason")).otherwise(F.col("_r.reason"))}).drop("_r")


def written(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of tasks and their blocks, each written once: tasks, bands, parts and artifacts read them many times, and to find them takes many patterns a line.

    Lines also have what follows them in the document (`_next`, `_next_page`, `_next_y`), `norm`, and `_head` where that is a page header; blocks are without headers.
    """
    following = {f"_next{name}": F.lead(c).over(_doc().orderBy("pos")) for name, c in (("", "text"), ("_page", "page"), ("_y", "y0"))}
    rows = in_tasks(lines.withColumns(following)).withColumn("norm", normal(F.col("text")))
    rows = checkpointed(rows.join(page_headers(lines).select("doc", "norm", F.lit(True).alias("_head")), ["doc", "norm"], "left"))
    return rows, checkpointed(blocks(rows.where("opens or _head is null").drop("norm", "_head", *following)))


def spans(parts: DataFrame) -> DataFrame:
    """Rows (doc, section, task, page, x0, y0, x1, y1): the box of a task's own blocks on each page."""
    own = parts.where("(k = 1 or not opens) and (k = 1 or block_role not in ('TASK_MARKER', 'FOOTNOTE'))")
    return own.groupBy(*_TASK, "page").agg(*[F.round(f(c), 3).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def item_range(rows: DataFrame) -> DataFrame:
    """Rows (doc, section, task, first_item, last_item, n_items, range_source): a range that the text names, else the numbers of its items."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    text = rows.groupBy(*_TASK).agg(joined.alias("_text")).withColumns({"_a": P.group(F.col("_text"), P.RANGE).try_cast("int"), "_b": P.group(F.col("_text"), P.RANGE, 2).try_cast("int")})
    named = (F.col("_a") <= F.col("_b")) & (F.col("_b") <= 300)
    number = P.group(F.col("text"), P.ITEM).try_cast("int")
    items = rows.where("not opens").withColumn("_i", number).where("_i <= 300").groupBy(*_TASK, "_i").agg(F.count(F.lit(1)).alias("_n")).where("_n <= 3")
    items = items.groupBy(*_TASK).agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.count(F.lit(1)).alias("_count"))
    both = text.join(items, _TASK, "left").where(named | F.col("_lo").isNotNull())
    pick = lambda a, b, name: F.when(named, a).otherwise(b).alias(name)
    return both.select(*_TASK, pick(F.col("_a"), F.col("_lo"), "first_item"), pick(F.col("_b"), F.col("_hi"), "last_item"), pick(F.col("_b") - F.col("_a") + 1, F.col("_count"), "n_items").cast("long").alias("n_items"), pick(F.lit("instruction"), F.lit("items"), "range_source"))


def tasks(lines: DataFrame, steps: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a task: label, number, kind, mode, pages, body, confidences with reasons, and whether it is to be reviewed. `steps`: as `written` gives them, if at hand."""
    rows, parts = written(lines) if steps is None else steps
    content = F.col("block_role").isin("TASK_MARKER", "FOOTNOTE")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~content, F.struct("pos", "k", c)))), lambda x: x[c]), "\n")
    narrow = (F.col("width") > 0) & (F.col("x1") - F.col("x0") < 0.72 * F.col("width"))
    centre = F.when(narrow, (F.col("x0") + F.col("x1")) / 2)
    columns = parts.groupBy(*_TASK, "page").agg(((F.min(centre) < 0.42 * F.max("width")) & (F.max(centre) > 0.58 * F.max("width"))).alias("_two"))
    columns = columns.where("_two").groupBy(*_TASK).agg(F.collect_list(F.concat(F.lit("multi_column_page:"), "page")).alias("_columns"))
    before = W.partitionBy(*_TASK).orderBy("pos", "k")
    steps = parts.where(~content).withColumns({"_page": F.lag("page").over(before), "_y1": F.lag("y1").over(before)})
    gaps = steps.where("_page = page and y0 - _y1 > 96").groupBy(*_TASK).agg(F.min_by("page", F.struct("pos", "k")).alias("_gap"))
    pages = spans(parts).groupBy(*_TASK).agg(F.count(F.lit(1)).alias("_pages"))
    body = parts.groupBy(*_TASK).agg(F.trim(ordered("text")).alias("body"), F.coalesce(F.min(F.when(F.col("block_role") != "TASK_MARKER", F.col("role_confidence"))), F.lit(0.5)).alias("role_confidence"))
    # the end page: that of the last line, or the one before the next marker's page if nothing stands there before it
    last = rows.groupBy(*_TASK).agg(F.max_by(F.struct("_next", "_next_page", "page"), "pos").alias("_l"), F.min("page").alias("page_start"))
    stands = F.col("_head").isNull() & (F.col("norm") != "speaking")
    with_parts = F.max(~F.col("opens") & P.found(F.col("text"), P.PART)).alias("_parts")
    there = rows.join(last, _TASK).groupBy(*_TASK).agg(F.max((F.col("page") == F.col("_l._next_page")) & stands).alias("_there"), with_parts)
    head = rows.where("opens").select(*_TASK, "role", "text", "section_type")
    got = head.join(body, _TASK).join(last, _TASK).join(there, _TASK).join(columns, _TASK, "left").join(gaps, _TASK, "left").join(pages, _TASK, "left").join(item_range(rows), _TASK, "left")
    boundary = F.when(F.col("_l._next").isNull(), "document_end").when(P.is_task(F.col("_l._next")), "next_task_marker").when(P.section_type(F.col("_l._next")).isNotNull(), "next_section_boundary").otherwise("layout_boundary")
    empty, many = F.col("body") == "", F.col("_pages") > 1
    limit = lambda c, v: F.when(c, v).otherwise(1.0)
    confidence = F.least(F.when(empty, 0.42).otherwise(0.97), limit(many, 0.93), limit(F.col("_gap").isNotNull(), 0.76), limit(F.col("_columns").isNotNull(), 0.82))
    reasons = F.array(F.lit("explicit_task_marker"), boundary, F.when(empty, "empty_body"), F.when(many, "multi_page_body"), F.when(F.col("_gap").isNotNull(), F.concat(F.lit("large_layout_gap:"), "_gap")))
    sure = F.round(F.least(confidence, "role_confidence"), 3)
    end = F.when((F.col("_l._next_page") > F.col("page_start")) & ~F.col("_there"), F.col("_l._next_page") - 1).otherwise(F.col("_l.page"))
    numbered = F.col("task") > 0
    got = got.withColumn("kind", P.kind(F.col("body"), F.col("_parts")))
    return got.select(
        *_TASK,
        stable_id("task", F.col("doc"), F.col("section"), F.col("task")).alias("task_id"),
        F.when(numbered, P.task_label(F.col("text"))).otherwise(P.section_label(F.col("text"), F.coalesce("section_type", F.lit("UNKNOWN")))).alias("label"),
        F.when(numbered, P.task_number(F.col("text"))).otherwise("").alias("number"),
        "kind",
        P.mode(F.col("kind")).alias("mode"),
        "page_start",
        end.alias("page_end"),
        "body",
        F.round(confidence, 3).alias("boundary_confidence"),
        F.array_join(F.array_sort(F.concat(F.array_compact(reasons), F.coalesce("_columns", F.array().cast("array<string>")))), ",").alias("reasons"),
        F.round("role_confidence", 3).alias("role_confidence"),
        sure.alias("confidence"),
        (sure < REVIEW).alias("review"),
        "first_item",
        "last_item",
        "n_items",
        "range_source",
    )


def parts(lines: DataFrame, steps: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Parts of tasks (doc, section, task, part, label, kind, confidence): lines from a part's marker up to the next; else sub-parts, two or more,

    where the task's kind has no options that look like them. `steps`: as `written` gives them, if at hand.
    """
    rows = in_tasks(lines) if steps is None else steps[0]
    major = F.when(~F.col("opens"), P.group(F.col("text"), P.PART))
    minor = F.when(~F.col("opens"), F.lower(F.concat(*[P.group(F.col("text"), P.SUBPART, k) for k in (1, 2, 3)])))
    own = W.partitionBy(*_TASK)
    rows = rows.withColumns({"_major": F.when(major != "", major), "_minor": F.when(minor != "", minor)})
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text")).over(own)), lambda x: x["text"]), "\n")
    rows = rows.withColumns({"_majors": F.count("_major").over(own), "_minors": F.count("_minor").over(own), "_kind": P.kind(whole)})
    sub = (F.col("_majors") == 0) & (F.col("_minors") >= 2) & ~F.col("_kind").isin(*P.WITH_OPTIONS)
    rows = rows.withColumn("_mark", F.coalesce("_major", F.when(sub, F.col("_minor"))))
    rows = rows.withColumn("part", F.count("_mark").over(own.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).where("part > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    got = rows.groupBy(*_TASK, "part").agg(F.min_by("_mark", "pos").alias("_mark"), F.max(F.col("_majors") > 0).alias("_m"), text.alias("_text"))
    return got.select(*_TASK, "part", F.concat(F.lit("Part "), "_mark").alias("label"), P.kind(F.col("_text")).alias("kind"), F.when(F.col("_m"), 0.94).otherwise(0.78).alias("confidence"))


def composition(owned: DataFrame, body: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Edges (source, kind, target) of tasks with two parts or more: parts owned, a stimulus shared, its artifacts, and dependence on the part before.

    `owned`: what `parts` returns; `body`: rows (doc, section, task, shared, body), `shared` where text stands before the first part;
    `artifacts`: rows (doc, section, task, artifact). A task has a stimulus where it shares text or owns an artifact.
    """
    many = owned.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*_TASK))).where("_n >= 2")
    task = stable_id("task_group", F.col("doc"), F.col("section"), F.col("task"))
    part = stable_id("part", F.col("doc"), F.col("section"), F.col("task"), F.col("part"))
    stimulus = stable_id("shared_stimulus", F.col("doc"), F.col("section"), F.col("task"))
    before = stable_id("part", F.col("doc"), F.col("section"), F.col("task"), F.col("part") - 1)
    rows, shares = many.join(body, _TASK), F.col("shared")
    if artifacts is not None:
        rows = rows.join(artifacts.select(*_TASK).distinct().withColumn("_own", F.lit(True)), _TASK, "left")
        shares = shares | F.col("_own").isNotNull()
    edge = lambda source, kind, target: F.struct(source.alias("source"), F.lit(kind).alias("kind"), target.alias("target"))
    later = P.found(F.col("body"), P.DEPENDENCY) & (F.col("part") > 1)
    edges = F.array_compact(F.array(edge(task, "OWNS_PART", part), F.when(shares, edge(part, "USES_STIMULUS", stimulus)), F.when(later, edge(part, "DEPENDS_ON", before))))
    out = rows.select(F.explode(edges).alias("e")).select("e.*")
    if artifacts is None:
        return out
    uses = many.select(*_TASK).distinct().join(artifacts.select(*_TASK, "artifact").distinct(), _TASK)
    return out.unionByName(uses.select(edge(stimulus, "USES_ARTIFACT", F.col("artifact")).alias("e")).select("e.*"))


def answer_groups(lines: DataFrame) -> DataFrame:
    """Rows (doc, section, number, pos, until): the first place of each number that a section's answers name, and where its lines end."""
    rows = section_starts(lines).withColumn("section", F.sum(F.col("starts").cast("int")).over(_doc().orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).where("section > 0")
    text = F.col("text")
    every = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?iuU){p}"), F.lit(1)) for p in (P.TASK_INSIDE, P.ANSWER_TO)])
    stop = P.found(text, P.TASK) | P.found(text, P.ANSWER_TO)
    after = W.partitionBy("doc", "section").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("_stop", F.coalesce(F.min(F.when(stop, F.col("pos"))).over(after), F.max("pos").over(W.partitionBy("doc", "section")) + 1))
    each = rows.select("doc", "section", "pos", "_stop", F.posexplode(every).alias("_k", "number"))
    return each.groupBy("doc", "section", "number").agg(F.min("pos").alias("pos"), F.min_by("_stop", F.struct("pos", "_k")).alias("until"))


def bands(lines: DataFrame, steps: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows (doc, section, task, page, top, bottom): the vertical band of a task on each of its pages, up to the next line after the task. `steps`: as `written` gives them, if at hand."""
    following = {"_next_page": F.lead("page").over(_doc().orderBy("pos")), "_next_y": F.lead("y0").over(_doc().orderBy("pos"))}
    rows = in_tasks(lines.withColumns(following)) if steps is None else steps[0]
    whole = rows.groupBy(*_TASK).agg(F.min_by(F.struct("page", "y0"), "pos").alias("_f"), F.max_by(F.struct("_next_page", "_next_y"), "pos").alias("_l"))
    each = rows.groupBy(*_TASK, "page").agg(F.max("height").alias("_h"), F.max("y1").alias("_y1")).join(whole, _TASK)
    top = F.when(F.col("page") == F.col("_f.page"), F.col("_f.y0")).otherwise(0.0)
    full = F.when(F.col("_h") > 0, F.col("_h")).otherwise(F.col("_y1"))
    bottom = F.when(F.col("page") == F.col("_l._next_page"), F.greatest(top + 1.0, F.col("_l._next_y") - 1.0)).otherwise(full)
    return each.select(*_TASK, "page", top.alias("top"), bottom.alias("bottom"))


def by_marker(lines: DataFrame) -> DataFrame:
    """`lines` with `mark` and `piece`: keyword markers cut a document; without any, numbered lines; without these, its pages."""
    word, number = P.found(F.col("text"), P.TASK), P.found(F.col("text"), P.ITEM)
    page = F.col("page") != F.lag("page", 1, -1).over(_doc().orderBy("pos"))
    rows = lines.withColumns({"_w": word, "_n": number, "_p": page})
    mark = F.when(_any(F.col("_w")), F.col("_w")).when(_any(F.col("_n")), F.col("_n")).otherwise(F.col("_p"))
    how = F.when(_any(F.col("_w")), "keyword").when(_any(F.col("_n")), "number").otherwise("page")
    return rows.withColumns({"mark": how, "_m": mark}).withColumn("piece", F.sum(F.col("_m").cast("int")).over(_doc().orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).drop("_w", "_n", "_p", "_m")


def review_sequence(found: DataFrame) -> DataFrame:
    """Rows (doc, step, node, before, after): each section and then its tasks, with the nodes beside them; of rows (doc, section, task)."""
    section = found.select("doc", "section", F.lit(-1).alias("task")).distinct()
    node = F.when(F.col("task") < 0, F.concat(F.lit("s"), "section")).otherwise(F.concat(F.lit("s"), "section", F.lit("t"), "task"))
    rows = section.unionByName(found.select("doc", "section", F.col("task").cast("int").alias("task"))).withColumn("node", node)
    order = _doc().orderBy("section", "task")
    return rows.select("doc", F.row_number().over(order).alias("step"), "node", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after"))


def nearby(artifacts: DataFrame, lines: DataFrame, gap: float = 72.0) -> DataFrame:
    """`artifacts` (doc, page, artifact, x0, y0, x1, y1) with `nearby`, the lines of the page within `gap`, and `caption`, the first caption of them."""
    side = lines.select("doc", "page", "pos", "text", F.col("y0").alias("_t"), F.col("y1").alias("_b"))
    apart = F.greatest(F.col("_t") - F.col("y1"), F.col("y0") - F.col("_b"), F.lit(0.0))
    near = artifacts.select("doc", "page", "artifact", "y0", "y1").join(side, ["doc", "page"]).where(apart <= gap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    first = F.min_by(F.when(P.found(F.col("text"), P.CAPTION), F.col("text")), F.when(P.found(F.col("text"), P.CAPTION), F.col("pos")))
    got = near.groupBy("doc", "page", "artifact").agg(text.alias("nearby"), F.coalesce(first, F.lit("")).alias("caption"))
    return artifacts.join(got, ["doc", "page", "artifact"], "left").withColumns({"nearby": F.coalesce("nearby", F.lit("")), "caption": F.coalesce("caption", F.lit(""))})
