"""Candidates for tasks in documents without a known structure: pieces by markers or pages, with spans, visuals near them, quality and a payload.

Keyword markers cut a document; without any, numbered lines; without these, its pages. What comes before the first marker belongs to none.
A document that needs character recognition has no candidates; one without lines has none either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.functions import texts
from gleanery.operators import edits, sheets
from gleanery.operators.proposals import canonical

VERSION, PARSER = "0.2", "layout-parser.v1"
# How a document was cut, and how sure that is.
METHODS = {"keyword": ("keyword_heading", 0.97), "number": ("numbered_line", 0.86), "page": ("page_fragment", 0.45)}
# Visuals count up to so far above and below a text, if they are larger than this; a crop has this margin.
ABOVE, BELOW, LEAST, MARGIN = 80.0, 120.0, 9.0, 10.0
_KEY = ["doc", "candidate"]


def pieces(lines: DataFrame) -> DataFrame:
    """`lines` of candidates, with `mark`, `candidate` (an id of the document's and its place) and `number`, the one of its marker."""
    rows = sheets.by_marker(lines).where("piece > 0")
    paged = F.col("mark") == "page"
    place = F.when(paged, F.concat(F.lit("p"), F.lpad(F.col("page").cast("string"), 4, "0"))).otherwise(F.concat(F.lit("t"), F.lpad(F.col("piece").cast("string"), 4, "0")))
    digest = F.substring(F.sha2(F.col("doc").cast("string"), 256), 1, 16)
    number = F.when(F.col("mark") == "keyword", P.group(F.col("text"), P.TASK)).when(F.col("mark") == "number", P.group(F.col("text"), P.ITEM))
    return rows.withColumns({"candidate": F.concat_ws("-", digest, place), "_number": number})


def crops(found: DataFrame, visuals: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (doc, candidate, page, n, x0, y0, x1, y1): the box around a candidate's text on a page and the visuals near it, with a margin, within the page."""
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    spans = found.groupBy(*_KEY, "page").agg(*box)
    large = visuals.where((F.col("raw") == "image") | ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > LEAST))
    near = edits.in_band(spans.withColumnRenamed("candidate", "pos"), large, ABOVE, BELOW).withColumnRenamed("pos", "candidate")
    size = lines.groupBy("doc", "page").agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - MARGIN).alias(c)
    high = lambda c, most: F.least(F.col(most), F.col(c) + MARGIN).alias(c)
    return near.join(size, ["doc", "page"]).select(*_KEY, "page", "n", low("x0"), low("y0"), high("x1", "_w"), high("y1", "_h"))


def payloads(lines: DataFrame, visuals: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row a candidate: number, method, confidence, statement, spans, crops, quality, and `payload`, all of it as canonical JSON with its digest.

    `occurrences`: rows (doc, source_id, url). Candidates are extracted, never canonical, and always to be verified.
    """
    found = pieces(lines)
    in_order = F.array_sort(F.collect_list(F.struct("pos", "text", "page", "x0", "y0", "x1", "y1")))
    heads = found.groupBy(*_KEY).agg(F.first("mark").alias("mark"), F.min_by("_number", "pos").alias("number"), in_order.alias("_lines"))
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    spans = found.groupBy(*_KEY, "page").agg(*box, F.count(F.lit(1)).alias("lines")).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1", "lines"))).alias("spans"))
    cut = crops(found, visuals, lines).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1", "n"))).alias("crops"))
    seen = occurrences.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("source_id", "url"))).alias("occurrences"))
    rows = heads.join(spans, _KEY).join(cut, _KEY, "left").join(seen, "doc", "left")
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    method = P.cascade([(F.col("mark") == k, v) for k, (v, _) in METHODS.items()])
    sure = P.cascade([(F.col("mark") == k, v) for k, (_, v) in METHODS.items()])
    statement = F.trim(F.array_join(F.transform("_lines", lambda x: x["text"]), "\n"))
    rows = rows.withColumns({"method": method, "confidence": sure, "statement": statement, "crops": none(cut, "crops"), "occurrences": none(seen, "occurrences")})
    structured = F.transform("_lines", lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text"), x["page"].alias("page"), F.array(*[x[c] for c in ("x0", "y0", "x1", "y1")]).alias("box")))
    parser = F.struct(F.lit(PARSER).alias("version"), F.col("method").alias("boundary_method"), F.col("confidence").alias("boundary_confidence"), texts.quality(F.col("statement")).alias("text_quality"), F.lit(True).alias("requires_model_verification"), F.lit(False).alias("canonical"))
    body = F.struct(
        F.lit(VERSION).alias("schema_version"), F.col("candidate").alias("task_id"), F.lit("queued_extract").alias("status"),
        F.when(F.col("number").isNotNull(), "task").otherwise("page_fragment").alias("candidate_type"), F.col("number").alias("task_number_hint"),
        F.col("statement").alias("statement_raw"), structured.alias("statement_structured"), F.col("spans").alias("page_spans"), F.col("crops").alias("assets"),
        F.struct(F.col("doc").cast("string").alias("document"), F.col("occurrences").alias("source_occurrences")).alias("provenance"), parser.alias("parser"),
    )
    rows = rows.withColumn("payload", canonical(body))
    return rows.select(*_KEY, "number", "method", "confidence", "statement", "spans", "crops", "payload", F.sha2("payload", 256).alias("digest"))


def manifests(found: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows (doc, status, candidates, visual_assets) of documents' layout stats and their candidates."""
    by_doc = found.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("crops")).alias("_v"))
    rows = stats.join(by_doc, "doc", "left")
    ocr = F.col("needs_ocr")
    counted = lambda c: F.when(ocr, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return rows.select("doc", F.when(ocr, "needs_ocr").otherwise("parsed_candidates").alias("status"), counted("_n").alias("candidates"), counted("_v").alias("visual_assets"))


# A numbered task's start on a page; visuals count up to so far above and below its text; margin of its box.
START = r"^\s*(?:(?:Задача|Problem)\s*)?(\d{1,3})\s*[.)]\s+"
OVER, UNDER, EDGE = 8.0, 80.0, 12.0


def page_fragments(lines: DataFrame, visuals: DataFrame) -> DataFrame:
    """Rows (doc, page, nth, number, text, x0, y0, x1, y1, image, drawing, score, status, reasons): the numbered pieces of each page, or the page as a whole.

    Lines before a page's first number belong to none, where it has one. The box holds the text and the visuals that reach into its band, with a margin, within the page.
    """
    page = ["doc", "page"]
    number = P.group(F.col("text"), START)
    begins = (number != "").cast("int")
    order = W.partitionBy(*page).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.where(F.trim("text") != "").withColumns({"nth": F.sum(begins).over(order), "_any": F.max(begins).over(W.partitionBy(*page)), "_number": number})
    rows = rows.where((F.col("nth") > 0) | (F.col("_any") == 0))
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n"))
    got = rows.groupBy(*page, "nth").agg(*box, text.alias("text"), F.min_by("_number", "pos").alias("number"), F.max("width").alias("_w"), F.max("height").alias("_h"))
    got = got.withColumns({"_top": F.greatest(F.lit(0.0), F.col("y0") - OVER), "_bottom": F.least("_h", F.col("y1") + UNDER)})
    side = visuals.where("raw in ('image', 'drawing')").select("doc", "page", F.col("raw").alias("_raw"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    # what of a visual lies in the band, across the page
    across = F.least("_w", "_x1") - F.greatest(F.lit(0.0), "_x0")
    down = F.least("_bottom", "_y1") - F.greatest("_top", "_y0")
    near = got.join(side, page).where((across > 0) & (down > 0) & (across * down > 1))
    seen = near.groupBy(*page, "nth").agg(F.bool_or(F.col("_raw") == "image").alias("image"), F.bool_or(F.col("_raw") == "drawing").alias("drawing"), F.min("_x0").alias("_x0"), F.min("_y0").alias("_y0"), F.max("_x1").alias("_x1"), F.max("_y1").alias("_y1"))
    got = got.join(seen, [*page, "nth"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("image", "drawing")})
    low = lambda c: F.greatest(F.lit(0.0), F.least(c, F.col(f"_{c}")) - EDGE).alias(c)
    high = lambda c, most: F.least(F.col(most), F.greatest(c, F.col(f"_{c}")) + EDGE).alias(c)
    numbered = F.col("number") != ""
    sure = texts.confidence(F.col("text"), F.col("image"), F.col("drawing"), numbered)
    got = got.select(*page, F.col("nth").cast("int").alias("nth"), F.when(numbered, F.col("number")).alias("number"), "text", low("x0"), low("y0"), high("x1", "_w"), high("y1", "_h"), "image", "drawing", sure.alias("_s"))
    return got.select(*[c for c in got.columns if c != "_s"], F.round("_s.score", 6).alias("score"), "_s.status", "_s.reasons")
