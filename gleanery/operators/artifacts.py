"""Artifacts on pages: tables, images, groups of drawings, formulas and code, and the tasks that own them.

Visuals are rows (doc, page, visual, raw, x0, y0, x1, y1, cells): `raw` is table, image or drawing. Lines are those of `sheets`. A visual
belongs to a task whose vertical band it overlaps and whose body it is near; several tasks may own it. Visuals and bands are joined by
stripes of the page, so that a page with very many of both costs what overlaps, not all pairs. Visuals without a page, a box or a raw
kind belong to nothing; without lines or visuals there are no rows but those of formulas and code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import boxes
from gleanery.functions import profile as P
from gleanery.operators import sheets as S
from gleanery.operators.structure import stable_id
from gleanery.sources.folders import checkpointed

#: Height of a stripe of a page.
STRIPE = 64.0
# Drawings in a group at least, its area, the overlap with a table that hides it, the weakest binding.
DRAWINGS, AREA, HIDDEN, BOUND = 4, 100.0, 0.70, 0.42
# Kinds of tables, text blocks that are artifacts, and the binding of these.
TABLES = ("TABLE", "GRID", "RESPONSE_TABLE", "FORM")
TEXT_KINDS = {"FORMULA_TEXT": "FORMULA", "CODE_BLOCK": "CODE_BLOCK"}
OWNED = 0.99
# Fixed value: how sure a composition is.
COMPOSED = 0.84
_TASK = ["doc", "section", "task"]
_BOX = ["x0", "y0", "x1", "y1"]


def _box() -> Column:
    return boxes.box(*[F.col(c) for c in _BOX])


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_band: tuple[str, str], right_band: tuple[str, str], least: float = 1.0, stripe: float = STRIPE) -> DataFrame:
    """Pairs of rows with equal `by` whose bands (top, bottom) overlap by more than `least`.

    Each row goes to the stripes that its band touches, and a pair is put out where its overlap begins, so once.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(stripe))
    dealt = lambda df, band, name: df.where(F.col(band[1]) > F.col(band[0])).withColumn(name, F.explode(F.sequence(at(band[0]), at(band[1]))))
    pairs = dealt(left, left_band, "_stripe").join(dealt(right, right_band, "_stripe"), [*by, "_stripe"])
    begin = F.greatest(left_band[0], right_band[0])
    both = F.least(left_band[1], right_band[1]) - begin > least
    return pairs.where(both & (F.floor(begin / F.lit(stripe)) == F.col("_stripe"))).drop("_stripe")


def drawing_groups(rows: DataFrame, by: list[str], least: int = DRAWINGS, area: float = AREA) -> DataFrame:
    """The union box of each group of drawings that are enough and large enough together, with their ids in order as `sources`."""
    union = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    got = rows.groupBy(*by).agg(*union, F.array_sort(F.collect_set(F.col("visual").cast("string"))).alias("sources"), F.count(F.lit(1)).alias("_n"))
    return got.where((F.col("_n") >= least) & (boxes.area(_box()) > area)).drop("_n")


def uncovered(groups: DataFrame, covers: DataFrame, by: list[str], iou: float = HIDDEN) -> DataFrame:
    """Groups that no box of `covers` with equal `by` lies over."""
    other = covers.select(*[F.col(c).alias(f"_by_{c}") for c in by], boxes.box(*[F.col(c) for c in _BOX]).alias("_over"))
    same = [F.col(c) == F.col(f"_by_{c}") for c in by]
    on = boxes.iou(_box(), F.col("_over")) >= iou
    for s in same:
        on = on & s
    return groups.join(other, on, "left_anti")


def _bound(rows: DataFrame, spans: DataFrame, widths: DataFrame, least: float) -> DataFrame:
    """Rows whose box fits the body of their task on their page, with `binding` and `binding_reasons`."""
    body = spans.select(*_TASK, "page", boxes.box(*[F.col(c) for c in _BOX]).alias("_body"))
    got = rows.join(body, [*_TASK, "page"]).join(widths, ["doc", "page"])
    score = F.round(boxes.binding(_box(), F.col("_body"), F.col("_width")), 3)
    return got.withColumns({"binding": score, "binding_reasons": boxes.binding_reasons(_box(), F.col("_body"), F.col("_width"))}).where(F.col("binding") >= least).drop("_body", "_width")


def _typed(rows: DataFrame, lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows with their id, kind and caption, by the task's kind and the lines near the box."""
    named = rows.withColumn("artifact", stable_id("artifact", *[F.col(c) for c in _TASK], F.col("source")))
    # a source that comes several times has several boxes: the context is that of the row
    named = named.withColumn("_id", F.concat_ws("|", "artifact", *[F.col(c).cast("string") for c in _BOX]))
    near = S.nearby(named.select("doc", "page", F.col("_id").alias("artifact"), *_BOX).distinct(), lines).select("doc", "page", F.col("artifact").alias("_id"), "nearby", "caption")
    got = named.join(near, ["doc", "page", "_id"]).join(kinds.select(*_TASK, "kind"), _TASK)
    typed = P.artifact_kind(F.col("raw"), F.col("kind"), F.col("nearby"), F.col("cells"))
    got = got.withColumn("_t", typed).drop("kind", "_id")
    return got.withColumns({"kind": F.col("_t.kind"), "type_confidence": F.col("_t.confidence"), "type_reason": F.col("_t.reason")})


def _text_blocks(blocks: DataFrame) -> DataFrame:
    """Formulas and code that a task's own lines hold."""
    rows = blocks.where(F.col("block_role").isin(*TEXT_KINDS))
    kind = F.when(F.col("block_role") == "FORMULA_TEXT", TEXT_KINDS["FORMULA_TEXT"]).otherwise(TEXT_KINDS["CODE_BLOCK"])
    source = F.concat(F.lit("line"), F.col("pos"), F.when(F.col("k") == 1, F.lit(".1")).otherwise(F.lit("")))
    return rows.select(
        *_TASK, "page", *_BOX,
        source.alias("source"),
        F.array(source).alias("sources"),
        stable_id("artifact", *[F.col(c) for c in _TASK], source, kind).alias("artifact"),
        kind.alias("kind"),
        F.col("role_confidence").alias("type_confidence"),
        F.col("role_reason").alias("type_reason"),
        F.lit(OWNED).alias("binding"),
        F.array(F.lit("owned_text_block")).alias("binding_reasons"),
        F.lit("").alias("caption"),
    )


def artifacts(visuals: DataFrame, lines: DataFrame, tasks: DataFrame | None = None, least: float = BOUND, steps: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row for each artifact of a task: kind, box, source, confidences with reasons, caption. `tasks`, `steps`: as `sheets.tasks` and `sheets.written` give them, if at hand."""
    # what several joins read is written once
    lines = checkpointed(lines)
    steps = steps or S.written(lines)
    kinds = checkpointed((S.tasks(lines, steps) if tasks is None else tasks).select(*_TASK, "kind"))
    blocks = steps[1]
    spans, bands = S.spans(blocks), S.bands(lines, steps)
    widths = lines.groupBy("doc", "page").agg(F.max("width").alias("_width"))
    seen = overlapping(visuals.where(F.col("raw").isNotNull()), bands, ["doc", "page"], ("y0", "y1"), ("top", "bottom")).drop("top", "bottom")
    seen = checkpointed(seen)
    source = F.col("visual").cast("string")
    single = seen.where("raw <> 'drawing'").select(*_TASK, "page", *_BOX, "raw", F.coalesce("cells", F.lit(0)).alias("cells"), source.alias("source"), F.array(source).alias("sources"))
    single = checkpointed(_typed(_bound(single, spans, widths, least), lines, kinds))
    groups = drawing_groups(seen.where("raw = 'drawing'"), [*_TASK, "page"])
    groups = uncovered(groups, single.where(F.col("kind").isin(*TABLES)), [*_TASK, "page"])
    groups = groups.withColumns({"raw": F.lit("drawing"), "cells": F.lit(0), "source": F.concat(F.lit("drawings"), "page")})
    groups = _typed(_bound(groups, spans, widths, least), lines, kinds)
    cols = [*_TASK, "page", *_BOX, "source", "sources", "artifact", "kind", "type_confidence", "type_reason", "binding", "binding_reasons", "caption"]
    every = single.select(*cols).unionByName(groups.select(*cols)).unionByName(_text_blocks(blocks))
    every = every.withColumn("confidence", F.round(F.when(F.col("binding") == OWNED, F.col("type_confidence")).otherwise(F.least("type_confidence", "binding")), 3))
    # of the same source, box and kind in a task the surest stays
    same = [*_TASK, "page", "source", *_BOX, "kind"]
    rest = [c for c in every.columns if c not in same]
    best = every.groupBy(*same).agg(F.max_by(F.struct(*rest), F.struct("confidence", "type_confidence", "artifact")).alias("_r"))
    return best.select(*same, "_r.*")


def reconstructed(tasks: DataFrame, owned: DataFrame, composed: DataFrame | None = None) -> DataFrame:
    """`tasks` with n_artifacts and their confidence no higher than the weakest binding, and than 0.84 for those in `composed` (doc, section, task)."""
    own = owned.groupBy(*_TASK).agg(F.count(F.lit(1)).alias("n_artifacts"), F.min("binding").alias("_bind"), F.min("confidence").alias("_least"))
    got = tasks.join(own, _TASK, "left")
    limits = [F.col("confidence"), F.coalesce("_bind", F.lit(1.0))]
    if composed is not None:
        got = got.join(composed.select(*_TASK).distinct().withColumn("_c", F.lit(COMPOSED)), _TASK, "left")
        limits.append(F.coalesce("_c", F.lit(1.0)))
    got = got.withColumn("confidence", F.round(F.least(*limits), 3))
    review = (F.col("confidence") < S.REVIEW) | F.coalesce(F.col("_least") < S.ARTIFACT, F.lit(False))
    return got.withColumns({"review": review, "n_artifacts": F.coalesce("n_artifacts", F.lit(0).cast("long"))}).select(*tasks.columns, "n_artifacts")
