"""Boxes as structs (x0, y0, x1, y1) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Common width by the smaller width."""
    common = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return common / F.greatest(F.lit(1.0), F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])


# Fixed values: (what a box overlaps of the body's width, and what that adds), width of the page that makes it wide, (gap, and what it adds), start and top.
ACROSS, WIDE, BELOW, START, TOP = [(0.5, 0.34, "x_overlap"), (0.15, 0.18, "partial_x_overlap")], (0.72, 0.14, "full_width_asset"), [(0, 0.22, "body_overlap"), (48, 0.16, "near_body"), (120, 0.08, "within_task_neighborhood")], 0.36, 0.98
FAR = (-0.18, "far_from_body")


def _steps(a: Column, body: Column, page_width: Column) -> tuple[list[tuple[Column, float, str]], list[tuple[Column, float, str]]]:
    """Conditions with their steps and reasons: across and down. The first of each that holds counts."""
    x, gap = horizontal_overlap(a, body), vertical_gap(a, body)
    wide = (page_width > 0) & ((a["x1"] - a["x0"]) >= page_width * WIDE[0])
    return [*((x >= least, v, why) for least, v, why in ACROSS), (wide, *WIDE[1:])], [*((gap <= most, v, why) for most, v, why in BELOW), (F.lit(True), *FAR)]


def _first(steps: list, at: int) -> Column:
    out = F.lit(0.0) if at == 1 else F.lit(None).cast("string")
    for step in reversed(steps):
        out = F.when(step[0], F.lit(step[at])).otherwise(out)
    return out


def binding(a: Column, body: Column, page_width: Column) -> Column:
    """How well an artifact's box belongs to a body's box on the same page, from 0 to 0.98."""
    across, down = _steps(a, body, page_width)
    score = START + _first(across, 1) + _first(down, 1)
    return F.when(body.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(TOP), score)))


def binding_reasons(a: Column, body: Column, page_width: Column) -> Column:
    """Why: what the box shares with the body across, and how far below or above it lies."""
    across, down = _steps(a, body, page_width)
    return F.when(body.isNull(), F.array(F.lit("no_task_body_on_page"))).otherwise(F.array_compact(F.array(_first(across, 2), _first(down, 2))))
