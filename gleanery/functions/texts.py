"""Text expressions: quality, confidence, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of broken text, and of formulas.
BROKEN = r"[�□]|\?{3,}"
FORMULA = r"(?i)[=<>±×÷√∑∫∞≤≥∠⊥∥]|\b(?:sin|cos|tg|ctg|log)\b"
# Penalties of a candidate's confidence.
START, SHORT, BAD, IMAGE, DRAWING, MATH, UNNUMBERED = 0.97, 0.28, 0.32, 0.18, 0.14, 0.08, 0.18
ACCEPTED, BY_MODEL = 0.90, 0.65

def quality(text: Column) -> Column:
    """struct(chars, suspicious, looks_empty) of the trimmed text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.struct(F.length(t).alias("chars"), t.rlike(BROKEN).alias("suspicious"), (F.length(t) < 8).alias("looks_empty"))


def confidence(text: Column, image: Column, drawing: Column, numbered: Column) -> Column:
    """struct(score, status, reasons): how sure a candidate's text and bounds are."""
    t = F.coalesce(text, F.lit(""))
    rules = [
        (F.length(F.trim(t)) < 40, SHORT, "very_short_text"), (t.rlike(BROKEN), BAD, "broken_glyphs"), (image, IMAGE, "embedded_image"),
        (drawing, DRAWING, "vector_drawing"), ((F.length(t) < 90) & t.rlike(FORMULA), MATH, "formula_heavy"), (~numbered, UNNUMBERED, "task_boundary_uncertain"),
    ]

    def judged(hits: Column) -> Column:
        score = F.lit(START)
        for k, (_, penalty, _) in enumerate(rules):
            score = score - F.when(hits[k], penalty).otherwise(0.0)
        reasons = F.array_join(F.array_compact(F.array(*[F.when(hits[k], name) for k, (_, _, name) in enumerate(rules)])), ",")
        status = F.when(score >= ACCEPTED, "accepted").when(score >= BY_MODEL, "needs_llm").otherwise("needs_human")
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), status.alias("status"), F.when(reasons == "", "clean_text").otherwise(reasons).alias("reasons"))

    # an element of an array is computed once, however often it is used: a pattern is sought once a text
    return F.transform(F.array(F.array(*[found for found, _, _ in rules])), judged)[0]


def grades(band: Column) -> Column:
    """'7-8' or '7–8' as [7, 8]; [] unless both are from 1 to 11 and in order."""
    b = F.regexp_replace(F.trim(band.cast("string")), "[–—]", "-")
    lo = F.regexp_extract(b, r"^(\d{1,2})(?:-(\d{1,2}))?$", 1)
    hi = F.regexp_extract(b, r"^(\d{1,2})(?:-(\d{1,2}))?$", 2)
    low = F.expr("int(null)")
    low = F.when(lo != "", lo.try_cast("int")).otherwise(low)
    high = F.when(hi != "", hi.try_cast("int")).otherwise(low)
    good = low.between(1, 11) & high.between(1, 11) & (low <= high)
    return F.when(good, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
