"""Answer checks, versions and small scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[-+]?(\d+(\.\d+)?|\.\d+)$"


def canonical(answer: Column) -> Column:
    """Trimmed, comma as point, no white space; plain decimals without trailing zeros, other text in lower case."""
    a = F.regexp_replace(F.replace(F.trim(answer), F.lit(","), F.lit(".")), r"\s+", "")
    a_number = F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"^\+", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    a_number = F.regexp_replace(F.regexp_replace(a_number, r"^(-?)0+(?=\d)", "$1"), r"^-0$", "0")
    return F.when(a.rlike(r"^[-+]?\d+(\.\d+)?$"), a_number).otherwise(F.lower(a))


def number(answer: Column, unit: Column | None = None) -> Column:
    """The number of an answer with a decimal comma or point, after the required unit; null if it is none."""
    v = F.replace(F.trim(answer), F.lit(","), F.lit("."))
    if unit is not None:
        suffix, compact = F.regexp_replace(F.lower(unit), r"\s+", ""), F.regexp_replace(F.lower(v), r"\s+", "")
        cut = F.when(F.endswith(compact, suffix), F.substring(compact, F.lit(1), F.length(compact) - F.length(suffix)))
        v = F.when(F.coalesce(suffix, F.lit("")) == "", v).otherwise(cut)
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def accepts_number(value: Column, expected: Column, tolerance: Column, low: Column, high: Column) -> Column:
    """Within the range, if there is one, or else within the tolerance."""
    ranged = low.isNotNull() | high.isNotNull()
    inside = (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
    return F.when(value.isNull(), False).when(ranged, inside).otherwise(F.coalesce(F.abs(value - expected) <= tolerance + 1e-9, F.lit(False)))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def accepts(kind: Column, given: Column, expected: Column) -> Column:
    """Whether an array answers a question of a kind: choices in any order, sequences in theirs, matchings place by place (a null place matches nothing)."""
    placed = (F.size(given) == F.size(expected)) & F.forall(F.zip_with(given, expected, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    right = F.when(kind.isin("single_choice", "multi_choice"), same_set(given, expected)).when(kind == "sequence", given == expected).when(kind == "matching", placed)
    return F.coalesce(right, F.lit(False))


def version(v: Column) -> Column:
    """A dotted version as numbers, to be compared as an array."""
    return F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def localized(labels: Column, language: Column) -> Column:
    """The label of the language, else that of `en`, else that of `ru`, else any."""
    return F.coalesce(F.try_element_at(labels, language), F.try_element_at(labels, F.lit("en")), F.try_element_at(labels, F.lit("ru")), F.try_element_at(F.map_values(labels), F.lit(1)))


def combo_rank(combo: Column) -> Column:
    """Fixed steps of a run of right answers: 3, 5, 8, 10, 15."""
    out = F.lit(0)
    for k, least in enumerate((3, 5, 8, 10, 15), start=1):
        out = F.when(combo >= least, k).otherwise(out)
    return out


def quota(used: Column, allocated: Column, configured: Column, ratio: Column, incoming: Column) -> Column:
    """struct(effective, threshold, projected, stop); null limits where none is positive."""
    effective = F.array_min(F.filter(F.array(allocated, configured), lambda x: x > 0))
    threshold = F.floor(effective * ratio)
    projected = used + F.greatest(F.lit(0), incoming)
    return F.struct(effective.alias("effective"), threshold.alias("threshold"), projected.alias("projected"), (projected >= threshold).alias("stop"))


def truthy(x: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(x)).isin("", "0", "false", "no", "off"), F.lit(True))


def lenient_int(x: Column, default: int, low: int | None = None, high: int | None = None) -> Column:
    v = F.coalesce(F.trim(x).try_cast("int"), F.lit(default))
    if low is not None:
        v = F.greatest(v, F.lit(low))
    return F.least(v, F.lit(high)) if high is not None else v
