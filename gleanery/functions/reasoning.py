"""A rubric for spoken reasoning: number words and spoken operations become `a op b [op c] = d`, and what holds decides the outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, spoken operations, signs, and the forms of a bare answer.
NUMBERS = {
    "пятнадцать": 15, "десять": 10, "пять": 5, "три": 3, "две": 2, "два": 2, "двух": 2, "одна": 1, "один": 1,
    "one": 1, "two": 2, "three": 3, "five": 5, "ten": 10, "fifteen": 15,
}
OPERATIONS = {
    "/": ("разделить на", "делим на", "поделить на", "divided by"),
    "*": ("умножить на", "умножаем на", "times", "multiplied by"),
    "=": ("равно", "равняется", "получается", "получим", "equals", "is equal to"),
}
SIGNS = {"×": "*", "÷": "/", "х": "x", "＝": "="}
BARE = r"(?:ответ |answer |the answer is )?"
# The outcomes.
UNSUBSTANTIATED, INCOMPLETE, UNCERTAIN, WRONG, SUPPORTED = "correct_unsubstantiated", "incomplete", "uncertain_semantics", "incorrect_reasoning", "correct_supported"

# The form of a statement, and how near its two sides have to be.
EXPRESSION = r"(?<!\d)(\d+)\s*([*/])\s*(\d+)(?:\s*([*/])\s*(\d+))?\s*=\s*(\d+)(?!\d)"
NEAR = 1e-7


@dataclass
class Rubric:
    """What supports an answer: ways, each of steps that must all be said, each in one of several forms such as 15/3=5."""

    answer: str
    ways: list[list[set[str]]]


def normalized(text: Column) -> Column:
    """Lower case, signs, digits for number words, signs for spoken operations, white space as one space."""
    out = F.lower(text)
    for a, b in SIGNS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    word = lambda x: rf"(?<![\p{{L}}])(?:{x})(?![\p{{L}}])"
    entry = lambda names, put: F.struct(F.array(*map(F.lit, names)).alias("names"), F.lit(word("|".join(names))).alias("pattern"), F.lit(put).alias("put"))
    entries = F.array(*[entry([w], str(n)) for w, n in NUMBERS.items()], *[entry(names, sign) for sign, names in OPERATIONS.items()])
    # only words that the text holds are sought as words
    step = lambda s, e: F.when(F.exists(e["names"], lambda n: F.contains(s, n)), F.regexp_replace(s, e["pattern"], e["put"])).otherwise(s)
    return F.trim(F.regexp_replace(F.aggregate(entries, out, step), r"\s+", " "))


def statements(text: Column) -> Column:
    """What a normalised text claims: array of struct(said, step, holds). `step` is compact; a division by zero does not hold."""

    def read(said: Column, parts: Column) -> Column:
        part = lambda k: parts[k - 1]
        number = lambda k: part(k).try_cast("double")
        put = lambda a, op, b: F.when(op == "/", F.try_divide(a, b)).otherwise(a * b)
        first = put(number(1), part(2), number(3))
        value = F.when(part(4) == "", first).otherwise(put(first, part(4), number(5)))
        plain = lambda k: F.regexp_replace(part(k), r"^0+(?=\d)", "")
        step = F.concat(plain(1), part(2), plain(3), part(4), plain(5), F.lit("="), plain(6))
        holds = F.coalesce(F.abs(value - number(6)) <= NEAR, F.lit(False))
        return F.struct(F.trim(said).alias("said"), step.alias("step"), holds.alias("holds"))

    groups = lambda said: F.split(F.regexp_replace(said, EXPRESSION, "$1|$2|$3|$4|$5|$6"), r"\|", -1)
    return F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(0)), lambda said: F.transform(F.array(groups(said)), lambda parts: read(said, parts))[0])


def assess(question: Column, correct: Column, transcript: Column, rubrics: dict[str, Rubric]) -> Column:
    """struct(status, evidence, contradictions) of a transcript, by the rubric of its question."""
    text = F.coalesce(transcript, F.lit(""))
    # an element of an array is computed once, however often it is used
    judged = lambda s, found: _assessed(question, F.coalesce(correct, F.lit(False)), text, s, found, rubrics)
    return F.transform(F.array(normalized(text)), lambda s: F.transform(F.array(statements(s)), lambda found: judged(s, found))[0])[0]


def _assessed(question: Column, correct: Column, text: Column, s: Column, found: Column, rubrics: dict[str, Rubric]) -> Column:
    silent = F.when(correct, UNSUBSTANTIATED).otherwise(INCOMPLETE)
    known = question.isin(*rubrics)
    right, wrong = F.filter(found, lambda x: x["holds"]), F.filter(found, lambda x: ~x["holds"])
    steps = F.transform(right, lambda x: x["step"])
    supported, bare = F.lit(False), F.lit(False)
    for name, r in rubrics.items():
        ways = F.lit(False)
        for way in r.ways:
            every = F.lit(True)
            for forms in way:
                every = every & F.arrays_overlap(steps, F.array(*map(F.lit, sorted(forms))))
            ways = ways | every
        supported = supported | ((question == name) & ways)
        bare = bare | ((question == name) & s.rlike(f"^{BARE}{r.answer}[.!]?$"))
    blank = F.trim(text) == ""
    silence = blank | (known & bare)
    status = (
        F.when(silence, silent)
        .when(~F.coalesce(known, F.lit(False)), UNCERTAIN)
        .when(F.size(wrong) > 0, WRONG)
        .when(supported, SUPPORTED)
        .when(F.size(right) > 0, INCOMPLETE)
        .otherwise(UNCERTAIN)
    )
    read = F.coalesce(known & ~silence, F.lit(False))
    said = lambda xs: F.when(read, F.transform(xs, lambda x: x["said"])).otherwise(F.array().cast("array<string>"))
    return F.struct(status.alias("status"), said(right).alias("evidence"), said(wrong).alias("contradictions"))
