"""Task sheets: cases with known results."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import profile as P
from gleanery.operators import sheets as S

SCHEMA = "doc int, role string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, height double, width double"


@pytest.fixture(scope="module")
def sheet(spark):
    def make(*pages, role=""):
        rows = [(page, k, t) for page, lines in enumerate(pages, 1) for k, t in enumerate(lines)]
        return spark.createDataFrame([(1, role, page, i, t, 72.0, 72.0 + 24 * k, 72.0 + 5 * len(t), 84.0 + 24 * k, 11.0, False, 842.0, 595.0) for i, (page, k, t) in enumerate(rows)], SCHEMA)

    return make


def tasks(lines):
    return [r.asDict() for r in S.tasks(lines).orderBy("section", "task").collect()]


def test_ranges_and_kinds(sheet):
    got = tasks(sheet(["READING", "Task 1", "Read the text and fill in the gaps", "1. first one", "2. second one", "Task 2. Match the headings", "11. alpha", "12. beta"]))
    assert [(r["label"], r["kind"], r["first_item"], r["last_item"]) for r in got] == [("Task 1", "GAP_FILL", 1, 2), ("Task 2", "MATCHING", 11, 12)]
    assert got[0]["mode"] == "TEXT_SHORT" and "next_task_marker" in got[0]["reasons"]


def test_parts_make_a_composite(sheet):
    lines = sheet(["Task 1", "Part 1. Listen to the text", "Part 2. Choose the correct answer", "Part 3. Write an essay"])
    assert [r["kind"] for r in tasks(lines)] == ["COMPOSITE"]
    assert [(r["label"], r["confidence"]) for r in S.parts(lines).orderBy("part").collect()] == [("Part 1", 0.94), ("Part 2", 0.94), ("Part 3", 0.94)]


def test_sub_parts_are_no_options(sheet):
    proof = sheet(["Problem 1. Prove the following", "a) the first claim", "b) the second claim"])
    assert [r["label"] for r in S.parts(proof).orderBy("part").collect()] == ["Part a", "Part b"]
    choice = sheet(["Task 1. Choose the correct answer", "a) red", "b) green", "c) blue"])
    assert S.parts(choice).count() == 0 and tasks(choice)[0]["kind"] == "SELECT_ONE"


def test_sets_repeat_numbers_and_end_before_the_next(sheet):
    lines = sheet(["Set 1", "Task 1 Talk about it", "Task 2 Speak"], ["more"], ["and more"], ["SPEAKING", "Set 2", "Task 1 Talk"], role="TASK_SET")
    got = tasks(lines)
    assert [(r["section"], r["number"]) for r in got] == [(1, "1"), (1, "2"), (2, "1")]
    assert [r["page_end"] for r in got] == [1, 3, 4]


def test_bare_numbers_are_no_tasks(sheet):
    assert tasks(sheet(["1. one", "2. two"])) == []
    assert S.by_marker(sheet(["1. one", "2. two"])).first()["mark"] == "number"


def test_headers_repeat_on_pages(sheet):
    lines = sheet(["Olympiad 2024", "Task 1", "text of it"], ["olympiad  2024", "Task 2", "more text"])
    assert [tuple(r) for r in S.page_headers(lines).collect()] == [(1, "olympiad 2024", 2)]
    assert tasks(lines)[0]["body"] == "text of it"


def test_answer_keys(sheet):
    lines = sheet(["КРИТЕРИИ", "Listening", "Task 1 a b c", "answer to question 2: x", "Reading", "Task 1 d", "Criteria scheme", "Listening - maximum 5 points"], role="ANSWER_KEY")
    assert [r["section_type"] for r in S.section_starts(lines).where("starts").orderBy("pos").collect()] == ["LISTENING", "READING", "CRITERIA"]
    assert sorted((r["section"], r["number"]) for r in S.answer_groups(lines).collect()) == [(1, "1"), (1, "2"), (2, "1")]


@pytest.mark.parametrize(("text", "kind"), [("choose the an-\nswer (A, B, C or D)", "SELECT_ONE"), ("Докажите, что", "PROOF"), ("Установите соответствие", "MATCHING"), ("true (T), false (F) or not stated (NS)", "TRUE_FALSE_NOT_STATED"), ("Напишите программу", "PROGRAMMING"), ("nothing", "UNKNOWN"), (None, "UNKNOWN")])
def test_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(P.kind(F.col("t"))).first()[0] == kind


@pytest.mark.parametrize(("text", "kind"), [("WRITING – Критерии оценивания", "WRITING"), ("Writing: критерии", "CRITERIA"), ("Часть 2.", "PART_GROUP"), ("Методические рекомендации", "METHODOLOGY"), ("Reading answers", "READING"), ("body", None)])
def test_section_types(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(P.section_type(F.col("t"))).first()[0] == kind


def test_roles_and_bundles_of_files(spark):
    row = lambda n: spark.createDataFrame([(n,)], "n string").select(P.document_role(F.col("n"), F.lit("")), P.bundle_key(F.col("n"))).first()
    assert tuple(row("x/Ans-engl-7-8.pdf")) == ("ANSWER_KEY", "engl-7-8")
    assert tuple(row("tasks-engl-7-8.pdf")) == ("TASK_SET", "engl-7-8")
    assert tuple(row("notes.pdf")) == ("", "notes")


def test_empty_sheets(sheet):
    none = sheet([])
    assert S.tasks(none).count() == S.parts(none).count() == S.answer_groups(none).count() == S.bands(none).count() == 0
