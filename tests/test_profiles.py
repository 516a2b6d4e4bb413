"""File-name profiles, spoken reasoning and bundles: cases with known results."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import filenames as N
from gleanery.functions import reasoning as R
from gleanery.operators import bundles as B
from gleanery.plans.profiles import RUBRICS


def profile(spark, name):
    return spark.createDataFrame([(name,)], "name string").select(N.profile(F.col("name")).alias("p")).first()["p"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("tasks-engl-9-11-pism-mun-lenobl-24-25.pdf", ["TASK_SET", N.SUBJECTS["engl"], "UNKNOWN", "2024/25", "9-11", "VSOSh", "MUNICIPAL", "WRITTEN", "Ленинградская область", "engl-9-11-pism-mun-lenobl-24-25"]),
        ("Ans-MATH-7-mun-zz9-23-24.PDF", ["ANSWER_KEY", "MATHEMATICS", "RU", "2023/24", "7", "VSOSh", "MUNICIPAL", "UNKNOWN", "ZZ9", "math-7-mun-zz9-23-24"]),
        ("sol-iikt-5-reg-x.doc", ["ANSWER_KEY", "INFORMATICS", "RU", "UNKNOWN", "5", "VSOSh", "REGIONAL", "UNKNOWN", "UNKNOWN", "sol-iikt-5-reg-x"]),
        ("script-engl-9-11-ustn-reg-mun-a-24-25.pdf", ["LISTENING_SCRIPT", N.SUBJECTS["engl"], "UNKNOWN", "2024/25", "9-11", "VSOSh", "MUNICIPAL", "ORAL", "A", "engl-9-11-ustn-reg-mun-a-24-25"]),
        ("", ["OTHER", "OTHER", "RU", "UNKNOWN", "UNKNOWN", "VSOSh", "UNKNOWN", "UNKNOWN", "UNKNOWN", ""]),
        (None, ["OTHER", "OTHER", "RU", "UNKNOWN", "UNKNOWN", "VSOSh", "UNKNOWN", "UNKNOWN", "UNKNOWN", ""]),
    ],
)
def test_profiles(spark, name, want):
    p = profile(spark, name)
    assert [p[k]["value"] for k in N.SURE] == want


def test_confidence_and_evidence(spark):
    p = profile(spark, "tasks-engl-9-11-pism-mun-lenobl-24-25.pdf")
    assert [p[k]["confidence"] for k in N.SURE] == [0.99, 0.99, 0.35, 0.98, 0.98, 0.72, 0.97, 0.94, 0.88, 0.91]
    assert p["stage"]["evidence"]["snippet"].endswith('token "mun"') and p["region"]["evidence"]["snippet"].endswith('token "lenobl"')
    q = profile(spark, "notes.txt")
    assert [q[k]["confidence"] for k in N.SURE] == [0.99, 0.45, 0.78, 0.45, 0.45, 0.72, 0.55, 0.55, 0.52, 0.91]
    assert q["subject"]["evidence"]["snippet"] == "notes.txt"


def test_reviewed_values_win(spark):
    rows = spark.createDataFrame([(1, "tasks-engl-9.pdf"), (2, "ans-math-9.pdf")], "id int, name string").withColumn("profile", N.profile(F.col("name")))
    gold = spark.createDataFrame([(1, "RU+EN", ["CRITERIA", "TASK_SET"]), (2, None, [])], "id int, language string, roles array<string>")
    a, b = N.with_reviewed(rows, gold, "id").orderBy("id").collect()
    assert (a.profile.language.value, a.profile.language.confidence, a.profile.role.value) == ("RU+EN", 0.995, "CRITERIA")
    assert (b.profile.language.value, b.profile.role.value, b.profile.role.confidence) == ("RU", "ANSWER_KEY", 0.99)


@pytest.mark.parametrize(
    ("question", "correct", "text", "status"),
    [
        ("ratio", True, "пятнадцать разделить на три равно пять, пять умножить на два равно десять", "correct_supported"),
        ("ratio", True, "fifteen times two divided by three equals ten", "correct_supported"),
        ("ratio", True, "15 / 3 * 2 = 10", "correct_supported"),
        ("ratio", True, "10", "correct_unsubstantiated"),
        ("ratio", False, "ответ десять!", "incomplete"),
        ("ratio", True, None, "correct_unsubstantiated"),
        ("mix", False, " ", "incomplete"),
        ("ratio", True, "15 / 3 = 4, 5 * 2 = 10", "incorrect_reasoning"),
        ("ratio", True, "15 / 0 = 10", "incorrect_reasoning"),
        ("ratio", True, "15 / 3 = 5", "incomplete"),
        ("ratio", True, "какая-то хитрая формула", "uncertain_semantics"),
        ("mix", True, "6 + 4 - 1 = 9", "uncertain_semantics"),
        (None, None, "15 / 3 = 5", "uncertain_semantics"),
    ],
)
def test_reasoning(spark, question, correct, text, status):
    df = spark.createDataFrame([(question, correct, text)], "q string, c boolean, t string")
    assert df.select(R.assess(F.col("q"), F.col("c"), F.col("t"), RUBRICS)["status"]).first()[0] == status


ASSETS = "asset int, bundle string, role string, audio string"


def test_bundle_edges(spark):
    rows = [(1, "b", "TASK_SET", None), (2, "b", "ANSWER_KEY", "r2"), (3, "b", "CRITERIA", "r3"), (4, "b", "LISTENING_SCRIPT", None), (5, "c", None, None), (6, None, "TASK_SET", None)]
    got = B.edges(spark.createDataFrame(rows, ASSETS)).collect()
    kinds = sorted((r["bundle"], r["kind"], r["confidence"]) for r in got)
    assert kinds == sorted([("b", "CONTAINS_ASSET", 0.96)] * 4 + [("c", "CONTAINS_ASSET", 0.78), ("b", "CONTAINS_MEDIA", 0.99), ("b", "HAS_ANSWER", 0.94), ("b", "SCORED_BY", 0.88), ("b", "USES_AUDIO", 0.99), ("b", "USES_TRANSCRIPT", 0.91)])
    media = {r["target"] for r in got if r["kind"] in ("CONTAINS_MEDIA", "USES_AUDIO")}
    assert len(media) == 1


@pytest.mark.parametrize(
    ("roles", "labels", "want"),
    [
        (["TASK_SET", "CRITERIA"], [], ["task_without_answer"]),
        (["ANSWER_KEY", "CRITERIA"], [], ["answer_without_task"]),
        (["LISTENING_SCRIPT", "CRITERIA"], [], ["script_without_task"]),
        (["TASK_SET", "ANSWER_KEY"], [("Listening", "Task 1")], ["listening_without_audio"]),
        (["CRITERIA", "AUDIO"], [], ["audio_without_task"]),
        (["CRITERIA"], [], ["incomplete_bundle"]),
        (["TASK_SET", "ANSWER_KEY"], [("A", "Task 1"), ("B", " task 1"), ("B", ""), ("B", None), ("B", "")], ["ambiguous_numbering"]),
        (["TASK_SET", "ANSWER_KEY", "CRITERIA", "SHARED"], [], ["criterion_of_several_tasks"]),
        (["TASK_SET", "ANSWER_KEY", "AUDIO"], [("Listening", "Task 1"), ("Listening", "Task 2")], []),
    ],
)
def test_exceptions(spark, roles, labels, want):
    assets = spark.createDataFrame([(i, "b", r, "rec" if r == "AUDIO" else None) for i, r in enumerate(roles)], ASSETS)
    edges = B.edges(assets)
    if "SHARED" in roles:
        edges = edges.unionByName(edges.where("kind = 'SCORED_BY'"))
    docs = spark.createDataFrame([(7, "b")], "doc int, bundle string")
    told = spark.createDataFrame([(7, *x) for x in labels], "doc int, section string, task string")
    got = B.exceptions(docs, B.flags(assets), told, B.shared_criteria(edges)).orderBy("nth").collect()
    assert [r["exception"] for r in got] == want
