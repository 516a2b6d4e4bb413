"""Artifacts: cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import artifacts as A
from gleanery.operators import sheets as S
from tests.test_sheets import SCHEMA

VISUALS = "doc int, page int, visual string, raw string, x0 double, y0 double, x1 double, y1 double, cells int"


@pytest.fixture(scope="module")
def sheet(spark):
    def make(*lines, doc=1):
        rows = [(doc, "", 1, i, t, 72.0, 72.0 + 24 * i, 372.0, 84.0 + 24 * i, 11.0, False, 842.0, 595.0) for i, t in enumerate(lines)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


LINES = ["LISTENING", "Task 1. Complete the table.", "the words of it", "Task 2. Choose the correct answer", "one", "two"]
SHORT = LINES[:3]


def strokes(n, x=72.0, y=100.0, w=50.0, h=40.0):
    return [(f"d{i}", "drawing", x + w * i, y, x + w * i + w, y + h, 0) for i in range(n)]


#: Cases by name: lines of a document and what its page shows.
CASES = {
    "formula": (["Problem 1. Calculate the value.", "x^2 + y^2 = 25", "Find x when y = 3."], []),
    "near": (LINES, [("t", "table", 72.0, 100.0, 372.0, 140.0, 4), ("far", "table", 580.0, 700.0, 590.0, 800.0, 4), ("wide", "image", 0.0, 150.0, 560.0, 200.0, 0), (None, None, 0.0, 0.0, 1.0, 1.0, 0)]),
    "bound": (SHORT, [("low", "image", 500.0, 400.0, 520.0, 420.0, 0), ("near", "image", 500.0, 150.0, 520.0, 160.0, 0)]),
    "four": (LINES, strokes(4)),
    "three": (LINES, strokes(3)),
    "tiny": (LINES, strokes(4, w=2.0, h=10.0)),
    "hidden": (LINES, [*strokes(4), ("t", "table", 72.0, 100.0, 272.0, 140.0, 2)]),
    "beside": (LINES, [*strokes(4), ("t", "table", 72.0, 100.0, 372.0, 140.0, 2)]),
    "twice": (LINES, [("t", "image", 72.0, 100.0, 272.0, 140.0, 2)] * 2),
}


def test_artifacts_and_their_owners(spark, sheet):
    lines = None
    for d, (text, _) in enumerate(CASES.values()):
        own = sheet(*text, doc=d)
        lines = own if lines is None else lines.unionByName(own)
    shown = spark.createDataFrame([(d, 1, *v) for d, (_, visuals) in enumerate(CASES.values()) for v in visuals], VISUALS)
    got = {name: {} for name in CASES}
    for r in A.artifacts(shown, lines).collect():
        own = got[list(CASES)[r["doc"]]]
        assert r["source"] not in own
        own[r["source"]] = r
    formula = got["formula"].values()
    assert {r["kind"] for r in formula} == {"FORMULA"} and all(r["binding"] >= 0.9 and r["binding_reasons"] == ["owned_text_block"] for r in formula)
    # a task's kind names its tables; what lies below the next marker belongs to the next task
    near = got["near"]
    assert (near["t"]["task"], near["t"]["kind"], near["t"]["type_reason"]) == (1, "RESPONSE_TABLE", "task_kind_table")
    assert near["t"]["binding"] == 0.92 and near["t"]["binding_reasons"] == ["x_overlap", "body_overlap"] and near["t"]["confidence"] == 0.92
    assert near["wide"]["task"] == 2 and "far" not in near
    # aside and far below the body a box scores .18, aside and next to it .52
    assert set(got["bound"]) == {"near"} and got["bound"]["near"]["binding"] == 0.52
    four = got["four"]["drawings1"]
    assert (four["kind"], four["sources"], four["x1"]) == ("DIAGRAM", ["d0", "d1", "d2", "d3"], 272.0)
    # three are no group, nor are four on less than the area; a table over at least .70 of them hides them
    assert got["three"] == {} and got["tiny"] == {}
    assert set(got["hidden"]) == {"t"} and set(got["beside"]) == {"t", "drawings1"}
    assert len(got["twice"]) == 1


def test_edges_and_confidence(spark, sheet):
    lines = sheet("Task 1. Prove the claims about the map", "a) Find the first value.", "b) Using the previous answer, prove the claim.")
    shown = spark.createDataFrame([(1, 1, "m", "image", 72.0, 90.0, 272.0, 110.0, 0)], VISUALS)
    owned, tasks = A.artifacts(shown, lines), S.tasks(lines)
    body = tasks.select("doc", "section", "task", F.lit(False).alias("shared"), "body")
    kinds = [r["kind"] for r in S.composition(S.parts(lines), body, owned).collect()]
    assert sorted(kinds) == ["DEPENDS_ON", "OWNS_PART", "OWNS_PART", "USES_ARTIFACT", "USES_STIMULUS", "USES_STIMULUS"]
    assert "USES_STIMULUS" not in [r["kind"] for r in S.composition(S.parts(lines), body).collect()]
    r = A.reconstructed(tasks, owned, S.parts(lines)).first()
    assert (r["n_artifacts"], r["confidence"] <= 0.84) == (1, True)
    none = A.reconstructed(tasks, owned.limit(0)).first()
    assert (none["n_artifacts"], none["confidence"]) == (0, tasks.first()["confidence"])


def test_stripes_give_each_overlap_once(spark):
    rng = random.Random(1)
    make = lambda n: [(k % 3, k, a := rng.uniform(-100, 500), a + rng.choice([0, 0.5, 3, 70, 300])) for k in range(n)]
    left, right = make(60), make(60)
    pairs = A.overlapping(spark.createDataFrame(left, "p int, a int, t double, u double"), spark.createDataFrame(right, "p int, b int, v double, w double"), ["p"], ("t", "u"), ("v", "w"))
    want = sorted((a, b) for p, a, t, u in left for q, b, v, w in right if p == q and min(u, w) - max(t, v) > 1)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == want
