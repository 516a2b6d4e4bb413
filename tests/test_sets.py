"""Contracts, explorers, edited pieces, bodies and proposed sets: cases with known results."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import answers
from gleanery.operators import contracts as C
from gleanery.operators import dimensions
from gleanery.operators import edits as D
from gleanery.operators import evaluation as E

QUESTION = "question int, interaction string, status string, options array<struct<id:string>>, answer array<string>, tolerance int, knowledge array<string>, grade_min int, grade_max int"


def ids(*names):
    return [(n,) for n in names]


def test_drafts(spark):
    good = [
        (1, "single_choice", "draft", ids("a", "b"), ["a"], None, ["u"], 5, 6),
        (2, "multi_choice", "draft", ids("a", "b", "c"), ["a", "c"], None, ["u"], 5, 5),
        (3, "sequence", "draft", ids("a", "b"), ["b", "a"], None, ["u"], None, 6),
        (4, "numeric", "draft", None, ["7"], 0, ["u"], 1, 2),
    ]
    assert C.broken_drafts(spark.createDataFrame(good, QUESTION), ["interaction"]).isEmpty()
    bad = [
        (1, "single_choice", "published", ids("a", "a"), ["z"], None, [], 7, 6),
        (2, "multi_choice", "draft", ids("a", "b"), ["a"], None, ["u"], 1, 2),
        (3, "sequence", None, ids("a", "b"), ["a"], None, ["u"], 1, 2),
        (4, "numeric", "draft", ids("a"), None, None, None, 1, 2),
        (5, None, "draft", None, None, None, ["u"], 1, 2),
    ]
    got = {}
    for r in C.broken_drafts(spark.createDataFrame(bad, QUESTION), ["interaction"]).collect():
        got.setdefault(r["question"], set()).add(r["fault"])
    assert got == {
        1: {"published_directly", "no_knowledge", "grades_turned", "option_ids_repeat", "one_option_wanted"},
        2: {"several_options_wanted"},
        3: {"published_directly", "every_option_once"},
        4: {"options_of_a_number", "no_answer", "tolerance_not_exact", "no_knowledge"},
        5: {"missing:interaction"},
    }


def test_prompts_and_scripts(spark):
    rows = [(1, "What is  this?", ["a", "b"]), (2, "what is this", ["b", "a", "a"]), (3, "What is this?", ["a"]), (4, " ", ["a"]), (5, None, ["a"])]
    got = C.repeated_prompts(spark.createDataFrame(rows, "q int, p string, u array<string>"), "p", "u", "q").collect()
    assert [(r["units"], r["n"], r["first"]) for r in got] == [("a|b", 2, 1)]
    scripts = spark.createDataFrame([(1, "one two\n three"), (2, "one"), (3, "x y"), (4, None), (5, "left")], "k int, script string")
    segments = spark.createDataFrame([(1, 2, "three "), (1, 1, "one  two"), (1, 3, None), (2, 1, "won"), (3, 1, "x"), (3, 2, "y"), (9, 1, "z")], "k int, i int, text string")
    assert {(r["k"], r["fault"]) for r in C.other_scripts(scripts, segments, "k", "i").collect()} == {(2, "segments_differ"), (5, "no_segments")}


def test_answers_by_kind(spark):
    rows = [("sequence", [1, 2], [1, 2], True), ("sequence", [2, 1], [1, 2], False), ("multi_choice", [2, 1, 1], [1, 2], True), ("matching", [0, 2], [0, 2], True), ("matching", [0], [0, 2], False), ("matching", [None, 2], [None, 2], False), ("other", [1], [1], False), (None, [1], [1], False), ("sequence", None, [1], False)]
    df = spark.createDataFrame(rows, "k string, g array<int>, w array<int>, r boolean")
    assert df.where(answers.accepts(F.col("k"), F.col("g"), F.col("w")) != F.col("r")).isEmpty()


def test_explorer(spark):
    comps = spark.createDataFrame([(1, "Vega cup", ["m"], 2000, 2010), (2, "Other", ["e"], 2000, 2001)], "id int, name string, subject_ids array<string>, season_from int, season_to int")
    archives = spark.createDataFrame([(1, "Old papers", [1, 2]), (2, "Vega list", [2]), (3, None, [])], "id int, name string, competition_ids array<int>")
    seen = spark.createDataFrame([(1, "o one", "m", 2005), (2, "o two", "e", 2005), (3, None, None, None)], "id int, name string, subject string, season int")
    assets = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [3]), (3, "c", None)], "id int, name string, observation_ids array<int>")
    show = lambda **k: {(r["tab"], r["id"]) for r in C.explored(comps, archives, seen, assets, **k).collect()}
    assert len(show()) == 11
    assert show(subject="m") == {("competitions", "1"), ("archives", "1"), ("observations", "1"), ("assets", "1")}
    assert show(query=" VEGA ") == {("competitions", "1"), ("archives", "1"), ("archives", "2")}
    assert show(subject="e", year=2005) == {("archives", "1"), ("archives", "2"), ("observations", "2"), ("assets", "1")}


def test_presence_and_lemmas(spark):
    seen = spark.createDataFrame([(1, "a", "tasks", "DOWNLOADED"), (2, "b", "tasks", "DUPLICATE"), (3, None, "tasks", "DOWNLOADED"), (4, "a", "answers", "DOWNLOADED"), (5, "a", "tasks", "PENDING"), (6, "a", None, None)], "id int, asset_id string, role string, fetch_status string")
    assets = spark.createDataFrame([("a", True), ("a", True), ("b", None)], "asset_id string, has_raw_download boolean")
    got = {r["id"]: r["presence"] for r in C.observed_presence(seen, assets).collect()}
    assert got == {1: "raw", 2: "located", 3: "located", 4: "unknown", 5: "located", 6: "unknown"}
    entries = spark.createDataFrame([(1, "pear"), (2, "Apple"), (3, "fig")], "id int, lemma string")
    saved = spark.createDataFrame([(2,), (1,), (1,), (9,)], "id int")
    assert [r["lemma"] for r in C.saved_entries(entries, saved, "id", "lemma").collect()] == ["Apple", "pear"]


SECTIONS = "doc int, nth int, id string, label string, start int, end int, tasks array<string>, confidence double"
EDITS = "doc int, seq int, op string, at string"


def edited(spark, *edits):
    sections = spark.createDataFrame([(1, 1, "a", "A", 1, 3, ["t1", "t2", "t3"], 0.9), (1, 2, "b", "B", 4, 4, None, 0.6), (2, 1, "a", "Z", 1, 1, [], 0.5)], SECTIONS)
    got = D.pieces(sections, spark.createDataFrame([(1, k, *e) for k, e in enumerate(edits)], EDITS)).where("doc = 1").orderBy("nth").collect()
    return [(r["label"], r["start"], r["end"], r["tasks"], r["confidence"], r["confirmed"], r["corrected"]) for r in got]


@pytest.mark.parametrize(
    ("edits", "want"),
    [
        ([("accept", "a"), ("left", "a"), ("delete", "b")], [("A", 1, 3, ["t1", "t2", "t3"], 1.0, True, False)]),
        ([("left", "b"), ("right", "b"), ("delete", "a"), ("merge", "b"), ("split", "zz")], [("B", 3, 5, [], 0.6, False, True)]),
        ([("split", "a"), ("split", "b")], [("A A", 1, 2, ["t1", "t2"], 0.9, False, True), ("A B", 3, 3, ["t3"], 0.72, False, True), ("B", 4, 4, [], 0.6, False, False)]),
        ([("merge", "a"), ("accept", "b")], [("A + B", 1, 4, ["t1", "t2", "t3"], 0.9, False, True)]),
        ([("delete", "a"), ("delete", "b")], []),
    ],
)
def test_pieces(spark, edits, want):
    assert edited(spark, *edits) == want


def test_bodies(spark):
    sections = spark.createDataFrame([(1, 1, "Reading", "READING", 1, 1, ""), (2, 1, "Other", "READING", 1, 1, "")], "doc int, section int, label string, type string, page_start int, page_end int, quality string")
    tasks = "doc int, section int, task int, label string, number string, spans array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    box = lambda x: [(1, x, 2.0, 3.0, 4.0)]
    gold = spark.createDataFrame([(1, 1, 1, "", "1", box(1.0)), (1, 1, 2, "", "2", box(1.0)), (1, 1, 3, "", "3", None), (1, 1, 4, "", "4", box(1.0))], tasks)
    made = spark.createDataFrame([(1, 1, 1, "", "1", box(1.04) * 2, True), (1, 1, 2, "", "2", box(1.2), False), (1, 1, 3, "", "3", None, True)], f"{tasks}, has_blocks boolean")
    artifacts = spark.createDataFrame([(1, 1, 1, 1, "TABLE", 0.5), (1, 1, 1, 2, "TABLE", 0.6), (1, 1, 3, 1, "MAP", None), (1, 1, 9, 1, "MAP", 0.1)], "doc int, section int, task int, artifact int, kind string, binding double")
    got = {r["doc"]: tuple(r)[1:] for r in E.bodies((sections, gold), (sections, made, artifacts)).collect()}
    assert got == {1: (3, 1, 2, 1, 0.3333, 0.5, 0.55), 2: (0, 0, 0, 0, None, None, None)}


def test_edges_of_sets(spark):
    rows = [(k, f"{r}x-9.pdf" if k < 5 else "y.pdf", role, "math", "2020", "s", "9", "r", "t") for k, (r, role) in enumerate([("tasks-", "T"), ("ans-", "A"), ("ans-", "A"), ("", ""), ("tasks-", "T"), ("", "")])]
    df = spark.createDataFrame(rows, "asset int, filename string, role string, subject string, year string, stage string, grades string, region string, tour string")
    got = {r["asset"]: (r["paired_with"], r["confidence"], "complementary_roles" in r["signals"]) for r in E.edge_proposals(df).collect()}
    assert got == {0: (1, 1.0, True), 1: (0, 1.0, True), 2: (0, 1.0, True), 3: (0, 0.95, False), 4: (1, 1.0, True)}
    assert sorted(r["n_assets"] for r in E.problemsets(df).collect()) == [1, 5]
    with pytest.raises(ValueError):
        E.edge_proposals(df, 0.5)


def test_registry(spark):
    subjects = spark.createDataFrame([("m",), ("m",), ("e",)], "id string")
    rows = [("good", ["m", "e"], 2000, 2001, ["a", "b"], ["https://x"], ["s"]), ("bad", ["z"], 2002, 2001, ["a", "a"], ["http://x", None], [""]), ("bare", None, None, 2001, None, None, None), ("good", ["m"], 1, 1, ["a"], [], [])]
    comps = spark.createDataFrame(rows, "id string, subject_ids array<string>, season_from int, season_to int, stages array<string>, links array<string>, source_ids array<string>")
    got = {(r["id"], r["fault"]) for r in C.registry_faults(subjects, comps).collect()}
    assert got == {
        ("m", "subject_repeats"), ("good", "competition_repeats"), ("bad", "unknown_subject"), ("bad", "seasons_turned"), ("bad", "stages_missing_or_repeated"),
        ("bad", "link_without_https"), ("bad", "empty_source"), ("bare", "seasons_turned"), ("bare", "stages_missing_or_repeated"),
    }


def test_packs(spark):
    make = spark.createDataFrame
    packs = make([(1, True, "l"), (2, True, "x"), (3, False, None), (4, True, None)], "pack_id int, enabled boolean, licence_id string")
    grants = make([([1, 4], True), ([2], False), (None, True)], "pack_ids array<int>, active boolean")
    licences = make([("l", "licensed", True, True, ["ru"]), ("x", "licensed", True, False, ["ru"])], "licence_id string, rights_type string, active boolean, distribution_allowed boolean, territories array<string>")
    blueprint = make([(1, "u", 0.5), (1, "v", 0.5), (2, "u", 0.0), (2, "u", 1.0), (3, "zz", None)], "pack_id int, unit string, weight double")
    questions = make([(1, ["u", "v"]), (2, ["w"])], "pack_id int, knowledge array<string>")
    got = {tuple(r) for r in C.pack_faults(packs, grants, licences, make([(1,), (2,)], "pack_id int"), blueprint, questions, make([("u",)], "unit string")).collect()}
    assert got == {
        (2, "no_grant", ""), (2, "no_licence", "x"), (4, "no_licence", ""), (4, "no_target", ""), (4, "no_blueprint", ""), (2, "unit_repeats", "u"), (1, "unknown_unit", "v"), (2, "unit_not_asked_for", "u"), (2, "weight_not_positive", "u"),
    }


def test_dimensions(spark):
    rows = [("a", "A", 1, ["b"]), ("b", "", 2, ["b"]), ("c", "C", 9, ["zz"]), ("c", "C2", None, None), (None, "N", 1, []), ("d", "D", 1, ["a", "b", None])]
    df = spark.createDataFrame(rows, "unit string, label string, ref int, needs array<string>")
    known = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    good, bad = dimensions.loaded(df, "unit", ["label"], {"ref": (known, "id")}, ["needs"])
    assert sorted(r["unit"] for r in good.collect()) == ["a", "d"] and good.columns == df.columns
    assert {(r["unit"], r["label"], *r["faults"]) for r in bad.collect()} == {("b", "", "missing:label", "itself:needs"), ("c", "C", "repeated", "unknown:ref", "unknown:needs"), ("c", "C2", "repeated"), (None, "N", "missing:unit")}
    empty = dimensions.loaded(df.limit(0), "unit", [], {}, [])
    assert [x.count() for x in empty] == [0, 0]
