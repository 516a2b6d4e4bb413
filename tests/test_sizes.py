"""What keeps queries within their memory and time on large tables: plans and sizes, and the same results as plain ways."""

import itertools

from pyspark.sql import functions as F

from gleanery.sources import folders


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_stored_tables_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    small = folders.checkpointed(rows)
    assert "BroadcastHashJoin" in plan(rows.join(small.select("id"), "id"))
    monkeypatch.setattr(folders, "SENT", 0)
    large = folders.checkpointed(rows)
    for other in (large.select("id"), large.groupBy("id").count(), large.where("n = 1").select("id").distinct()):
        got = rows.join(other, "id", "left")
        assert "BroadcastHashJoin" not in plan(got) and got.count() == 1000
    folders.discard(small, large)


def test_cycles_of_long_chains_need_no_closure(spark, monkeypatch):
    from gleanery.operators import quality

    chain = spark.range(400).select(F.col("id").alias("x"), F.when(F.col("id") == 0, 2).otherwise(F.col("id") - 1).alias("y"))
    ends = spark.createDataFrame([(1000, 1001), (1001, 1002), (2000, 2000), (None, 3), (3000, None)], "x long, y long")
    forked = ends.unionByName(spark.createDataFrame([(1, 2), (2, 1), (1, 5), (5, 6)], "x long, y long"))
    assert {r["node"] for r in quality.on_cycle(forked, "x", "y").collect()} == {1, 2, 2000}
    monkeypatch.setattr(quality, "closure", None)
    got = [r["node"] for r in quality.on_cycle(chain.unionByName(ends), "x", "y").collect()]
    assert sorted(got) == [0, 1, 2, 2000]
    assert quality.on_cycle(ends.limit(2), "x", "y").isEmpty()


def test_orders_are_counted_in_their_row(spark):
    from gleanery.operators import answer_keys as K

    items = {1: [3, 0, 3, 2], 2: [1], 3: [], 4: [5, 5, 5], 5: [0, None, 2], 6: [4, 1, 2, 8, 6], 7: None}
    rows = spark.createDataFrame([*items.items(), (1, [0, 2, 3, 3]), (2, [2, 4]), (None, [2, 3])], "k long, items array<int>")
    items[None] = [2, 3]
    holds = lambda o: F.element_at(o, -1) % 2 == 0
    want = {k: len({p for p in itertools.permutations(v) if p[-1] is not None and p[-1] % 2 == 0}) for k, v in items.items() if v}
    want[2] += 2  # those of [2, 4]
    got = K.count_orders(rows.where("size(items) > 0"), "k", F.col("items"), holds)
    assert {r["k"]: r["orders"] for r in got.collect()} == want
    assert [x["orders"] for x in K.count_orders(rows.where("k in (3, 7)"), "k", F.col("items"), lambda o: F.size(o) == 0).collect()] == [1, 1]
    every = K.count_orders(rows.where("k = 4"), "k", F.col("items"), lambda o: F.lit(True), distinct=False)
    assert every.first()["orders"] == 6
    assert "Generate" not in plan(got)


def test_sheet_lines_are_dealt_out_by_their_number(spark, monkeypatch):
    from gleanery.plans import sheets

    monkeypatch.setattr(sheets, "DEALT", 50)
    assert sheets.sheet_lines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1500 // 50


def test_words_are_summed_in_their_row(spark):
    from gleanery.operators import records as R

    texts = {1: "Don’t stop--now, 'tis Ann's  ann ANN'S", 2: "12 ... жук", 3: "", 4: None, 5: "a", None: "x-y éa b" * 50, 6: " ’ z' Z’s z"}
    rows = spark.createDataFrame([*texts.items()], "k long, text string")
    got = R.word_sums(rows, "k", "text")
    plain = R.tokens(rows, "k", "text").groupBy("k").agg(F.count(F.lit(1)).alias("tokens"), F.sum("start").alias("starts"), F.max("token").alias("last"), F.countDistinct(R.normal_word(F.col("token"))).alias("forms"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.count() == 4
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert "Generate" not in plan(got)
    assert {r["k"]: r["forms"] for r in R.word_sums(rows.unionByName(spark.createDataFrame([(5, "b A")], rows.schema)), "k", "text").collect()}[5] == 2


def test_lines_of_tasks_are_found_once(spark, monkeypatch):
    from gleanery.operators import sheets as S
    from gleanery.plans import artifacts, sheets

    made = {"in_tasks": [], "blocks": []}
    for name, calls in made.items():
        monkeypatch.setattr(S, name, lambda *rows, f=getattr(S, name), calls=calls: calls.append(1) or f(*rows))
    for query in (sheets.sheet_tasks, artifacts.artifact_edges):
        query(spark, "/root/testdata/sf0.001")
        assert [len(x) for x in made.values()] == [1, 1], query.__name__
        for calls in made.values():
            calls.clear()


def test_patterns_are_sought_once_a_text(spark):
    from gleanery.functions import reasoning, texts

    rows = spark.range(3).select(F.concat(F.lit("a = b � | "), F.col("id")).alias("t"))
    c = texts.confidence(F.col("t"), F.lit(False), F.col("t").contains("|"), F.lit(None).cast("boolean"))
    got = rows.select(c.alias("c")).select("c.score", "c.status", "c.reasons")
    assert plan(got).count("sin|cos|tg|ctg") == 1
    assert [tuple(r) for r in got.collect()] == [(0.97 - 0.28 - 0.32 - 0.14 - 0.08, "needs_human", "very_short_text,broken_glyphs,vector_drawing,formula_heavy")] * 3
    rubric = {"q": reasoning.Rubric("10", [[{"15/3=5"}, {"5*2=10"}]])}
    said = rows.select(F.concat(F.lit("Fifteen divided by 3 equals 5 and five times two = 010, onetime 7 / 0 = 7; "), F.length("t") - 10, F.lit(" * 6 / 2 = 3")).alias("t"))
    a = reasoning.assess(F.lit("q"), F.lit(True), F.col("t"), rubric)
    got = said.select(a.alias("a")).select("a.status", "a.evidence", "a.contradictions")
    assert plan(got).count("regexp_extract_all") == 1
    assert [tuple(r) for r in got.collect()] == [("incorrect_reasoning", ["15 / 3 = 5", "5 * 2 = 010", "1 * 6 / 2 = 3"], ["7 / 0 = 7"])] * 3


def test_observations_are_read_once_for_their_edges(spark):
    from gleanery.operators import network as N

    names = ("id", "site", "page", "asset", "competition")
    seen = spark.range(4).select(*[F.when(F.col("id") % (k + 2) > 0, F.concat(F.lit(n), "id")).alias(n) for k, n in enumerate(names)])
    held = spark.createDataFrame([("a", "h", ["c1", "c2"])], "id string, host string, competitions array<string>")
    got = N.edges(held, seen)
    assert plan(got).count("Range (0, 4") == 1
    want = {(r["id"], kind, t) for r in seen.collect() for kind, t in (("AT_SITE", r["site"]), ("FOUND_ON", r["page"]), ("HAS_ASSET", r["asset"]), ("BELONGS_TO", r["competition"] and f"competition_{r['competition']}")) if r["id"] and t}
    assert {tuple(r) for r in got.collect() if r["kind"] not in ("HOSTS", "ARCHIVE_OF")} == want and got.count() == len(want) + 3


def test_pairs_are_grouped_where_they_lie(spark):
    from gleanery.operators import evaluation as E

    side = lambda rows, c: spark.createDataFrame(rows, f"doc long, key string, n long, {c} string")
    gold = side([(1, "a", 1, "g1"), (1, "a", 2, "g2"), (1, "b", 1, None), (2, "a", 1, "g4"), (None, "a", 1, "g5")], "x").repartition("doc")
    made = side([(1, "a", 7, "m1"), (1, "b", 3, None), (1, "b", 4, "m3"), (3, "a", 1, "m4"), (None, "a", 1, "m5")], "y").repartition("doc")
    got = E.paired(gold, made, ["doc"], "key", "n")
    assert "Join" not in plan(got)
    assert got.columns == ["doc", "key", "n", "x", "m_n", "m_y"]
    want = {(1, "a", 1, "g1", 7, "m1"), (1, "a", 2, "g2", None, None), (1, "b", 1, None, 3, None), (2, "a", 1, "g4", None, None), (None, "a", 1, "g5", None, None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 5


def test_kinds_of_long_texts_take_one_pass(spark):
    """Pieces that may come in any number are not sought again from each of the places before them: that took the cube of the text."""
    from gleanery.functions import profile as P

    pieces = {"TRUE_FALSE": "not stated " + "true false " * 20000, "ORDERING": "right order " + "put " * 20000 + "arrange order", "UNKNOWN": "meaning second sentence " + "complete put " * 20000}
    got = spark.createDataFrame([*pieces.items()], "want string, t string").select("want", P.kind(F.col("t")).alias("kind")).collect()
    assert len(got) == 3 and all(r["want"] == r["kind"] for r in got)


def test_kinds_are_those_of_the_patterns(spark):
    import random

    from gleanery.functions import profile as P

    rng = random.Random(5)
    bits = "choose all|select two|correct|TRUE (a)|true|false|not stated|complete the form|fill in the table|key word|complete|second sentence|meaning|similar meaning|form a word|use the word given|idiom|idioms|match|matchbox|which paragraph|put|right order|arrange|order|decide which answer|fits each gap|best fits|gap|one word for each gap|choose a option|choose A, B|, answer|question|choose the answer (A|give short answer|fill gaps|write your essay|(10 – 20 words)|words)|prove|proven|algorithm|speak|speaker|find value|выберите все|верно|укажите все верные|заполните таблицу|соотнесите|расположите|порядке|выберите один правильный ответ|ответьте на вопрос|докажите|алгоритм|диалог|найдите число|the|-".split("|")
    other = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a", "в": "\u1c80", "д": "\u1c81", "о": "\u1c82", "с": "\u1c83", "т": "\u1c84\u1c85"}
    case = [str, str.upper, str.title, lambda x: "".join(rng.choice(other.get(c, c) + c) for c in x)]
    texts = [rng.choice(case)("".join(rng.choice(bits) + rng.choice([" ", "  ", "\n", "-\n", "", "\u00a0", "\u2003\t"]) for _ in range(rng.choice([1, 2, 3, 5, 8])))) for _ in range(4000)]
    t = F.col("t")
    joined = F.regexp_replace(t, r"([A-Za-zА-Яа-яЁё])-\s*\n\s*([A-Za-zА-Яа-яЁё])", "$1$2")
    clean = F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))
    plain = P.cascade([(P.found(F.col("c"), p, across), k) for k, across, p in P.KINDS], "UNKNOWN")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", clean.alias("c")).select("t", "c", plain.alias("want"), P.kind(t).alias("got"), P.instruction(t).alias("i"))
    assert rows.where("want <> got or c <> i").head(3) == [] and rows.select("want").distinct().count() == 21
    assert set(P.WORDS) == {k for k, _, _ in P.KINDS} and set(P.ORDERED) == {k for k, across, _ in P.KINDS if across}


def test_inversions_of_small_keys_take_no_row_for_each_bit(spark):
    import random

    from gleanery.operators import answer_keys as K

    rng = random.Random(9)
    rows = [(rng.choice([*range(30), None]), i, float(rng.randrange(200))) for i in range(6000)] + [(99, i, -float(i)) for i in range(25000)]
    got = K.inversions(spark.createDataFrame(rows, "k int, i int, v double").repartition(5), "k", ["i"], "v")
    assert "Generate" not in plan(got) and "explode" not in plan(got)
    want = {k: [v for x, _, v in rows if x == k] for k in {r[0] for r in rows} - {99}}
    want = {k: (len(v), sum(a > b for a, b in itertools.combinations(v, 2))) for k, v in want.items()} | {99: (25000, 25000 * 24999 // 2)}
    assert {r["k"]: (r["n"], r["inversions"]) for r in got.collect()} == want


def test_large_and_small_keys_count_alike(spark):
    from gleanery.operators import answer_keys as K

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("k"), "id", F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"))
    want = sorted(map(tuple, K.inversions(rows, "k", ["id"], "v").collect()))
    assert len(want) == 31
    for block in (1, 2, 33, 64, 1999, 2000):
        assert sorted(map(tuple, K.inversions(rows, "k", ["id"], "v", block).collect())) == want, block


def test_lines_are_dealt_out_once_for_their_evaluation(spark, monkeypatch):
    """Sections, tasks and artifacts of both sides come of one shuffle of the lines, in parts by their number: each had its own, and pairs of them had more."""
    from gleanery.plans import evaluation, sets

    monkeypatch.setattr(evaluation, "DEALT", 500)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for query in (evaluation.calibration_documents, sets.body_metrics):
        got = query(spark, "/root/testdata/sf0.001")
        assert plan(got).count("Exchange ") == 1 and "Join" not in plan(got), query.__name__
        assert got.rdd.getNumPartitions() == lines // 500
    assert plan(evaluation.calibration_micro(spark, "/root/testdata/sf0.001")).count("Exchange ") == 2


def test_evaluations_of_three_tables_shuffle_each_once(spark):
    from gleanery.operators import evaluation as E

    sections = "doc int, section int, label string, type string, page_start int, page_end int, quality string"
    tasks = "doc int, section int, task int, label string, number string, kind string, page_start int, page_end int, quality string, review boolean"
    artifacts = "doc int, section int, task int, artifact int, kind string"
    make = spark.createDataFrame
    gold = (
        make([(1, 1, "A", "READING", 1, 2, ""), (1, 2, "B", "READING", 3, 3, ""), (1, 3, "Part 1", None, 4, 4, E.UNSURE), (2, 1, "A", "READING", 1, 1, ""), (None, 1, "A", "READING", 1, 1, "")], sections),
        make([(1, 1, 1, "", "1", "K1", 1, 1, "", None), (1, 1, 2, "Task 1", "", "UNKNOWN", 2, 2, "", None), (1, 2, 1, "x", None, "K2", 3, 3, E.UNSURE, None), (1, 9, 1, "", "1", "K1", 1, 1, "", None), (None, 1, 1, "", "1", "K1", 1, 1, "", None)], tasks),
        make([(1, 1, 1, 2, "MAP"), (1, 1, 1, 1, "FORM"), (1, 1, 2, 1, "MAP"), (1, 2, 1, 1, "TABLE")], artifacts),
    )
    made = (
        make([(1, 7, "z", "reading", 1, 2, None), (1, 8, "z", "Reading", 3, 4, None), (1, 5, "part-1", "UNKNOWN", 9, 9, None), (3, 1, "A", "READING", 1, 1, ""), (None, 1, "A", "READING", 1, 1, "")], sections),
        make([(1, 7, 4, "", " 1", "K1", 1, 1, "", True), (1, 7, 5, "", "1", "K9", 2, 3, "", False), (1, 8, 1, "X", "", "K3", 1, 1, "", None), (1, 9, 1, "", "1", "K1", 1, 1, "", True), (None, 1, 1, "", "1", "K1", 1, 1, "", True)], tasks),
        make([(1, 7, 4, 1, "MAP"), (1, 7, 4, 2, "GRID"), (1, 8, 1, 1, "FORM"), (1, 9, 1, 1, "MAP")], artifacts),
    )
    got = E.evaluate(gold, made)
    assert plan(got).count("Exchange ") == 1 and "Join" not in plan(got)
    rows = {r["doc"]: r.asDict() for r in got.collect()}
    counts = ("sections", "section_hits", "section_spans", "section_spans_ok", "tasks", "task_hits", "task_spans", "task_spans_ok", "kinds", "kinds_ok", "to_review", "artifacts", "artifact_hits")
    assert {k: [r[c] for c in counts] for k, r in rows.items()} == {1: [3, 3, 2, 1, 4, 3, 2, 1, 2, 1, 1, 4, 2], 2: [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]}
    assert rows[1]["task_recall"] == 0.75 and rows[2]["task_recall"] is None and not rows[1]["reviewable"]
