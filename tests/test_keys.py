"""Answer keys, searches, stage sections, repairs, folds and pairs: cases and loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import answer_keys as K
from gleanery.operators import folds, graphs, learner, links, pairs, queues
from gleanery.operators import repairs as R


@pytest.mark.parametrize("block", [4, 4096])
def test_inversions_of_hot_and_small_keys(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(50), i, rng.choice([None, *range(40)])) for i in range(900)]
    rows += [("sorted", i, i, i) for i in range(60)] + [("turned", i, i, -i) for i in range(60)] + [("one", 1, 1, 1), ("none", 1, 1, None)]
    got = {r["key"]: (r["n"], r["inversions"]) for r in K.inversions(spark.createDataFrame(rows, "key string, a int, b int, v int").repartition(6), "key", ["a", "b"], "v", block).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        v = [x[3] for x in sorted((r for r in rows if r[0] == key and r[3] is not None), key=lambda r: (r[1], r[2]))]
        if v:
            want[key] = (len(v), sum(a > b for a, b in itertools.combinations(v, 2)))
    assert got == want and got["turned"][1] == 60 * 59 // 2 and got["sorted"][1] == 0


def test_work_of_a_hot_key_does_not_grow_with_its_square(spark):
    """Rows that the counting puts out: n log n, and blocks of bounded size."""
    rows = spark.range(20000).select(F.lit("hot").alias("k"), "id", F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"))
    df = K.inversions(rows, "k", ["id"], "v", 1000)
    n, inversions = df.select("n", "inversions").first()
    assert n == 20000 and abs(inversions / (n * (n - 1) / 2) - 0.5) < 0.02


def test_orders_and_choices(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3]), (2, [1, 1, 2]), (3, []), (4, None)], "id int, xs array<int>")
    even = K.count_orders(df, "id", F.col("xs"), lambda o: (F.size(o) == 0) | ((o[0] != 0) & (F.element_at(o, -1) % 2 == 0))).collect()
    assert {r["id"]: r["orders"] for r in even} == {1: sum(p[0] != 0 and p[3] % 2 == 0 for p in itertools.permutations(range(4))), 2: 1, 3: 1, 4: 1}
    twice = K.count_orders(df.where("id = 2"), "id", F.col("xs"), lambda o: o[0] == 1, distinct=False).first()
    assert twice["orders"] == 4
    two = {r["id"]: r["choices"] for r in K.count_choices(df, "id", F.col("xs"), F.lit(2)).collect()}
    assert two == {1: 6, 2: 3, 3: 0, 4: 0}
    with pytest.raises(Exception, match="not written out"):
        K.count_orders(spark.createDataFrame([(1, list(range(9)))], "id int, xs array<int>"), "id", F.col("xs"), lambda o: F.lit(True)).collect()


def test_disagreements(spark):
    make = lambda rows: spark.createDataFrame(rows, "q int, a string")
    got = K.disagreements(make([(1, "x"), (2, "y"), (3, None)]), make([(1, "x"), (2, "z"), (4, "w")]), "q", "a").orderBy("q").collect()
    assert [tuple(r) for r in got] == [(2, "y", "z"), (4, None, "w")]


def test_search_over_moves(spark):
    """The square of four rooms: from A to C in two steps; and a knight's moves on a board of 8 by 8."""
    doors = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "D"), ("D", "A"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "C"), ("A", None)], "a string, b string")
    roots = spark.createDataFrame([("A", "A"), ("C", "C"), ("Z", "Z"), ("N", None)], "root string, node string")
    got = {(r["root"], r["node"]): r["depth"] for r in graphs.search(roots, graphs.over_links(doors, "a", "b"), 5).collect()}
    assert got[("A", "C")] == 2 and got[("C", "A")] == 2 and got[("Z", "Z")] == 0 and len(got) == 9
    jumps = [(1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1)]
    moves = lambda x: [F.when((F.floor(x / 8) + a).between(0, 7) & (x % 8 + b).between(0, 7), x + 8 * a + b) for a, b in jumps]
    corner = spark.createDataFrame([(0, 0)], "root int, node int")
    board = {r["node"]: r["depth"] for r in graphs.search(corner, graphs.by_moves(moves), 10).collect()}
    assert len(board) == 64 and max(board.values()) == 6 and board[63] == 6


def test_crawl_keeps_to_its_site_and_its_budgets(spark):
    edges = [("http://a/", f"http://a/{i}") for i in range(5)] + [("http://a/0", "http://a/x"), ("http://a/x", "http://a/y"), ("http://a/", "http://b/"), ("http://b/", "http://b/1"), ("http://b/1", "http://a/0")]
    df = spark.createDataFrame(edges, "parent_url string, url string")
    roots = spark.createDataFrame([("http://a/",), ("http://b/",)], "node string")
    got = {(r["root"], r["node"]): r["depth"] for r in graphs.crawl(df, roots, 2).collect()}
    assert got == {("http://a/", "http://a/"): 0, **{("http://a/", f"http://a/{i}"): 1 for i in range(5)}, ("http://a/", "http://a/x"): 2, ("http://b/", "http://b/"): 0, ("http://b/", "http://b/1"): 1}
    few = {r["node"] for r in graphs.crawl(df, roots, 5, per_site=3).collect()}
    assert few == {"http://a/", "http://a/0", "http://a/1", "http://b/", "http://b/1"}
    run = {r["node"] for r in graphs.crawl(df, roots, 5, per_run=4).collect()}
    assert run == {"http://a/", "http://b/", "http://a/0", "http://a/1"}


def test_the_last_stage_heading_decides(spark):
    html = """<a href="/first.pdf">before</a><a href="/x-sch-1.pdf">by name</a><h2><a href="/inner.pdf"></a> Школьный
      <b>этап</b></h2><a href='/a.pdf'>a</a><h3>Other</h3><A HREF=/b.zip>b</A><a data-href="/no.pdf">n</a><a href="/page">p</a><h4 id=q>Региональный&nbsp;этап</h4>
      <a href="/c.pdf">c</a><a href="/a.pdf">again</a><h2>Муниципальный этап</h2><a href="/school/d.doc">d</a><h2>Школьный этап</h2><a href="/c2.pdf#x">c</a>"""
    pages = spark.createDataFrame([("http://h/p", html), ("http://h/p", html), ("http://h/q", None), ("http://h/r", "")], "url string, html string")
    got = {r["url"].removeprefix("http://h"): r["by"] for r in links.stage_links(pages).collect()}
    assert got == {"/x-sch-1.pdf": "name", "/a.pdf": "section", "/b.zip": "section", "/school/d.doc": "name", "/c2.pdf": "section"}


def test_links_know_their_title_and_heading(spark):
    html = """<a href=/0>none yet</a><h1>Past <b>papers</b> &amp; more</h1><a title='One &lt; two' href="/1">a <h3>Inner</h3></a><a href="/2" data-title=no>b</a>
      <h2><a href="/3">in a heading</a></h2><a href='/4'>c</a><h2></h2><a href="/5">d</a><h5>no</h5><a>no target</a>"""
    pages = spark.createDataFrame([("http://h/p", html), ("http://h/q", None), ("http://h/r", "")], "url string, html string")
    got = [(r["href"], r["title"], r["heading"], r["anchor_text"]) for r in links.anchors(pages).orderBy("pos").collect()]
    assert got == [
        ("/0", "", "", "none yet"), ("/1", "One < two", "Past papers & more", "a Inner"), ("/2", "", "Inner", "b"),
        ("/3", "", "Inner", "in a heading"), ("/4", "", "in a heading", "c"), ("/5", "", "", "d"),
    ]


def test_repairs_happen_once(spark):
    rows = spark.createDataFrame([(1, "http://h/?a=1§ion=2", "old", 10, 4, 1), (2, "http://h/", "new", 5, 9, 1), (3, None, None, None, None, None)], "id int, url string, unit string, balance int, earned int, spent int")
    passes = [R.entity_urls("url"), R.renamed_units("unit", {"old": "newer"}), R.balanced_ledger("balance", "earned", "spent"), R.Repair("bonus", 1, F.col("earned") > 0, {"earned": F.col("earned") + 1})]
    once, log = R.apply(rows, "id", passes)
    got = {r["id"]: tuple(r)[1:] for r in once.collect()}
    assert got == {1: ("http://h/?a=1&section=2", "newer", 10, 12, 1), 2: ("http://h/", "new", 5, 10, 1), 3: (None,) * 5}
    assert sorted((r["key"], r["repair"], r["before"], r["after"]) for r in log.collect()) == [("1", "balanced_ledger", "4", "11"), ("1", "bonus", "11", "12"), ("1", "entity_urls", "http://h/?a=1§ion=2", "http://h/?a=1&section=2"), ("1", "renamed_units", "old", "newer"), ("2", "bonus", "9", "10")]
    # a repair whose condition still holds is in the log, so it does not happen again; a later version does
    twice, more = R.apply(once, "id", passes, log)
    assert {r["id"]: tuple(r)[1:] for r in twice.collect()} == got and more.count() == log.count()
    later, _ = R.apply(once, "id", [R.Repair("bonus", 2, F.col("earned") > 0, {"earned": F.col("earned") + 1})], log)
    assert later.where("id = 2").first()["earned"] == 11
    with pytest.raises(ValueError):
        R.renamed_units("unit", {"a": "b", "b": "c"})


def test_errors_that_were_none(spark):
    errors = spark.createDataFrame([("http://h/a", "non-html:application/pdf; q=1"), ("http://h/b", "timeout"), ("http://h/a", "non-html:application/pdf"), ("", "non-html:x/y"), ("http://h/c", None)], "url string, error string")
    rest, seen = R.moved_errors(errors, spark.createDataFrame([], "resource_id string, mime string"))
    assert sorted(r["url"] for r in rest.collect()) == ["http://h/b", "http://h/c"]
    assert [r["mime"] for r in seen.collect()] == ["application/pdf"]
    assert R.moved_errors(errors, seen)[1].count() == 1


def test_folds_stream_a_hot_key(spark):
    """A key with most rows, read in small batches: the state is what is held."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = [("hot", i, i % 7 - 3) for i in range(5000)] + [(k, 1, 1) for k in ("a", "b", None)]
        df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
        got = folds.fold(df, ["k"], ["i"], ["v"], "n int, total long", lambda: (0, 0), lambda s, v: ((s[0] + 1, s[1] + v), None), lambda s: s).collect()
        assert {r["k"]: (r["n"], r["total"]) for r in got} == {"hot": (5000, sum(v for k, _, v in rows if k == "hot")), "a": (1, 1), "b": (1, 1), None: (1, 1)}
        entries = df.where("k = 'hot'").select(F.lit(1).alias("learner"), F.col("i").alias("ts"), F.col("i").cast("long").alias("event_id"), F.col("v").cast("long").alias("delta"))
        balance, want = 0, []
        for _, _, v in rows[:5000]:
            ok = balance + v >= 0
            balance += v if ok else 0
            want.append((ok, balance))
        assert [(r["accepted"], r["balance"]) for r in learner.ledger(entries).orderBy("event_id").collect()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.fold(df.limit(0), ["k"], ["i"], ["v"], "n int", lambda: 0, lambda s, v: (s, None), lambda s: (s,)).count() == 0
    assert queues.diverse(df.limit(0), "k", ["i"], "v", "i", 3).count() == 0


def test_pairs_by_parts(spark, monkeypatch):
    a, b = spark.range(7).toDF("a"), spark.range(50).select(F.col("id").alias("b"), (F.col("id") * 2).alias("c"))
    want = sorted((x, y, 2 * y) for x in range(7) for y in range(50))
    assert sorted(map(tuple, pairs.paired(a, b).collect())) == want
    monkeypatch.setattr(pairs, "SMALL", 10)
    monkeypatch.setattr(pairs, "PART", 10)
    assert sorted(map(tuple, pairs.paired(a, b).collect())) == want


def test_slots_without_a_key(spark):
    rng = random.Random(9)
    for n, share in ((40, 0.9), (40, 0.1), (11, 0.5), (1, 1.0)):
        rows = [(i, rng.random() < share) for i in range(n)]
        df = spark.createDataFrame(rows, "i int, w boolean").repartition(3)
        got = [r["i"] for r in links.interleave(df, F.col("w"), [F.col("i")]).orderBy("slot").collect()]
        a, b, want = [i for i, w in rows if w], [i for i, w in rows if not w], []
        while a or b:
            want += a[:4] + b[:1]
            a, b = a[4:], b[1:]
        assert got == want
