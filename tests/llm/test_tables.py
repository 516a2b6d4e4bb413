"""Sharding, neighbours, language model, joins and substrings."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import components, jaccard, neighbours, sharding, substrings
from gleanery.llm import language_model as lm
from gleanery.llm import words as W
from gleanery.llm.components import connected
from tests.llm.conftest import ODD


def near(text, rng, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(a) == set(range(24)) and ((a == b) | (b == 24)).all()
    assert abs((b == 24).mean() - 1 / 25) < 0.01


def test_slots_are_gapless(spark, make_docs):
    docs = make_docs([*ODD, *[(i, f"t{i}") for i in range(300)], *[(7, "hot")] * 200]).select("doc_id", "text", F.lit("x").alias("slot0"))
    rows = sharding.slots(sharding.assign(docs, "doc_id", 5), ["doc_id", "text"], parts=4).collect()
    assert len(rows) == len(ODD) + 500
    for s in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.slots(sharding.assign(docs.limit(0)), ["doc_id", "text"]).count() == 0


@pytest.fixture(scope="module")
def copies(prose):
    rng = random.Random(8)
    base = [prose(rng.randint(20, 120), k) for k in range(8)]
    texts = [(i, near(base[i % 8], rng, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))) for i in range(120)]
    texts += [(200 + k, prose(60, 900 + k) + " " + base[0]) for k in range(10)] + [(300, "a b c"), (301, "A b C"), (302, "a b"), (303, base[1]), (304, base[1])]
    return texts + ODD


def brute_classes(texts):
    sets = []
    for _, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split(" ")
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(texts):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((str(k), len(sets[i]), str(k if not sets[i] else least.get(find(i)))) for i, (k, _) in enumerate(texts))


@pytest.mark.parametrize(("seeds", "block"), [(8, 4096), (1, 3)])
def test_classes_are_brute_force(spark, make_docs, copies, seeds, block, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 20)  # some leads are split
    full = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda sigs: full(sigs, seeds, block))
    docs = make_docs(copies).selectExpr("*", "1 as n_shingles", "2 as unit", "3 as n")
    rows = jaccard.classes(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == brute_classes(copies)
    assert all(r["unit"] == 2 and r["n"] == 3 for r in rows)


def test_classes_of_nothing(make_docs):
    assert jaccard.classes(make_docs([(1, "x")]).limit(0)).count() == 0
    assert [r["component_id"] for r in jaccard.classes(make_docs([(5, None)])).collect()] == [5]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_classes_of_few_short_texts(make_docs, n):
    texts = [(1, "a b c d e f g"), (2, "a b c d"), (3, "A b c d e f g h")][:n]
    rows = jaccard.classes(make_docs(texts)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == brute_classes(texts)


def test_questions_of_one_key():
    u = jaccard.Units(jaccard.pa.table({"unit": [b"x", b"y"], "text": ["a b c d e f g", "a b c d"]}))
    asked = dict(u.questions(1000))
    assert len(asked) == len(u.keys) == 4
    assert all(got is None for p in asked.values() for got in jaccard._count([p]))
    assert all(got is not None for p in asked.values() for got in jaccard._count([p, p]))


def test_like_vectors_share_nodes_and_others_are_pruned():
    rng = np.random.default_rng(3)
    heads = rng.poisson(1, (16, jaccard.GROUPS))
    v = np.repeat(heads, 32, axis=0)
    for x in v:
        x[rng.integers(0, jaccard.GROUPS, 3)] += 1
    v = rng.permutation(v).astype(np.int64)
    alone = np.arange(len(v))
    order = jaccard.packed(v, alone)
    assert sorted(order) == alone.tolist()
    size = v.sum(1)
    tree = jaccard.Tree(v[order], size[order], size[order], alone[order])
    for q in range(0, len(v), 8):
        tree.search(v[q], size[q], size[q], q)
    assert tree.visited < 0.5 * len(v) * len(range(0, len(v), 8))
    one = jaccard.packed(v, np.repeat([0, 1], len(v) // 2))
    assert (one[: len(v) // 2] < len(v) // 2).all()


def test_tree_finds_all_that_pass_the_bound():
    rng = np.random.default_rng(2)
    v = rng.poisson(2, (300, jaccard.GROUPS)).astype(np.int64)
    v[100:200] = np.maximum(0, v[0] + rng.integers(-1, 2, (100, jaccard.GROUPS)) * (rng.random((100, jaccard.GROUPS)) < 0.1))
    size, comp = v.sum(1), rng.integers(0, 4, 300)
    order = np.lexsort((size, comp))
    rest = size - rng.integers(0, 30, 300)
    tree = jaccard.Tree(v[order], size[order], rest[order], comp[order])
    for q in range(0, 300, 7):
        most = np.minimum(np.minimum(v[order], v[q]).sum(1), np.minimum(rest[order], rest[q]))
        want = np.flatnonzero((comp[order] != comp[q]) & jaccard.linked(most, size[q], size[order]))
        assert set(want) == set(tree.search(v[q], size[q], rest[q], comp[q]))


def test_components(spark):
    links = spark.createDataFrame([(str(a), str(b)) for a, b in [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (7, 9), (5, 5)]], "a string, b string")
    assert {tuple(r) for r in connected(links).collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("4", "1"), ("7", "7"), ("8", "7"), ("9", "7")}
    assert connected(links.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "NODES", 5)
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(k, 500) for k in range(300, 400)] + [(700 + k, 700 + rng.randrange(60)) for k in range(50)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    links = spark.createDataFrame(rng.sample(pairs, len(pairs)), "a long, b long").repartition(7)
    got = {tuple(r) for r in connected(links).collect()}
    assert got == {(x, find(x)) for p in pairs if p[0] != p[1] for x in p}


def brute_substrings(texts, n=13):
    least = {}
    words = [(k, (t or "").encode().split()) for k, t in texts]
    for k, w in words:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            least[key] = min(least.get(key, substrings.LAST), substrings.LAST if k is None else k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < (substrings.LAST if k is None else k):
                gone |= set(range(i, i + n))
        out.append((str(k), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def test_substrings_are_brute_force(make_docs, prose, copies):
    shared = prose(60, 77)
    texts = [*copies, *[(400 + k, prose(30, 600 + k) + "\n" + shared[k * 3 :] + "\t" + prose(20, 700 + k)) for k in range(10)], (500, "la la " * 40), (501, "la la " * 30), (None, shared)]
    rows = substrings.deduplicate(make_docs(texts).selectExpr("*", "1 as kept", "2 as n_words")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows) == brute_substrings(texts)
    assert substrings.deduplicate(make_docs(texts).limit(0)).count() == 0


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in ok:
        found = {j: float((w * v).sum()) for j, w in ok if j != i}
        out[i] = sorted(found, key=lambda j: (-found[j], j))[:k]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    x[50:90] = x[50]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [1.0, None] * 12), (903, [float("nan")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank")
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    got = neighbours.nearest(df, df, 10).collect()
    want = brute_nearest(rows, 10)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == set(want)
    assert sum(len(set(found[i]) & set(want[i])) for i in want) / sum(map(len, want.values())) >= 0.9
    assert found[55] == [50, 51, 52, 53, 54, 56, 57, 58, 59, 60]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert len(neighbours.nearest(few, few).collect()) == 12
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def compared(x, queries, found=20):
    """Recall of the `found` nearest in probed cells, and the share of the table that lies in them, by the shipped plan."""
    p = neighbours.plan(x.shape[1], len(x))
    near = queries @ x.T
    best = np.argsort(-near, axis=1)[:, 1 : found + 1]
    seen = np.zeros(near.shape, bool)
    for t in range(neighbours.TABLES):
        own = neighbours.cells(x, t, p.axes)[:, 0]
        probed = neighbours.cells(queries, t, p.axes, p.probes)
        for k, cells in enumerate(probed):
            seen[k] |= np.isin(own, cells)
    return np.take_along_axis(seen, best, 1).mean(), seen.mean()


def test_compared_share_falls_with_the_table_and_recall_does_not():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = [compared(x[:n], x[:40]) for n in (2000, 10_000, 50_000)]
    assert all(recall >= 0.9 for recall, _ in got), got
    assert got[0][1] > 1.5 * got[1][1] > 2 * got[2][1], got
    wide = rng.normal(size=(6000, 300)) + 2 * rng.normal(size=(60, 300)).repeat(100, axis=0)
    assert compared(wide / np.linalg.norm(wide, axis=1, keepdims=True), wide[::200])[0] >= 0.9


def compared_by_shelves(x, queries, found=20):
    """The same for vectors of uneven lengths: shelves of the longest first, others where their longest could beat the last found."""
    length = np.linalg.norm(x, axis=1)
    band = np.floor(np.log(length.max() / length) / np.log(neighbours.LIKE)).astype(int)
    every = neighbours.shelves([(x.shape[1], int(b), int((band == b).sum()), float(length[band == b].max())) for b in np.unique(band)])
    early = neighbours.probed_first(every)
    near = queries @ x.T
    best = np.argsort(-near, axis=1)[:, 1 : found + 1]
    seen = np.zeros(near.shape, bool)
    for turn in (True, False):
        known = np.where(seen, near, -np.inf)
        last = np.sort(known, axis=1)[:, -found - 1]
        for s in every:
            if ((s.size, s.number) in early) != turn:
                continue
            own = np.flatnonzero((band >= s.first) & (band <= s.last))
            asks = np.flatnonzero(turn | (np.linalg.norm(queries, axis=1) * s.high >= last))
            p = neighbours.plan(x.shape[1], s.n)
            for t in range(neighbours.TABLES):
                cell = neighbours.cells(x[own], t, p.axes)[:, 0]
                for q, probed in zip(asks, neighbours.cells(queries[asks], t, p.axes, p.probes) if len(asks) else [], strict=True):
                    seen[q, own] |= np.isin(cell, probed)
    return np.take_along_axis(seen, best, 1).mean(), seen.mean()


def test_compared_share_falls_for_uneven_lengths_too():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(50_000, 64)) * np.exp(0.5 * rng.normal(size=(50_000, 1)))
    got = [compared_by_shelves(x[:n], x[:40]) for n in (2000, 10_000, 50_000)]
    assert all(recall >= 0.9 for recall, _ in got), got
    assert got[0][1] > 1.2 * got[1][1] > 1.5 * got[2][1], got


def test_shelves_hold_all_bands():
    rng = np.random.default_rng(5)
    bands = [(size, int(b), int(rng.integers(1, 900)), 1.1 ** -float(b)) for size in (3, 64) for b in rng.choice(500, 60, replace=False)]
    every = neighbours.shelves(bands)
    for size, b, _, high in bands:
        (own,) = [s for s in every if s.size == size and s.first <= b <= s.last]
        assert own.high >= high
    assert sum(s.n for s in every) == sum(n for _, _, n, _ in bands)
    assert all(s.first == s.last or s.n < 2 * neighbours.LEAST for s in every)


def test_probed_cells_have_the_largest_sums():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 16))
    axes = (8, 4, 2)
    y = [neighbours.rotate(x / np.linalg.norm(x, axis=1, keepdims=True), 3 + neighbours.TABLES * k)[:, :a] for k, a in enumerate(axes)]
    both = [np.stack([z, -z], axis=2).reshape(5, -1) for z in y]
    sums = (both[0][:, :, None, None] + both[1][:, None, :, None] + both[2][:, None, None, :]).reshape(5, -1)
    assert (neighbours.cells(x, 3, axes, 40) == np.argsort(-sums, axis=1)[:, :40]).all()
    assert (neighbours.cells(x, 3, axes) == sums.argmax(1)[:, None]).all()


def test_neighbours_far_from_all_clusters_of_other_sizes_and_lengths(spark):
    rng = np.random.default_rng(4)
    cluster = np.eye(64)[0] + 0.001 * rng.normal(size=(3000, 64))
    far = -np.eye(64)[0] + 0.3 * rng.normal(size=(4, 64))
    few = rng.normal(size=(30, 16))
    rows = [(i, v.tolist()) for i, v in enumerate([*cluster, *far, *few])]
    asked = rows[3000:]
    schema = "vec_id long, embedding array<double>"
    got = neighbours.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest(rows[3000:3004] + rows[:3000], 20) | brute_nearest(rows[3004:], 20)
    assert all(sorted(found[i]) == sorted(want[i]) for i, _ in asked)
    long = rng.normal(size=(6000, 48)) * np.exp(rng.normal(size=(6000, 1)) * 0.7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(long)], schema)
    got = neighbours.nearest(df, df.where("vec_id < 100")).collect()
    exact = long[:100] @ long.T
    exact[np.arange(100), np.arange(100)] = -np.inf
    best = np.argsort(-exact, axis=1)[:, :20]
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) / 2000 >= 0.9


def test_language_model(spark, make_docs, prose):
    texts = [(i, prose(80, i)) for i in range(60)] + ODD
    docs = make_docs(texts).selectExpr("*", "0 as score", "1 as n_known")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = lm.score(docs, learn).collect()
    token = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter()
    for k, t in texts:
        if k is not None and zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(token(t))
    total, types = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = token(r["text"])
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score(docs.limit(0), learn).count() == 0
    assert all(r["train_tokens"] == 0 for r in lm.score(make_docs(ODD), F.lit(False)).collect())


def test_every_training_token_is_learnt_from(spark, make_docs, prose):
    docs = make_docs([(i, prose(40, i)) for i in range(30)] + ODD).withColumn("_learn", F.col("doc_id").isNotNull())
    rows = lm.X.chunked(docs, [F.col("doc_id"), F.col("text")], 6)
    start = lm.vocabulary(lm.count(rows, "text", 3))
    model = lm.train(docs, start, "text")
    data, off = W.buffers(lm.pa.array([r["text"] for r in docs.where("_learn").collect()], lm.pa.string()))
    t = lm.Tokens(data, off)
    outer, inner = lm.contexts(start.symbols(t.keys), t.first)
    assert (model.outer[np.unique(outer)] != start.outer[np.unique(outer)]).any(1).all()
    assert (model.inner[np.unique(inner)] != start.inner[np.unique(inner)]).any(1).all()


def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 4096)  # several shards
    rng = random.Random(5)
    follow = {k: rng.sample(range(900), 3) for k in range(900)}

    def chain(n):
        k, out = rng.randrange(900), []
        for _ in range(n):
            out.append(f"w{k}")
            k = rng.choice(follow[k])
        return " ".join(out)

    texts = [(i, chain(120)) for i in range(150)] + ODD
    held = F.col("doc_id") % 7 == 2
    scores = []
    for n in (1, 7):
        rows = lm.score(make_docs(texts, n), ~held).collect()
        scores.append(sorted((str(r["doc_id"]), str(r["text"]), r["score"]) for r in rows))
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]]
    assert all(math.isclose(x[2], y[2], rel_tol=1e-9) for x, y in zip(*scores, strict=True))
    out = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows if r["doc_id"] is not None and r["doc_id"] % 7 == 2 and r["doc_id"] < 150]
    assert sum(out) / len(out) > 0.02  # of words outside the top too, in texts that were not learnt from


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    m = lm.Model()
    keys = np.unique(rng.integers(0, 2**63, 1500).astype(W.U))
    count = rng.integers(1, 50, len(keys))
    top = np.sort(np.argsort(-count, kind="stable")[: lm.TOP - 20])
    m.top, m.rank = keys[top], rng.permutation(lm.TOP - 20)
    rest = np.setdiff1d(np.arange(len(keys)), top)
    for k in rest:
        m.rest[lm.place(keys[k : k + 1])[0]] += count[k] + 1
    m.outer = rng.normal(0, 1, m.outer.shape).astype(np.float32)
    m.inner = rng.normal(0, 1, m.inner.shape).astype(np.float32)
    symbol = m.symbols(keys)
    total = 0.0
    for k in range(len(keys)):  # after the same context
        s = np.array([symbol[3], symbol[9], symbol[k]])
        total += 10 ** lm.log10_probabilities(m, s, np.array([1, 1, count[k]]), np.array([0, 3]))[2]
    for c in range(lm.REST):  # and an unseen word of each place
        s = np.array([symbol[3], symbol[9], lm.TOP + c])
        total += 10 ** lm.log10_probabilities(m, s, np.array([1, 1, 0]), np.array([0, 3]))[2]
    assert abs(total - 1) < 1e-3
