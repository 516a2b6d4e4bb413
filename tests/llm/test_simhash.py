"""Fingerprints and their classes against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import queries, simhash
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    runs = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_classes(rows):
    """The smallest key that links reach, for each row (key, fingerprint)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    keys = {}
    for i, (k, _) in enumerate(rows):
        keys.setdefault(find(i), []).append(k)
    return [min((k for k in keys[find(i)] if k is not None), default=None) for i in range(len(rows))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query(spark):
    texts = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(k, plain_fingerprint(t)) for k, t in texts]
    want = sorted((k, f"{p:016x}", c) for (k, p), c in zip(prints, plain_classes(prints), strict=True))
    got = queries.op11_simhash(spark, FOLDER)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == want


def test_odd_texts_and_columns(spark, make_docs, prose):
    texts = [*ODD, *[(i, prose(3, i % 5)) for i in range(10)], (97, "Ab CD\t\nef  GH"), (98, "ab cd ef gh"), (99, "ÄB cd ef gh")]
    docs = make_docs(texts).withColumns({"fp": F.lit("own"), "component_id": F.lit("gone"), "class": F.lit(1), "key": F.lit(2)})
    got = simhash.classes(docs.withColumn("fingerprint", simhash.fingerprint("text")))
    assert set(docs.columns) | {"fingerprint"} == set(got.columns)
    prints = [(k, plain_fingerprint(t)) for k, t in texts]
    want = [(k, signed(p), c, "own", 1, 2) for (k, p), c in zip(prints, plain_classes(prints), strict=True)]
    assert sorted(map(repr, map(tuple, got.select("doc_id", "fingerprint", "component_id", "fp", "class", "key").collect()))) == sorted(map(repr, want))
    assert simhash.classes(docs.limit(0).withColumn("fingerprint", simhash.fingerprint("text"))).count() == 0
    nulls = simhash.classes(spark.createDataFrame([(None, 5), (None, 7), (1, None)], "doc_id long, fingerprint long")).collect()
    assert [r["component_id"] for r in nulls] == [None] * 3


def flipped(rng, p, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        p ^= 1 << b
    return p


def points(rng, random_ones, groups, chain):
    out = [rng.getrandbits(64) for _ in range(random_ones)]
    for size, most in groups:
        base = rng.getrandbits(64)
        out += [flipped(rng, base, most) for _ in range(size)]
    p = rng.getrandbits(64)
    for _ in range(chain):
        out.append(p := flipped(rng, p, 4))
    return out


@pytest.mark.parametrize(("shard", "block"), [(1024, 8192), (16, 8192), (16, 64), (400, 100)])
def test_classes_of_groups_chains_and_strays(spark, shard, block):
    """Near copies of three, six and nine bits, chains and random points, with shards parted by vantage points too."""
    rng = random.Random(shard + block)
    rows = list(enumerate(points(rng, 300, [(400, 3), (300, 6), (200, 9), (5, 2)], 60)))
    df = spark.createDataFrame([(k, signed(p)) for k, p in rows], "doc_id long, fingerprint long").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, shard=shard, block=block).collect()}
    assert [got[k] for k, _ in rows] == plain_classes(rows)


def test_links_agree_on_a_mask():
    rng = random.Random(2)
    for n in (10, 5000, 10**6, 10**8, 10**11):
        masks = simhash.masks(n)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = flipped(rng, x, 4)
            assert any(x & m == y & m for m in masks)
        assert n <= 1024 or all(n / 2 ** m.bit_count() <= 1024 for m in masks)


def test_trees_prune(spark):
    """A group of copies is left out once it is one component, and a tree compares fewer pairs than all."""
    rng = random.Random(5)
    for rows, most in ((points(rng, 0, [(4000, 2)], 0), 0.02), (points(rng, 4000, [], 0), 0.6)):
        fp = np.array(sorted(set(rows)), np.uint64)
        links = simhash.Links(np.arange(len(fp)))
        order = np.argsort(simhash.W.mix(fp + np.uint64(1)))
        tree = simhash.Tree(fp, order, links)
        tree.join(order)
        assert tree.compared < most * len(fp) ** 2
