"""Periodic runs against plain loops."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import queries, repeats
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, least=24):
    """Stretches by each lag, kept for the lowest lag that gives them."""
    n, ids = len(w), {}
    a = np.array([ids.setdefault(x, len(ids)) for x in w])
    found = {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], a[q:] == a[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s + q >= max(least, 3 * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in texts:
        w = planted(d, words(t))
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((d, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_kept(w, runs))))
    got = queries.op13_periodic_runs(spark, FOLDER)
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10


def odd_texts():
    rng = random.Random(6)
    out = ["a " * 5000, "a b " * 2000 + "c", "x " * 23, "x " * 24, "x\ty\n" * 12, " ".join("ab"[bin(i).count("1") % 2] for i in range(3000))]
    out.append(" ".join(rng.choice("ab") for _ in range(4000)))
    fib = ["a", "b"]
    while len(fib) < 2000:
        fib = (fib * 2)[:-1]
    out.append(" ".join(fib))
    for _ in range(60):  # runs of many periods, side by side, overlapping and inside each other
        w = [f"w{rng.randrange(rng.choice([3, 50, 1000]))}" for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            p = [f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 40, 130]))]
            if rng.random() < 0.3:
                p = p * 5 + ["z"]
            w += (p * 30)[: rng.randrange(len(p), len(p) * 9)] + w[: rng.randrange(20)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("long", [repeats.LONG, 400])
def test_runs(spark, make_docs, long):
    texts = [*ODD[:8], (97, "z" * 50000), *[(1000 + i, t) for i, t in enumerate(odd_texts())]]
    docs = make_docs(texts).withColumns({"row": F.lit("own"), "runs": F.lit(0), "found": F.lit("x"), "c0": F.lit("y"), "start": F.lit(1)})
    got = repeats.find_runs(docs, long=long).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in texts:
        w, r = words(t), by_id[i]
        runs = plain_runs(w)
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(w), runs), i
        assert r["kept"] == plain_kept(w, runs)
        assert (r["row"], r["found"], r["c0"], r["start"]) == ("own", "x", "y", 1)
    assert repeats.find_runs(docs.limit(0), long=long).count() == 0


def test_work_grows_little_faster_than_the_text():
    rng = np.random.default_rng(1)
    for row in (np.zeros(200_000, np.int32), rng.integers(0, 1000, 200_000).astype(np.int32)):
        found = repeats.scan(row, repeats.bands(len(row)))
        assert found == ([(0, 200_000, 1)] if not row.any() else [])
    top = repeats.bands(200_000)[-3:]
    assert repeats.scan(np.zeros(200_000, np.int32), top) == [(0, 200_000, 1)]
