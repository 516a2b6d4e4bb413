"""The pipeline against a plain version of itself, and the registered queries' shapes."""

import importlib
import random
import zlib

import corpus_pipeline
import pytest
import tiktoken

from gleanery.llm import langid, queries, secrets
from tests.llm.conftest import ODD, SCHEMA
from tests.llm.test_tables import brute_classes, near
from tests.llm.test_texts import brute_hits


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    rng = random.Random(6)
    other = lambda n, k: " ".join(random.Random(k).choice(["über", "schön", "nicht", "weiß", "größe"]) + str(random.Random(k + i).randrange(90)) for i in range(n))
    texts = [(i, prose(60, i), "en") for i in range(80)] + [(100 + i, other(50, 31 * i), "de") for i in range(60)]
    texts += [(200 + i, near(texts[i][1], rng, 0.02), "en") for i in range(10)]
    texts += [(300, texts[3][1] + " token = 0123456789abcdef0123", "en"), (301, prose(40, 991) + " " + prose(20, 990), "en")]
    texts += [(i, t, None) for i, t in ODD]
    d = tmp_path_factory.mktemp("tables")
    docs = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in texts]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(20, 990))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs


def test_pipeline(spark, folder):
    d, docs = folder
    got = sorted((r.asDict() for r in corpus_pipeline.run(spark, d).collect()), key=lambda r: r["doc_id"] or -1)
    sample = [(x[1], x[2]) for x in docs if x[0] is not None and x[1] is not None and x[2] is not None and zlib.crc32(str(x[0]).encode()) % 5]
    sample.sort()
    model = langid.train([t for t, _ in sample], [k for _, k in sample])
    left = []
    for row in docs:
        text = (row[1] or "").encode()
        best, _, odd = model.predict(*langid.W.buffers(langid.pa.array([text], langid.pa.binary())))
        if any(c.isalpha() for c in row[1] or "") and not odd[0]:
            left.append((row[0], row[1], model.languages[best[0]], row[3], row[4]))
    classes = {(k, n): c for k, n, c in brute_classes([(x[0], x[1]) for x in left])}
    kept, seen = [], set()
    for x in left:
        c = next(c for (k, _), c in classes.items() if k == str(x[0]))
        if c == "None" or (c == str(x[0]) and x[:2] not in seen):  # one doc_id with other texts is in other classes
            seen.add(x[:2])
            kept.append(x)
    bench = [(1, r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    kept = [x for x in kept if not brute_hits(x[1], bench)[1]]
    vocabulary = tiktoken.Encoding("t", pat_str=queries.PATTERN, mergeable_ranks=secrets.load_ranks(queries.MULTI), special_tokens={})
    general = tiktoken.Encoding("e", pat_str=queries.PATTERN, mergeable_ranks=secrets.load_ranks(queries.GENERAL), special_tokens={})
    want = []
    for key, text, lang, source, _ in kept:
        clean, at = "", 0
        for start, end in sorted((s, e) for s, _, e in secrets.scan(text, lambda r: len(general.encode_ordinary(r)))):
            clean += text[at:start] + "[SECRET]" if start >= at else ""
            at = max(at, end)
        clean += text[at:]
        want.append({"doc_id": key, "lang": lang, "source": source, "n_chars": len(clean), "ids": vocabulary.encode_ordinary(clean), "n_tokens": len(vocabulary.encode_ordinary(clean)), "round_trip": True})
    assert got == sorted(want, key=lambda r: r["doc_id"] or -1)
    assert 300 not in {r["doc_id"] for r in got} or 3 not in {r["doc_id"] for r in got}
    assert 301 not in {r["doc_id"] for r in got}


def test_two_runs_give_two_results(spark, folder):
    first = corpus_pipeline.run(spark, folder[0])
    second = corpus_pipeline.run(spark, folder[0])
    assert sorted(map(repr, first.collect())) == sorted(map(repr, second.collect()))


def test_near_copies_keep_a_row_of_each_class(spark, prose, make_docs):
    one, two, three = prose(40, 1), prose(40, 2), prose(40, 3)
    texts = [(7, one), (7, two), (7, two), (8, one), (9, three), (9, three), (9, three + " end"), (None, prose(40, 4))]
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_copies(spark, make_docs(texts), "").collect())
    assert got == sorted([("7", one), ("7", two), ("9", three), ("None", texts[-1][1])])


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0, name


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
