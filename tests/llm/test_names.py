"""Columns of the caller's that bear the names of an operator's own: they stay as they are, and the results too."""

import pytest
from pyspark.sql import functions as F

from gleanery.llm import bpe, conversations, decontaminate, jaccard, langid, language_model, neighbours, repeats, secrets, sharding, simhash, substrings, toxicity
from gleanery.llm.queries import GENERAL, MULTI, PATTERN

#: Names that operators have used inside, or would.
NAMES = [
    "_chunk", "_bucket", "_payload", "_learn", "_unit", "_least", "_class", "_lead", "_n", "_part", "_at", "_copy", "_before", "_size", "_row", "_conv", "_t", "_y", "_item", "_text", "_to", "_key",
    "unit", "least", "class", "chunk", "bucket", "n", "part", "at", "slice", "copy", "before", "size", "row", "found", "runs_", "fp", "key", "component", "node", "shard_", "c0", "c1", "c2", "h", "l", "t", "id", "conv", "kind", "dig", "known", "hits_", "raw", "blocks", "place", "slot_",
]


def model(docs):
    return langid.train(["the thing and the other", "das ist ein anderes ding"] * 30, ["en", "de"] * 30)


OPERATORS = {
    "secrets": lambda docs: secrets.find_secrets(docs, GENERAL, PATTERN),
    "langid": lambda docs: langid.identify(docs, model(docs)),
    "decontaminate": lambda docs: decontaminate.decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(2)),
    "toxicity": lambda docs: toxicity.score(docs, toxicity.Net(1)),
    "sharding": lambda docs: sharding.slots(sharding.assign(docs, "doc_id", 3), ["doc_id", "text"], parts=2),
    "language_model": lambda docs: language_model.score(docs, F.col("doc_id") > 3),
    "bpe": lambda docs: bpe.encode(docs, MULTI, PATTERN, decoded="decoded"),
    "jaccard": lambda docs: jaccard.classes(docs, name="_class_of"),
    "substrings": substrings.deduplicate,
    "simhash": lambda docs: simhash.classes(docs.withColumn("fingerprint", simhash.fingerprint("text"))),
    "repeats": repeats.find_runs,
    "repeats, long": lambda docs: repeats.find_runs(docs, long=10),
    "conversations": lambda docs: conversations.repair(docs, "source", "doc_id", "lang", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_names_stay(make_docs, prose, name):
    base = prose(40, 1)
    docs = make_docs([(1, base), (2, base + " more of it"), (3, prose(30, 2)), (4, "a b " * 20), (5, None), (5, "same"), (5, "same")])
    operator = OPERATORS[name]
    extra = [n for n in NAMES if n not in docs.columns]
    plain = operator(docs)
    odd = operator(docs.withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit(""))) for n in extra}))
    results = [c for c in plain.columns if c not in extra]
    if name == "sharding":  # equal rows get their slots in no order
        results.remove("slot")
    assert sorted(map(repr, map(tuple, odd.select(*results).collect()))) == sorted(map(repr, map(tuple, plain.select(*results).collect())))
    if name != "conversations":
        assert set(extra) <= set(odd.columns)
        wrong = F.lit(False)
        for n in extra:
            wrong = wrong | (F.col(f"`{n}`") != F.concat(F.lit(n), F.coalesce("text", F.lit(""))))
        assert odd.where(wrong).isEmpty()


def test_neighbours_take_other_columns(spark):
    rows = [(i, [float(i % 3), float(i), 1.0]) for i in range(30)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = plain.withColumns({n: F.lit(n) for n in [*NAMES, "turns", "raw", "query_id", "rank", "score"]})
    got, want = (sorted(map(tuple, neighbours.nearest(df, df.where("vec_id % 10 = 0")).collect())) for df in (odd, plain))
    assert got == want
