"""Words, secrets, decontamination, BPE, language and toxicity."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontaminate, langid, secrets, toxicity
from gleanery.llm import words as W
from gleanery.llm.queries import GENERAL, MULTI, PATTERN
from tests.llm.conftest import ODD


def by_key(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_words_are_those_of_the_patterns():
    texts = ["Ab c", None, "", " é x\x0b", "a", "b", "1-2_3 ÄB"]
    data, off = W.buffers(pa.array(texts))
    for table, pattern in ((W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (W.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = W.split(data, off, table, lower=True)
        got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
        low = ["".join(c.lower() if c.isascii() else c for c in t or "") for t in texts]
        assert got == [re.findall(pattern, t) for t in low]


@pytest.fixture(scope="module")
def codec():
    ranks = secrets.load_ranks(MULTI)
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaa", "abababab" * 50, "the theory — of 123 things\n\n  x", "中文字符🙂", "é" * 999, "\x00\x01 ��", "mixed CASE words'll don't"])
def test_bpe_is_that_of_the_library(codec, text):
    own, library = codec
    ids = own.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_over_tables(spark, make_docs, codec):
    docs = make_docs(ODD).selectExpr("*", "1 as ids")
    rows = by_key(bpe.decode(bpe.encode(docs, MULTI, PATTERN), MULTI))
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == codec[1].encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(docs.limit(0), MULTI, PATTERN).count() == 0


def test_secrets(spark, make_docs):
    key = "aB3xZ9qLm2Pw8RtY5vK1"
    texts = [
        (1, "token = short password=0123456789ab"),
        (2, "TOKEN=secret=abcdefghijkl token=password:abcdefghijkl"),
        (3, "AKIAABCDEFGHIJ12345 AKIA123"),
        (4, "x" + "0123456789abcdef0" + "g"),
        (5, f"key {key} end"),
        (6, "d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000 docs/reference/2024/chapter12"),
        *ODD,
    ]
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["secrets"]] for r in by_key(secrets.find_secrets(make_docs(texts).selectExpr("*", "2 as secrets"), GENERAL, PATTERN))}
    assert got[1] == [("assign", 14, 35)]
    assert got[2] == [("assign", 0, 25)]
    assert ("access", 0, 19) in got[3] and len([x for x in got[3] if x[0] == "access"]) == 1
    assert ("hex", 1, 18) in got[4]
    assert got[5] == [("random", 4, 4 + len(key))]
    assert [x for x in got[6] if x[0] == "random"] == []
    assert all(not got[i] for i in (90, 91, 92, 93, 96, 97))
    clean = {r["doc_id"]: r["text"] for r in by_key(secrets.redact(make_docs(texts), GENERAL, PATTERN))}
    assert clean[5] == "key [SECRET] end" and clean[1] == "token = short [SECRET]" and clean[90] is None


def test_words_and_letters_do_not_hide_secrets():
    tokens = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=secrets.load_ranks(GENERAL), special_tokens={})
    found = lambda t: [t[s:e] for s, k, e in secrets.scan(t, lambda r: len(tokens.encode_ordinary(r))) if k == 3]
    key, split, letters = "aB3xZ9qLm2Pw8RtY5vK1", "aB3xZ9qL/m2Pw8R+tY5vK1z", "qXvBzKwJpRtGhYmNcDfL"
    for before in ("/services/internal/production/notifications/channel/", "application-settings-production-database-connection-"):
        for after in ("", "/configuration/production/environment/variables"):
            for secret in (key, letters):
                assert found(f"at {before}{secret}{after} end") == [secret]
            (span,) = found(f"at {before}{split}{after} end")
            assert split in span
    assert found(letters) == [letters]
    glued = "internationalproductionconfigurationenvironment" + key
    assert found(glued) == [glued]
    digest, uuid = "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000"
    words = "/services/internal/production/notifications/channel/configuration/environment/variables/administration/"
    for plain in (f"{words}{digest}", f"{words}{uuid}", f"{words}k8s-production-cluster", "internationalization", "Donaudampfschifffahrtsgesellschaft", digest, uuid):
        assert found(plain) == [], plain


def brute_hits(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, found = low(text), set(), set()
    for i, t in items:
        w = low(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == w[k : k + n]:
                    hit |= set(range(a, a + n))
                    found.add("" if i is None else str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_decontamination_is_brute_force(spark, make_docs, prose, block_words):
    items = [(1, prose(30, 1)), (2, prose(10, 2)), (3, prose(3, 3)), (4, "ab"), (5, None), (6, ""), (7, prose(30, 1)), (8, prose(11, 8)), (None, "null id item")]
    first = prose(30, 1).split()
    texts = [(1, prose(50, 10) + " " + prose(30, 1).upper() + "! " + prose(9, 11)), (2, " ".join(first[3:12])), (3, " ".join(first[3:13])), (4, prose(3, 3)), (5, "ab ab, AB"), (6, prose(11, 8) + prose(11, 8)), (7, "a null id item"), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(texts).selectExpr("*", "'own' as hits", "1 as items")
    for r in by_key(decontaminate.decontaminate(docs, bench, block_words=block_words)):
        n, hit, found = brute_hits(r["text"], items)
        assert (r["n_words"], sum(x["end"] - x["start"] for x in r["hits"]), r["items"]) == (n, hit, found), r["doc_id"]
    assert all(not r["hits"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_language(spark, make_docs):
    rng = np.random.default_rng(1)
    kinds = {"aa": ["tion", "ing", "the", "er"], "bb": ["ção", "nho", "que", "ir"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 3)) for _ in range(30)), k, "s", 1) for i, k in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(docs.withColumnRenamed("source", "score"), model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 and not r["rejected"] for r in got)
    assert {r["doc_id"] for r in docs.where(langid.held_out()).collect()} == {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    odd = {r["doc_id"]: r for r in langid.identify(make_docs(ODD), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (90, 91, 92, 95))
    assert odd[96]["lang_pred"] in ("aa", "bb")
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


#: Texts in no language of the driver's documents.
FOREIGN = {
    "random letters": "qzx vjwk pfghq xkcd wvbnm zzqy jfkd plmq rtyx ghbv wqpz xmnk vbcq jhgf tyrw qpxz kjvn " * 2,
    "Russian": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
    "Japanese": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "program": "def run(self, x):\n    if x is None:\n        return {}\n    for k, v in x.items():\n        self.out[k] = v * 2 + len(k)\n",
}


def test_foreign_texts_are_rejected_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    foreign = spark.createDataFrame([(i, t) for i, t in enumerate(FOREIGN.values())], "doc_id int, text string")
    got = {list(FOREIGN)[r["doc_id"]]: r["rejected"] for r in langid.identify(foreign, model).collect()}
    assert got == dict.fromkeys(FOREIGN, True)
    # texts that mix languages, and numbers and keys among words, stay
    clean = langid.identify(docs.where(langid.held_out()), model).collect()
    assert sum(r["rejected"] for r in clean) < 0.01 * len(clean)
    assert sum(r["lang_pred"] == r["lang"] for r in clean) > 0.97 * len(clean)
    first, second = (r["text"] for r in docs.where("lang in ('en', 'fr') and n_chars between 500 and 900").groupBy("lang").agg(F.min("text").alias("text")).collect())
    mixed = spark.createDataFrame([(1, f"{first} {second}"), (2, f"{first} 4734663219866878 40d78a45c418324758e099eb7cb89bc1 +1 (168) 555-5254")], "doc_id int, text string")
    assert not any(r["rejected"] for r in langid.identify(mixed, model).collect())


def test_held_out_labels_teach_nothing(spark):
    """Other labels on held-out rows leave the models of language and toxicity as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.fit(d.where(~langid.held_out())) for d in (docs, turned))
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and (a.threshold, a.strange) == (b.threshold, b.strange)
    wrong = labels.withColumn("toxic", F.when(langid.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    few = {"per_class": 4}
    c, d = (toxicity.fit(docs.drop("lang", "source"), x.where(~langid.held_out()), **few) for x in (labels, wrong))
    assert all(np.array_equal(c.p[k], d.p[k]) for k in c.p)


def test_network_gradients():
    net = toxicity.Net(3)
    x = toxicity.inputs(*W.buffers(pa.array(["one two three four", "five " * 40])))
    label, weight = np.array([1, 0, 1], np.float32)[: len(x.window)], np.ones(len(x.window), np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        z = net.logits(x).astype(np.float64)
        return float((np.log1p(np.exp(z)) - label * z).sum())

    grads = net.backward(x, np.arange(len(x.window)), label, weight)
    rng = np.random.default_rng(0)
    for name in ("wx", "bx", "u", "att", "v", "out", "b"):
        p = net.p[name]
        i = tuple(rng.integers(0, n) for n in p.shape)
        old, eps = p[i], 1e-3
        p[i] = old + eps
        up = loss()
        p[i] = old - eps
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * eps) - grads[name][i]) < 2e-2 * max(1, abs(grads[name][i])), name


def test_toxicity(spark, make_docs, prose):
    bad = ["grobzk", "vlurt", "shnark"]
    texts = [(i, prose(60, i) + (f" {bad[i % 3]} {prose(10, i + 500)} {bad[(i + 1) % 3]}" if i % 3 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts] + [(1000, None), (None, 1)], "doc_id long, toxic int")
    docs = make_docs([*texts, *ODD])
    net = toxicity.fit(docs, labels.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in toxicity.score(docs.selectExpr("*", "1 as score"), net).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == (i % 3 == 0) for i in held)
    assert right / len(held) > 0.85
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[90]["predicted"] == got[91]["predicted"] == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, blank).collect()} == {0}


def test_digest_of_empty():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c4")
