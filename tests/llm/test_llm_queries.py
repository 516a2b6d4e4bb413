"""The ten registered queries over the smallest tables: against their SQL, or plain versions of what they return."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash

from gleanery.llm import queries, secrets, sharding

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def part(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    got = rows(spark, name)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got[0]) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def test_secrets(spark, texts):
    got = rows(spark, "op1_secret_scan")
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        base = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 12]
        base += [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(t)] + [("hex", m.start(), m.end()) for m in secrets.HEX.finditer(t)]
        base.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in secrets.KINDS[:3]]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_languages(spark, duck):
    truth = dict(duck.sql("select doc_id, lang from documents").fetchall())
    got = rows(spark, "op2_language_id")
    assert all(r["held_out"] == (part(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_toxicity(spark, duck):
    got = rows(spark, "op4_toxicity")
    assert all(r["held_out"] == (part(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len(got) == duck.sql("select count(*) from documents").fetchall()[0][0]


def test_neighbours(spark, duck):
    ids, x = zip(*duck.sql("select vec_id, embedding from embeddings").fetchall(), strict=True)
    x = np.array(x, float)
    got = rows(spark, "op5_nearest_neighbours")
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    hit = 0
    for k in asked:
        near = x @ x[k]
        best = sorted((-s, i) for s, i in zip(near.tolist(), ids, strict=True) if i != ids[k])[:20]
        own = sorted((r for r in got if r["query_id"] == ids[k]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(math.isclose(r["score"], near[ids.index(r["vec_id"])], rel_tol=1e-12, abs_tol=1e-12) for r in own)
        hit += len({i for _, i in best} & {r["vec_id"] for r in own})
    assert hit >= 0.9 * 20 * len(asked)


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_shards_are_those_of_the_plain_hash(spark):
    for r in rows(spark, "op6_sharding"):
        key = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
        assert (r["shard"], r["grown_shard"]) == (plain_jump(key, 24), plain_jump(key, 25))


def test_shards(spark, texts):
    got = rows(spark, "op6_sharding")
    assert len(got) == len(texts)
    key = {r["doc_id"]: r for r in got}
    for i, t in texts.items():
        raw = (t or "").encode()
        assert (key[i]["size"], key[i]["text_crc32"], key[i]["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
    for s in range(24):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and any(r["grown_shard"] == 24 for r in got)
    assert sharding.__doc__


def test_language_model(spark, texts):
    token = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in texts.items() if part(i, 7) != 2 for w in token(t))
    total, types = sum(counts.values()), len(counts)
    gain, n = 0.0, 0
    for r in rows(spark, "op7_lm_scoring"):
        own = token(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part(r["doc_id"], 7) == 2, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own), rel_tol=1e-9)
        if r["held_out"]:
            gain, n = gain + r["score"] - r["base_score"], n + r["n_tokens"]
    assert gain > 0.02 * n


def test_tokens(spark, texts):
    coder = tiktoken.Encoding("t", pat_str=queries.PATTERN, mergeable_ranks=secrets.load_ranks(queries.MULTI), special_tokens={})
    for r in rows(spark, "op8_bpe"):
        t = texts[r["doc_id"]] or ""
        ids = coder.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t))
