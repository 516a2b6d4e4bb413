"""Queries of the ten operators over whole tables, and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.llm import bpe, conversations, decontaminate, jaccard, langid, language_model, neighbours, repeats, secrets, sharding, simhash, substrings, toxicity
from gleanery.llm.frames import stored

#: Vocabulary files: parameters of the operators that need one.
GENERAL = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, GENERAL, PATTERN).select("doc_id", "secrets")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()).where(F.col("doc_id").isNotNull()))
    return langid.identify(docs.drop("lang"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(~langid.held_out()))
    return toxicity.score(docs, net).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("_raw"))
    rows = docs.select("doc_id", (F.octet_length("_raw") + 8).cast("long").alias("size"), F.crc32("_raw").alias("text_crc32"))
    placed = sharding.slots(sharding.assign(rows, "doc_id", shards), ["doc_id", "size", "text_crc32"])
    grown = sharding.assign(placed, "doc_id", shards + 1, "grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(parts=7, kept=2)
    scored = language_model.score(docs, ~held & F.col("doc_id").isNotNull())
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, MULTI, PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.classes(docs).select("doc_id", "n_shingles", "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", simhash.fingerprint("text").alias("fingerprint"))
    return simhash.classes(stored(docs)).select("doc_id", simhash.hexed("fingerprint").alias("fingerprint"), "component_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    harm = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    harmed = (
        rows.withColumn("harm", harm)
        .where("harm <> 0")
        .withColumn("text", F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .withColumn("role", F.when(F.col("harm") == 4, "user").otherwise(role))
        .withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    )
    found = conversations.repair(harmed).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@F.arrow_udf(StringType())
def _planted(text: pa.Array, h: pa.Array) -> pa.Array:
    """Texts in which, for h divisible by 10, the words from a given one on are those of a period."""
    out = text.to_pylist()
    for k, x in enumerate(h.to_pylist()):
        if x is None or x % 10 or not out[k]:
            continue
        w = re.findall(rb"[^\x20\x09-\x0D]+", out[k].encode())
        if w:
            n, g = len(w), x // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[k] = b" ".join(w[i if i < a else a + (i - a) % p] for i in range(n)).decode()
    return pa.array(out, pa.string())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.octet_length("text").alias("size"), _planted("text", F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    found = repeats.find_runs(docs, size="size")
    # runs come by start, then period: an earlier one stays at equal exponents
    higher = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), lambda a, b: F.when(higher(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("(1000 * length) div period"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_sharding": op6_sharding,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_simhash": op11_simhash,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dp),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (s) WHERE least < doc_id),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

_LOWER_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op9_jaccard_join": OP9_SQL, "op3_decontamination": OP3_SQL, "op10_substring_dedup": OP10_SQL}
