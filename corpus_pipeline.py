"""A cleaning pipeline over `documents`: language, near-copies, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs. All but the
last return the columns of documents.

Defined cases: null and empty texts and texts without a letter go in the first stage (language `und`); rows with a null doc_id take part like others;
rows that repeat a doc_id are copies where their texts are near, and stay apart where they are not; an empty table gives an empty table; further
columns of documents are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontaminate, jaccard, langid, secrets
from gleanery.llm.frames import checkpoint_folder
from gleanery.llm.queries import GENERAL, MULTI, PATTERN

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the identifier rejects, and writes what it finds to lang."""
    model = langid.fit(docs.where(~langid.held_out()).where(F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model)
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-copies: the one of the smallest doc_id. Rows in no class all stay."""
    found = jaccard.classes(docs, name="_class")
    kept = found.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    # rows of one class that repeat its doc_id are copies too; a doc_id that repeats with other texts is in several classes
    lone = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    once = kept.where(~lone).groupBy("_class").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return kept.where(lone).select(*COLUMNS).unionByName(once.select(*COLUMNS))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    clean = secrets.redact(docs, GENERAL, PATTERN)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether they decode to it."""
    # less than the operator alone: a worker also has what the stages before have left
    coded = bpe.encode(docs, MULTI, PATTERN, decoded="decoded", remembered=250_000)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_free), ("secret scans", secret_free), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to a folder of this run in the shared one and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Models and vocabularies are beyond SQL: the pipeline is tested against a plain version of itself.
ORACLE_SQL: str | None = None
