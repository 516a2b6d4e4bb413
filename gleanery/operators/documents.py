"""Documents: content identity, lines, marker segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("sha", F.sha2(text, 256))


def content_status(docs: DataFrame, order: list[Column], text: str = "text", kept: str = "DOWNLOADED", copy: str = "DUPLICATE") -> DataFrame:
    """The first row of each content is kept, later ones are copies."""
    rows = with_digest(docs, text)
    return rows.withColumn("status", F.when(F.row_number().over(W.partitionBy("sha").orderBy(*order)) == 1, kept).otherwise(copy))


def mirrors(docs: DataFrame, key: str, mirror: str, text: str = "text") -> DataFrame:
    """One row a content: how many rows and mirrors hold it, and the smallest key."""
    return with_digest(docs, text).groupBy("sha").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct(mirror).alias("mirrors"), F.min(key).alias("first_key"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, pos, line) for each line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def segments(rows: DataFrame, marker: Column, by: str, order: str) -> DataFrame:
    """Adds `segment`: rows from one marker up to the next are one segment, those before the first are segment 0."""
    running = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.coalesce(marker, F.lit(False)).cast("int")).over(running))


def segment_summary(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """One row a segment: its first and last place, rows, characters and first text."""
    return rows.groupBy(by, "segment").agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text)).alias("n_chars"), F.min_by(text, order).alias("head"))


def repeated_lines(rows: DataFrame, by: str, line: str, least: int = 2, length: int = 4) -> DataFrame:
    """Normalised lines of some length that several keys hold."""
    norm = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return rows.withColumn("norm", norm).where(F.length("norm") >= length).groupBy("norm").agg(F.countDistinct(by).alias("n_keys"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_keys") >= least)
