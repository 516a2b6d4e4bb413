"""Ordered readers, and sinks of shards, queues and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.records import csv_field
from gleanery.sources.folders import checkpointed

ROWS = 100


def read_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON-line shards with `file` and `line`, their places in file-name and line order; other lines are left out. Shards are small files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "_l"))
    return whole.where(F.trim("_l").startswith("{")).select("file", "line", F.from_json("_l", schema).alias("r")).select("file", "line", "r.*")


def read_layouts(spark: SparkSession, path: str, schema: str, fields: tuple[str, ...] = ("questions", "tasks")) -> DataFrame:
    """Objects of JSON files that hold an array, an object with an array in one of `fields`, or lines of objects. Each file is one value of text."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    array = F.from_json("v", f"array<{schema}>")
    named = [F.from_json(F.get_json_object("v", f"$.{f}"), f"array<{schema}>") for f in fields]
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, schema))
    found = F.when(F.col("v").startswith("["), array).otherwise(F.coalesce(*named, lines))
    return whole.select(F.explode(found).alias("r")).select("r.*")


def read_catalog(spark: SparkSession, catalog: DataFrame, folder: str, schema: str) -> DataFrame:
    """Objects of the files that enabled packs (pack_id, asset, enabled) name, each with its pack_id. Files are found by their names in `folder`."""
    rows = spark.read.schema(schema).json(f"{folder}/*.jsonl").withColumn("asset", F.col("_metadata.file_name"))
    return rows.join(catalog.where("enabled").select("pack_id", "asset"), "asset").drop("asset")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `nth`, its rows' places from 0 in the given order: by ranges of the order, their sizes, and places in each range."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").count()  # a row for each range
    before = sizes.select("_p", (F.sum("count").over(W.orderBy("_p")) - F.col("count")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(before, "_p").withColumn("nth", F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in the given order; the files appear when all are written."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def append_shards(df: DataFrame, path: str, *order: str, held: int = 0, rows: int = ROWS) -> None:
    """Appends rows in shards of `rows` (folders shard=N), where `held` rows are there already: the last shard is topped up first."""
    shard = F.floor((F.col("nth") + held) / rows).cast("int")
    numbered(df, *order).withColumn("shard", shard).drop("nth").repartition("shard").sortWithinPartitions("shard", *order).write.mode("append").partitionBy("shard").json(path)


def shard_digests(df: DataFrame, order: str, rows: int = ROWS) -> DataFrame:
    """Rows (shard, digest) of shards of `rows` rows each."""
    cut = numbered(df, order).withColumn("shard", F.floor(F.col("nth") / rows).cast("int")).drop("nth")
    line = F.to_json(F.struct(*df.columns))
    return cut.groupBy("shard").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("_l")))), lambda x: x["_l"]), "\n"), 256).alias("digest"))


def shard_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (shard, change): which shards are to be written (added, changed) or deleted (stale); what is the same stays."""
    both = old.withColumnRenamed("digest", "_old").join(new, "shard", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("digest").isNull(), "stale").when(F.col("_old") != F.col("digest"), "changed").otherwise("same")
    return both.select("shard", change.alias("change"))


def csv_lines(df: DataFrame, *columns: str) -> Column:
    """Rows as CSV lines; arrays joined by |."""
    kinds = dict(df.dtypes)
    text = lambda c: F.array_join(c, "|") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(",", *[csv_field(text(c)) for c in columns])


def review_queue(tasks: DataFrame, documents: DataFrame, key: str, status: str, wanted: str = "needs_llm", **constants: str) -> DataFrame:
    """Tasks of a status with what is known of their documents and constant columns, to be written in the order of their ids."""
    return tasks.where(F.col(status) == wanted).join(documents, key).withColumns({k: F.lit(v) for k, v in constants.items()})


def envelopes(df: DataFrame, by: str, order: str, **constants: str) -> DataFrame:
    """A JSON envelope for each key: constants, the number of records and the records in order. Keys are batches of bounded size."""
    records = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*[c for c in df.columns if c != by]).alias("_r")))), lambda x: x["_r"])
    return df.groupBy(by).agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in constants.items()], F.count(F.lit(1)).alias("n"), records.alias("records"))).alias("envelope"))


def word_forms(entries: DataFrame) -> DataFrame:
    """Rows (form, lemma, nth) of entries (lemma, forms, nth): each form and the lemma itself; of equal forms the last entry counts."""
    flat = entries.select("lemma", "nth", F.explode(F.array_distinct(F.concat(F.array("lemma"), F.coalesce("forms", F.array().cast("array<string>"))))).alias("form"))
    return flat.groupBy("form").agg(F.max_by("lemma", "nth").alias("lemma"), F.max("nth").alias("nth"))
