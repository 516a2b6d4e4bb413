"""The shared folder for checkpoints, and readers and sinks of line files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of the files of a table that may be broadcast.
SENT = 1 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session where spark.checkpoint.dir is unset, as in tests, gets a temporary one, others raise."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder as Parquet and read again: its lineage ends there, and Spark knows the size of the files."""
    path = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """As `stored`, for tables that are joined as they are: one whose files are over `SENT` is never broadcast.

    Rows can take forty times the room of their files, and the few columns that a join needs even more, so Spark would send tables
    to the driver and to all tasks that fit neither.
    """
    out = stored(df)
    if _bytes(out) <= SENT:
        return out
    held = out.hint("merge")
    held._stored_at = out._stored_at
    return held


def _bytes(df: DataFrame) -> int:
    """Bytes of the files of a stored table."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `checkpointed` has written and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; lines that are no objects are left out."""
    schema = schema if isinstance(schema, str) else schema.simpleString()
    rows = spark.read.text(path).where(F.trim("value").startswith("{"))
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null").select("r.*")


def read_strict(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """JSON lines that must all parse; of equal keys the last line of the last file wins."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    at = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("*", at.alias("_at")).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "_at").alias("_r")).select(key, "_r.*")


def read_registry(spark: SparkSession, path: str, required: tuple[str, ...] = ("source_id", "url")) -> DataFrame:
    """A CSV registry with a header, a byte-order mark or none; fields are trimmed, rows without the required ones left out."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    for c in required:
        rows = rows.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    return rows


def read_documents(spark: SparkSession, path: str, field: str = "questions") -> DataFrame:
    """JSON files that hold either an array of objects or an object with one in `field`; Spark reads either as rows."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias("r")).select("r.*") if field in rows.columns else rows


def write_shards(df: DataFrame, path: str, rows: int = 100) -> None:
    """JSON files of at most `rows` lines each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def write_by_content(df: DataFrame, path: str, content: str) -> DataFrame:
    """Appends the contents that `path` lacks, in folders by the first two digits of their SHA-256; returns what was new."""
    spark = df.sparkSession
    rows = df.withColumn("sha", F.sha2(content, 256)).withColumn("prefix", F.substring("sha", 1, 2)).dropDuplicates(["sha"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
    rows = checkpointed(rows)
    rows.write.mode("append").partitionBy("prefix").parquet(path)
    return rows
