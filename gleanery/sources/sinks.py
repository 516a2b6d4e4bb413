"""Sinks that rewrite only what has changed, and stores of one file a record. Writes are committed by Spark: a task that fails or runs twice leaves nothing behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.exports import ROWS, numbered, shard_changes
from gleanery.sources.folders import checkpointed, discard, write_by_content

#: Beside the shards, hidden from readers: versions of the table (shard, digest), the highest complete one counts.
DIGESTS = "_digests"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path`."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _digests(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The shards' digests that are known for sure, and the number of their version."""
    done = [int(v) for v in folders(spark, f"{path}/{DIGESTS}") if v.isdigit() and exists(spark, f"{path}/{DIGESTS}/{v}/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], "shard int, digest string"), 0
    return spark.read.schema("shard int, digest string").parquet(f"{path}/{DIGESTS}/{max(done):08d}"), max(done)


def _record(df: DataFrame, path: str, version: int) -> None:
    spark = df.sparkSession
    df.select("shard", "digest").write.mode("overwrite").parquet(f"{path}/{DIGESTS}/{version:08d}")
    for v in folders(spark, f"{path}/{DIGESTS}"):
        if v.isdigit() and int(v) < version:
            delete(spark, f"{path}/{DIGESTS}/{v}")


def write_changed(df: DataFrame, path: str, *order: str, rows: int = ROWS) -> dict[str, int]:
    """Brings shards of `rows` JSON lines each (folders shard=N) to what `df` holds in the given order; returns how many were added, changed, stale and the same.

    Only added and changed shards are written, each replaced whole when its job ends; stale ones are deleted; files of the same shards stay
    as they are. The digests of what is about to change are taken back first and recorded last, so after a run that broke off, at whatever
    point, the next one writes again what it cannot be sure of. An empty table leaves no shard.
    """
    spark = df.sparkSession
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    cut = checkpointed(numbered(df, *order).withColumn("_shard", F.floor(F.col("nth") / rows).cast("int")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("_l")))), lambda x: x["_l"])
    new = checkpointed(cut.groupBy(F.col("_shard").alias("shard")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest")))
    old, version = _digests(spark, path)
    changes = checkpointed(shard_changes(old, new))
    counts = {k: 0 for k in ("added", "changed", "stale", "same")} | {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    moved = changes.where("change <> 'same'").select("shard")
    # shards that a broken run has left without a digest are written or deleted too
    unknown = [int(n.removeprefix("shard=")) for n in folders(spark, path) if n.startswith("shard=")]
    lost = spark.createDataFrame([(n,) for n in unknown], "shard int").join(new, "shard", "left_anti")
    if sum(counts.values()) > counts["same"]:
        _record(checkpointed(old.join(moved, "shard", "left_anti")), path, version + 1)
        write = changes.where("change in ('added', 'changed')").select(F.col("shard").alias("_shard"))
        out = cut.join(write, "_shard").withColumnRenamed("_shard", "shard").repartition("shard").sortWithinPartitions("shard", "nth").drop("nth")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("shard").json(path)
        _record(new, path, version + 2)
    for r in lost.toLocalIterator():
        delete(spark, f"{path}/shard={r['shard']}")
    discard(cut, new, changes)
    return counts


# one state, replaced whole


def write_state(df: DataFrame, path: str, *order: str) -> None:
    """Replaces a state by `df` as JSON lines in the given order. Readers see the state before until the new one is complete; a run that breaks off leaves it."""
    spark = df.sparkSession
    done = _complete(spark, path)
    version = max([0, *(int(v) for v in folders(spark, path) if v.isdigit())]) + 1
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{version:08d}")
    # what was read before stays for its readers until the next state
    for v in folders(spark, path):
        if v.isdigit() and int(v) < version and (not done or v != done[-1]):
            delete(spark, f"{path}/{v}")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete state; an empty one where none was written."""
    done = _complete(spark, path)
    return spark.read.schema(schema).json(f"{path}/{done[-1]}") if done else spark.createDataFrame([], schema)


def _complete(spark: SparkSession, path: str) -> list[str]:
    return [v for v in folders(spark, path) if v.isdigit() and exists(spark, f"{path}/{v}/_SUCCESS")]


def write_with_sidecars(df: DataFrame, path: str, content: str, *described: str) -> DataFrame:
    """Appends the contents that `path` lacks (`write_by_content`, in its folder `raw`), and for each a record of the columns `described` beside them, by its digest.

    Returns what was new. Records of contents that are there already are written too where they lack, as after a run that broke off between the two.
    """
    new = write_by_content(df, f"{path}/raw", content)
    told = df.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha"), F.octet_length(content).alias("bytes"), *described)
    known = read_records(df.sparkSession, f"{path}/meta", "sha string").select("sha")
    put_records(told.join(known, "sha", "left_anti"), f"{path}/meta", "sha")
    return new


# one file a record


def put_records(df: DataFrame, path: str, key: str) -> None:
    """Writes each row to a file of its own, in a folder named by its key; rows of known keys replace theirs.

    Keys are up to 80 letters, digits, dots, dashes and underscores; others, null ones included, raise before anything is written. Of rows
    with one key the last by content stays.
    """
    name = F.col(key).cast("string")
    bad = df.where(~F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]{1,80}\z"), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError(f"keys must be names of files: {bad.select(key).first()[0]!r}")
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    one = df.groupBy(name.alias("record")).agg(F.max(body).alias("value"))
    one.repartition("record").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("record").text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records of a store, for an export in bulk; none of a store that is not there."""
    if not any(n.startswith("record=") for n in folders(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.text(f"{path}/record=*").select(F.from_json("value", schema).alias("r")).select("r.*")


def delete_records(keys: DataFrame, path: str, key: str) -> int:
    """Deletes the records of the given keys; returns how many there were."""
    spark, n = keys.sparkSession, 0
    for r in keys.select(F.col(key).cast("string")).distinct().toLocalIterator():
        where = f"{path}/record={r[0]}"
        if r[0] is not None and exists(spark, where):
            delete(spark, where)
            n += 1
    return n
