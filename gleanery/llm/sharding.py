"""Sharding by jump consistent hashing.

`assign` gives every row a shard from its key and the number of shards alone: no table of shards is kept, and with one
more shard a row either stays or goes to the new one (a fraction of 1 / (n + 1) of the rows). `slots` numbers the rows of
each shard without gaps.

Defined cases: a null key is a key like any other (all null keys go to one shard); repeated keys share a shard; rows that
are equal in key, size and checksum get different slots in no particular order; an empty table gives an empty table; other
columns are kept, and new columns replace those of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.frames import masked

#: Rows of a shard are numbered in so many parts, so that no task holds a whole shard.
PARTS = 512
#: Equal rows in an array.
SLICE = 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys (Lamping and Veach, 2014)."""
    key = keys.astype(np.uint64)
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        j[live] = ((b[live] + 1) * (2.0**31 / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[j[live] < shards]
    return b.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard, from 0 to shards - 1, of a key of any type."""

    @F.pandas_udf("int")
    def shard(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards))

    return shard(F.xxhash64(key))


def assign(df: DataFrame, key: str = "doc_id", shards: int = 24, name: str = "shard") -> DataFrame:
    """`df` with the shard of each row; one narrow pass, no shuffle."""
    return df.withColumn(name, shard_of(F.col(key), shards))


def slots(df: DataFrame, by: list[str], shard: str = "shard", name: str = "slot", parts: int = PARTS) -> DataFrame:
    """`df` with each row's place in its shard, from 0 and gapless, by a hash of the columns `by` and then their values.

    Each shard is cut into `parts` by that hash; parts are numbered on their own and moved by the rows of the parts before
    (a table of shards x parts rows at most, so it is broadcast). Equal rows are counted first, so many of them cost one row.
    """
    df, (shard, *by), back = masked(df.drop(name), shard, *by)
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("part", part)
    sizes = groups.groupBy(shard, "part").agg(F.sum("n").alias("size"))
    before = sizes.select(shard, "part", (F.sum("size").over(W.partitionBy(shard).orderBy("part")) - F.col("size")).alias("before"))
    order = W.partitionBy(shard, "part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("at", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # many equal rows become slices before they become rows, so that no array holds them all
    zero, last = F.lit(0).cast("long"), F.col("n") - 1
    sliced = placed.join(F.broadcast(before), [shard, "part"]).withColumn("slice", F.explode(F.sequence(zero, F.floor(last / SLICE))))
    each = sliced.withColumn("copy", F.explode(F.sequence(F.col("slice") * SLICE, F.least(last, (F.col("slice") + 1) * SLICE - 1))))
    return back(each, **{name: F.col("before") + F.col("at") + F.col("copy")})
