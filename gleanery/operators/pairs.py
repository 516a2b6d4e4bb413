"""All rows of a table beside those of a small one, whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is sent to all tasks, and rows in a part of a larger one.
SMALL, PART = 10_000, 1_000


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of `left` with each of `right`, as results that have a row for both need them (a learner and a unit).

    A `right` of up to `SMALL` rows goes to all tasks; a larger one is dealt into parts, and rows of `left` meet them part by part.
    """
    few = right.limit(SMALL + 1).count()
    if few <= SMALL:
        return left.crossJoin(F.broadcast(right))
    parts = -(-right.count() // PART)
    dealt = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int"))
    rows = dealt.groupBy("_part").agg(F.collect_list(F.struct(*right.columns)).alias("_rows"))
    asks = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asks.join(rows, "_part").select(*left.columns, F.explode("_rows").alias("_r")).select(*left.columns, "_r.*")
