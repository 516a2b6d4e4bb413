"""Loading dimensions: rows that hold to their keys and references go in, others are told with what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(rows: DataFrame, key: str, required: list[str], references: dict[str, tuple[DataFrame, str]], inside: list[str] | None = None) -> DataFrame:
    """`rows` with `faults`, an array: missing:c, repeated, unknown:c for a value of c that the referred table lacks, itself:c for one that names its own row.

    `references`: of each column the table and its key; an array column refers by each of its values. `inside`: columns that refer to the rows themselves.
    A null reference is none. Rows keep apart by their content, so a repeated key is told for all its rows.
    """
    own = rows.select(F.col(key).alias("_ref")).where("_ref is not null").distinct()
    repeats = rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key"), F.lit(True).alias("_twice"))
    got = rows.join(repeats, F.col(key) == F.col("_key"), "left").drop("_key")
    told = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing:{c}")) for c in [key, *required]]
    told.append(F.when(F.col("_twice"), F.lit("repeated")))
    tables = {c: other.select(F.col(k).alias("_ref")).where("_ref is not null").distinct() for c, (other, k) in references.items()}
    tables |= {c: own for c in inside or []}
    for n, (c, known) in enumerate(tables.items()):
        many = rows.schema[c].dataType.typeName() == "array"
        values = rows.select(F.explode(c).alias("_ref") if many else F.col(c).alias("_ref")).where("_ref is not null").distinct()
        lost = values.join(known, "_ref", "left_anti").withColumn("_none", F.lit(True))
        if many:  # rows by the values that no table has
            bad = rows.select(F.col(c).alias("_list"), F.explode(F.array_distinct(c)).alias("_ref")).join(lost, "_ref").select("_list").distinct().withColumn(f"_bad{n}", F.lit(True))
            got = got.join(bad, F.col(c) == F.col("_list"), "left").drop("_list")
        else:
            got = got.join(lost.select(F.col("_ref").alias("_list"), F.col("_none").alias(f"_bad{n}")), F.col(c) == F.col("_list"), "left").drop("_list")
        told.append(F.when(F.col(f"_bad{n}"), F.lit(f"unknown:{c}")))
        if c in (inside or []):
            same = F.array_contains(c, F.col(key)) if many else F.col(c) == F.col(key)
            told.append(F.when(F.coalesce(same, F.lit(False)), F.lit(f"itself:{c}")))
    return got.select(*rows.columns, F.array_compact(F.array(*told)).alias("faults"))


def loaded(rows: DataFrame, key: str, required: list[str], references: dict[str, tuple[DataFrame, str]], inside: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that go in, and those that don't, with `faults`."""
    got = checked(rows, key, required, references, inside)
    return got.where(F.size("faults") == 0).drop("faults"), got.where(F.size("faults") > 0)
