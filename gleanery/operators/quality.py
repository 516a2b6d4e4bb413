"""Constraints as queries for the rows that violate them. Rows found none means the table is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.documents import with_digest
from gleanery.sources.folders import checkpointed


def required(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def foreign_key(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")


def allowed(df: DataFrame, column: str, values: list) -> DataFrame:
    """Nulls are violations too."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def within(df: DataFrame, column: str, low, high) -> DataFrame:
    """Nulls are violations too."""
    return df.where(F.col(column).isNull() | ~F.col(column).between(low, high))


def implies(df: DataFrame, when: Column, then: Column) -> DataFrame:
    return df.where(when & ~F.coalesce(then, F.lit(False)))


def weight_sums(df: DataFrame, by: list[str], weight: str, target: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(weight).alias("total")).where(F.abs(F.col("total") - target) > tolerance)


def one_owner(df: DataFrame, item: str, owner: str) -> DataFrame:
    """Items that several owners claim."""
    return df.groupBy(item).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def distribution(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Values whose counts differ from those expected (value, n), either way."""
    got = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    both = got.join(expected.select("value", F.col("n").alias("wanted")), "value", "full")
    return both.na.fill(0, ["n", "wanted"]).where("n <> wanted")


def digest_mismatch(df: DataFrame, text: str, digest: str) -> DataFrame:
    return with_digest(df, text).where(~F.col("sha").eqNullSafe(F.col(digest)))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows (node, ancestor) of all ancestors.

    Each round joins what is known with itself, so chains of any length take a logarithm of it in rounds; rounds are written to
    the checkpoint folder, so that the plan does not grow.
    """
    known = checkpointed(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct())
    n = known.count()
    while True:
        up = known.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_up"))
        further = known.join(up, F.col("ancestor") == F.col("_mid")).select("node", F.col("_up").alias("ancestor"))
        known = checkpointed(known.unionByName(further).distinct())
        if (now := known.count()) == n:
            return known
        n = now


def on_cycle(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Nodes that are their own ancestors; none means the relation has no cycle.

    Where no node has two parents, each round doubles the steps that all nodes take upwards, and those that fall off the top are dropped: what some
    node reaches when the number of places reached no longer falls lies on a cycle. That is a row a node and a logarithm of the longest chain in
    rounds. Other relations need their closure, whose rows can be the square of the nodes.
    """
    steps = checkpointed(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct())
    if not steps.groupBy("node").count().where("count > 1").isEmpty():
        return closure(steps, "node", "ancestor").where("node = ancestor").select("node")
    n = None
    while True:
        reached = steps.select("ancestor").distinct()
        if (now := reached.count()) == n:
            return reached.select(F.col("ancestor").alias("node"))
        n = now
        further = steps.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_up"))
        steps = checkpointed(steps.join(further, F.col("ancestor") == F.col("_mid")).select("node", F.col("_up").alias("ancestor")))
