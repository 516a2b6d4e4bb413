"""Breadth-first searches from many roots at once, over tables of links or over moves that are computed, with scopes and budgets.

A search goes level by level; each level is written to the checkpoint folder, so its lineage stays short. Nodes that null links lead to are
left out; a root without links is found at depth 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.sources.folders import checkpointed


def search(roots: DataFrame, follow: Callable[[DataFrame], DataFrame], depth: int, admit: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (root, node, depth): each node that `depth` steps from a root reach, at its least depth.

    `follow`: rows (root, node) that the frontier's rows (root, node, depth) lead to. `admit`: which new rows are visited, of these and all
    rows so far; what is not admitted is not followed, and may come again on a later level.
    """
    frontier = checkpointed(roots.select("root", "node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    if admit is not None:
        frontier = checkpointed(admit(frontier, frontier.limit(0)))
    known = frontier
    for k in range(1, depth + 1):
        new = follow(frontier).select("root", "node").where("node is not null").distinct()
        new = new.join(known.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(k))
        frontier = checkpointed(new if admit is None else admit(new, known))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def over_links(links: DataFrame, source: str, target: str) -> Callable[[DataFrame], DataFrame]:
    """Following rows of a table."""
    step = links.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct()
    return lambda frontier: frontier.join(step, F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node"))


def by_moves(moves: Callable[[Column], list[Column]], allowed: Callable[[Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Following moves that are computed from a node: a graph that no table holds."""

    def follow(frontier: DataFrame) -> DataFrame:
        new = frontier.select("root", F.explode(F.array(*moves(F.col("node")))).alias("node"))
        return new if allowed is None else new.where(allowed(F.col("node")))

    return follow


def crawl(links: DataFrame, roots: DataFrame, depth: int, per_site: int | None = None, per_run: int | None = None, source: str = "parent_url", target: str = "url") -> DataFrame:
    """Rows (root, node, depth) of a crawl that keeps to the host of its root, of links and roots (a column `node`, normalised URLs).

    Budgets bound the pages visited, the nearest first and then by URL: `per_site` of a host, `per_run` of all roots together.
    """
    same = urls.host(F.col("node")) == urls.host(F.col("root"))
    step = over_links(links, source, target)
    starts = roots.select(F.col("node").alias("root"), "node")
    if per_site is None and per_run is None:
        return search(starts, lambda f: step(f).where(same), depth)

    def admit(new: DataFrame, known: DataFrame) -> DataFrame:
        got = new
        if per_site is not None:
            host = urls.host(F.col("node"))
            used = known.groupBy(host.alias("_host")).agg(F.countDistinct("node").alias("_used"))
            own = F.dense_rank().over(W.partitionBy("_host").orderBy("node"))
            got = got.withColumn("_host", host).withColumn("_n", own).join(used, "_host", "left")
            got = got.where(F.col("_n") + F.coalesce("_used", F.lit(0)) <= per_site).drop("_host", "_n", "_used")
        if per_run is not None:
            left = per_run - known.select("node").distinct().count()
            pages = got.select("node").distinct().orderBy("node").limit(max(left, 0))
            got = got.join(pages, "node", "left_semi").select("root", "node", "depth")
        return got

    return search(starts, lambda f: step(f).where(same), depth, admit)
