"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.frames import discard, stored

#: Nodes that a task links in memory at a time.
NODES = 200_000


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v), v < u, that make the same components as `links`: stars around the lowest node that a task's own links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars() -> pa.RecordBatch:
            both = [(x, r) for x in parent if (r := find(x)) != x]
            return pa.RecordBatch.from_pydict({"u": [x for x, _ in both], "v": [r for _, r in both]}, schema=kind)

        kind = None
        for b in batches:
            kind = b.schema
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > NODES:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return links.mapInArrow(run, links.schema)


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the lowest node that each linked node reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014) over links that each task has contracted to stars before: a step
    takes one partial aggregation and one join, both of which bear a node with very many links; the number of steps grows with the
    logarithm of the longest chain. They end when every link leads from a node to the lowest of its component.
    """
    edges = stored(contracted(links.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))))
    while True:
        # the lowest neighbours are written, so that the join's both sides are exchanged by Spark and hot nodes can be split
        both = edges.union(edges.select("v", "u"))
        lower, higher = F.when(F.col("v") < F.col("u"), F.col("v")), F.col("v") > F.col("u")
        seen = both.groupBy("u").agg(F.min("v").alias("m"), F.min(lower).alias("first"), F.max(lower).alias("last"), F.max(higher).alias("above"))
        star = F.col("first").isNull() | ((F.col("first") == F.col("last")) & ~F.col("above"))
        low = stored(seen.select("u", F.least("u", "m").alias("m"), star.alias("star")))
        if low.where("not star").isEmpty():
            discard(edges)
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = stored(contracted(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        discard(edges, low)
        edges = stored(contracted(small))
        discard(large, least)
