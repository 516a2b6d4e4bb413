"""Layout: body spans, gaps, columns and the binding of artifacts to bodies, over boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import boxes


def body_spans(rows: DataFrame, by: list[str], box: str = "box") -> DataFrame:
    """The union box of each group and how many rows it has."""
    b = F.col(box)
    got = rows.groupBy(*by).agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"), F.count(F.lit(1)).alias("n"))
    return got.select(*by, boxes.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("body"), "n")


def large_gaps(rows: DataFrame, by: list[str], order: list[Column], box: str = "box", least: float = 96.0) -> DataFrame:
    """Rows that begin more than `least` below the row before them."""
    before = F.lag(F.col(box)["y1"]).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("gap", F.col(box)["y0"] - before).where(F.col("gap") > least)


def columns(rows: DataFrame, by: list[str], box: str = "box", apart: float = 40.0) -> DataFrame:
    """Whether the centres of a group's rows lie so far apart that it has several columns."""
    centre = (F.col(box)["x0"] + F.col(box)["x1"]) / 2
    return rows.groupBy(*by).agg((F.max(centre) - F.min(centre)).alias("spread")).withColumn("several", F.col("spread") > apart)


def bind(artifacts: DataFrame, bodies: DataFrame, page: list[str], artifact: str, body_key: str, page_width: float, least: float = 0.42) -> DataFrame:
    """The best body on its page for each artifact, if it fits well enough."""
    pairs = artifacts.join(bodies, page).withColumn("score", F.round(boxes.binding(F.col("box"), F.col("body"), F.lit(page_width)), 3)).where(F.col("score") >= least)
    return pairs.groupBy(artifact).agg(F.max_by(F.struct(body_key, "score"), F.struct("score", (-F.col(body_key)).alias("k"))).alias("m")).select(artifact, f"m.{body_key}", "m.score")
