"""Document structure: sections, tasks and parts out of marked lines, their edges, and networks of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import profile
from gleanery.functions.urls import host
from gleanery.operators.documents import segments
from gleanery.sources.folders import checkpointed


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 20 hex digits of SHA-1 over the trimmed parts in lower case."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *[F.lower(F.trim(p.cast("string"))) for p in parts])), 1, 20))


def tasks(rows: DataFrame, section: Column, task: Column, by: str = "doc_id", order: str = "pos", line: str = "line") -> DataFrame:
    """One row a task: lines from a task marker up to the next one or the next section. Lines before the first marker of a section are its task 0.

    `section` and `task` are marker conditions, so a rule profile is a pair of expressions.
    """
    rows = segments(rows, section, by, order).withColumnRenamed("segment", "section")
    running = W.partitionBy(by, "section").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("task", F.sum((F.coalesce(task, F.lit(False)) & ~F.coalesce(section, F.lit(False))).cast("int")).over(running))
    got = rows.groupBy(by, "section", "task").agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.min_by(line, order).alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("body"))
    got = got.withColumn("kind", profile.kind(F.col("body")))
    short = F.length(F.trim("body")) < 40
    confidence = F.round(0.95 - F.when(F.col("task") == 0, 0.15).otherwise(0.0) - F.when(short, 0.2).otherwise(0.0), 3)
    return got.withColumns({"task_id": stable_id("task", F.col(by), F.col("section"), F.col("task")), "n_chars": F.length("body"), "confidence": confidence, "review": confidence < 0.78})


def composition(rows: DataFrame, owner: str, part: str, order: str) -> DataFrame:
    """Edges (source, kind, target): an owner owns its parts, and each part depends on the one before it."""
    owns = rows.select(F.col(owner).cast("string").alias("source"), F.lit("OWNS_PART").alias("kind"), F.col(part).cast("string").alias("target"))
    before = F.lag(part).over(W.partitionBy(owner).orderBy(order))
    depends = rows.withColumn("_b", before).where("_b is not null").select(F.col(part).cast("string").alias("source"), F.lit("DEPENDS_ON").alias("kind"), F.col("_b").cast("string").alias("target"))
    return owns.unionByName(depends)


def network(links: DataFrame) -> DataFrame:
    """Nodes (id, kind, value, n) of sites, pages and resources, with how many links lead from or to them."""
    node = lambda kind, value: (F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(value, 256), 1, 24)).alias("id"), F.lit(kind).alias("kind"), value.alias("value"))
    out = [links.select(*node("site", host(F.col("parent_url")))), links.select(*node("page", F.col("parent_url"))), links.select(*node("resource", F.col("url")))]
    return out[0].unionAll(out[1]).unionAll(out[2]).groupBy("id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def reachable(edges: DataFrame, source: str, target: str, roots: DataFrame, depth: int) -> DataFrame:
    """Rows (node, depth): nodes within `depth` steps of the roots (a column `node`), each at its least depth."""
    step = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct()
    known = frontier = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for k in range(1, depth + 1):
        new = frontier.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        frontier = checkpointed(new.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def coverage_ratios(rows: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """Counts of rows that meet each flag and all of them, and the share of the latter."""
    every = F.lit(True)
    for f in flags:
        every = every & F.col(f)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(f).alias(f) for f in flags], F.count_if(every).alias("runnable"))
    return out.withColumn("ratio", F.round(F.col("runnable") / F.col("total"), 9))


def gap_clusters(rows: DataFrame, flags: list[str]) -> DataFrame:
    """How many rows fail each flag."""
    gaps = F.array_compact(F.array(*[F.when(~F.col(f), f"missing:{f}") for f in flags]))
    return rows.select(F.explode(gaps).alias("gap")).groupBy("gap").count()


def reviewed(machine: DataFrame, decisions: DataFrame, key: str, value: str, human: str) -> DataFrame:
    """Machine values beside human ones: UNREVIEWED, CONFIRMED or CHANGED."""
    rows = machine.join(decisions.select(key, F.col(human).alias("human")), key, "left")
    decision = F.when(F.col("human").isNull(), "UNREVIEWED").when(F.col("human") == F.col(value), "CONFIRMED").otherwise("CHANGED")
    return rows.withColumn("decision", decision)


def first_seen_order(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Distinct values of each key in the order in which they first came."""
    first = rows.groupBy(by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))
