"""Bundles of files that belong together: proposed edges with confidences, and exceptions in a fixed order.

Assets are rows (asset, bundle, role, audio): `audio` names a recording that the asset comes with, or is null. A null role is none;
assets without a bundle are in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.structure import stable_id

# Kinds of edges between roles of one bundle, by the roles that must both be there, with confidences and how they were found.
BETWEEN = [
    ("HAS_ANSWER", "answers", "Task set", "Answer set", 0.94, "problemset_structure"),
    ("SCORED_BY", "criteria", "Writing", "Criterion rubric", 0.88, "problemset_structure"),
    ("USES_TRANSCRIPT", "script", "Listening", "Transcript", 0.91, "problemset_structure"),
    ("USES_AUDIO", "audio", "Listening", "", 0.99, "problemset_media_link"),
]
SEVERAL, ALONE, MEDIA = 0.96, 0.78, 0.99
ROLES = {"tasks": "TASK_SET", "answers": "ANSWER_KEY", "criteria": "CRITERIA", "script": "LISTENING_SCRIPT"}


def flags(assets: DataFrame) -> DataFrame:
    """Rows (bundle, files, media, tasks, answers, criteria, script, audio): what each bundle holds; `media` is its first recording by asset."""
    rows = assets.where(F.col("bundle").isNotNull())
    has = [F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(n) for n, r in ROLES.items()]
    first = F.min_by("audio", F.when(F.col("audio").isNotNull(), F.col("asset")))
    got = rows.groupBy("bundle").agg(F.countDistinct("asset").alias("files"), first.alias("media"), *has)
    return got.withColumn("audio", F.col("media").isNotNull())


def edges(assets: DataFrame) -> DataFrame:
    """Rows (bundle, source, kind, target, confidence, method): the assets and the recording that a bundle contains, and edges between its roles."""
    held = flags(assets)
    node = stable_id("problemset", F.col("bundle"))
    media = stable_id("media", F.col("media"))
    sure = F.when(F.col("files") > 1, SEVERAL).otherwise(ALONE)
    own = assets.select("bundle", "asset").distinct().join(held.select("bundle", "files"), "bundle")
    owns = own.select("bundle", node.alias("source"), F.lit("CONTAINS_ASSET").alias("kind"), stable_id("asset", F.col("asset")).alias("target"), sure.alias("confidence"), F.lit("bundle_key").alias("method"))

    def edge(condition: Column, source: Column, kind: str, target: Column, confidence: float, method: str) -> Column:
        return F.when(condition, F.struct(source.alias("source"), F.lit(kind).alias("kind"), target.alias("target"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")))

    found = [edge(F.col("audio"), node, "CONTAINS_MEDIA", media, MEDIA, "source_filename_contract")]
    found += [edge(F.col("tasks") & F.col(other), F.lit(a), kind, F.lit(b) if b else media, sure_of, how) for kind, other, a, b, sure_of, how in BETWEEN]
    return owns.unionByName(held.select("bundle", F.explode(F.array_compact(F.array(*found))).alias("e")).select("bundle", "e.*"))


def shared_criteria(found: DataFrame) -> DataFrame:
    """Rows (bundle, shared): whether a criterion of the bundle scores several things."""
    n = found.where("kind = 'SCORED_BY'").groupBy("bundle", "target").count()
    return n.groupBy("bundle").agg((F.max("count") > 1).alias("shared"))


def exceptions(documents: DataFrame, held: DataFrame, labels: DataFrame, criteria: DataFrame | None = None) -> DataFrame:
    """Rows (doc, nth, exception, detail) in the order of the rules, of documents (doc, bundle).

    `held`: `flags`; `labels`: rows (doc, section, task) of section and task labels, for listening sections and labels that repeat;
    `criteria`: `shared_criteria` of the edges after review.
    """
    text = F.lower(F.trim(F.coalesce("task", F.lit(""))))
    heard = labels.groupBy("doc").agg(F.coalesce(F.bool_or(F.lower("section").contains("listening")), F.lit(False)).alias("listening"))
    twice = labels.where(text != "").groupBy("doc", text.alias("label")).count().where("count > 1").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("repeated"))
    rows = documents.join(held, "bundle").join(heard, "doc", "left").join(twice, "doc", "left")
    rows = rows.join(criteria, "bundle", "left") if criteria is not None else rows.withColumn("shared", F.lit(False))
    task, answer, script, audio = (F.col(c) for c in ("tasks", "answers", "script", "audio"))
    rules = [
        (task & ~answer, "task_without_answer", None),
        (answer & ~task, "answer_without_task", None),
        (script & ~task, "script_without_task", None),
        (F.col("listening") & ~audio, "listening_without_audio", None),
        (audio & ~task, "audio_without_task", None),
        ((F.col("files") == 1) & ~audio, "incomplete_bundle", None),
        (F.col("repeated").isNotNull(), "ambiguous_numbering", F.col("repeated")),
        (F.col("shared"), "criterion_of_several_tasks", None),
    ]
    each = [F.when(c, F.struct(F.lit(k).alias("nth"), F.lit(name).alias("exception"), (F.lit("") if detail is None else detail).alias("detail"))) for k, (c, name, detail) in enumerate(rules, 1)]
    return rows.select("doc", F.explode(F.array_compact(F.array(*each))).alias("e")).select("doc", "e.*")
