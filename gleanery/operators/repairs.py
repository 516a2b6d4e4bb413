"""Repairs of rows that older versions have written: versioned, safe to repeat, with a log of what they changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls

LOG = "key string, repair string, version int, field string, before string, after string"


@dataclass
class Repair:
    """A pass over rows: which rows it is for, and what it makes of their columns."""

    name: str
    version: int
    broken: Column
    fixed: dict[str, Column] = field(default_factory=dict)


def entity_urls(column: str) -> Repair:
    """URLs in which `&section` was read as a character reference and became a sign."""
    return Repair("entity_urls", 2, F.col(column).contains("§ion"), {column: F.replace(F.col(column), F.lit("§ion"), F.lit("&section"))})


def renamed_units(column: str, units: dict[str, str]) -> Repair:
    """Ids of units that are called otherwise now; a new id must not be an old one of another."""
    if clash := set(units) & set(units.values()):
        raise ValueError(f"ids both old and new: {sorted(clash)}")
    names = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    return Repair("renamed_units", 1, F.col(column).isin(*units), {column: F.try_element_at(names, F.col(column))})


def balanced_ledger(balance: str, earned: str, spent: str) -> Repair:
    """Balances from before the ledger: what is missing counts as earned."""
    short = F.col(balance) - (F.col(earned) - F.col(spent))
    return Repair("balanced_ledger", 1, short > 0, {earned: F.col(earned) + short})


def apply(rows: DataFrame, key: str, repairs: list[Repair], log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows as repaired, and the log with what was changed added: rows (key, repair, version, field, before, after).

    Repairs go in their order, each over what the one before has made. A row that the log names for a repair in its version or a later one
    is left alone, so a repair whose condition still holds afterwards happens once too. A null condition is no fault.
    """
    spark = rows.sparkSession
    log = spark.createDataFrame([], LOG) if log is None else log
    entries = []
    for r in repairs:
        done = log.where((F.col("repair") == r.name) & (F.col("version") >= r.version)).select(F.col("key").alias("_key")).distinct().withColumn("_done", F.lit(True))
        marked = rows.withColumn("_key", F.col(key).cast("string")).join(done, "_key", "left")
        marked = marked.withColumn("_broken", F.coalesce(r.broken, F.lit(False)) & F.col("_done").isNull())
        told = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), new.cast("string").alias("after")) for c, new in r.fixed.items()]
        changed = marked.where("_broken").select(F.col("_key").alias("key"), F.explode(F.filter(F.array(*told), lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("f"))
        entries.append(changed.select("key", F.lit(r.name).alias("repair"), F.lit(r.version).alias("version"), "f.*"))
        kinds = dict(rows.dtypes)
        rows = marked.withColumns({c: F.when(F.col("_broken"), new.cast(kinds[c])).otherwise(F.col(c)) for c, new in r.fixed.items()}).select(*rows.columns)
    for e in entries:
        log = log.unionByName(e)
    return rows, log


def moved_errors(errors: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors (url, error) that only say what kind of file was met are no errors: they become observations (resource_id, mime), beside those in `seen`."""
    kind = F.regexp_extract("error", "^non-html:(.*)$", 1)
    is_kind = F.coalesce(F.col("error").startswith("non-html:"), F.lit(False))
    found = errors.where(is_kind).select(urls.resource_id(F.col("url")).alias("resource_id"), F.trim(F.lower(F.split(kind, ";")[0])).alias("mime")).distinct()
    new = found.where("resource_id <> '' and mime <> ''").join(seen.select("resource_id", "mime"), ["resource_id", "mime"], "left_anti")
    return errors.where(~is_kind), seen.select("resource_id", "mime").unionByName(new)


def to_visit_again(links: DataFrame, queued: DataFrame, sign: str = "§ion") -> DataFrame:
    """Parents of links with a broken sign that are not queued yet, with the root they were found from: rows (url, root, depth 0)."""
    broken = links.where(F.col("url").contains(sign) & (F.coalesce("parent_url", F.lit("")) != ""))
    parents = broken.groupBy(F.col("parent_url").alias("url")).agg(F.min(F.coalesce(F.col("source_url"), F.col("parent_url"))).alias("root"))
    return parents.join(queued.select("url"), "url", "left_anti").withColumn("depth", F.lit(0))
