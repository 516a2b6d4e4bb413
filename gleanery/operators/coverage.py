"""Coverage: cells of counts and histograms, presence, rule joins, bundles, evaluation. Unknown stays null and is counted as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Presence of material, from the weakest to the strongest.
STATES = ("unknown", "catalogued", "located", "raw")


def missing(columns: list[str]) -> Column:
    """Names of the columns that are null, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in columns])), ",")


def histogram(rows: DataFrame, column: str, default: str = "UNKNOWN") -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit(default)).alias(column)).count()


def cells(rows: DataFrame, keys: list[str], histograms: dict[str, str], example: str, most: int = 4) -> DataFrame:
    """One row a cell: its rows, a histogram map for each name -> column, and the smallest examples.

    Histograms are counted per value first, so a cell gathers a few values and no rows; only the smallest examples are gathered.
    """
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    for name, c in histograms.items():
        per = rows.groupBy(*keys, F.coalesce(c, F.lit("UNKNOWN")).alias("_v")).count()
        out = out.join(per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "count")))).alias(name)), keys)
    first = rows.select(*keys, example).distinct().withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(example))).where(F.col("_n") <= most)
    return out.join(first.groupBy(*keys).agg(F.sort_array(F.collect_list(example)).alias("examples")), keys)


def rank_of(state: Column) -> Column:
    out = F.lit(0)
    for k, s in enumerate(STATES):
        out = F.when(state == s, k).otherwise(out)
    return out


def presence(catalog: DataFrame, observed: DataFrame, keys: list[str], state: str) -> DataFrame:
    """The best state of each cell that the catalogue or an observation names; catalogued alone is the weakest."""
    both = catalog.select(*keys).distinct().withColumns({"_rank": F.lit(1), "_seen": F.lit(0)}).unionByName(observed.select(*keys, rank_of(F.col(state)).alias("_rank"), F.lit(1).alias("_seen")))
    best = both.groupBy(*keys).agg(F.max("_rank").alias("_rank"), F.sum("_seen").alias("observations"))
    return best.select(*keys, F.element_at(F.array(*map(F.lit, STATES)), F.col("_rank") + 1).alias("state"), "observations")


def wildcard_match(packs: DataFrame, grants: DataFrame, attributes: list[str], order: str) -> DataFrame:
    """The first grant of each pack, where an empty grant attribute fits all. Grants are a small dimension."""
    g = grants.select(*[F.col(c).alias(f"_g_{c}") for c in [*attributes, order]])
    on = F.lit(True)
    for c in attributes:
        on = on & (F.col(f"_g_{c}").isNull() | (F.col(f"_g_{c}") == F.col(c)))
    found = packs.join(g, on, "left")
    return found.groupBy(*packs.columns).agg(F.min(f"_g_{order}").alias(order))


def paired(gold: DataFrame, machine: DataFrame, keys: list[str], order: str) -> DataFrame:
    """k-th occurrence of a key in one table with the k-th in the other; unmatched rows of both stay."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    a, b = nth(gold).select(*keys, "nth", F.col(order).alias("gold")), nth(machine).select(*keys, "nth", F.col(order).alias("machine"))
    return a.join(b, [*keys, "nth"], "full")


def bundles(assets: DataFrame, keys: list[str], role: str, asset: str) -> DataFrame:
    """Deterministic groups of assets of equal metadata, with their roles and whether they complement each other."""
    group = F.concat(F.lit("set_"), F.substring(F.sha1(F.lower(F.concat_ws("|", *keys))), 1, 20))
    return assets.groupBy(group.alias("bundle_id"), *keys).agg(F.count(F.lit(1)).alias("assets"), F.sort_array(F.collect_set(role)).alias("roles"), F.min(asset).alias("first_asset"), (F.countDistinct(role) > 1).alias("complementary"))


def binary_metrics(rows: DataFrame, gold: str, machine: str, by: list[str] | None = None) -> DataFrame:
    """Exact counts, with precision and recall that are null where nothing could be counted."""
    g, m = F.col(gold) == 1, F.col(machine) == 1
    out = rows.groupBy(*(by or [])).agg(F.count_if(g & m).alias("tp"), F.count_if(~g & m).alias("fp"), F.count_if(g & ~m).alias("fn"), F.count_if(~g & ~m).alias("tn"))
    return out.withColumns({"precision": F.expr("try_divide(tp, tp + fp)"), "recall": F.expr("try_divide(tp, tp + fn)")})
