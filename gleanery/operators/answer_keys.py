"""Answer keys computed on their own: inversions, orders and choices that meet a condition, and keys held against those that were given.

Inversions are counted without pairs of rows. A key of no more rows than a block holds is counted where its rows meet, sorted twice and
not written out by bits. The rows of a larger key get their place and their rank by ranges of the table. Those whose ranks agree above the
lowest bits are few enough to be counted in the same way; others are in the wrong order by the highest bit in which their ranks differ, so
for each of the upper bits the rows that agree above it are counted in blocks of places: a block's own inversions, and its zeros times the
ones in the blocks before. Work is n rows, and for large keys n log(n / block) rows more; a block is the most that meets in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.sources.exports import numbered
from gleanery.sources.folders import checkpointed, discard

#: Rows of a key that are counted where they meet, and places in a block of a larger key.
BLOCK = 1 << 16
#: Items whose orders, and whose choices, are written out at most.
ORDERS, CHOICES = 8, 16


def _ones_ahead(place: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Inversions of each group: `place` holds groups of `n` numbers from 0 to n - 1, each once, that begin at `start`. Halved by bits, from the highest."""
    first, end, at = np.repeat(start, n), np.repeat(start + n, n), np.arange(len(place))
    found = np.zeros(len(start), np.int64)
    for bit in reversed(range(int(n.max() - 1).bit_length())):
        # numbers that agree above the bit are side by side, in the order in which they came
        low = first + (place >> (bit + 1) << (bit + 1))
        one = (place >> bit & 1).astype(bool)
        ones = np.cumsum(one) - one
        ahead = ones - ones[low]
        found += np.add.reduceat(np.where(one, 0, ahead), start)
        to = np.where(one, np.minimum(low + (1 << bit), end) + ahead, at - ahead)
        place[to] = place.copy()
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group of rows side by side: its keys, `n` and its inversions. Groups go over the ends of batches."""
    held = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch])
        sizes, starts, end = rows["n"].to_numpy(), [], 0
        while end < len(sizes) and end + sizes[end] <= len(sizes):
            starts.append(end)
            end += int(sizes[end])
        if starts:
            found = _ones_ahead(rows["place"].to_numpy()[:end].astype(np.int64), np.array(starts), sizes[starts])
            yield from rows.drop_columns(["place"]).take(starts).append_column("inversions", pa.array(found)).to_batches()
        held = rows.slice(end).to_batches()


def _counted(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows (*keys, n, inversions) of groups that are small enough for a task."""
    own = W.partitionBy(*keys)
    placed = rows.select(*keys, F.col(value).alias("_v"), F.count(F.lit(1)).over(own).alias("n"), (F.row_number().over(own.orderBy(*order)) - 1).alias("place"))
    out = rows.select(*keys).schema.add("n", "long").add("inversions", "long")
    return placed.sortWithinPartitions(*keys, "_v", "place").select(*keys, "n", "place").mapInArrow(_counts, out)


def inversions(rows: DataFrame, by: str, order: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """Rows (by, n, inversions): for each key, how many pairs have the greater value first. Equal values are in order; rows with a null value take no part; a null key is one."""
    slim = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    o = [f"o{i}" for i in range(len(order))]
    large = checkpointed(slim.groupBy("k").count().where(F.col("count") > block).select(F.col("k").alias("key")))
    named = F.col("k").alias(by), "n", "inversions"
    if large.isEmpty():
        discard(large)
        return _counted(slim, ["k"], [*o, "v"], "v").select(*named)
    same = F.col("k").eqNullSafe(F.col("key"))
    small = _counted(slim.join(large, same, "left_anti"), ["k"], [*o, "v"], "v")
    return small.unionByName(_by_bits(slim.join(large, same, "left_semi"), o, block)).select(*named)


def _by_bits(slim: DataFrame, order: list[str], block: int) -> DataFrame:
    """Rows (k, n, inversions) of keys of more than `block` rows (k, *order, v)."""
    placed = numbered(slim, "k", *order, "v").select("k", "v", F.col("nth").alias("place"))
    ranked = numbered(placed, "k", "v", "place").select("k", "place", F.col("nth").alias("rank"))
    ranked = checkpointed(ranked)
    sizes = checkpointed(ranked.groupBy(F.col("k").alias("key")).agg(F.min("rank").alias("lowest"), F.count(F.lit(1)).alias("n")))
    own = ranked.join(sizes, F.col("k").eqNullSafe(F.col("key"))).select("k", "place", (F.col("rank") - F.col("lowest")).alias("r"), "n")
    lowest = block.bit_length() - 1
    near = _counted(own.select("k", F.shiftright("r", lowest).alias("above"), "place", "r"), ["k", "above"], ["place"], "r").select("k", "inversions")
    bits = F.ceil(F.log2(F.col("n"))).cast("int")
    each = own.withColumn("bit", F.explode(F.sequence(F.lit(lowest), bits - 1)))
    one = F.expr("cast(shiftright(r, bit) & 1 as long)")
    each = each.select("k", "bit", F.expr("shiftright(r, bit + 1)").alias("above"), F.floor(F.col("place") / block).alias("block"), "place", one.alias("one"))
    part = ["k", "bit", "above", "block"]
    before = F.sum("one").over(W.partitionBy(*part).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    inner = F.when(F.col("one") == 0, before).otherwise(0)
    blocks = each.withColumn("inner", inner).groupBy(*part).agg(F.sum("inner").alias("inner"), F.sum("one").alias("ones"), F.sum(1 - F.col("one")).alias("zeros"))
    ahead = F.coalesce(F.sum("ones").over(W.partitionBy("k", "bit", "above").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = blocks.withColumn("ahead", ahead).select("k", (F.col("inner") + F.col("zeros") * F.col("ahead")).alias("inversions"))
    found = near.unionByName(far).groupBy("k").agg(F.sum("inversions").alias("inversions"))
    return sizes.join(found, F.col("key").eqNullSafe(F.col("k"))).select(F.col("key").alias("k"), "n", "inversions")


def count_orders(rows: DataFrame, key: str, items: Column, holds: Callable[[Column], Column], distinct: bool = True) -> DataFrame:
    """Rows (key, orders): in how many orders the items of an array meet a condition; equal items make equal orders, counted once if `distinct`.

    Arrays of over `ORDERS` items raise; an empty or null one has one order.
    """
    few = F.when(F.size(F.coalesce(items, F.array())) > ORDERS, F.raise_error(F.lit(f"orders of over {ORDERS} items are not written out"))).otherwise(items)
    at = rows.select(F.col(key).alias("k"), F.coalesce(few, F.array()).alias("items"))
    kind = at.schema["items"].dataType.simpleString()
    # equal items side by side: an order is made once if it takes the first of them; arrays of the same items make the same orders
    held = F.collect_set(F.array_sort("items")) if distinct else F.collect_list("items")

    def grown(o: Column) -> Column:
        left, n = o["left"], F.size(o["left"])
        fresh = lambda i: F.when(i == 1, True).otherwise(~F.element_at(left, i).eqNullSafe(F.element_at(left, i - 1)))
        places = F.sequence(F.lit(1), n)
        each = F.transform(F.filter(places, fresh) if distinct else places, lambda i: F.struct(F.concat(o["order"], F.slice(left, i, F.lit(1))).alias("order"), F.concat(F.slice(left, F.lit(1), i - 1), F.slice(left, i + 1, n)).alias("left")))
        # orders that are complete go through unchanged
        return F.when(n > 0, each).otherwise(F.array(o))

    made = F.transform("held", lambda xs: F.struct(F.array().cast(kind).alias("order"), xs.alias("left")))
    for _ in range(ORDERS):
        made = F.flatten(F.transform(made, grown))
    good = F.filter(made, lambda o: F.coalesce(holds(o["order"]), F.lit(False)))
    return at.groupBy("k").agg(held.alias("held")).select(F.col("k").alias(key), F.size(good).cast("long").alias("orders"))


def count_choices(rows: DataFrame, key: str, items: Column, n: Column, holds: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (key, choices): in how many ways `n` items of an array, told apart by their places, can be chosen so that they meet a condition."""
    size = F.size(F.coalesce(items, F.array()))
    few = F.when(size > CHOICES, F.raise_error(F.lit(f"choices of over {CHOICES} items are not written out"))).otherwise(size)
    at = rows.select(F.col(key).alias("k"), F.coalesce(items, F.array()).alias("items"), n.alias("n"), few.alias("size"))
    at = at.withColumn("mask", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, size) - 1"))))
    chosen = F.filter("items", lambda x, i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) > 0)
    fits = F.bit_count("mask") == F.col("n")
    if holds is not None:
        fits = fits & F.coalesce(holds(chosen), F.lit(False))
    return at.groupBy("k").agg(F.count_if(F.coalesce(fits, F.lit(False))).alias("choices")).withColumnRenamed("k", key)


def disagreements(given: DataFrame, found: DataFrame, key: str, answer: str) -> DataFrame:
    """Rows (key, given, found) of keys whose given answer is not the computed one, or that only one side has."""
    both = given.select(key, F.col(answer).alias("given")).join(found.select(key, F.col(answer).alias("found")), key, "full")
    return both.where(~F.col("given").eqNullSafe(F.col("found")))
