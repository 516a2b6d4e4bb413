"""Work queues, document states, plans and diverse picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.folds import fold
from gleanery.operators.pairs import paired

# A document is given up at these answers, or after so many attempts.
LOST = (401, 403, 404, 410)
MOST_ATTEMPTS = 5


def work_queue(rows: DataFrame, n: int, statuses: list[str], priority: str, attempts: str, first_seen: str, key: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The next n rows to work on: highest priority, then fewest attempts, then oldest."""
    ready = rows.where(F.col("status").isin(*statuses) & (F.col(attempts) < most))
    return ready.orderBy(F.desc(priority), attempts, first_seen, key).limit(n)


def document_states(attempts: DataFrame, by: str, order: list[str]) -> DataFrame:
    """State of each document after its attempts (code, ok) in order: PENDING, DOWNLOADED, FAILED_RETRYABLE or FAILED_TERMINAL; a final state stays."""

    def step(s: tuple[str, int], code: int | None, ok: bool | None) -> tuple[tuple[str, int], None]:
        status, n = s
        if status in ("DOWNLOADED", "FAILED_TERMINAL"):
            return s, None
        lost = code in LOST or n + 1 >= MOST_ATTEMPTS
        return ("DOWNLOADED" if ok else "FAILED_TERMINAL" if lost else "FAILED_RETRYABLE", n + 1), None

    return fold(attempts, [by], order, ["code", "ok"], "status string, attempts int", lambda: ("PENDING", 0), step, lambda s: s)


def preparation(ev: DataFrame, weights: DataFrame, now: Column, days: int) -> DataFrame:
    """Each learner's questions a day, units due and three units to focus on. The weights of the parts are fixed values."""
    rows = paired(ev.select("learner").distinct(), weights).join(ev, ["learner", "unit"], "left")
    remaining = F.greatest(F.lit(0), F.greatest(F.lit(3), F.ceil(F.col("weight") * 40)) - F.coalesce("attempts", F.lit(0)))
    due = F.coalesce(F.col("next_review") <= now, F.lit(False)).cast("int")
    gap = remaining + F.col("weight") * 10 + 8 * due + 10 * F.greatest(F.lit(0.0), 0.75 - F.coalesce("mastery", F.lit(0.5)))
    rows = rows.withColumns({"remaining": remaining, "due": due, "gap": F.round(gap, 9)})
    got = rows.groupBy("learner").agg(F.sum("remaining").alias("remaining"), F.sum("due").alias("due"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("g"), "unit"))), 1, 3).alias("f"))
    daily = F.ceil(F.col("remaining") / F.lit(days)) + F.least(F.col("due"), F.lit(3))
    return got.select("learner", F.greatest(F.lit(5), F.least(F.lit(20), daily)).cast("int").alias("questions"), F.col("due").cast("int").alias("due"), F.transform("f", lambda x: x["unit"]).alias("focus"))


def diverse(ranked: DataFrame, by: str, order: list[str], unit: str, item: str, n: int, same: int = 2, back: int = 7) -> DataFrame:
    """The first n items in order, of which at most `same` of a unit come within the last `back` picks."""

    def step(s: tuple[int, tuple], what, kind) -> tuple[tuple[int, tuple], tuple | None]:
        place, recent = s
        if place >= n or recent.count(kind) >= same:
            return s, None
        return (place + 1, (*recent, kind)[-back:]), (place, what)

    kinds = ranked.schema[item].dataType.simpleString()
    return fold(ranked, [by], order, [item, unit], f"place int, {item} {kinds}", lambda: (0, ()), step)


def next_items(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def latest_of(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key."""
    return next_items(rows, [by], order, n).drop("place")
