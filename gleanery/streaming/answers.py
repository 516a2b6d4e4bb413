"""Answer events as streams: daily totals with a watermark, first-seen links, evidence kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.learner import LADDER, MOST_MISTAKES


def daily_totals(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Answers and right answers of each learner and day; events later than `late` are dropped."""
    day = answers.withWatermark("ts", late).groupBy("learner", F.window("ts", "1 day").alias("w"))
    return day.agg(F.count(F.lit(1)).alias("answered"), F.count_if("correct").alias("n_correct")).select("learner", F.to_date("w.start").alias("day"), "answered", "n_correct")


def first_seen(links: DataFrame, key: str = "id", stamp: str = "found_at", late: str = "7 days") -> DataFrame:
    """Each link once, within the watermark."""
    return links.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


_STATE = "attempts long, n_correct long, mistakes int, interval_days int"
_OUT = f"learner long, unit int, {_STATE}"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts, right, mistakes, days = state.get if state.exists else (0, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ok in rows["correct"].tolist():
        attempts += 1
        right += ok
        mistakes = max(0, mistakes - 1) if ok else min(MOST_MISTAKES, mistakes + 2)
        days = next((x for x in LADDER if days < x), LADDER[-1]) if ok else 0
    state.update((attempts, right, mistakes, days))
    yield pd.DataFrame({"learner": [key[0]], "unit": [key[1]], "attempts": [attempts], "n_correct": [right], "mistakes": [mistakes], "interval_days": [days]})


def evidence(answers: DataFrame) -> DataFrame:
    """Counters of each learner and unit after each batch; within a batch events are taken in time order."""
    return answers.groupBy("learner", "unit").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
