"""Learners: evidence, mastery, review, combos, ledgers, daily activity, readiness and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.folds import fold
from gleanery.operators.pairs import paired

# Review intervals in days, and hours until a missed unit is due.
LADDER = (1, 3, 7, 14, 30)
MISSED_HOURS = 6
# Mistakes are held between 0 and 8, two up and one down.
MOST_MISTAKES, UP, DOWN = 8, 2, 1
# Experience for an answer.
WRONG_XP, RIGHT_XP, COMBO_XP, MOST_COMBO = 2, 10, 2, 10
LEVEL_XP = 350


def from_events(events: DataFrame) -> DataFrame:
    """Answers out of the driver's events: learner, unit (k modulo 10), correct, time and order."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("user_id").alias("learner"), (k % 10).alias("unit"), (F.col("event_type") != "error").alias("correct"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def mastery(correct: Column, attempts: Column) -> Column:
    return F.when(attempts == 0, 0.5).otherwise((correct + 1.0) / (attempts + 2.0))


def _answered(s: tuple, correct: bool | None, ts) -> tuple[tuple, None]:
    """Attempts, right ones, mistakes, review interval and last time after one more answer."""
    attempts, right, mistakes, interval, _ = s
    if correct:
        up = next((d for d in LADDER if interval < d), LADDER[-1])
        return (attempts + 1, right + 1, max(mistakes - DOWN, 0), up, ts), None
    return (attempts + 1, right, min(mistakes + UP, MOST_MISTAKES), 0, ts), None


def evidence(answers: DataFrame) -> DataFrame:
    """Counters of each learner and unit, with the saturating mistakes and the review ladder folded in time order; an answer that is not known counts as wrong."""
    schema = "attempts long, n_correct long, mistakes int, interval int, last_seen timestamp"
    rows = fold(answers, ["learner", "unit"], ["ts", "event_id"], ["correct", "ts"], schema, lambda: (0, 0, 0, 0, None), _answered, lambda s: s)
    hours = F.when(F.col("interval") > 0, F.col("interval") * 24).otherwise(MISSED_HOURS)
    return rows.select("learner", "unit", "attempts", "n_correct", "mistakes", F.col("interval").alias("interval_days"), "last_seen", (F.col("last_seen") + F.make_dt_interval(hours=hours)).alias("next_review"), mastery(F.col("n_correct"), F.col("attempts")).alias("mastery"))


def state(attempts: Column, mastery_: Column) -> Column:
    """Fixed cut-offs: under three attempts is new; then by mastery."""
    return F.when(attempts == 0, "UNSEEN").when(attempts < 3, "NEW").when(mastery_ < 0.55, "WEAK").when(mastery_ < 0.76, "GROWING").otherwise("CONFIDENT")


def combos(answers: DataFrame) -> DataFrame:
    """Adds combo (right answers in a row so far), best combo, xp gain and running xp."""
    order = W.partitionBy("learner").orderBy("ts", "event_id")
    wrong = F.sum((~F.col("correct")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = answers.withColumn("_island", wrong)
    inside = W.partitionBy("learner", "_island").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("combo", F.when(F.col("correct"), F.sum(F.col("correct").cast("int")).over(inside)).otherwise(0))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    gain = F.when(F.col("correct"), RIGHT_XP + COMBO_XP * F.least(F.col("combo"), F.lit(MOST_COMBO))).otherwise(WRONG_XP)
    return rows.withColumns({"best_combo": F.max("combo").over(running), "xp_gain": gain}).withColumn("xp", F.sum("xp_gain").over(running)).drop("_island")


def daily(answers: DataFrame) -> DataFrame:
    """One row a learner and day; the best combo is that of the day's answers in the learner's whole run."""
    rows = combos(answers).withColumn("day", F.to_date("ts"))
    return rows.groupBy("learner", "day").agg(F.count(F.lit(1)).alias("answered"), F.count_if("correct").alias("n_correct"), F.sum("xp_gain").alias("xp"), F.max("combo").alias("best_combo"))


def activity(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row a learner and day of answers (learner, ts, event_id, correct, xp, crystals, combo, pack) and sessions completed (learner, ts).

    Negative gains count nothing; the last pack is that of the day's last answer; a day with sessions only has no answers and no pack.
    """
    day = F.to_date("ts").alias("day")
    gain = lambda c: F.sum(F.greatest(F.col(c), F.lit(0))).cast("long").alias(c)
    own = answers.groupBy("learner", day).agg(F.count(F.lit(1)).alias("answered"), F.count_if("correct").alias("n_correct"), gain("xp"), gain("crystals"), F.max("combo").alias("best_combo"), F.max_by("pack", F.struct("ts", "event_id")).alias("last_pack"))
    done = sessions.groupBy("learner", day).agg(F.count(F.lit(1)).alias("sessions"))
    return own.join(done, ["learner", "day"], "full").na.fill(0, ["answered", "n_correct", "xp", "crystals", "best_combo", "sessions"])


def filled_days(days: DataFrame, last: Column, n: int = 7) -> DataFrame:
    """The last n days of each learner, empty ones included."""
    grid = days.select("learner").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(last, n - 1), last)))
    return grid.join(days, ["learner", "day"], "left").na.fill(0)


def ledger(entries: DataFrame, most_credit: int | None = None) -> DataFrame:
    """Entries in order with whether they are accepted (a debit above the balance is not) and the balance after; a null delta changes nothing."""

    def step(balance: int, event_id: int, delta: int | None) -> tuple[int, tuple]:
        after = balance + (delta or 0)
        if most_credit is not None:
            after = min(after, most_credit)
        balance = after if after >= 0 else balance
        return balance, (event_id, delta, after >= 0, balance)

    schema = "event_id long, delta long, accepted boolean, balance long"
    return fold(entries, ["learner"], ["ts", "event_id"], ["event_id", "delta"], schema, lambda: 0, step)


def readiness(ev: DataFrame, weights: DataFrame, now: Column) -> DataFrame:
    """Weighted readiness and confidence in percent, with the three weakest units. Fixed: full confidence at five attempts, prior 0.35, 0.05 off when due.

    Units are summed in their order, alike at any partitioning; a learner's units are one row. The middle of two percents goes up: a sum of doubles may
    miss it by some 1e-14, so places after the tenth do not count.
    """
    learners = ev.select("learner").distinct()
    rows = paired(learners, weights.where("weight > 0")).join(ev, ["learner", "unit"], "left")
    n = F.coalesce("attempts", F.lit(0))
    sure = F.least(F.lit(1.0), n / 5.0)
    estimate = mastery(F.coalesce("n_correct", F.lit(0)), n) * sure + 0.35 * (1 - sure)
    due = (n > 0) & (F.col("next_review") <= now)
    rows = rows.withColumns({"sure": sure, "estimate": F.when(due, F.greatest(F.lit(0.0), estimate - 0.05)).otherwise(estimate)})
    percent = lambda x: F.floor(F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 10) + 0.5).cast("int")
    weakest = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.round("estimate", 9), "unit"))), 1, 3), lambda s: s["unit"])
    units = F.array_sort(F.collect_list(F.struct("unit", "weight", (F.col("weight") * F.col("estimate")).alias("estimate"), (F.col("weight") * F.col("sure")).alias("sure")))).alias("_u")
    total = lambda c: F.aggregate("_u", F.lit(0.0), lambda a, x: a + x[c])
    return rows.groupBy("learner").agg(units, weakest.alias("weakest")).select("learner", percent(total("estimate") / total("weight")).alias("readiness"), percent(total("sure") / total("weight")).alias("confidence"), "weakest")


def adaptive_rank(questions: DataFrame, ev: DataFrame, weights: DataFrame, now: Column) -> DataFrame:
    """Questions (question, unit, prerequisites) by priority for each learner, lowest first."""
    learners = ev.select("learner").distinct()
    pairs = paired(learners, questions.join(weights, "unit", "left"))
    own = pairs.join(ev, ["learner", "unit"], "left")
    pre = pairs.select("learner", "question", F.explode("prerequisites").alias("unit")).join(ev.select("learner", "unit", "mastery"), ["learner", "unit"], "left")
    blocked = pre.groupBy("learner", "question").agg(F.avg(F.greatest(F.lit(0.0), 0.65 - F.coalesce("mastery", F.lit(0.5)))).alias("blocked"))
    rows = own.join(blocked, ["learner", "question"], "left")
    direct = F.coalesce("mastery", F.lit(0.5)) - 0.08 * F.least(F.coalesce("mistakes", F.lit(0)), F.lit(4))
    due = F.when(F.col("next_review") <= now, 0.22).otherwise(0.0)
    p = direct + 1.5 * F.coalesce("blocked", F.lit(0.0)) - due - 0.25 * F.coalesce("weight", F.lit(0.0))
    return rows.select("learner", "question", F.round(p, 9).alias("priority"))
