"""Human edits replayed, and which of several structures and decisions counts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.folds import fold
from gleanery.sources.exports import numbered


def replayed(starts: DataFrame, edits: DataFrame, by: str = "doc") -> DataFrame:
    """Rows (by, starts): a document's sorted starts after its edits (by, seq, op, at, to), one after the other.

    move takes the start `at` to `to`, split halves the piece that begins at `at` up to the next start, merge and delete take the start `at` away,
    create adds `to`. An edit of a start that isn't there changes nothing. Starts and edits of one document are few: both are arrays.
    """
    first = starts.groupBy(by).agg(F.array_sort(F.collect_set("start")).alias("_s"))
    log = edits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "at", "to"))).alias("_e"))

    def step(acc: Column, e: Column) -> Column:
        there = F.array_contains(acc, e["at"])
        following = F.array_min(F.filter(acc, lambda x: x > e["at"]))
        middle = F.floor((e["at"] + following) / 2).cast("long")
        without = F.array_remove(acc, e["at"])
        new = F.when(there & (e["op"] == "move"), F.array_append(without, e["to"])).when(there & (e["op"] == "split") & following.isNotNull(), F.array_append(acc, middle))
        new = new.when(there & e["op"].isin("merge", "delete"), without).when(e["op"] == "create", F.array_append(acc, e["to"])).otherwise(acc)
        return F.array_sort(F.array_distinct(new))

    both = first.join(log, by, "left")
    return both.select(by, F.aggregate(F.coalesce("_e", F.array().cast(log.schema["_e"].dataType)), F.col("_s"), step).alias("starts"))


PIECE = "array<struct<id:string,label:string,start:int,end:int,tasks:array<string>,confidence:double,confirmed:boolean,corrected:boolean>>"
# Fixed value: the confidence that the second half of a split piece has at most.
HALF = 0.72


def _edited(pieces: list[dict], doc: str, seq: int, op: str, at: str) -> list[dict]:
    """The pieces of a document after one edit of the piece `at`; one that isn't there, or an edit that doesn't fit, changes nothing."""
    i = next((k for k, p in enumerate(pieces) if p["id"] == at), None)
    if i is None:
        return pieces
    one, out = dict(pieces[i]), list(pieces)
    out[i] = one
    if op == "accept":
        one |= {"confirmed": True, "confidence": 1.0}
    elif op == "left" and one["start"] > 1:
        one |= {"start": one["start"] - 1, "corrected": True}
    elif op == "right":
        one |= {"end": one["end"] + 1, "corrected": True}
    elif op == "split" and one["end"] > one["start"]:
        middle, cut = (one["start"] + one["end"]) // 2, -(-len(one["tasks"]) // 2)
        name = hashlib.sha1(f"{doc}|human-split|{seq}|{middle + 1}".encode()).hexdigest()[:20]
        later = one | {"id": f"section_{name}", "label": one["label"] + " B", "start": middle + 1, "tasks": one["tasks"][cut:], "confidence": min(one["confidence"], HALF), "corrected": True}
        one |= {"label": one["label"] + " A", "end": middle, "tasks": one["tasks"][:cut], "corrected": True}
        out.insert(i + 1, later)
    elif op == "merge" and i + 1 < len(out):
        after = out.pop(i + 1)
        one |= {"label": f"{one['label']} + {after['label']}", "end": max(one["end"], after["end"]), "tasks": one["tasks"] + after["tasks"], "corrected": True}
    elif op == "delete":
        del out[i]
    return out


def pieces(sections: DataFrame, edits: DataFrame, by: str = "doc") -> DataFrame:
    """Rows (by, nth, id, label, start, end, tasks, confidence, confirmed, corrected): the sections of each document after its edits, one after the other.

    Sections are rows (by, nth, id, label, start, end, tasks, confidence), edits rows (by, seq, op, at) that name a piece by its id: accept, left (begins a
    page earlier), right (ends a page later), split (at the middle page, tasks by halves), merge (with the next piece), delete. What the pieces
    have is a document's state, so edits of any number stream past it. Edits of documents without sections change nothing.
    """
    empty = F.lit(None)
    first = sections.select(by, F.lit(0).alias("turn"), F.col("nth").cast("long").alias("seq"), F.lit("").alias("op"), "id", "label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("tasks", F.array().cast("array<string>")).alias("tasks"), F.col("confidence").cast("double").alias("confidence"))
    later = edits.select(by, F.lit(1).alias("turn"), F.col("seq").cast("long").alias("seq"), "op", F.col("at").alias("id"), empty.cast("string").alias("label"), empty.cast("int").alias("start"), empty.cast("int").alias("end"), empty.cast("array<string>").alias("tasks"), empty.cast("double").alias("confidence"))

    def step(state: list[dict], doc, turn, seq, op, id_, label, start, end, tasks, confidence) -> tuple[list[dict], None]:
        if turn == 0:
            return [*state, {"id": id_, "label": label or "", "start": start, "end": end, "tasks": list(tasks), "confidence": confidence, "confirmed": False, "corrected": False}], None
        return _edited(state, str(doc), seq, op, id_), None

    fields = ["turn", "seq", "op", "id", "label", "start", "end", "tasks", "confidence"]
    both = first.unionByName(later).withColumn("_doc", F.col(by))
    done = fold(both, [by], ["turn", "seq", "op", "id"], ["_doc", *fields], f"pieces {PIECE}", list, step, lambda s: (s,))
    return done.select(by, F.posexplode("pieces").alias("nth", "p")).select(by, "nth", "p.*")


def preferred(keys: DataFrame, by: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """`keys` with `source` and `value`: of sources (by, value), the first that has the key."""
    out = keys
    for name, df in sources:
        out = out.join(df.select(by, F.col("value").alias(f"_{name}")), by, "left")
    source = F.coalesce(*[F.when(F.col(f"_{name}").isNotNull(), F.lit(name)) for name, _ in sources])
    return out.select(*keys.columns, source.alias("source"), F.coalesce(*[F.col(f"_{name}") for name, _ in sources]).alias("value"))


def review_state(decisions: DataFrame, by: str) -> DataFrame:
    """Rows (by, fields, decided, state) of decisions (by, decision: null, CONFIRMED, CHANGED or REJECTED)."""
    rows = decisions.groupBy(by).agg(F.count(F.lit(1)).alias("fields"), F.count("decision").alias("decided"), F.count_if(F.col("decision") == "REJECTED").alias("_no"))
    state = F.when(F.col("_no") > 0, "REJECTED").when(F.col("decided") == 0, "UNREVIEWED").when(F.col("decided") < F.col("fields"), "IN_REVIEW").otherwise("COMPLETE")
    return rows.withColumn("state", state).drop("_no")


def distractors(entries: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Rows (key, place, other): k other entries for each, those that follow it in the order of a hash, around the end: an equi-join on places."""
    rows = numbered(entries.select(key, F.md5(F.col(key).cast("string")).alias("_h")), "_h", key).select(key, "nth")
    n = rows.count()
    want = rows.select(key, "nth", F.explode(F.sequence(F.lit(1), F.lit(min(k, n - 1)))).alias("place")) if n > 1 else rows.select(key, "nth", F.lit(0).alias("place")).limit(0)
    want = want.withColumn("nth", F.pmod(F.col("nth") + F.col("place"), F.lit(max(n, 1))))
    return want.join(rows.select("nth", F.col(key).alias("other")), "nth").select(key, "place", "other")


def in_band(texts: DataFrame, visuals: DataFrame, above: float = 80.0, below: float = 120.0) -> DataFrame:
    """Rows (doc, page, pos, n, x0, y0, x1, y1): how many visuals of the page overlap a text's band, and the box around them and the text."""
    side = visuals.select("doc", "page", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = texts.join(side, ["doc", "page"]).where((F.col("_y1") >= F.col("y0") - above) & (F.col("_y0") <= F.col("y1") + below))
    box = [f(F.col(c), F.col(f"_{c}")).alias(c) for f, c in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))]
    return both.select("doc", "page", "pos", *box).groupBy("doc", "page", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
