"""Repair of conversations by cheapest edits.

A conversation's rows, in the order of their turns, are to have roles whose initials read `(s?(ua)+)?`. A row is kept (cost 0), gets the
role user or assistant (3) or is deleted (4); a row of either role without text may be put in anywhere (3). Rows at fault (the first that
holds: blank, a duplicate of an earlier row in role and text, truncated) are deleted where blank or duplicates, and cost 3 more where
they are truncated and stay. The audit is the edits' initials (D, I, K, R) in order; of the cheapest ones the least in ASCII.

1. The first row of each role and text in a conversation is found by an aggregation of digests. These marks and the rows are parted by
   ranges of (conversation, turn, role, digest) and sorted, so a long conversation spreads over many tasks and no window is needed.
2. A task walks its rows. A conversation that lies within the task is repaired there; the first and the last one may go on in other
   tasks, and leave a segment: a byte for each row, and the texts if they are few. Segments are put together by conversation.
3. A conversation is a graph of (rows done, state of the pattern). Arcs cost 0 to 6, so Dial's buckets give the distance of each node to
   the end; the audit walks from the start along tight arcs, the least letter first. Both go by blocks of rows, so that memory is some
   bytes for each row whatever the length.
4. Conversations of over `HELD` bytes of text are not kept in memory: their rows are sorted again behind their audit, and streamed.

Defined cases: a null role or text is one space; null turns come first and count for no gap; a null conversation id is an id like others;
rows of one turn are taken by role, then by a digest of the text; repeated rows are duplicates; a conversation whose rows are all
deleted has an empty repair; an empty table gives an empty table; other columns are left out, as rows do not outlive their repair.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm.frames import shuffle_partitions, stored, text_bytes

#: Bytes of a conversation's texts that a task holds, bytes of text in a part, rows whose distances are held at once.
HELD, PART, BLOCK = 16 << 20, 32 << 20, 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
#: States of the pattern: start, behind s, behind u, behind a; the state that the next user or assistant leads to; its role.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: The state that keeping an initial (s, u, a, other) leads to, by state; -1: not allowed.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
FAR = 1 << 60
#: The pattern's blanks are space and the controls from tab to carriage return.
WORDY, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


# 3. cheapest edits of rows given as bytes: initial (0 to 3) + 4 x fault


def _arcs(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits that take the row away in this state: letter, next state, cost."""
    initial, fault = code & 3, code >> 2
    yield "D", state, DELETE
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if (to := KEPT[state][initial]) >= 0:
        yield "K", to, KEEP + more
    yield "R", NEXT[state], REROLE + more


#: For each row's byte and each state, the edits in the order of their letters; and, backwards, what leads to each state.
EDITS = [[sorted([*_arcs(code, s)]) for s in range(4)] for code in range(16)]
STEPS = [[sorted([*EDITS[code][s], ("I", NEXT[s], INSERT)]) for s in range(4)] for code in range(16)]
BACK = [[[(s, cost) for s in range(4) for _, to, cost in EDITS[code][s] if to == t] for t in range(4)] for code in range(16)]
BEHIND = [[s for s in range(4) if NEXT[s] == t] for t in range(4)]


def distances(codes: bytes, end: list[int]) -> list[int]:
    """Cheapest cost from each node (row, state) to the end, where the states cost `end`: Dial's buckets, backwards."""
    n = len(codes)
    dist = [FAR] * (4 * (n + 1))
    base = min(end)
    buckets: list[list[int]] = [[] for _ in range(max(x for x in end if x < FAR) - base + 1)]
    for s, x in enumerate(end):
        if x < FAR:
            dist[4 * n + s] = x
            buckets[x - base].append(4 * n + s)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:  # arcs of cost 0 add to the bucket at hand
            at = d + base
            if dist[node] != at:
                continue
            row, t = divmod(node, 4)
            before = [(4 * row + s, INSERT) for s in BEHIND[t]]
            if row:
                before += [(4 * (row - 1) + s, cost) for s, cost in BACK[codes[row - 1]][t]]
            for other, cost in before:
                if at + cost < dist[other]:
                    dist[other] = at + cost
                    while d + cost >= len(buckets):
                        buckets.append([])
                    buckets[d + cost].append(other)
        d += 1
    return dist


def audit(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and letters of the least of the cheapest audits."""
    edges = [*range(0, len(codes), block), len(codes)]
    ends, dist = [[0, FAR, FAR, 0]], distances(b"", [0, FAR, FAR, 0])
    for lo, hi in zip(edges[-2::-1], edges[:0:-1], strict=True):
        dist = distances(codes[lo:hi], ends[-1])
        ends.append(dist[:4])
    cost, letters, state = dist[0], [], 0
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = codes[lo:hi]
        if k:  # the first block's are at hand
            dist = distances(part, ends[len(ends) - 2 - k])
        row, last = 0, hi == len(codes)
        while row < len(part) or (last and dist[4 * row + state]):
            here = dist[4 * row + state]
            steps = STEPS[part[row]][state] if row < len(part) else [("I", NEXT[state], INSERT)]
            letter, to = next((x, t) for x, t, more in steps if here == more + dist[4 * (row + (x != "I")) + t])
            letters.append(letter)
            row, state = row + (letter != "I"), to
    return cost, "".join(letters)


def applied(letters: Iterable[str], rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of what stays of the rows (role, text), and what is put in."""
    state, rows = 0, iter(rows)
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield letter, ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            role = ROLE[state]
        elif letter == "K":
            state = KEPT[state]["sua".find(role[:1])]
        if letter != "D":
            yield letter, role, text


def digest(lines: Iterable[tuple[str, str, str]]) -> str:
    """SHA-256 of `role:text` lines."""
    h, new = hashlib.sha256(), ""
    for _, role, text in lines:
        h.update(f"{new}{role}:{text}".encode())
        new = "\n"
    return h.hexdigest()


# 1. and 2. rows in order


def _ordered(rows: DataFrame, parts: int) -> DataFrame:
    """Rows and marks of first ones, by ranges and in order."""
    marks = rows.groupBy("conv", "dig").agg(F.min(F.struct("known", "turn", "role")).alias("m")).select("conv", "m.*", "dig")
    nothing = {"text": F.lit(""), "initial": F.lit(0), "fault": F.lit(0), "kind": F.lit(0)}
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks.withColumns(nothing))
    place = ["conv", "known", "turn", "role", "dig"]
    return both.repartitionByRange(parts, *place).sortWithinPartitions(*place, "kind")


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    body = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    initial = F.coalesce(*[F.when(F.col("role").startswith(c), F.lit(k)) for k, c in enumerate("sua")], F.lit(3))
    fault = F.when(~F.col("text").rlike(WORDY), F.lit(BLANK)).when(~F.col("text").rlike(ENDED), F.lit(CUT)).otherwise(F.lit(0))
    # told apart by the role's length too, so that no two pairs read the same
    dig = F.unhex(F.md5(F.encode(F.concat_ws(":", F.length("role"), "role", "text"), "UTF-8")))
    return body.select("conv", F.col("turn").isNotNull().cast("int").alias("known"), "turn", "role", "text", dig.alias("dig"), initial.alias("initial"), fault.alias("fault"))


class Segment:
    """A conversation's rows in a task."""

    def __init__(self, conv, held: int):
        self.conv, self.codes, self.held, self.size = conv, bytearray(), held, 0
        self.roles: list[str] | None = []
        self.texts: list[str] | None = []
        self.lo = self.hi = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.hi:
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
            self.turns += 1
        if self.texts is not None:
            self.size += len(role) + len(text)
            self.roles.append(role)
            self.texts.append(text)
            if self.size > self.held:
                self.roles = self.texts = None

    def then(self, other: Segment) -> None:
        """Adds the segment that follows."""
        self.codes += other.codes
        self.turns += other.turns - (self.hi is not None and self.hi == other.lo)
        self.lo = other.lo if self.lo is None else self.lo
        self.hi = self.hi if other.hi is None else other.hi
        self.size += other.size
        if self.texts is None or other.texts is None or self.size > self.held:
            self.roles = self.texts = None
        else:
            self.roles += other.roles
            self.texts += other.texts

    def result(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        initial, fault = codes & 3, codes >> 2
        cost, letters = audit(bytes(self.codes))
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        told = None if self.texts is None else digest(applied(letters, zip(self.roles, self.texts, strict=True)))
        counts = [int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)]
        return (self.conv, gaps, *counts, int((~LEGAL[initial[:-1], initial[1:]]).sum()), cost, letters, told)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = ["conv", *(c.split()[0] for c in RESULT.split(", "))]


def _segments(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[Segment]:
    now, mark = None, None
    for batch in batches:
        for conv, known, turn, role, text, dig, initial, fault, kind in zip(*(batch.column(c).to_pylist() for c in ("conv", "known", "turn", "role", "text", "dig", "initial", "fault", "kind")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now
                now, mark = Segment(conv, held), None
            if kind == 0:
                mark = (known, turn, dig)
                continue
            if fault != BLANK and mark != (known, turn, dig):
                fault = DUPLICATE
            mark = None
            now.add(turn, role, text, initial + 4 * fault)
    if now is not None:
        yield now


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held: int = HELD, parts: int | None = None) -> DataFrame:
    """One row for each conversation: its id, gaps (turns that lack between the lowest and the highest), rows by their fault, adjacent
    initials other than su, ua and au, cost, audit, and the SHA-256 of the repaired lines `role:text`."""
    parts = parts or max(shuffle_partitions(rows), text_bytes(rows, text) // PART)
    body = _rows(rows, conv, turn, role, text)
    kind = StructType([body.schema["conv"]])
    schema = f"{kind.simpleString()[7:-1].replace(':', ' ', 1)}, {RESULT}"
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv_type, done = None, []

        def out(own: list[tuple], segment: Segment | None = None) -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in own], t) for k, t in enumerate([conv_type, *types])]
            cols += [pa.array([part] * len(own), pa.int32()), pa.array([segment and pickle.dumps(segment)] * len(own), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [*NAMES, "part", "segment"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv").type
                yield b

        last, first = None, True
        for s in _segments(seen(), held):
            if last is not None:
                if first:  # it may have begun in another task
                    yield out([(last.conv, *[None] * 8)], last)
                    first = False
                else:
                    done.append(last.result())
                if len(done) == 1000:
                    yield out(done)
                    done = []
            last = s
        if done:
            yield out(done)
        if last is not None:  # it may go on in another task
            yield out([(last.conv, *[None] * 8)], last)

    found = stored(_ordered(body, parts).mapInArrow(run, f"{schema}, part int, segment binary"))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        whole, *others = map(pickle.loads, table.column("segment").to_pylist())
        for s in others:
            whole.then(s)
        own = whole.result()
        return pa.table([pa.array([own[k]], t) for k, t in enumerate([table.schema.field("conv").type, *types])], NAMES)

    cut = found.where("segment is not null").groupBy("conv").applyInArrow(join, schema)
    every = stored(found.where("segment is null").select(*NAMES).unionByName(cut))
    long = every.where("repaired_sha256 is null")
    if not long.isEmpty():
        told = _lines(body, long, parts).mapInArrow(_digests, f"{schema.split(', ')[0]}, told string")
        told = told.withColumnRenamed("conv", "_conv")
        every = every.join(told, every["conv"].eqNullSafe(told["_conv"]), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "told", F.lit(hashlib.sha256().hexdigest())))
    return every.select(F.col("conv").alias(conv), *NAMES[1:])


# 4. repaired rows


def _lines(body: DataFrame, audits: DataFrame, parts: int) -> DataFrame:
    """Rows (conv, place, edit, role, text) of the conversations in `audits`, each in order and within one task."""
    own = audits.select(F.col("conv").alias("_conv"), "audit")
    rows = body.join(own.select("_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi").select("conv", "known", "turn", "role", "dig", "text")
    heads = own.select(F.col("_conv").alias("conv"), F.lit(-1).alias("known"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("dig"), F.col("audit").alias("text"))
    place = ["conv", "known", "turn", "role", "dig"]
    kind = StructType([body.schema["conv"]]).simpleString()[7:-1].replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.schema.field("conv").type]
                yield from zip(*(b.column(c).to_pylist() for c in ("conv", "known", "role", "text")), strict=True)

        stream, out = rows(), []
        for conv, _, _, letters in stream:  # an audit, whose rows follow
            own = ((role, text) for _, (_, _, role, text) in zip(range(len(letters) - letters.count("I")), stream, strict=False))
            for k, (edit, role, text) in enumerate(applied(letters, own)):
                out.append((conv, k, edit, role, text))
                if len(out) == 1000:
                    yield _batch(out, types[0])
                    out = []
        if out:
            yield _batch(out, types[0])

    return heads.unionByName(rows).repartition(parts, "conv").sortWithinPartitions(*place).mapInArrow(run, f"{kind}, place long, edit string, role string, text string")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], ["conv", "place", "edit", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's lines, which come in order."""
    now, h = None, None
    for b in batches:
        kind = b.schema.field("conv").type
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])], ["conv", "told"])  # noqa: B023, E731
        for conv, place, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "place", "role", "text")), strict=True):
            if place == 0:
                if h is not None:
                    yield out()
                now, h = conv, hashlib.sha256()
            h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if h is not None:
        yield out()


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held: int = HELD) -> DataFrame:
    """The repaired rows: conversation, place in it from 0, edit (I, K or R), role and text."""
    parts = max(shuffle_partitions(rows), text_bytes(rows, text) // PART)
    audits = repair(rows, conv, turn, role, text, held, parts).select(F.col(conv).alias("conv"), "audit")
    return _lines(_rows(rows, conv, turn, role, text), audits, parts).withColumnRenamed("conv", conv)
