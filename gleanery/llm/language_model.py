"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end a text. Every word has a class and a place in it: of the `TOP` most frequent training words each
has a place of its own, in classes by frequency; all others share places by hashing, in classes by their last two bytes. A token's
probability is that of its class given the context, times that of its place in the class given the context, both softmaxes that are
learnt, times that of the word among those of its place: add-one counts (an unseen word takes the one spare count of its place, so
probabilities sum to one). Features of the context are the places of the words one, two and three before (skips), the hashed pair before,
and for places in a class the hashed pair of class and word before: n-grams and skips act on every word.

Counts cover all training texts: each chunk asks hash buckets for its distinct words (see `exchange`). Weights are trained by
distributed gradient updates: training texts are dealt to shards of about `SHARD` bytes by a hash of key and text, and shards to `ROUNDS`
rounds; each shard descends on its texts from the common weights, and the mean of the shards' steps, weighted by their tokens and
summed in blocks in a tree of fan-in `FAN`, is the common step. Each training token gives a gradient in exactly one round. Shards, the order of
their texts and that of their steps depend on the rows alone, so scores do not depend on how the input is partitioned.

Words are told apart by 60 hash bits and their class.

Defined cases: null and empty texts are one end token; rows with a null key are scored but not learnt from; without any training
text every probability is that of an unseen word; repeated rows count as often as they occur; other columns are kept, and results
replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import exchange as X
from gleanery.llm import words as W
from gleanery.llm.frames import give_back, masked, schema_with, shuffle_partitions, stored, text_bytes

#: Places of a class; classes of the most frequent words and of all others.
MEMBERS, TOP_CLASSES, REST_CLASSES = 32, 16, 16
CLASSES = TOP_CLASSES + REST_CLASSES
TOP, REST = MEMBERS * TOP_CLASSES, MEMBERS * REST_CLASSES
#: Symbols of a context: all places, and none (before the text).
SYMBOLS = TOP + REST + 1
PAIRS, INNER = 1 << 13, 1 << 13
ROWS = 1 + 3 * SYMBOLS + PAIRS
END = W.mix(np.array([7], W.U))[0] & ~W.U(REST_CLASSES - 1)
ROUNDS, BATCH, RATE = 2, 8192, 0.15
#: Bytes of text of a training shard.
SHARD = 8 << 20
BLOCKS, FAN = 16, 64
#: Tasks that merge the buckets' top words.
MERGERS = 16


class Tokens:
    """Keys of some texts' tokens, each text's end among them, and the first token of each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = W.split(data, off, W.NOT_SPACE, lower=True)
        last = w.data[w.end - 1].astype(np.uint32)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint32)
        ending = (((last | (before << 8)) * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(W.U)
        keys = (W.word_hashes(w) & ~W.U(REST_CLASSES - 1)) | ending
        self.keys = np.insert(keys, w.first[1:], END)
        self.first = w.first + np.arange(len(w.first))


def place(keys: np.ndarray) -> np.ndarray:
    """Which of the REST places a word takes that is not among the top words: its class by its ending, its place in that by its hash."""
    return ((keys & W.U(REST_CLASSES - 1)) * W.U(MEMBERS) + ((keys >> W.U(32)) & W.U(MEMBERS - 1))).astype(np.int64)


@dataclass
class Model:
    top: np.ndarray = field(default_factory=lambda: np.zeros(0, W.U))  # keys of the top words, sorted, and their ranks
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: int = 0  # N and V
    types: int = 0
    rest: np.ndarray = field(default_factory=lambda: np.ones(REST))  # counts and types and one in each place outside the top
    outer: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, CLASSES), np.float32))
    inner: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES + INNER, MEMBERS), np.float32))

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        rest = place(keys) + TOP
        if not len(self.top):
            return rest
        at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
        return np.where(self.top[at] == keys, self.rank[at], rest)

    def dead(self) -> np.ndarray | None:
        """Places of the top classes that no word has, if there are any."""
        free = (np.arange(TOP + REST) < TOP) & (np.arange(TOP + REST) >= len(self.top))
        return free.reshape(CLASSES, MEMBERS) if free.any() else None


def contexts(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the rows of the features of its class (but for row 0, which all have), and of those of its place."""
    n = len(symbol)
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in (1, 2, 3):
        s = np.full(n, SYMBOLS - 1)
        s[k:] = np.where(at[k:] >= k, symbol[:-k], SYMBOLS - 1)
        back.append(s)
    pair = (back[0] * SYMBOLS + back[1]).astype(W.U) * W.U(0x9E3779B97F4A7C15) >> W.U(64 - 13)
    cls = symbol // MEMBERS
    inner = (back[0] * CLASSES + cls).astype(W.U) * W.U(0xC2B2AE3D27D4EB4F) >> W.U(64 - 13)
    outer = np.stack([1 + back[0], 1 + SYMBOLS + back[1], 1 + 2 * SYMBOLS + back[2], 1 + 3 * SYMBOLS + pair.astype(np.int64)])
    return outer.astype(np.uint16), np.stack([cls, CLASSES + inner.astype(np.int64)]).astype(np.uint16)


def _logits(m: Model, outer: np.ndarray, inner: np.ndarray, rows: np.ndarray, inside: np.ndarray, dead: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logits of classes and of places, with a highest of 0."""
    z = outer.take(rows[0], axis=0)
    for k in (1, 2, 3):
        z += outer.take(rows[k], axis=0)
    z += outer[0]
    y = inner.take(inside[0], axis=0)
    y += inner.take(inside[1], axis=0)
    if dead is not None:
        y[dead[inside[0]]] = -1e9
    for x in (z, y):
        x -= x.max(1, keepdims=True)
    return z, y


def log10_probabilities(m: Model, symbol: np.ndarray, count: np.ndarray, first: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """log10 of each token's probability; `count` is its count in the training texts."""
    rows, inside = contexts(symbol, first)
    out, dead = np.empty(len(symbol)), m.dead()
    for i in range(0, len(symbol), batch):
        s = symbol[i : i + batch]
        n = np.arange(len(s))
        p = np.zeros(len(s))
        for x, own in zip(_logits(m, m.outer, m.inner, rows[:, i : i + batch], inside[:, i : i + batch], dead), (s // MEMBERS, s % MEMBERS), strict=True):
            p += x[n, own]
            np.exp(x, out=x)
            p -= np.log(x.sum(1))
        p /= np.log(10)
        o = np.flatnonzero(s >= TOP)
        p[o] += np.log10((count[i : i + batch][o] + 1) / m.rest[s[o] - TOP])
        out[i : i + batch] = p
    return out


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One step on the rows that a batch touches, shorter for rows with much gradient so far."""
    order = np.argsort(rows, kind="stable")
    lead = X.starts(rows[order])
    which = rows[order[lead]]
    g = np.add.reduceat(grad.take(order, axis=0), lead, axis=0)
    seen[which] += np.einsum("ij,ij->i", g, g) / g.shape[1]
    table[which] -= g * (rate / np.sqrt(seen[which] + 1))[:, None]


def learn(m: Model, outer: np.ndarray, inner: np.ndarray, seen: tuple[np.ndarray, np.ndarray], symbol: np.ndarray, first: np.ndarray, order: np.ndarray, rate: float = RATE, batch: int = BATCH) -> None:
    """Gradient steps on the tokens in the given order, in batches."""
    rows, inside = contexts(symbol, first)
    rows, inside, symbol = rows[:, order], inside[:, order], symbol[order]
    dead = m.dead()
    for i in range(0, len(symbol), batch):
        r, t, s = rows[:, i : i + batch], inside[:, i : i + batch], symbol[i : i + batch]
        n = np.arange(len(s))
        z, y = _logits(m, outer, inner, r, t, dead)
        for x, own in ((z, s // MEMBERS), (y, s % MEMBERS)):
            np.exp(x, out=x)
            x /= x.sum(1, keepdims=True)
            x[n, own] -= 1
        _descend(outer, seen[0], np.zeros(1, np.uint16), z.sum(0, keepdims=True), rate)
        for k in range(4):
            _descend(outer, seen[0], r[k], z, rate)
        for k in range(2):
            _descend(inner, seen[1], t[k], y, rate)


# counts


class Counted:
    """Distinct tokens of a chunk and their counts in its training texts."""

    def __init__(self, table: pa.Table, text: str):
        self.table = table
        data, off = W.buffers(table.column(text))
        parts = [Tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in W.blocks(off)]
        self.keys = np.concatenate([np.zeros(0, W.U), *(p.keys for p in parts)])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts] or [np.zeros(0, np.int64)]))]).astype(np.int64)
        self.types, self.type_of = np.unique(self.keys, return_inverse=True)

    def bounds(self, buckets: int) -> np.ndarray:
        edge = np.array([min(-(-(k << 64) // buckets), (1 << 64) - 1) for k in range(buckets)], W.U)
        return np.append(np.searchsorted(self.types, edge), len(self.types))

    def questions(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        learnt = np.repeat(self.table.column("_learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(self.first))
        n = np.bincount(self.type_of[learnt], minlength=len(self.types))
        at = self.bounds(buckets)
        for k in range(buckets):
            keys = self.types[at[k] : at[k + 1]]
            if len(keys):
                yield k, X.pack(keys[0], np.diff(keys).view(np.uint8).reshape(-1, 8).T.copy(), n[at[k] : at[k + 1]].astype(np.uint32))


#: The row of a bucket that tells of itself, not to a chunk.
OF_ALL = -1


def _total(payloads: list[bytes]) -> tuple[list[bytes], bytes]:
    keys, counts = [], []
    for p in payloads:
        lead, planes, n = X.unpack(p)
        keys.append(np.cumsum(np.concatenate([[lead], np.ascontiguousarray(planes.T).view(W.U).ravel()]), dtype=W.U))
        counts.append(n.astype(np.int64))
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    lead = X.starts(every[order])
    sums = np.add.reduceat(np.concatenate(counts)[order], lead)
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(lead, len(order))))
    out = [X.pack(x) for x in np.split(total, np.cumsum([len(k) for k in keys])[:-1])]
    types = every[order][lead]
    at = place(types)
    rest = np.stack([np.bincount(at, sums, REST), np.bincount(at, sums > 0, REST)])
    high = np.lexsort((types.view(np.int64), -sums))[:TOP]
    high = high[sums[high] > 0]
    return out, X.pack(rest, types[high], sums[high])


def count(rows: DataFrame, text: str, buckets: int) -> DataFrame:
    """Rows (chunk, bucket, payload): the training counts of each chunk's distinct tokens, and of each bucket its totals."""
    questions = X.ask(rows, lambda t: Counted(t, text).questions(buckets))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(X.CHUNK)
        out, own = _total(table.column(X.PAYLOAD).to_pylist())
        chunk = [*table.column(X.CHUNK).to_pylist(), OF_ALL]
        bucket = table.column(X.BUCKET)[0].as_py()
        return pa.table({X.CHUNK: pa.array(chunk, pa.int32()), X.BUCKET: pa.array([bucket] * len(chunk), pa.int32()), X.PAYLOAD: pa.array([*out, own], pa.binary())})

    return questions.groupBy(X.BUCKET).applyInArrow(run, f"{X.CHUNK} int, {X.BUCKET} int, {X.PAYLOAD} binary")


def vocabulary(counts: DataFrame) -> Model:
    """Totals and top words from the buckets' own rows. The driver gets a row for each place and `TOP` words."""
    own = counts.where(F.col(X.CHUNK) == OF_ALL).select(X.PAYLOAD).repartition(MERGERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by place, and the top words of what a task has read."""
        rest, keys, n = np.zeros((2, REST)), np.zeros(0, W.U), np.zeros(0, np.int64)
        for b in batches:
            for p in b.column(0).to_pylist():
                more, k, c = X.unpack(p)
                rest += more
                keys, n = np.concatenate([keys, k]), np.concatenate([n, c])
                high = np.lexsort((keys.view(np.int64), -n))[:TOP]
                keys, n = keys[high], n[high]
        columns = [np.concatenate([np.arange(REST), np.full(len(keys), -1)]), np.concatenate([np.zeros(REST, np.int64), keys.view(np.int64)]), np.concatenate([rest[0], n]).astype(np.int64), np.concatenate([rest[1], np.ones(len(keys))]).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["place", "key", "n", "types"])

    flat = own.mapInArrow(run, "place long, key long, n long, types long")
    sums = {r[0]: (r[1], r[2]) for r in flat.where("place >= 0").groupBy("place").agg(F.sum("n"), F.sum("types")).collect()}
    words = flat.where("place < 0").orderBy(F.desc("n"), "key").limit(TOP).collect()
    m = Model()
    m.total, m.types = sum(x for x, _ in sums.values()), sum(x for _, x in sums.values())
    for k, (n, types) in sums.items():
        m.rest[k] += n + types
    keys = np.array([r["key"] for r in words], np.int64).view(W.U)
    np.subtract.at(m.rest, place(keys), np.array([r["n"] + 1 for r in words], float))
    order = np.argsort(keys)
    m.top, m.rank = keys[order], order
    # start from the counts: bias rows are log frequencies
    n = np.zeros(TOP)
    n[: len(words)] = [r["n"] for r in words]
    every = np.concatenate([n + 0.5, m.rest]).reshape(CLASSES, MEMBERS)
    m.outer[0] = np.log(every.sum(1)) - np.log(every.sum())
    m.inner[:CLASSES] = np.log(every) - np.log(every.sum(1, keepdims=True))
    return m


# training


_STEP = "block int, part long, step binary"


def _sum(table: pa.Table) -> pa.Table:
    """The weighted mean of the steps of a block, in the order of their parts."""
    total, weight = 0.0, 0
    for p in table.sort_by("part").column("step").to_pylist():
        step, n = X.unpack(p)
        total, weight = total + step.astype(np.float64) * n, weight + n
    step = X.pack((total / max(weight, 1)).astype(np.float32), weight)
    return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "step": pa.array([step], pa.binary())})


def _learner(shared, rounds: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """The step of a shard in blocks."""
        m = shared.value
        shard = table.column("shard")[0].as_py()
        rng = np.random.default_rng(shard)
        outer, inner = m.outer.copy(), m.inner.copy()
        seen = (np.zeros(len(outer), np.float32), np.zeros(len(inner), np.float32))
        n = 0
        data, off = W.buffers(table.select(["key", "text"]).sort_by([("key", "ascending"), ("text", "ascending")]).column("text"))
        for i, j in W.blocks(off):
            t = Tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            learn(m, outer, inner, seen, m.symbols(t.keys), t.first, rng.permutation(len(t.keys)))
            n += len(t.keys)
        flat = np.concatenate([(outer - m.outer).ravel(), (inner - m.inner).ravel()])
        steps = [X.pack(x, n) for x in np.array_split(flat, BLOCKS)]
        give_back()
        return pa.table({"block": pa.array(range(BLOCKS), pa.int32()), "part": pa.array([shard // rounds] * BLOCKS, pa.int64()), "step": pa.array(steps, pa.binary())})

    return run


def train(docs: DataFrame, m: Model, text: str, key: str = "doc_id", rounds: int = ROUNDS) -> Model:
    """Rounds of distributed gradient updates over all tokens of the rows of `docs` that are to be learnt from."""
    shards = -(-text_bytes(docs, text) // (rounds * SHARD)) or 1  # of a round
    dealt = F.pmod(F.xxhash64(key, text), F.lit(rounds * shards))
    rows = docs.where("_learn").select(F.col(key).alias("key"), F.col(text).alias("text"), dealt.alias("shard"))
    context = docs.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(m)  # fixed size: ROWS x CLASSES and (CLASSES + INNER) x MEMBERS numbers
        own = rows.where(F.col("shard") % rounds == turn).repartition(shuffle_partitions(rows), "shard")
        steps = own.groupBy("shard").applyInArrow(_learner(shared, rounds), _STEP)
        parts = shards
        while True:
            steps = steps.groupBy("block", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(_sum, _STEP)
            if parts <= FAN:
                break
            parts = -(-parts // FAN)
        got = {r["block"]: X.unpack(bytes(r["step"]))[0] for r in steps.collect()}  # BLOCKS rows
        if got:
            flat = np.concatenate([got[k] for k in range(BLOCKS)])
            cut = m.outer.size
            m = Model(m.top, m.rank, m.total, m.types, m.rest, m.outer + flat[:cut].reshape(m.outer.shape), m.inner + flat[cut:].reshape(m.inner.shape))
    return m


def score(docs: DataFrame, learn_from, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS, buckets: int | None = None) -> DataFrame:
    """`docs` with n_tokens, n_known, train_tokens, base_score and score; `learn_from` says which rows to learn from."""
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    marked, (key, text), back = masked(docs, key, text, _learn=F.coalesce(learn_from, F.lit(False)))
    out = schema_with(marked.drop("_learn"), n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double")
    buckets = buckets or X.parts(marked, text)
    rows = X.chunked(marked, [F.col(key), F.col(text)], buckets)
    counts = stored(count(rows, text, buckets))
    model = train(marked, vocabulary(counts), text, key, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def use(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        m = shared.value
        c = Counted(table, text)
        at = c.bounds(buckets)
        n = np.zeros(len(c.types), np.int64)
        for bucket, payload in answers:
            n[at[bucket] : at[bucket + 1]] = X.unpack(payload)[0]
        count = n[c.type_of]
        base = np.log10((n + 1) / (m.total + m.types + 1))[c.type_of]
        symbol = m.symbols(c.types)[c.type_of]
        p = np.empty(len(count))
        texts = len(c.first) - 1
        for i in range(0, texts, 256):  # some texts at a time
            j = min(i + 256, texts)
            a, b = c.first[i], c.first[j]
            p[a:b] = log10_probabilities(m, symbol[a:b], count[a:b], c.first[i : j + 1] - a)
        sums = [np.add.reduceat(x, c.first[:-1]) if texts else x[:0] for x in ((count > 0).astype(np.int64), base, p)]
        new = [np.diff(c.first), sums[0], np.full(texts, m.total), sums[1], sums[2]]
        table = table.drop_columns([X.CHUNK, "_learn"])
        for name, x in zip(("n_tokens", "n_known", "train_tokens", "base_score", "score"), new, strict=True):
            table = table.append_column(name, pa.array(x))
        return table

    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return back(X.apply(rows, counts.where(F.col(X.CHUNK) != OF_ALL), use, out), **{c: c for c in results})
