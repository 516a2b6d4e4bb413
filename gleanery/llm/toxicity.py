"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words: a hashed word embedding beside the mean of hashed character-pair embeddings of the word. Two GRUs read each
window of `STEPS` words from both sides, attention pools their states, and a logistic layer gives the window's logit. Windows
overlap and cover the whole text; a text's logit is its highest window's, so length does not dilute a passage. Everything is
trained here in numpy: a labelled text teaches through its highest windows (multiple-instance learning), with Adam, on a
bounded sample of about `PER_CLASS` texts of each label. A part kept back calibrates the score.

Defined cases: null and empty texts, and texts without a word, get the score of the calibrated lowest logit seen (under one
half); null labels are not learnt from; without labels of both kinds every score is the share of toxic labels, at most 0.49;
repeated rows are treated alike; other columns are kept, and results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as W
from gleanery.llm.frames import schema_with

WORD_BITS, WORD_WIDTH, CHAR_BITS, CHAR_WIDTH, HIDDEN = 14, 12, 12, 8, 8
#: Words of a window and from one window to the next; a text's last window ends with the text.
STEPS, STRIDE = 32, 24
#: Bound of the training sample: about so many texts of each label, twice so many of both at most.
PER_CLASS = 1000
UPDATES, BATCH, RATE = 900, 16, 0.02


@dataclass
class Inputs:
    """Hashed inputs of the words of some texts and their windows."""

    word: np.ndarray  # row of each word's embedding
    char: np.ndarray  # rows of the character pairs of all words, and where each word's begin
    at: np.ndarray
    window: np.ndarray  # first word of each window, its length and its text
    size: np.ndarray
    text: np.ndarray


def inputs(data: np.ndarray, off: np.ndarray) -> Inputs:
    w = W.split(data, off, W.LETTERS, lower=True)
    n = w.end - w.start
    at = np.cumsum(n) - n
    where = np.arange(int(n.sum())) + np.repeat(w.start - at, n)
    d = np.concatenate([w.data, np.zeros(1, np.uint8)]).astype(np.uint32)
    nxt = d[where + 1]
    nxt[at + n - 1] = 0
    char = ((d[where] | (nxt << 8)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
    count = w.counts
    windows = np.where(count > 0, 1 + np.maximum(0, -(-(count - STEPS) // STRIDE)), 0)
    text = np.repeat(np.arange(len(count)), windows)
    k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = w.first[text] + np.minimum(k * STRIDE, np.maximum(count[text] - STEPS, 0))
    return Inputs((W.word_hashes(w) >> W.U(64 - WORD_BITS)).astype(np.int32), char.astype(np.int32), at, first, np.minimum(STEPS, w.first[text + 1] - first), text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Net:
    """Parameters, and the forward and backward passes. Directions: 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_WIDTH + CHAR_WIDTH
        init = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"word": rng.normal(0, 0.3, (1 << WORD_BITS, WORD_WIDTH)).astype(np.float32), "char": rng.normal(0, 0.3, (1 << CHAR_BITS, CHAR_WIDTH)).astype(np.float32)}
        self.p |= {"wx": init(d, 6 * h), "bx": np.zeros(6 * h, np.float32), "u": init(2, h, 3 * h), "att": init(2 * h, h), "v": init(h, 1)[:, 0], "out": init(2 * h, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.scale, self.shift, self.floor = 1.0, 0.0, 0.0

    def words(self, x: Inputs) -> np.ndarray:
        """The input vector of every word."""
        if not len(x.word):
            return np.zeros((0, WORD_WIDTH + CHAR_WIDTH), np.float32)
        n = np.diff(np.append(x.at, len(x.char)))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.word], np.add.reduceat(self.p["char"][x.char], x.at, axis=0) / n], axis=1)

    def forward(self, projected: np.ndarray, first: np.ndarray, size: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows, from the words' input projections. `keep` collects what the backward pass needs."""
        p, h, n = self.p, HIDDEN, len(first)
        step = np.arange(STEPS)[:, None]
        live = step < size
        full = live.all(1)
        where = np.minimum(first + step, len(projected) - 1)
        states = np.empty((STEPS, n, 2 * h), np.float32)
        saved = []
        for way in (0, 1):
            state = np.zeros((n, h), np.float32)
            xs = projected[:, 3 * h * way : 3 * h * (way + 1)][where]
            u = p["u"][way]
            for t in range(STEPS) if way == 0 else range(STEPS - 1, -1, -1):
                xp, up = xs[t], state @ u
                gates = xp[:, : 2 * h] + up[:, : 2 * h]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                r, z = gates[:, :h], gates[:, h:]
                new = r * up[:, 2 * h :]
                new += xp[:, 2 * h :]
                np.tanh(new, out=new)
                after = state - new
                after *= z
                after += new
                if not full[t]:
                    after = np.where(live[t, :, None], after, state)
                if keep is not None:
                    saved.append((way, t, state, r, z, new, up[:, 2 * h :], live[t, :, None]))
                state = after
                states[t, :, h * way : h * (way + 1)] = state
        hidden = np.tanh(states.reshape(-1, 2 * h) @ p["att"]).reshape(STEPS, n, h)
        e = np.where(live, hidden @ p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        if keep is None:  # the output is linear in the pooled state
            return (a * (states.reshape(-1, 2 * h) @ p["out"]).reshape(STEPS, n)).sum(0) + p["b"][0]
        pooled = np.einsum("tn,tnh->nh", a, states)
        keep += [saved, states, hidden, a, pooled, where]
        return pooled @ p["out"] + p["b"][0]

    def logits(self, x: Inputs, most: int = 1024) -> np.ndarray:
        projected = self.words(x) @ self.p["wx"] + self.p["bx"]
        parts = [self.forward(projected, x.window[i : i + most], x.size[i : i + most]) for i in range(0, len(x.window), most)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def backward(self, x: Inputs, which: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the logistic loss of the windows `which`."""
        p, h = self.p, HIDDEN
        vectors = self.words(x)
        keep: list = []
        logit = self.forward(vectors @ p["wx"] + p["bx"], x.window[which], x.size[which], keep)
        saved, states, hidden, a, pooled, where = keep
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d = ((_sigmoid(logit) - label) * weight).astype(np.float32)
        g["b"][0] = d.sum()
        g["out"] = pooled.T @ d
        dpool = d[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        dstates = a[:, :, None] * dpool[None]
        de = a * (da - (a * da).sum(0))
        dhid = de[:, :, None] * p["v"] * (1 - hidden**2)
        g["v"] = np.einsum("tn,tnh->h", de, hidden)
        g["att"] = np.einsum("tnh,tnk->hk", states, dhid)
        dstates += dhid @ p["att"].T
        dproj = np.zeros((len(vectors), 6 * h), np.float32)
        dh = {0: np.zeros((len(which), h), np.float32), 1: np.zeros((len(which), h), np.float32)}
        for way, t, state, r, z, new, up, m in reversed(saved):
            total = dh[way] + dstates[t, :, h * way : h * (way + 1)]
            live = np.where(m, total, 0)
            dn = live * (1 - z) * (1 - new**2)
            dz = live * (state - new) * z * (1 - z)
            dr = dn * up * r * (1 - r)
            dxp = np.concatenate([dr, dz, dn], axis=1)
            dup = np.concatenate([dr, dz, dn * r], axis=1)
            g["u"][way] += state.T @ dup
            dh[way] = dup @ p["u"][way].T + np.where(m, total * z, total)
            some = np.flatnonzero(m[:, 0])  # windows begin at different words, so at one step no word comes twice
            dproj[where[t, some], 3 * h * way : 3 * h * (way + 1)] += dxp[some]
        g["wx"] = vectors.T @ dproj
        g["bx"] = dproj.sum(0)
        dvec = dproj @ p["wx"].T
        g["word"] = (x.word, dvec[:, :WORD_WIDTH])
        n = np.diff(np.append(x.at, len(x.char)))
        g["char"] = (x.char, np.repeat(dvec[:, WORD_WIDTH:] / n[:, None], n, axis=0))
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit + self.shift)


def _pick(x: Inputs, windows: np.ndarray) -> Inputs:
    """A few windows with their words alone, so that a step touches no others."""
    first, size = x.window[windows], x.size[windows]
    words = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(first, size, strict=True)]))
    end = np.append(x.at, len(x.char))
    n = end[words + 1] - end[words]
    at = np.cumsum(n) - n
    return Inputs(x.word[words], x.char[np.arange(int(n.sum())) + np.repeat(end[words] - at, n)], at, np.searchsorted(words, first), size, x.text[windows])


def _join(parts: list[Inputs]) -> Inputs:
    """The inputs of several texts, numbered from 0."""
    n_word = np.cumsum([0, *(len(c.word) for c in parts)])
    n_char = np.cumsum([0, *(len(c.char) for c in parts)])
    moved = [Inputs(c.word, c.char, c.at + n_char[k], c.window + n_word[k], c.size, np.full(len(c.window), k)) for k, c in enumerate(parts)]
    return Inputs(*(np.concatenate([getattr(c, f) for c in moved]) for f in ("word", "char", "at", "window", "size", "text")))


def train(texts: list[str], labels: list[int], counts: dict[int, int] | None = None, seed: int = 11) -> Net:
    """A network from labelled texts; `counts` of both labels in the whole label table set the scores' base rate."""
    net, rng = Net(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.scale, share = 0.0, min(float(y.mean()) if len(y) else 0.0, 0.49)
        net.shift = float(np.log(max(share, 1e-6) / (1 - share)))
        return net
    docs = [inputs(*W.buffers(pa.array([t]))) for t in texts]
    order = rng.permutation([i for i, d in enumerate(docs) if len(d.window)])
    kept = [i for k, i in enumerate(order) if k % 6 == 0] if len(order) >= 60 else list(order)
    learn = [i for k, i in enumerate(order) if k % 6] if len(order) >= 60 else list(order)
    ratio = max(1.0, min(10.0, (y[learn] == 0).sum() / max(1, (y[learn] == 1).sum())))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps, each_epoch = 0, -(-len(learn) // BATCH)
    epochs = -(-UPDATES // each_epoch)
    total = epochs * each_epoch
    for _ in range(epochs):
        rng.shuffle(learn)
        for b in range(0, len(learn), BATCH):
            part = _join([docs[i] for i in learn[b : b + BATCH]])
            if steps < total // 5:  # before the network can tell windows apart, any of a text may teach
                rank = rng.random(len(part.window))
            else:
                rank = -net.logits(part)
            # each text's first windows by that rank
            by = np.lexsort((rank, part.text))
            place = np.arange(len(by)) - np.searchsorted(part.text[by], part.text[by])
            x = _pick(part, by[place < (6 if steps < total // 5 else 2)])
            n_own = np.bincount(x.text)[x.text]
            own = y[np.array(learn[b : b + BATCH])[x.text]]
            each = (np.where(own > 0, ratio, 1) / n_own / min(BATCH, len(learn) - b)).astype(np.float32)
            grads = net.backward(x, np.arange(len(x.window)), own, each)
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for k, grad in grads.items():
                if isinstance(grad, tuple):
                    rows, inverse = np.unique(grad[0], return_inverse=True)
                    sums = np.zeros((len(rows), grad[1].shape[1]), np.float32)
                    np.add.at(sums, inverse, grad[1])
                    s[k][rows] += sums**2
                    net.p[k][rows] -= 5 * rate * sums / (np.sqrt(s[k][rows]) + 1e-6)
                else:
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.99 * s[k] + 0.01 * grad**2
                    net.p[k] -= (rate * m[k] / (1 - 0.9**steps) / (np.sqrt(s[k] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
    _calibrate(net, np.array([net.logits(docs[i]).max() for i in kept], np.float64), y[kept])
    if counts and min(counts.get(0, 0), counts.get(1, 0)) > 0:
        net.shift += float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
        net.floor = min(net.floor, (-0.1 - net.shift) / net.scale)
    return net


def _calibrate(net: Net, z: np.ndarray, y: np.ndarray) -> None:
    """A logistic line from text logits to probabilities, by Newton's steps with a weak prior on slope one."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 0.1 * b])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    net.scale, net.shift = max(float(a), 0.05), float(b)
    net.floor = float(min(z.min(), (-0.1 - net.shift) / net.scale))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = PER_CLASS) -> Net:
    """A network trained on a bounded sample of labelled rows, drawn by a hash of the key over the whole label table."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_class / n))])
    chosen = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.element_at(share, F.col("_y")) * 1_000_000)
    chosen = chosen.orderBy(F.xxhash64(key), key, "_y").limit(2 * per_class * len(counts))
    # at most 2 * per_class ids of each label: a proven bound for the broadcast
    got = docs.select(key, F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(chosen), key).orderBy(F.xxhash64(key, "_t"), "_y").select("_t", "_y").limit(4 * per_class * len(counts)).collect()
    got = sorted((r[0], r[1]) for r in got)
    return train([r[0] for r in got], [r[1] for r in got], counts)


def score(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """`docs` with score and predicted; one narrow pass over whole texts."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = schema_with(docs, score="double", predicted="int")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            data, off = W.buffers(b.column(at))
            out = []
            for i, j in W.blocks(off):
                x = inputs(data[off[i] : off[j]], off[i : j + 1] - off[i])
                high = np.full(j - i, net.floor)
                if len(x.text):
                    z = net.logits(x)
                    some, lead = np.unique(x.text, return_index=True)
                    high[some] = np.maximum.reduceat(z, lead)
                out.append(net.probability(high))
            p = np.concatenate([np.zeros(0), *out])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [f.name for f in schema])

    return docs.mapInArrow(run, schema)
