"""Language identification: averaged hashed subword embeddings with a linear softmax.

Every run of three and four bytes of the lower-cased text (white space as one sign) is hashed to a row of an embedding
table; a text is the mean of its rows over the whole text, and a linear softmax gives the languages. Table and weights are
trained by stochastic gradient descent in numpy, on a bounded sample: about `PER_LANGUAGE` labelled texts of each language.
A tenth of the sample is kept back to set a temperature (so that scores are probabilities) and the thresholds of rejection.

A text is rejected where its likeliest language is not likely, or where its runs are strange to all languages: a softmax is sure of
texts in none of them too. How strange a run is, in bits, is its share in the language that has it most. A text's mean over runs without digits (numbers and keys
are in no language; short texts count as some usual runs more) is held against a threshold between the strangest texts kept back and what has to be rejected: the same
texts with their letters shuffled, and texts of each language as they look to the others. So a text that mixes languages stays.

Since a mean and a linear layer commute, scoring adds up one table of (hashed run, language) logits, with the bits beside them.

Defined cases: a null text, or one without any letter, is `und` with score 0 and counts as rejected; with no labelled text at
all every text is `und`; repeated rows are treated alike; other columns are kept, and results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as W
from gleanery.llm.frames import give_back, schema_with, small

UNKNOWN = "und"
BITS, WIDTH = 15, 16
#: Bound of the training sample: about so many texts of each language, and twice so many for all languages together at most.
PER_LANGUAGE = 1000
EPOCHS, RATE = 4, 0.5
#: At most this share of correctly labelled calibration texts may be rejected; a text at even odds or better never is.
REJECTED, EVEN = 0.001, 0.5
#: Bytes of text whose runs are looked up at once: each takes some 100 bytes meanwhile.
PIECE = 1 << 18
#: Usual runs that every text counts with, and the least and the usual way from the strangest texts kept back to those to be rejected.
USUAL, APART, BETWEEN = 40, 0.5, 0.5

_SIGN = W.LOWER.copy()
_SIGN[~W.NOT_SPACE] = 32
_IS_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_IS_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def held_out(doc_id: str = "doc_id", parts: int = 5, kept: int = 0) -> Column:
    """Whether crc32 of the id as text leaves `kept` by `parts`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == kept, F.lit(False))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed runs of some texts, the first run of each text, and which runs are without digits. Every text counts as followed by white space."""
    n = len(data)
    s = np.full(n + 3, 32, np.uint32)
    s[:n] = _SIGN[data]
    three = s[:n] | (s[1 : n + 1] << 8) | (s[2 : n + 2] << 16)
    four = three | (s[3 : n + 3] << 24)
    for k in (1, 2, 3):  # a text's last runs end in white space, not in the next text
        p = off[1:] - k
        p = p[p >= off[:-1]]
        low, space = np.uint32((1 << 8 * k) - 1), np.uint32(0x20202020 << 8 * k & 0xFFFFFFFF)
        four[p] = four[p] & low | space
        three[p] = four[p] & np.uint32(0xFFFFFF)
    out = np.empty(2 * n, np.uint16)
    out[0::2] = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    out[1::2] = (four * np.uint32(0x85EBCA6B) ^ (four >> 15) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    plain = np.empty(2 * n, bool)
    plain[0::2] = ~(_IS_DIGIT[four & 255] | _IS_DIGIT[(four >> 8) & 255] | _IS_DIGIT[(four >> 16) & 255])
    plain[1::2] = plain[0::2] & ~_IS_DIGIT[four >> 24]
    return out, 2 * off, plain


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each hashed run, with the temperature in it, and its bits
    bias: np.ndarray
    threshold: float
    usual: float = 0.0  # bits of a run, on average
    strange: float = np.inf  # bits of a run from which a text is in no language

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest language of each text, its probability, and whether the text is rejected."""
        f, at, plain = features(data, off)
        n = np.diff(at)
        mean, bits, runs = np.zeros((len(n), len(self.languages))), np.zeros(len(n)), np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            own = self.table[f]
            mean[some] = np.add.reduceat(own[:, :-1], at[some], axis=0, dtype=np.float64) / n[some, None]
            bits[some] = np.add.reduceat(np.where(plain, own[:, -1], 0), at[some], dtype=np.float64)
            runs[some] = np.add.reduceat(plain, at[some], dtype=np.int64)
        p = softmax(mean + self.bias)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        return best, top, (top < self.threshold) | (shrunk(bits, runs, self.usual) > self.strange)


def shrunk(bits: np.ndarray, runs: np.ndarray, usual: float) -> np.ndarray:
    """Mean bits of texts whose runs have so many together, and that have `USUAL` usual runs more."""
    return (bits + usual * USUAL) / (runs + USUAL)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 1), np.float32), np.zeros(0), 1.0)
    y = np.array([languages.index(x) for x in labels])
    counted = [_bag(t) for t in texts]
    bags = [(ids, (n / max(n.sum(), 1)).astype(np.float32)) for ids, n, _ in counted]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept = order[: len(order) // 10] if len(order) >= 50 else order
    learn = order[len(order) // 10 :] if len(order) >= 50 else order
    table = rng.normal(0, 0.3, (1 << BITS, WIDTH)).astype(np.float32)
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = bags[i]
            x = share @ table[ids]
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            table[ids] -= (rate * 50) * share[:, None] * (weights @ p)
            weights -= rate * np.outer(x, p)
            bias -= rate * p
    logits = table @ weights
    z = np.array([bags[i][1] @ logits[bags[i][0]] + bias for i in kept])
    # temperature by the likelihood of the texts kept back
    heat = np.geomspace(0.1, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean() for t in heat]
    t = heat[int(np.argmin(loss))]
    p = softmax(z / t)
    right = p.max(1)[p.argmax(1) == y[kept]]
    threshold = min(float(np.quantile(right, REJECTED)) if len(right) else EVEN, EVEN)
    seen = np.zeros((1 << BITS, len(languages)))
    for i in learn:
        seen[counted[i][0], y[i]] += counted[i][2]
    bits, usual, strange = _strangeness(seen, [(texts[i], y[i], counted[i]) for i in kept], rng)
    return Model(languages, np.column_stack([logits / t, bits]).astype(np.float32), bias / t, threshold, usual, strange)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed runs of a text, how often it has them, and how often without digits."""
    ids, _, plain = features(*W.buffers(pa.array([text])))
    known, at = np.unique(ids, return_inverse=True)
    return known, np.bincount(at, minlength=len(known)), np.bincount(at, plain, len(known))


def _bits(seen: np.ndarray) -> np.ndarray:
    """Bits of each run: by its share in the language that has it most; runs that none has count half."""
    return -np.log2(((seen + 0.5) / (seen.sum(0) + 0.5 * len(seen))).max(1))


def _strangeness(seen: np.ndarray, kept: list[tuple[str, int, tuple]], rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
    """Bits of each run, their usual mean, and the mean from which a text is rejected; of runs seen by language, and texts kept back."""
    bits = _bits(seen)
    total = seen.sum(1)
    usual = float((bits * total).sum() / max(total.sum(), 1))

    def mean(bag: tuple[np.ndarray, np.ndarray, np.ndarray], bits: np.ndarray) -> float:
        ids, _, n = bag
        return float(shrunk((bits[ids] * n).sum(), n.sum(), usual))

    clean = [mean(bag, bits) for _, _, bag in kept if bag[2].sum()]
    if not clean:
        return bits, usual, np.inf
    bad = []
    others = {k: _bits(np.delete(seen, k, 1)) for k in {y for _, y, _ in kept}} if seen.shape[1] > 1 else {}
    for text, y, bag in kept:
        if bag[2].sum() < 2 * USUAL:
            continue  # too short to tell
        letters = np.array(list(text))
        place = np.flatnonzero([not c.isspace() for c in text])
        letters[place] = letters[rng.permutation(place)]
        bad.append(mean(_bag("".join(letters)), bits))
        if y in others:
            bad.append(mean(bag, others[y]))
    high = float(np.quantile(clean, 1 - REJECTED))
    low = float(np.quantile(bad, 0.05)) if bad else high
    return bits, usual, high + max(APART, BETWEEN * (low - high))


def sample(docs: DataFrame, text: str, label: str, per_class: int, key: str) -> list:
    """About `per_class` labelled rows (text, label) of each class: those lowest in a hash of key, text and label, so the same in each run."""
    drawn = F.xxhash64(key, text, label)
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"), drawn.alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # a row for each label
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("l")) * 1_000_000)
    return [(r[0], r[1]) for r in chosen.orderBy("h", "l").limit(2 * per_class * len(counts)).collect()]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, key: str = "doc_id") -> Model:
    """A model trained on a bounded sample of the labelled rows of `docs`."""
    rows = sorted(sample(docs, text, label, per_language, key))
    return train([r[0] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected; one narrow pass over whole texts."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, lang_pred="string", score="double", rejected="boolean")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = shared.value
        for b in small(batches, at):
            column = b.column(at)
            data, off = W.buffers(column)
            lang, score, lost = [], [], []
            for i, j in W.blocks(off, PIECE):
                part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
                letters = np.concatenate([[0], np.cumsum(_IS_LETTER[part], dtype=np.int64)])
                some = letters[own[1:]] > letters[own[:-1]]
                for k in np.flatnonzero(~some & (own[1:] > own[:-1])):
                    some[k] = any(c.isalpha() for c in part[own[k] : own[k + 1]].tobytes().decode(errors="replace"))
                some &= bool(model.languages)
                best, p, odd = model.predict(part, own) if model.languages else (np.zeros(j - i, int), np.zeros(j - i), np.ones(j - i, bool))
                lang += [model.languages[x] if s else UNKNOWN for x, s in zip(best, some, strict=True)]
                score += np.where(some, p, 0.0).tolist()
                lost += (odd | ~some).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lost, pa.bool_())], [f.name for f in schema])
        give_back()

    return docs.mapInArrow(run, schema)
