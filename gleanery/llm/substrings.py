"""Substring deduplication by super-k-mer partitioning.

A window is `WINDOW` consecutive words. Its minimiser is the lowest hash of a run of `SEED` words in it; consecutive windows
with the same minimiser make a super-k-mer, which travels as one packed string to the minimiser's bucket. Equal windows have
equal minimisers, so all of a window's occurrences meet in one bucket, where sorting brings them together; the words themselves
are compared, not only hashes. A chunk of documents sends each distinct super-k-mer once, with its lowest and highest doc_id.
The bucket answers with the windows that also start in a lower document; the chunk removes the words that they cover.

Defined cases: null and empty texts have no words; texts of under `WINDOW` words lose none; a null doc_id counts as higher than
all others, and rows of equal doc_id take nothing from each other; other columns are kept, and results replace columns of their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import exchange as X
from gleanery.llm import words as W
from gleanery.llm.frames import masked, schema_with

WINDOW, SEED = 13, 3
LAST = (1 << 63) - 1


class Chunk:
    """The super-k-mers of a chunk's documents, which are taken in the order of their ids."""

    def __init__(self, table: pa.Table, key: str, text: str, buckets: int, window: int = WINDOW, seed: int = SEED):
        ids = pc.fill_null(table.column(key), LAST).to_numpy().astype(np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.window = window
        data, off = W.buffers(table.column(text).take(pa.array(self.order)))
        parts, hashes, length, counts = [], [], [], []
        for i, j in W.blocks(off):
            w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = w.end - w.start + 1  # with one space
            part = np.concatenate([w.data, np.zeros(1, np.uint8)])[X.expand(w.start, n)]
            part[np.cumsum(n) - 1] = 32
            parts.append(part)
            hashes.append(W.word_hashes(w))
            length.append(n)
            counts.append(w.counts)
        none = np.zeros(0, np.int64)
        self.text = np.concatenate([np.zeros(0, np.uint8), *parts])
        self.length = np.concatenate([none, *length])
        self.start = np.cumsum(self.length) - self.length
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([none, *counts]))])
        self._super(np.concatenate([np.zeros(0, W.U), *hashes]), buckets, seed)

    def _super(self, h: np.ndarray, buckets: int, seed: int) -> None:
        window, n = self.window, np.diff(self.first)
        windows = np.maximum(n - window + 1, 0)
        at = X.expand(self.first[:-1], windows)  # first word of each window
        if not len(at):
            self.head = self.tail = self.doc = self.entry = np.zeros(0, np.int64)
            self.sent: list[dict[bytes, int]] = [{} for _ in range(buckets)]
            self.low = self.high = [np.zeros(0, np.int64)] * buckets
            self.base = np.zeros(buckets + 1, np.int64)
            return
        g = np.zeros(len(h) - seed + 1, W.U)
        for k in range(seed):
            g = g * W.U(0xC2B2AE3D27D4EB4F) + h[k : len(g) + k]
        g = W.mix(g)
        span, wide = window - seed + 1, 1
        while 2 * wide <= span:  # lowest of 1, 2, 4, ... neighbours
            g = np.minimum(g[:-wide], g[wide:])
            wide *= 2
        if wide < span:
            g = np.minimum(g[: len(g) - span + wide], g[span - wide :])
        low = g[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
        lead = np.flatnonzero(new)
        tail = np.append(lead[1:], len(at)) - 1
        self.head, self.tail = at[lead], at[tail]
        self.doc = self.ids[np.searchsorted(self.first, self.head, "right") - 1]
        bucket = (W.mix(low[lead] ^ W.U(0x5851F42D4C957F2D)) % W.U(buckets)).astype(np.int64)
        a, last = self.start[self.head], self.tail + window - 1
        b = self.start[last] + self.length[last] - 1
        body = self.text.tobytes()
        sent: list[dict[bytes, int]] = [{} for _ in range(buckets)]
        lows: list[list[int]] = [[] for _ in range(buckets)]
        highs: list[list[int]] = [[] for _ in range(buckets)]
        entry = []
        for x, y, k, doc in zip(a.tolist(), b.tolist(), bucket.tolist(), self.doc.tolist(), strict=True):
            s = body[x:y]
            own = sent[k]
            e = own.get(s)
            if e is None:
                own[s] = e = len(own)
                lows[k].append(doc)  # documents come in order: the first is the lowest
                highs[k].append(doc)
            else:
                highs[k][e] = doc
            entry.append(e)
        self.sent = sent
        self.low, self.high = [np.array(x, np.int64) for x in lows], [np.array(x, np.int64) for x in highs]
        self.base = np.cumsum([0, *map(len, sent)])
        self.entry = np.array(entry, np.int64) + self.base[bucket]

    def questions(self) -> Iterator[tuple[int, bytes]]:
        for k, own in enumerate(self.sent):
            if own:
                yield k, X.pack(b"\n".join(own), self.low[k], self.high[k])

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Which words the answered windows cover."""
        edge = np.zeros(len(self.start) + self.window + 1, np.int64)
        order = np.argsort(self.entry, kind="stable")
        ordered = self.entry[order]
        for bucket, payload in answers:
            e, offset, least = X.unpack(payload)
            e = e.astype(np.int64) + self.base[bucket]
            lo, hi = np.searchsorted(ordered, e, "left"), np.searchsorted(ordered, e, "right")
            skm = order[X.expand(lo, hi - lo)]
            lower = np.repeat(least, hi - lo) < self.doc[skm]
            at = (self.head[skm] + np.repeat(offset.astype(np.int64), hi - lo))[lower]
            edge[: len(self.start) + 1] += np.bincount(at, minlength=len(self.start) + 1)
            edge -= np.bincount(at + self.window, minlength=len(edge))
        return np.cumsum(edge)[: len(self.start)] > 0


def _bucket(payloads: list[bytes], window: int = WINDOW) -> list[bytes | None]:
    """Windows of each chunk's entries that also start in a lower document than one that holds them in the chunk."""
    known: dict[bytes, int] = {}
    chunks = []
    for p in payloads:
        body, low, high = X.unpack(p)
        chunks.append((np.array([known.setdefault(s, len(known)) for s in body.split(b"\n")], np.int64), low, high))
    least = np.full(len(known), LAST)
    for entry, low, _ in chunks:
        np.minimum.at(least, entry, low)
    body = b"\n".join(known) + b"\n"
    off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) + 1)])
    data = np.frombuffer(body, np.uint8)
    hashes, begin, end, counts = [], [], [], []
    for i, j in W.blocks(off):
        w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i])
        g, at = W.shingles(W.word_hashes(w), w.first, window, short=False)
        n = np.diff(at)
        first = X.expand(w.first[:-1], n)
        hashes.append(g)
        begin.append(w.start[first] + off[i])
        end.append(w.end[first + window - 1] + off[i])
        counts.append(n)
    h, a, b, n = (np.concatenate(x) for x in (hashes, begin, end, counts))
    lowest = np.repeat(least, n)
    order = np.argsort(h, kind="stable")
    lead = X.starts(h[order])
    size = np.diff(np.append(lead, len(order)))
    same = order[X.expand(lead[size > 1], size[size > 1])]
    # equal hashes: compare the words themselves
    meet: dict[bytes, int] = {}
    keys = [body[x:y] for x, y in zip(a[same].tolist(), b[same].tolist(), strict=True)]
    for k, doc in zip(keys, lowest[same].tolist(), strict=True):
        if meet.setdefault(k, doc) > doc:
            meet[k] = doc
    lowest[same] = [meet[k] for k in keys]
    first = np.cumsum(n) - n
    out: list[bytes | None] = []
    for entry, _, high in chunks:
        k = X.expand(first[entry], n[entry])
        own = np.repeat(np.arange(len(entry)), n[entry])
        hit = np.flatnonzero(lowest[k] < high[own])
        k, own = k[hit], own[hit]
        out.append(X.pack(own.astype(np.uint32), (k - first[entry[own]]).astype(np.uint32), lowest[k]) if len(k) else None)
    return out


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """`docs` with n_words, n_removed and kept (the kept words, joined by one space)."""
    docs, (key, text), back = masked(docs.drop("n_words", "n_removed", "kept"), key, text)
    out = schema_with(docs, n_words="long", n_removed="long", kept="string")
    buckets = buckets or X.parts(docs, text)
    rows = X.chunked(docs, [F.col(key), F.col(text)], buckets)
    questions = X.ask(rows, lambda t: Chunk(t, key, text, buckets, window).questions())
    answers = X.answer(questions, lambda p: _bucket(p, window))

    def use(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        c = Chunk(table, key, text, buckets, window)
        gone = c.removed(answers)
        n_words = np.diff(c.first)
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_removed = lost[c.first[1:]] - lost[c.first[:-1]]
        n = c.length.copy()
        # the last kept word of a document has no space after it
        stay = np.flatnonzero(~gone)
        doc = np.searchsorted(c.first, stay, "right") - 1
        last = stay[np.append(doc[1:] != doc[:-1], True)] if len(stay) else stay
        mask = np.repeat(~gone, n)
        mask[c.start[last] + n[last] - 1] = False
        n[last] -= 1
        n[gone] = 0
        size = np.concatenate([[0], np.cumsum(n)])[c.first]
        kept = pa.Array.from_buffers(pa.large_string(), len(c.order), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(c.text[mask])]).cast(pa.string())
        table = table.drop_columns([X.CHUNK]).take(pa.array(c.order))
        return table.append_column("n_words", pa.array(n_words)).append_column("n_removed", pa.array(n_removed)).append_column("kept", kept)

    return back(X.apply(rows, answers, use, out), n_words="n_words", n_removed="n_removed", kept="kept")
