"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each pair of neighbours that the vocabulary can merge lies in the bucket of its
rank; a bitmap in two levels (256 ranks to a word) tells which buckets hold anything, so find-first-set gives the lowest
rank in two steps however many pairs wait. Entries whose pair has changed meanwhile are skipped when they come up. A pre-token
of n bytes takes O(n log n) steps at most (a bucket is sorted when it comes up), so very long ones cost no more for each byte.

Defined cases: null and empty texts have no tokens and decode to no bytes; an empty table gives an empty table; other columns
are kept, and a result replaces a column of the same name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.exchange import expand
from gleanery.llm.frames import kept, schema_with, small
from gleanery.llm.secrets import load_ranks

#: A Python worker remembers the ids of the last so many distinct pre-tokens, and of as many before them (180 bytes each: 216 MB at most).
REMEMBERED = 600_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n))
    pair = [-1] * (n + 1)  # rank of the pair whose left part begins here
    get = ranks.get
    # the queue: positions by rank; low: which ranks of each 256 hold any; high: which of those 256s do
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    high = 0
    live = 0  # pairs that can be merged now: when none is left, all waiting entries are stale
    for i in range(n - 1):
        r = pair[i] = get(piece[i : i + 2], -1)
        if r >= 0:
            live += 1
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                k = r >> 8
                low[k] = low.get(k, 0) | 1 << (r & 255)
                high |= 1 << k
    while live:
        k = (high & -high).bit_length() - 1
        word = low[k]
        rank = k << 8 | ((word & -word).bit_length() - 1)
        low[k] = word = word & (word - 1)
        if not word:
            high &= high - 1
        places = buckets.pop(rank)
        if len(places) > 1:
            places.sort()
        for x, i in enumerate(places):
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            after[i] = end = after[j]
            live -= 1 if pair[j] < 0 else 2
            pair[j] = -1
            p, q = before[i], i  # the pairs that have changed: of the part before and this one, of this one and the next
            if end < n:
                before[end] = i
                r = pair[i] = get(piece[i : after[end]], -1)
            else:
                r = pair[i] = -1
            lowest = rank
            while True:
                if r >= 0:
                    live += 1
                    if r in buckets:
                        buckets[r].append(q)
                    else:
                        buckets[r] = [q]
                        k = r >> 8
                        low[k] = low.get(k, 0) | 1 << (r & 255)
                        high |= 1 << k
                    if r < lowest:
                        lowest = r
                if p < 0 or q == p:
                    break
                q = p
                if pair[p] >= 0:
                    live -= 1
                r = pair[p] = get(piece[p:end], -1)
            if lowest < rank and x + 1 < len(places):  # a lower rank has come up: the rest of this bucket waits
                buckets[rank] = places[x + 1 :] + buckets.get(rank, [])
                k = rank >> 8
                low[k] = low.get(k, 0) | 1 << (rank & 255)
                high |= 1 << k
                break
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes whole texts by a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks, self.remembered = ranks, remembered
        self.find = regex.compile(pattern).findall
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            by_id[i] = b
        # the bytes of all tokens in a row, and where each one's begin
        self.vocabulary = np.frombuffer(b"".join(by_id), np.uint8)
        self.length = np.array([len(b) for b in by_id], np.int64)
        self.start = np.cumsum(self.length) - self.length
        # ids of pre-tokens, as the bytes of 32-bit numbers
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = array("i", [whole] if whole is not None else merge(raw, self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= self.remembered:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text."""
        pieces = self.find(text or "")
        coded = list(map(self.known.get, pieces))
        if None in coded:
            slow = self.piece
            coded = [x or slow(p) for x, p in zip(coded, pieces, strict=True)]
        return np.frombuffer(b"".join(coded), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that token ids stand for."""
        return self.vocabulary[expand(self.start[ids], self.length[ids])].tobytes()


def _codec(ranks, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """One codec for each worker and vocabulary, so that what it remembers serves all tasks of the worker."""
    return kept((ranks.id if hasattr(ranks, "id") else id(ranks), pattern, remembered), lambda: Codec(ranks.value, pattern, remembered))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """`docs` with the token ids of `text`, and with the bytes that the ids decode to in the column `decoded`, if named.

    One narrow pass without a shuffle; the vocabulary file (under 2 MB) is read by the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    docs = docs.drop(ids, *([decoded] if decoded else []))
    schema = schema_with(docs, **{ids: "array<int>"}, **({decoded: "binary"} if decoded else {}))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern, remembered)
        for b in small(batches, at):
            coded = [codec.encode(t) for t in b.column(at).to_pylist()]
            cols = [*b.columns, _lists(coded)]
            if decoded:
                cols.append(pa.array([codec.decode(x) for x in coded], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes that the token ids in `ids` stand for (null for null)."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    df = df.drop(decoded)
    at = df.columns.index(ids)
    schema = schema_with(df, **{decoded: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, "")
        for b in batches:
            out = [None if x is None else codec.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def _lists(coded: list[np.ndarray]) -> pa.Array:
    """Token ids as an Arrow column."""
    size = np.cumsum([0, *map(len, coded)])
    return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *coded])))
