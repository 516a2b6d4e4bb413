"""Words of whole texts, found and hashed with numpy over Arrow's own buffers.

Texts are handled as UTF-8 bytes: the word classes of this package differ only in ASCII characters, so splitting and
lower-casing bytes gives the same words as splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are handled at once: the arrays beside them take about 40 times as much.
BLOCK = 1 << 20

_ASCII = np.arange(256)
#: Words [^\x20\x09-\x0D]+
NOT_SPACE = ~np.isin(_ASCII, [0x20, 9, 10, 11, 12, 13])
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
LETTERS = (_ASCII >= 0x80) | ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x41) & (_ASCII <= 0x5A)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A))
LOWER = np.where((_ASCII >= 0x41) & (_ASCII <= 0x5A), _ASCII + 32, _ASCII).astype(np.uint8)


@dataclass
class Words:
    """Words of some texts: bytes, each word's start and end in them, and the first word of each text (and of none)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, at, body = column.buffers()
    off = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def split(data: np.ndarray, off: np.ndarray, word: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Words of the texts whose bytes begin at `off`: runs of bytes in the class `word`, never across texts."""
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = inside & ~before
    end = before & ~inside
    # where two texts meet inside a run, a word ends and another starts
    meet = off[1:-1]
    meet = meet[inside[meet] & before[meet]]
    start[meet] = True
    end[meet] = True
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    return Words(data, start, end, np.searchsorted(start, off))


_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i up to n."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, U(b))
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        got = (both[0], both[1])
        if size <= 2 * BLOCK:
            _POWERS[base] = got
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the last steps of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _P) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal runs have equal hashes."""
    n = len(values)
    power, inverse = _powers(base, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((values.astype(U) + U(1)) * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, and the first run of each text; with fewer words, but not none, the whole text is one run if `short`."""
    count = np.diff(first)
    runs = np.maximum(count - n + 1, 0)
    if short:
        runs = np.where((count > 0) & (count < n), 1, runs)
    at = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=at[1:])
    where = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], runs)
    padded = np.concatenate([hashes, np.zeros(n, U)])
    out = np.zeros(len(where), U)
    size = np.repeat(np.minimum(count, n), runs)
    for k in range(n):
        longer = out * U(_Q) + padded[where + k]
        out = np.where(k < size, longer, out) if short else longer
    return mix(out + size.astype(U)), at
