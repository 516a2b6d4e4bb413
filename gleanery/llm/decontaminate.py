"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (10 consecutive words, or the whole item if shorter) are sets of five-word shingles (a shorter window is
one shingle). Shingles are ordered by rarity in the documents. Since a window counts only if it is contained whole, the
necessary prefix is its one rarest shingle: documents are joined on that alone. A match fixes where the window would begin;
it must fit between the document's first and last word (positional and length bounds), and is then compared word by word.

The benchmark side is broadcast in blocks of at most `BLOCK_WORDS` words. A benchmark within the bound is one block; a larger
one takes one pass for each block, with a checkpoint in between, and the same result.

Defined cases: null and empty texts have no words and no hits; items without words never occur; equal items all count; a null item id is the empty string;
repeated rows are treated alike; empty tables give no hits; other columns are kept, and results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as W
from gleanery.llm.frames import give_back, schema_with, small, stored

WINDOW = 10
SHINGLE = 5
#: Words of benchmark items in a broadcast block (about 100 bytes each).
BLOCK_WORDS = 1_000_000


class Windows:
    """Distinct windows of a block of items, and the join index on their prefix shingles."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW, shingle: int = SHINGLE):
        self.window, self.shingle = window, shingle
        known: dict[tuple[bytes, ...], int] = {}
        self.items: list[set[str]] = []
        for item, text in zip(ids, texts, strict=True):
            data, off = W.buffers(pa.array([text], pa.binary()))
            w = W.split(data, off, W.LETTERS, lower=True)
            got = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
            for i in range(max(len(got) - window + 1, min(len(got), 1))):
                at = known.setdefault(tuple(got[i : i + window]), len(known))
                if at == len(self.items):
                    self.items.append(set())
                self.items[at].add(item)
        self.texts = [b" ".join(k) for k in known]
        self.size = np.array([len(k) for k in known], np.int64)
        flat = [x for k in known for x in k]
        data, off = W.buffers(pa.array(flat, pa.binary()))
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.hashes = W.span_hashes(data, off[:-1], off[1:])
        # every shingle of every window: its hash, window and offset
        self.gram, at = W.shingles(self.hashes, self.first, shingle)
        self.gram_window = np.repeat(np.arange(len(self.size)), np.diff(at))
        self.gram_offset = np.arange(len(self.gram)) - at[:-1][self.gram_window]
        self.lengths = sorted({int(min(x, shingle)) for x in self.size})

    def distinct(self) -> np.ndarray:
        return np.unique(self.gram)

    def prefix(self, counts: dict[int, int]) -> None:
        """Keeps each window's rarest shingle as its prefix; a window with a shingle that no document has cannot occur."""
        seen = np.array([counts.get(int(g.view(np.int64)), 0) for g in self.gram], np.int64)
        order = np.lexsort((self.gram, seen, self.gram_window))
        lead = np.unique(self.gram_window[order], return_index=True)[1] if len(order) else np.zeros(0, np.int64)
        lead = order[lead]
        lead = lead[seen[lead] > 0]
        lead = lead[np.argsort(self.gram[lead], kind="stable")]
        self.key, self.key_window, self.key_offset = self.gram[lead], self.gram_window[lead], self.gram_offset[lead]
        del self.gram, self.gram_window, self.gram_offset


def _seen(keys: np.ndarray) -> np.ndarray:
    """A table on the top 20 bits of a hash: whether any key has them."""
    t = np.zeros(1 << 20, bool)
    t[keys >> W.U(44)] = True
    return t


def _grams(w: W.Words, hashes: np.ndarray, lengths: list[int], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the documents' runs of words of each length, and the word at which each begins."""
    n = w.counts
    for k in lengths:
        g, at = W.shingles(hashes, w.first, k, short=False)
        yield g, np.arange(len(g)) + np.repeat(w.first[:-1] - at[:-1], np.maximum(n - k + 1, 0))


def _counts(docs: DataFrame, block, grams, text: str) -> DataFrame:
    """Occurrences in the documents of the items' shingles, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = grams.value
        table, total = _seen(keys), np.zeros(len(keys), np.int64)
        win = block.value
        for b in batches:
            data, off = W.buffers(b.column(0))
            for i, j in W.blocks(off):
                w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i], W.LETTERS, lower=True)
                for g, _ in _grams(w, W.word_hashes(w), win.lengths, win.shingle):
                    g = g[table[g >> W.U(44)]]
                    at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                    total += np.bincount(at[keys[at] == g], minlength=len(keys)) if len(keys) and len(g) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _match(win: Windows, table: np.ndarray, w: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur, and the word at which each occurrence begins."""
    none = np.zeros(0, np.int64)
    if not len(win.key):
        return none, none
    found_w, found_at = [], []
    text = w.text
    for g, where in _grams(w, hashes, win.lengths, win.shingle):
        hit = np.flatnonzero(table[g >> W.U(44)])
        lo, hi = np.searchsorted(win.key, g[hit], "left"), np.searchsorted(win.key, g[hit], "right")
        n = hi - lo
        k = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        found_w.append(win.key_window[k])
        at = np.repeat(where[hit], n)
        start = at - win.key_offset[k]
        # positional and length bounds: the whole window lies in the same text
        t = text[at]
        start = np.where((start >= w.first[t]) & (start + win.size[found_w[-1]] <= w.first[t + 1]), start, -1)
        found_at.append(start)
    i, at = np.concatenate(found_w), np.concatenate(found_at)
    i, at = i[at >= 0], at[at >= 0]
    for k in range(win.window):
        size = win.size[i]
        same = (size <= k) | (win.hashes[np.minimum(win.first[i] + k, len(win.hashes) - 1)] == hashes[np.minimum(at + k, len(hashes) - 1)])
        i, at = i[same], at[same]
    # the words themselves, not only their hashes
    start, end, data, size = w.start, w.end, w.data, win.size
    exact = [b" ".join(data[s:e].tobytes() for s, e in zip(start[a : a + size[x]], end[a : a + size[x]], strict=True)) == win.texts[x] for x, a in zip(i, at, strict=True)]
    exact = np.array(exact, bool)
    pairs = np.unique(np.stack([at[exact], i[exact]]), axis=1)
    return pairs[1], pairs[0]


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with n_words, hits (runs of hit words as structs (start, end), end exclusive) and items (ids as strings, sorted)."""
    docs = docs.drop("n_words", "hits", "items")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_item"), F.encode(F.coalesce(F.col(item_text).cast("string"), F.lit("")), "UTF-8").alias("_text"))
    letters = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, -(-letters // (2 * block_words)))  # a word and what follows it take two bytes at least
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "items": F.expr("cast(array() as array<string>)")})
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("_item"), F.lit(n)) == k).collect()  # at most about block_words words
        out = _one_block(out, docs, block, text, window)
        if n > 1:
            out = stored(out)
    return out


def _one_block(out: DataFrame, docs: DataFrame, block: list, text: str, window: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    win = Windows([r[0] for r in block], [bytes(r[1]) for r in block], window)
    shared, grams = context.broadcast(win), context.broadcast(win.distinct())
    counts = {r[0]: r[1] for r in _counts(docs, shared, grams, text).collect()} if len(win.size) else {}  # a row for each shingle of the block at most
    shared.destroy()
    win.prefix(counts)
    ready = context.broadcast(win)
    at = out.columns.index(text)
    names = out.columns
    schema = schema_with(out)
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        win = ready.value
        table = _seen(win.key)
        for b in small(batches, at):
            data, off = W.buffers(b.column(at))
            old_hits, old_items = b.column(names.index("hits")), b.column(names.index("items"))
            n_words, hits, items = [], [], []
            for i, j in W.blocks(off):
                w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i], W.LETTERS, lower=True)
                which, start = _match(win, table, w, W.word_hashes(w))
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + win.size[which], -1)
                hit = np.cumsum(edge)[:-1] > 0
                text_of = np.searchsorted(w.first, start, "right") - 1
                found: dict[int, set[str]] = {}
                for t, x in zip(text_of.tolist(), which.tolist(), strict=True):
                    found.setdefault(t, set()).update(win.items[x])
                for t in range(j - i):
                    own = hit[w.first[t] : w.first[t + 1]].copy()
                    n_words.append(len(own))
                    if t in found or len(old_hits[i + t]):
                        for r in old_hits[i + t].as_py():
                            own[r["start"] : r["end"]] = True
                        hits.append(_runs(own))
                        items.append(sorted(found.get(t, set()) | set(old_items[i + t].as_py())))
                    else:
                        hits.append([])
                        items.append([])
            new = {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, runs), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(k)) for k, c in enumerate(names)], names)

    return out.mapInArrow(run, schema)
