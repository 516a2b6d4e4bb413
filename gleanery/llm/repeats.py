"""Periodic runs in texts by an all-lag scan of word ids.

A run is a stretch of words that repeats with a smallest period q (words q apart are the same), holds the period `exponent` times and
`least` words at least, and that no neighbouring word extends. A text's words become numbers, the same for the same word, and the
numbers are compared with themselves shifted by each lag up to n / `exponent`; stretches of equal places are the runs.

All lags of a band [q, 2 q) are compared in one strided step. A run has equal places over (`exponent` - 1) q words, so it is enough to
look at every place that is a multiple of an eighth of that: eight hits in a row at one lag lead to the stretch, which is then followed
to both ends word by word. Work is about n words for each band, so n log n for a text. A stretch found at a multiple of its smallest
period is reduced by the lag's prime factors; what lies in a known run at a multiple of its period is not followed again.

Texts stay where they are, in one narrow pass, but for those of over `LONG` bytes: these are sent as numbers to one task for each band of
lags, and the runs are put together afterwards. A document's numbers have to fit one task's memory.

Defined cases: null and empty texts, and texts without words, have no words, no runs and are kept as empty texts; null and repeated ids
are rows like others; an empty table gives an empty table; other columns are kept, and results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import exchange as X
from gleanery.llm import words as W
from gleanery.llm.frames import masked, schema_with, shuffle_partitions, small, stored

LEAST, EXPONENT = 24, 3
#: Bytes of a text whose bands of lags are dealt to several tasks.
LONG = 4 << 20
#: Places that must agree in a row before a stretch is followed, and comparisons held in memory at once.
HITS, HELD = 8, 1 << 22
RUNS = "array<struct<start:long,length:long,period:long>>"


@dataclass
class Texts:
    """Words of some texts in one buffer, each with a space behind it: where each begins, the first of each text, and a number for each word."""

    data: np.ndarray
    at: np.ndarray
    first: np.ndarray
    ids: np.ndarray


def numbered(data: np.ndarray, off: np.ndarray) -> Texts:
    w = W.split(data, off)
    n = w.end - w.start + 1
    joined = np.concatenate([w.data, np.zeros(1, np.uint8)])[X.expand(w.start, n)]
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    joined[at[1:] - 1] = 32
    words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(joined)])
    return Texts(joined, at, w.first, words.dictionary_encode().indices.to_numpy().astype(np.int32))


# the scan


def bands(words: int, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Bands [lo, hi) of lags of a text of so many words."""
    top, out, lo = words // exponent + 1, [], 1
    while lo < top:
        hi = 8 if lo == 1 else 2 * lo
        out.append((lo, min(hi, top)))
        lo = hi
    return out


def candidates(row: np.ndarray, lo: int, hi: int, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags of the band where HITS places in a row agree. `row` ends in hi numbers that equal nothing."""
    n = len(row) - hi
    need = max((exponent - 1) * lo, least - hi + 1)
    step = max(1, need // HITS)
    hits = min(HITS, need // step)
    places = -(-n // step)
    size = max(hits, HELD // (hi - lo))
    for k in range(0, max(places - hits + 1, 0), size):
        m = min(size + hits - 1, places - k)
        shifted = np.ndarray((m, hi - lo), row.dtype, row, row.itemsize * (k * step + lo), (row.itemsize * step, row.itemsize))
        same = shifted == row[k * step : (k + m) * step : step][:m, None]
        done = 1
        while done < hits:  # so many in a row
            more = min(done, hits - done)
            same = same[:-more] & same[more:]
            done += more
        i, j = np.nonzero(same)
        if len(i):
            yield (i + k) * step, j + lo


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many first places agree, looked at in growing parts."""
    at, size = 0, 64
    while at < len(x):
        same = x[at : at + size] == y[at : at + size]
        if not same.all():
            return at + int(same.argmin())
        at, size = at + size, 2 * size
    return len(x)


def _factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            q //= f
        else:
            f += 1
    return out + [q] * (q > 1)


def smallest_period(run: np.ndarray, q: int) -> int:
    """The smallest period of numbers that have the period q and twice its length: it divides q."""
    for f in _factors(q):
        if q % f == 0 and np.array_equal(run[q // f :], run[: -(q // f)]):
            q //= f
    return q


def scan(row: np.ndarray, lags: list[tuple[int, int]], ends: list[int] | None = None, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) that the bands find in `row`, whose numbers are at least 0 but for distinct negative ones between texts.

    `ends`: where to stop in each band, as where only longer texts follow the lag so far.
    """
    found: set[tuple[int, int, int]] = set()
    period, until = np.zeros(len(row), np.int32), np.zeros(len(row), np.int64)
    low = int(row.min(initial=0))
    for (lo, hi), end in zip(lags, ends or [len(row)] * len(lags), strict=True):
        part = np.concatenate([row[:end], np.arange(low - hi, low, dtype=row.dtype)])
        for places, lag in candidates(part, lo, hi, least, exponent):
            order = np.lexsort((places, lag))
            places, lag = places[order], lag[order]
            while len(places):
                p = period[places]
                known = (p > 0) & (lag % np.maximum(p, 1) == 0) & (places + lag < until[places])
                places, lag = places[~known], lag[~known]
                if not len(places):
                    break
                # of each lag the first place is followed; later ones of its stretch go with it
                lead = X.starts(lag)
                past = np.empty(len(lead), np.int64)
                for k, i in enumerate(lead.tolist()):
                    at, q = int(places[i]), int(lag[i])
                    if period[at] and q % period[at] == 0 and at + q < until[at]:  # known since
                        past[k] = at + 1
                        continue
                    right = at + _agreeing(part[at : end - q], part[at + q : end])
                    left = at - _agreeing(part[:at][::-1], part[q : at + q][::-1])
                    past[k] = right
                    if (size := right - left + q) >= max(least, exponent * q):
                        own = smallest_period(part[left : left + size], q)
                        if (left, size, own) not in found:
                            found.add((left, size, own))
                            period[left : left + size] = own
                            until[left : left + size] = left + size
                rest = places >= np.repeat(past, np.diff(np.append(lead, len(lag))))
                places, lag = places[rest], lag[rest]
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts: Texts, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, by start and then period: all texts are scanned together, the longest first, with a number of its own behind each."""
    count = np.diff(texts.first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in count]
    order = np.argsort(-count, kind="stable")
    order = order[count[order] >= least]
    if not len(order):
        return out
    n = count[order]
    close = np.cumsum(n + 1)
    row = np.empty(int(close[-1]), np.int32)
    own = np.ones(len(row), bool)
    own[close - 1] = False
    row[own] = texts.ids[X.expand(texts.first[order], n)]
    row[close - 1] = -1 - np.arange(len(order), dtype=np.int32)
    lags = bands(int(n[0]), exponent)
    # a band is for texts that hold its lowest lag often enough
    ends = [int(close[max(np.searchsorted(-n, -exponent * lo, "right") - 1, 0)]) for lo, _ in lags]
    begin = close - n - 1
    for start, size, q in scan(row, lags, ends, least, exponent):
        k = int(np.searchsorted(begin, start, "right")) - 1
        out[order[k]].append((start - int(begin[k]), size, q))
    return out


# texts without what repeats


def _kept(texts: Texts, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Texts of the words that no run holds after its first period, joined by one space."""
    keep = np.ones(len(texts.ids), bool)
    for first, own in zip(texts.first[:-1].tolist(), runs, strict=True):
        for start, size, q in own:
            keep[first + start + q : first + start + size] = False
    words = np.flatnonzero(keep)
    n = texts.at[words + 1] - texts.at[words]
    data = texts.data[X.expand(texts.at[words], n)]
    last = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(words, texts.first)]
    # each text without its last space
    n = np.diff(last)
    data = data[X.expand(last[:-1], np.maximum(n - 1, 0))]
    off = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(off), pa.py_buffer(data)]).cast(pa.string())


def _structs(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [r for own in runs for r in own]
    fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    off = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def _results(batch: pa.RecordBatch, texts: Texts, runs: list) -> pa.RecordBatch:
    n = pa.array(np.diff(texts.first))
    return pa.RecordBatch.from_arrays([*batch.columns, n, _structs(runs), _kept(texts, runs)], [*batch.schema.names, "n_words", "runs", "kept"])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, long: int = LONG, size: str | None = None) -> DataFrame:
    """`docs` with n_words, runs (start and length in words, period; by start, then period) and kept, the text without what repeats.

    `size`: a column with the bytes of each text, about, where it is known without making the text.
    """
    docs, (body, *known), back = masked(docs.drop("n_words", "runs", "kept"), text, *([size] if size else []))
    schema = schema_with(docs, n_words="long", runs=RUNS, kept="string")
    place = docs.columns.index(body)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, place):
            data, off = W.buffers(batch.column(place))
            for i, j in W.blocks(off):
                texts = numbered(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield _results(batch.slice(i, j - i), texts, runs_of(texts, least, exponent))

    heavy = F.coalesce(F.col(known[0]) if known else F.octet_length(body), F.lit(0)) > long
    out = docs.where(~heavy).mapInArrow(near, schema)
    big = stored(docs.where(heavy).withColumn("row", F.monotonically_increasing_id()))
    if not big.isEmpty():
        out = out.unionByName(_far(big, body, least, exponent).select(*schema.fieldNames()))
    return back(out, n_words="n_words", runs="runs", kept="kept")


def _far(big: DataFrame, body: str, least: int, exponent: int) -> DataFrame:
    """The stored long texts of `big`, which have a number `row`, with their results: a task for each text and band of lags."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = numbered(*W.buffers(pa.array([text], text.type)))
                ids = texts.ids.tobytes()
                for lo, hi in bands(len(texts.ids), exponent):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "lo": pa.array([lo], pa.int64()), "hi": pa.array([hi], pa.int64()), "ids": pa.array([ids], pa.binary())})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, lo, hi, ids = (batch.column(c)[k].as_py() for c in range(4))
                found = scan(np.frombuffer(ids, np.int32), [(lo, hi)], None, least, exponent)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), *(pa.array([r[c] for r in found], pa.int64()) for c in range(3))], ["row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(body)
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                texts = numbered(*W.buffers(one.column(at)))
                runs = [[(r["start"], r["length"], r["period"]) for r in one.column(one.num_columns - 1)[0].as_py() or []]]
                yield _results(one.drop_columns(["found"]), texts, runs)

    parts = 2 * shuffle_partitions(big)
    shifted = big.select("row", body).mapInArrow(deal, "row long, lo long, hi long, ids binary").repartition(parts, "row", "lo")
    runs = shifted.mapInArrow(follow, "row long, start long, length long, period long").distinct()
    order = lambda a, b: F.when(a["start"] == b["start"], a["period"] - b["period"]).otherwise(a["start"] - b["start"]).cast("int")
    lists = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    own = big.join(lists, "row", "left").select(*big.columns, F.array_sort("found", order).alias("found"))
    return own.mapInArrow(finish, schema_with(big, n_words="long", runs=RUNS, kept="string"))
