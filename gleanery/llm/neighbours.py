"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length and turned by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform); the signed
axis nearest to it is its cell. Where the table is so large that one rotation's cells would hold more than about `FILL` vectors, further
rotations divide them (see `plan`), so cells grow in number with the table and not in size. There are `TABLES` tables. A query probes in
each the cells whose summed projections are largest, `PROBES` times the square root of their number (`LEAST` vectors at least): the share of the table that a query
is compared with falls with the root of the table's size, by one rule for all sizes. What lies in the probed cells is ranked by the exact
inner product of the original vectors in double precision. A query that has found too few that way is then ranked against all vectors.
Vectors of one number of components are searched among themselves. Where their lengths differ, they stand on shelves of like length (up to
the ratio `LIKE`), each with cells of its own, since a cell says nothing of lengths. Queries probe the shelves of the longest vectors
first; a further shelf is probed by the queries for which its longest vector could beat the last of what they have found.

Neighbouring cells travel as one group; groups of many vectors or many queries are cut into blocks of both, and only the best few of a
query leave a task, so pairs are never written out. Equal vectors travel as one, with the few smallest ids that can be wanted.

Defined cases: vectors that are null or zero, or hold null or non-finite components, and rows with a null id, take no part; rows equal in
id and vector count once; ties go to the smaller id; with fewer candidates than asked for all are returned; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from gleanery.llm.exchange import expand, starts
from gleanery.llm.frames import shuffle_partitions, stored

NEAREST = 20
#: Tables, probes for each root of the number of cells, vectors of a cell, and how many of them a query probes at least.
TABLES, PROBES, FILL, LEAST = 8, 1.5, 12, 256
#: Vectors or queries of a group's block, and of all groups that a task holds at a time.
BLOCK, HELD = 4096, 32768
#: Pairs that a task weighs at a time, and bytes of hashed rows that are handed on at once.
PAIRS, BATCH = 1 << 20, 1 << 24
#: Ratio of the lengths on a shelf, and share of the vectors on the shelves that are probed first, at least.
LIKE, FIRST = 1.1, 1 / 16
SEED = 20


@dataclass(frozen=True)
class Plan:
    """Axes of each rotation of a table, all its cells, the cells that a query probes, and those of a group."""

    axes: tuple[int, ...]
    cells: int
    probes: int
    span: int


def plan(size: int, n: int, probes: float = PROBES) -> Plan:
    """For n vectors of `size` components: rotations with all axes as long as cells would hold over FILL vectors, and one with what is left."""
    most = 1 << max(1, (size - 1).bit_length())
    want, axes, cells = max(2, -(-n // FILL)), [], 1
    while not axes or cells < want:
        axes.append(min(most, max(1, -(-want // (2 * cells)))))
        cells *= 2 * axes[-1]
    return Plan(tuple(axes), cells, min(cells, max(math.ceil(probes * math.sqrt(cells)), -(-LEAST // FILL))), max(1, BLOCK * cells // n))


@dataclass(frozen=True)
class Shelf:
    """Vectors of like length: their number of components, the shelf's number from the longest on, its first band and last, vectors and longest one."""

    size: int
    number: int
    first: int
    last: int
    n: int
    high: float


def shelves(bands: list[tuple[int, int, int, float]]) -> list[Shelf]:
    """Shelves of bands (size, band, vectors, longest), where bands are numbered from the longest vectors: a band, or neighbouring ones of few vectors."""
    out: list[list] = []
    for size, band, n, high in sorted(bands):
        if out and out[-1][0] == size and max(out[-1][3], n) < LEAST:
            out[-1][2], out[-1][3] = band, out[-1][3] + n
        else:
            out.append([size, band, band, n, high])
    number: dict[int, int] = {}
    made = []
    for size, first, last, n, high in out:
        number[size] = number.get(size, -1) + 1
        made.append(Shelf(size, number[size], first, last, n, high))
    return made


def probed_first(every: list[Shelf]) -> set[tuple[int, int]]:
    """The shelves (size, number) of the longest vectors, until they hold their share of each size."""
    total: dict[int, int] = {}
    for s in every:
        total[s.size] = total.get(s.size, 0) + s.n
    out, held = set(), dict.fromkeys(total, 0)
    for s in every:
        if held[s.size] < FIRST * total[s.size]:
            out.add((s.size, s.number))
        held[s.size] += s.n
    return out


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, on the next power of two of components."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([SEED, seed, size])
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            y = out.reshape(len(out), -1, 2, h)
            out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(out), size)
            h *= 2
        out /= np.sqrt(size)
    return out


def cells(x: np.ndarray, table: int, axes: tuple[int, ...], probes: int = 1) -> np.ndarray:
    """The `probes` cells of each vector with the largest summed projections, largest first: of each rotation 2 * axis, and one more for its negative end."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cell, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k, a in enumerate(axes):
        y = rotate(x, table + TABLES * k)[:, :a]
        both = np.stack([y, -y], axis=2).reshape(len(y), -1)
        if probes == 1:
            cell = cell * (2 * a) + both.argmax(1)[:, None]
            continue
        order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        # a sum among the largest P comes of the i-th and j-th largest with i * j <= P
        i, j = np.nonzero(np.outer(np.arange(1, cell.shape[1] + 1), np.arange(1, order.shape[1] + 1)) <= probes)
        sums = total[:, i] + np.take_along_axis(both, order, 1)[:, j]
        best = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        cell = np.take_along_axis(cell[:, i] * (2 * a) + order[:, j], best, 1)
        total = np.take_along_axis(sums, best, 1)
    return cell


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, raw, size, length) of the vectors that take part; raw has the components as doubles."""
    for b in batches:
        ids, raw, size, length = [], [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                raw.append(x.tobytes())
                size.append(len(x))
                length.append(float(np.linalg.norm(x)))
        columns = [pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(size, pa.int32()), pa.array(length, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "raw", "size", "length"])


def _vectors(raw: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, size)


def _hashed(df: DataFrame, plans: dict[tuple[int, int], Plan], carry: str, kind: str, probing: bool) -> DataFrame:
    """Rows (raw, size, carry, shelf, table, part, cells): for each table and group of cells, those of the vector on its shelf, or those that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack([b.column(1).to_numpy(), b.column(3).to_numpy()], axis=1)
            for size, shelf in np.unique(keys, axis=0).tolist():
                p = plans.get((size, shelf))
                if p is None:
                    continue
                every, probes = np.flatnonzero((keys == (size, shelf)).all(1)), p.probes if probing else 1
                step = max(1, BATCH // (8 * max(size, 4 * probes)))
                for i, t in ((i, t) for i in range(0, len(every), step) for t in range(TABLES)):
                    part = b.take(pa.array(every[i : i + step]))
                    cell = np.sort(cells(_vectors(part.column(0), size), t, p.axes, probes), axis=1)
                    own = np.repeat(np.arange(len(cell)), cell.shape[1])
                    cell = cell.ravel()
                    group = cell // p.span
                    at = starts(own * p.cells + group)
                    again = part.take(pa.array(own[at]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(cell)), pa.int32()), pa.array(cell))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.full(len(at), t, np.int32)), pa.array(group[at]), lists], ["raw", "size", carry, "shelf", "table", "part", "cells"])

    return df.select("raw", "size", carry, "shelf").mapInArrow(run, f"raw binary, size int, {carry} {kind}, shelf int, table int, part long, cells array<long>")


class Best:
    """The best `k` points of each query among the pairs seen so far, and those that tie with the last up to rounding."""

    def __init__(self, k: int):
        self.k, self.pairs, self.n = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, query: np.ndarray, point: np.ndarray, score: np.ndarray) -> None:
        self.pairs.append((query, point, score))
        self.n += len(query)
        if self.n > PAIRS:
            self.n = len(self.cut()[0])

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, p, s = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        order = np.lexsort((-s, q))
        q, p, s = q[order], p[order], s[order]
        at = starts(q)
        n = np.diff(np.append(at, len(q)))
        low = s[at + np.minimum(n, self.k) - 1]
        ok = s >= np.repeat(low - 1e-9 * (1 + np.abs(low)), n)
        self.pairs = [(q[ok], p[ok], s[ok])]
        return self.pairs[0]


def _weigh(x: np.ndarray, q: np.ndarray, cell: np.ndarray, asked: np.ndarray, cells: np.ndarray, best: Best, x0: int, q0: int) -> None:
    """Offers `best` the points x of `cell` for the queries q[asked] that probe `cells`; x0 and q0 are the numbers of the first of each."""
    order, turn = np.argsort(cell, kind="stable"), np.argsort(cells, kind="stable")
    x, cell, asked, cells = x[order], cell[order], asked[turn], cells[turn]
    at = starts(cell)
    for lo, hi, a, b in zip(at, np.append(at[1:], len(cell)), np.searchsorted(cells, cell[at]), np.searchsorted(cells, cell[at], "right"), strict=True):
        step = max(1, PAIRS // (hi - lo))
        for i in range(a, b, step):
            who = asked[i : min(i + step, b)]
            near = q[who] @ x[lo:hi].T
            best.add(q0 + np.repeat(who, hi - lo), x0 + np.tile(order[lo:hi], len(who)), near.ravel())


def _rank(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of each query among the points of a bucket, in the groups and blocks that both are in."""
    names = ["size", "shelf", "table", "part", "block", "turn"]
    at: dict[tuple, list] = {}
    for side, table in enumerate((points, queries)):
        keys = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
        for row, key in enumerate(keys):
            at.setdefault(key, [[], []])[side].append(row)
    out: dict[str, list] = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
    both = {key: x for key, x in at.items() if x[0] and x[1]}
    for size in sorted({key[0] for key in both}):
        best = Best(k + 1)
        own = [x for key, x in both.items() if key[0] == size]
        rows = [np.concatenate([np.array(x[side]) for x in own]) for side in (0, 1)]
        p, asked = points.take(pa.array(rows[0])), queries.take(pa.array(rows[1]))
        x, q = _vectors(p.column("raw"), size), _vectors(asked.column("raw"), size)
        who = asked.column("query_id").to_numpy()
        names_of, query = np.unique(who, return_inverse=True)  # a query stands in several groups
        vector = np.empty((len(names_of), size))
        vector[query] = q
        cell = p.column("cells").combine_chunks()
        probed = asked.column("cells").combine_chunks()
        x0, q0 = 0, 0
        off = probed.offsets.to_numpy()
        flat, single = probed.values.to_numpy(), cell.flatten().to_numpy()
        for a, b in ((len(g[0]), len(g[1])) for g in own):
            o = off[q0 : q0 + b + 1]
            _weigh(x[x0 : x0 + a], vector, single[x0 : x0 + a], np.repeat(query[q0 : q0 + b], np.diff(o)), flat[o[0] : o[-1]], best, x0, 0)
            x0, q0 = x0 + a, q0 + b
        a, b, _ = best.cut()
        exact = (x[b] * vector[a]).sum(1)
        ids = p.column("ids").combine_chunks()
        lo, n = ids.offsets.to_numpy()[:-1][b], np.diff(ids.offsets.to_numpy())[b]
        v, s, a = ids.values.to_numpy()[expand(lo, n)], np.repeat(exact, n), np.repeat(a, n)
        # a point may have come up in several tables
        order = np.lexsort((v, -s, a))
        v, s, a = v[order], s[order], a[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (a[1:] != a[:-1])
        new &= v != names_of[a]
        v, s, a = v[new], s[new], a[new]
        first = starts(a)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        out["query_id"].append(names_of[a[place < k]])
        out["vec_id"].append(v[place < k])
        out["score"].append(s[place < k])
    return pa.table({c: pa.array(np.concatenate(x)) for c, x in out.items()})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding", probes: float = PROBES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of `vectors` found for each row of `queries`, other than its own id."""
    clean = lambda df: df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(_clean, "id long, raw binary, size int, length double").distinct()
    every = clean(vectors)
    # of equal vectors the k + 1 smallest ids are all that can be wanted
    first = every.withColumn("_r", F.row_number().over(Win.partitionBy("raw").orderBy("id"))).where(F.col("_r") <= k + 1)
    unique = stored(first.groupBy("raw", "size").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("length").alias("length")))
    # a row for each number of components, and for each band of lengths: at most some thousands, as lengths are doubles
    longest = unique.groupBy("size").agg(F.max("length").alias("high"))
    band = F.floor(F.log(F.col("high") / F.col("length")) / math.log(LIKE)).cast("int")
    banded = unique.join(longest, "size").withColumn("band", band).drop("high")
    counts = banded.groupBy("size", "band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("high")).collect()
    every_shelf = shelves([(r["size"], r["band"], r["n"], r["high"]) for r in counts])
    plans = {(s.size, s.number): plan(s.size, s.n, probes) for s in every_shelf}
    spark, early = vectors.sparkSession, probed_first(every_shelf)
    table = lambda chosen: spark.createDataFrame([(s.size, s.number, s.first, s.last, s.high) for s in chosen], "size int, shelf int, first int, last int, high double")
    wanted = stored(clean(queries).select("raw", "size", F.col("id").alias("query_id"), F.col("length").alias("own")))

    def search(chosen: list[Shelf], asks: DataFrame) -> DataFrame:
        on = table(chosen)
        points = banded.join(on, "size").where(F.col("band").between(F.col("first"), F.col("last"))).select("raw", "size", "ids", "shelf")
        return _found(_hashed(points, plans, "ids", "array<long>", False), _hashed(asks, plans, "query_id", "long", True), k)

    first = [s for s in every_shelf if (s.size, s.number) in early]
    top = stored(_best(search(first, wanted.join(table(first).select("size", "shelf"), "size")), k))
    rest = [s for s in every_shelf if (s.size, s.number) not in early]
    if rest:
        # an inner product is at most the product of the lengths
        last = top.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        asks = wanted.join(table(rest).select("size", "shelf", "high"), "size").join(last, "query_id", "left")
        asks = asks.where(F.col("least").isNull() | (F.col("own") * F.col("high") * (1 + 1e-9) >= F.col("least")))
        top = stored(_best(top.select("query_id", "vec_id", "score").unionByName(search(rest, asks)), k))
    # queries that have found too few where not all was probed: ranked against all vectors of their size
    partly = sorted({size for (size, _), p in plans.items() if p.probes < p.cells})
    enough = top.where(F.col("rank") == k).select("query_id")
    short = wanted.where(F.col("size").isin(partly)).join(enough, "query_id", "left_anti")
    one = lambda df: df.withColumns({"shelf": F.lit(0), "table": F.lit(0), "part": F.lit(0).cast("long"), "cells": F.array(F.lit(0).cast("long"))})
    if partly and not short.isEmpty():
        ids = short.select("query_id").distinct()
        top = top.join(ids, "query_id", "left_anti").unionByName(_best(_found(one(unique.drop("length")), one(wanted.drop("own").join(ids, "query_id")), k), k))
    return top


def _found(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score): of each task the k best of the points that share a group with a query and a cell that it probes."""
    by = ["size", "shelf", "table", "part"]
    blocks = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_{name}")).withColumn(name, F.ceil(F.col(f"_{name}") / F.lit(BLOCK)).cast("int"))
    # groups that both sides have, in blocks of points and in turns of queries
    held = stored(blocks(points, "blocks").join(blocks(asked, "turns"), by))
    rows = held.agg(F.sum(F.col("_blocks") * F.col("turns"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(points), rows // HELD)
    held = held.drop("_blocks", "_turns")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bucket = F.pmod(F.xxhash64(*by, "block", "turn"), F.lit(buckets)).cast("int")
    points = points.join(held, by).withColumn("block", F.pmod(F.xxhash64("raw"), F.col("blocks")).cast("int")).withColumn("turn", each("turns"))
    asked = asked.join(held, by).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).withColumn("block", each("blocks"))
    dealt = lambda df: df.drop("blocks", "turns").withColumn("_bucket", bucket).groupBy("_bucket")
    return dealt(points).cogroup(dealt(asked)).applyInArrow(lambda p, q: _rank(p, q, k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the k best of each query."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Win.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
