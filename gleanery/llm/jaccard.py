"""N-gram Jaccard join with a count-vector R-tree, and the classes it makes.

Texts are sets of five-word shingles; two are linked at a Jaccard similarity of 0.75 or more. Equal texts are one unit.

1. Shingles are counted over all units (by packed questions, see `exchange`). A unit's shingles in the order of rarity have a
   prefix of a quarter, of which linked units must share one; a shingle that only one unit has joins with nothing. Most units
   have a quarter of such shingles and are done. The shared prefix shingles deal the others to groups.
2. In a group the units are points: their shingles are hashed into `GROUPS` groups, whose counts are the coordinates. An R-tree
   over the points holds the highest coordinates of each node. Summed coordinate minima bound the overlap from above, so a node
   or a point whose bound is too low for a link is left out; so is a node of the asking unit's own component. What follows the
   group's shingle in a unit's order bounds the overlap too, in the group of the first shingle that two units share.
3. Surviving pairs are verified on the shingle sets.

The tree is asked twice. First `SEEDS` units ask in each group, chosen by hash; what they link to becomes components. Then
every unit that is not in its group's largest component asks for units of other components. A pair that never came up lies in
one component already, or failed a bound; so components are exact, and groups of copies do not cost the square of their size.
Groups of over `BLOCK` units are cut into blocks by hash; units that ask go to all.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; with fewer words than
five the whole text is one shingle; a null id takes part like others but is never the smallest, and a class of null ids alone has
a null component; repeated rows are copies; an empty table gives an empty table; other columns are kept, and results replace
columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from gleanery.llm import exchange as X
from gleanery.llm import words as W
from gleanery.llm.components import connected
from gleanery.llm.frames import discard, give_back, masked, shuffle_partitions, stored

SHINGLE, GROUPS, FANOUT, SEEDS, BLOCK = 5, 256, 16, 8, 512
KEY_BITS = 40
#: Bytes of a unit in a bucket, about.
ROW = 2 * GROUPS
#: Pairs of one lead that stay together.
PAIRS = 4096


def linked(common, a, b):
    """Similarity of 0.75 or more, in whole numbers, from the sizes of an overlap and of two sets."""
    return 100 * common >= 75 * (a + b - common)


# 1. rarity and prefixes


class Units:
    """Distinct shingles of a chunk's units."""

    def __init__(self, table: pa.Table):
        ids = table.column("unit").to_pylist()
        lead: dict[bytes, int] = {}
        for k, u in enumerate(ids):
            lead.setdefault(u, k)
        self.units = sorted(lead)
        data, off = W.buffers(table.column("text").take(pa.array([lead[u] for u in self.units], pa.int64())))
        owner, grams = [np.zeros(0, np.int64)], [np.zeros(0, W.U)]
        for i, j in W.blocks(off):
            w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i], W.NOT_SPACE, lower=True)
            g, at = W.shingles(W.word_hashes(w), w.first, SHINGLE)
            own = np.repeat(np.arange(i, j), np.diff(at))
            order = np.lexsort((g, own))
            g, own = g[order], own[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
            owner.append(own[new])
            grams.append(g[new])
        self.owner, self.gram = np.concatenate(owner), np.concatenate(grams)
        self.size = np.bincount(self.owner, minlength=len(self.units))
        self.keys, self.key_of, self.counts = np.unique((self.gram >> W.U(64 - KEY_BITS)).astype(np.int64), return_inverse=True, return_counts=True)

    def bounds(self, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin: buckets are ranges of keys."""
        return np.searchsorted(self.keys, -(-(np.arange(buckets + 1, dtype=np.int64) << KEY_BITS) // buckets))

    def questions(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        at = self.bounds(buckets)
        for k in range(buckets):
            keys, n = self.keys[at[k] : at[k + 1]], self.counts[at[k] : at[k + 1]]
            if len(keys):
                gap = np.diff(keys)
                wide = np.uint64 if len(gap) and gap.max() >= 1 << 32 else np.uint32
                planes = gap.astype(wide).view(np.uint8).reshape(-1, np.dtype(wide).itemsize).T.copy()
                many = np.flatnonzero(n > 1).astype(np.uint32)
                yield k, X.pack(int(keys[0]), np.dtype(wide).itemsize, planes, many, n[many].astype(np.uint32))


def _count(payloads: list[bytes]) -> list[bytes | None]:
    """For each chunk, which of its keys more than one unit has, and how many do."""
    keys, counts = [], []
    for p in payloads:
        lead, wide, planes, many, n = X.unpack(p)
        gap = np.ascontiguousarray(planes.T).view(np.uint32 if wide == 4 else np.uint64).ravel().astype(np.int64)
        keys.append(np.cumsum(np.concatenate([[lead], gap])))
        c = np.ones(len(keys[-1]), np.int64)
        c[many] = n
        counts.append(c)
    size = np.array([len(k) for k in keys])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    lead = X.starts(every[order])
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(np.concatenate(counts)[order], lead), np.diff(np.append(lead, len(order))))
    out: list[bytes | None] = []
    for end, n in zip(np.cumsum(size), size, strict=True):
        own = total[end - n : end]
        some = np.flatnonzero(own > 1)
        out.append(X.pack(some.astype(np.uint32), np.minimum(own[some], (1 << 31) - 1).astype(np.int32)) if len(some) else None)
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them all: one, two or four each."""
    most = int(counts.max())
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def unpack_counts(packed: list[bytes]) -> np.ndarray:
    if all(len(x) == GROUPS for x in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), GROUPS)
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}
    return np.array([np.frombuffer(x, kinds[len(x)]) for x in packed], np.int32).reshape(len(packed), GROUPS)


def _signatures(table: pa.Table, answers: list[tuple[int, bytes]], buckets: int) -> pa.Table:
    """Each unit's size, its shared prefix shingles with their counts and what follows them, and, if it has any, its counts by group and its shingles."""
    u = Units(table)
    at = u.bounds(buckets)
    df = np.ones(len(u.keys), np.int64)
    for bucket, payload in answers:
        k, n = X.unpack(payload)
        df[at[bucket] + k.astype(np.int64)] = n
    own_df = df[u.key_of]
    order = np.lexsort((u.gram, own_df, u.owner))
    first = np.cumsum(u.size) - u.size
    place = np.arange(len(order)) - first[u.owner[order]]
    prefix = u.size - (3 * u.size + 3) // 4 + 1
    chosen = (place < prefix[u.owner[order]]) & (own_df[order] > 1)
    keep, kept_at = order[chosen], place[chosen]
    n_keep = np.bincount(u.owner[keep], minlength=len(u.units))
    off = pa.array(np.concatenate([[0], np.cumsum(n_keep)]), pa.int32())
    tokens = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(u.gram[keep].view(np.int64)), pa.array(own_df[keep].astype(np.int32)), pa.array((u.size[u.owner[keep]] - kept_at).astype(np.int32))], ["token", "df", "rest"]))
    some = np.flatnonzero(n_keep)
    vectors: list[bytes | None] = [None] * len(u.units)
    sets: list[bytes | None] = [None] * len(u.units)
    for k in some.tolist():
        g = u.gram[first[k] : first[k] + u.size[k]]
        vectors[k] = pack_counts(np.bincount((g % W.U(GROUPS)).astype(np.int64), minlength=GROUPS))
        sets[k] = g.tobytes()
    return pa.table({"unit": pa.array(u.units, pa.binary()), "n": pa.array(u.size, pa.int64()), "tokens": tokens, "vector": pa.array(vectors, pa.binary()), "grams": pa.array(sets, pa.binary())})


def signatures(docs: DataFrame, unit: str = "unit", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (unit, n, tokens, vector, grams), one for each distinct unit."""

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each unit one text for each task: copies stay where they are."""
        give_back()
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for k, u in enumerate(b.column(0).to_pylist()):
                if u not in seen:
                    seen.add(u)
                    new.append(k)
            yield b.take(pa.array(new, pa.int64()))

    buckets = buckets or X.parts(docs, text)
    slim = docs.select(F.col(unit).alias("unit"), F.col(text).alias("text"))
    rows = X.chunked(slim.mapInArrow(first_of_task, "unit binary, text string"), ["unit"], buckets)
    answers = X.answer(X.ask(rows, lambda t: Units(t).questions(buckets)), _count)
    schema = "unit binary, n long, tokens array<struct<token:long,df:int,rest:int>>, vector binary, grams binary"
    return X.apply(rows, answers, lambda t, a: _signatures(t, a, buckets), schema)


# 2. the tree


def packed(vectors: np.ndarray, component: np.ndarray) -> np.ndarray:
    """An order in which like vectors share a node: halves by the coordinate that varies most, down to single nodes.

    A component of over FANOUT points has nodes of its own, which its points need not visit.
    """
    _, which, size = np.unique(component, return_inverse=True, return_counts=True)
    pool = np.where(size[which] > FANOUT, which, -1)
    out: list[np.ndarray] = []
    for p in np.unique(pool):
        left = [np.flatnonzero(pool == p)]
        while left:
            rows = left.pop()
            if len(rows) <= FANOUT:
                out.append(rows)
                continue
            x = vectors[rows].astype(np.float32)
            half = -(-len(rows) // (2 * FANOUT)) * FANOUT
            order = np.argsort(x[:, x.var(0).argmax()], kind="stable")
            left += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out)


class Tree:
    """An R-tree over count vectors, packed in the given order: nodes hold highest coordinates, sizes, most of what follows and a component."""

    def __init__(self, vectors: np.ndarray, size: np.ndarray, rest: np.ndarray, component: np.ndarray):
        self.visited = 0  # nodes and points whose minima have been summed
        self.levels = [(vectors, size, size, rest, component)]
        while len(self.levels[-1][0]) > FANOUT:
            v, lo, hi, r, c = self.levels[-1]
            at = np.arange(0, len(v), FANOUT)
            one = np.minimum.reduceat(c, at) == np.maximum.reduceat(c, at)
            self.levels.append((np.maximum.reduceat(v, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(r, at), np.where(one, c[at], -1)))

    def search(self, vector: np.ndarray, size: int, rest: int, component: int) -> np.ndarray:
        """Points of other components whose bounds allow a link."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, lo, hi, r, c = self.levels[depth]
            nodes = nodes[(c[nodes] != component) & (4 * hi[nodes] >= 3 * size) & (3 * lo[nodes] <= 4 * size)]
            nodes = nodes[linked(np.minimum(r[nodes], rest), size, lo[nodes])]
            self.visited += len(nodes)
            # the overlap is at most the summed minima; a smaller set needs less of it
            most = np.minimum(v[nodes], vector).sum(1, dtype=np.int64)
            nodes = nodes[linked(np.minimum(most, np.minimum(hi[nodes], size)), size, lo[nodes])]
            if depth:
                n = len(self.levels[depth - 1][0])
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < n]
        return nodes


def _pairs(table: pa.Table, seeds: int) -> pa.Table:
    """Surviving pairs of each group and block of a bucket. `asks`: whether a row asks or is in the tree; with `seeds`, so many of those in the tree where none does."""
    token, block = table.column("token").to_numpy(), table.column("block").to_numpy()
    unit = table.column("unit").to_pylist()
    comp = unit if seeds else table.column("component").to_pylist()
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    size, rest = table.column("n").to_numpy(), table.column("rest").to_numpy()
    vector = unpack_counts(table.column("vector").to_pylist())
    number = {c: k for k, c in enumerate(dict.fromkeys(comp))}
    comp = np.array([number[c] for c in comp], np.int64)
    order = np.lexsort((comp, block, token))
    lead = np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (block[order][1:] != block[order][:-1])])
    at = np.append(np.flatnonzero(lead), len(order))
    found: set[tuple[bytes, bytes]] = set()
    for i, j in zip(at[:-1], at[1:], strict=True):
        rows = order[i:j]
        held, asking = rows[~asks[rows]], rows[asks[rows]]
        if seeds and not len(asking):  # units are digests: the lowest are the same few in every group that has them
            asking = sorted(rows, key=unit.__getitem__)[:seeds]
        if not len(held) or not len(asking):
            continue
        if len(held) > FANOUT:
            held = held[packed(vector[held], comp[held])]
        tree = Tree(vector[held], size[held], rest[held], comp[held])
        for q in asking:
            for k in held[tree.search(vector[q], size[q], rest[q], comp[q])]:
                found.add((unit[q], unit[k]) if unit[q] < unit[k] else (unit[k], unit[q]))
    a, b = [x for x, _ in found], [x for _, x in found]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _search(rows: DataFrame, n: int, seeds: int = 0) -> DataFrame:
    """Distinct pairs (a, b) that the trees of (token, block) let through, by `n` buckets of them."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("token", "block"), F.lit(n)).cast("int"))
    return dealt.groupBy("_bucket").applyInArrow(lambda t: _pairs(t, seeds), "a binary, b binary").distinct()


# 3. verification


def _verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    grams = dict(zip(sets.column("unit").to_pylist(), (np.frombuffer(x, W.U) for x in sets.column("grams").to_pylist()), strict=True))
    ok_a, ok_b = [], []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        x, y = grams[a], grams[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
        if common and linked(common, len(x), len(y)):
            ok_a.append(a)
            ok_b.append(b)
    return pa.table({"a": pa.array(ok_a, pa.binary()), "b": pa.array(ok_b, pa.binary())})


def verify(pairs: DataFrame, sigs: DataFrame, parts: int) -> DataFrame:
    """The pairs whose shingle sets are similar enough, stored. A part of the pairs gets each set it needs once.

    Pairs are dealt by the lowest partner of their second unit, mostly one seed for a group of copies, so most sets travel once; the pairs of a
    partner that has more than `PAIRS` of them are dealt further by their second unit.
    """
    led = stored(pairs.withColumn("_lead", F.min("a").over(Win.partitionBy("b"))))
    # written, so that Spark knows how few they are before it plans the join
    many = stored(led.groupBy("_lead").count().where(F.col("count") > PAIRS).select("_lead", F.ceil(F.col("count") / F.lit(PAIRS)).alias("_split")))
    turn = F.pmod(F.xxhash64("b"), F.coalesce("_split", F.lit(1)))
    dealt = led.join(many, "_lead", "left").select("a", "b", F.pmod(F.xxhash64("_lead", turn), F.lit(parts)).cast("int").alias("_part"))
    need = dealt.select(F.col("_part").alias("_need"), F.explode(F.array("a", "b")).alias("unit")).distinct()
    sets = need.join(sigs.where(F.col("grams").isNotNull()).select("unit", "grams"), "unit")
    sure = stored(dealt.groupBy("_part").cogroup(sets.groupBy("_need")).applyInArrow(_verify, "a binary, b binary"))
    discard(led, many)
    return sure


def components(sigs: DataFrame, seeds: int = SEEDS, block: int = BLOCK) -> DataFrame:
    """Rows (node, component) of all units that have a link."""
    # buckets and parts by the bytes of vectors and sets, so that a task holds as much at any size
    held = sigs.where(F.size("tokens") > 0).agg(F.sum(F.size("tokens")), F.sum("n")).first()
    least = 2 * shuffle_partitions(sigs)
    buckets, parts = max(least, (held[0] or 0) * ROW // X.PART), max(least, (held[1] or 0) * 8 // X.PART)
    rows = sigs.where(F.size("tokens") > 0).select("unit", "n", "vector", F.explode("tokens").alias("t")).select("unit", "n", "vector", "t.token", "t.df", "t.rest")
    blocks = F.ceil(F.col("df") / F.lit(block)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    # first round: some ask for all; in large groups those of the lowest hashes, about as many, ask in all blocks
    lead = rows.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("unit", "token"), F.col("df")) < seeds))
    to_all = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    every = rows.withColumn("asks", F.lit(False)).unionByName(to_all(lead))
    pairs = stored(_search(every, buckets, seeds))
    first = connected(sure := verify(pairs, sigs, parts))
    # second round: of each group, all but the largest component ask; vectors come back for groups of several components only
    now = stored(rows.drop("vector").join(first.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit")))
    sizes = now.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("n_comp"))
    mixed = now.join(sizes.where("n_comp > 1").select("token", "main"), "token")
    some = stored(mixed.join(sigs.where(F.size("tokens") > 0).select("unit", "vector"), "unit"))
    there = some.withColumn("asks", F.lit(False))
    late = stored(_search(there.unionByName(to_all(some.where("component <> main"))), buckets))
    # what the second round links are components of the first and units that had no link
    known = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    found = verify(late, sigs, parts).join(known("a"), "a", "left").join(known("b"), "b", "left")
    second = connected(found.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    alone = second.join(first, "node", "left_anti")
    out = stored(moved.unionByName(alone.select("node", "component")))
    discard(pairs, sure, now, some, late)
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """`docs` with n_shingles and component_id, the smallest key reachable by links; in `name`, if given, an id of the class.

    Classes that share a smallest key, as where a key repeats with other texts, differ in `name`.
    """
    more = [name] if name else []
    docs, (key, text), back = masked(docs.drop("n_shingles", "component_id", *more), key, text)
    members = docs.withColumn("unit", F.unhex(F.md5(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")))))
    sigs = stored(signatures(members, "unit", text))
    comps = components(sigs)
    least = members.groupBy("unit").agg(F.min(key).alias("least"))
    units = sigs.select("unit", F.col("n").alias("n_shingles")).join(comps.withColumnRenamed("node", "unit"), "unit", "left").join(least, "unit")
    units = stored(units.select("unit", "n_shingles", F.coalesce("component", "unit").alias("class"), "least"))
    smallest = stored(units.groupBy("class").agg(F.min("least").alias("component_id")))
    known = stored(units.join(smallest, "class").select("unit", "n_shingles", "component_id", "class"))
    discard(sigs, comps, units, smallest)
    # a text without shingles is linked with nothing, copies included
    component = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id"))
    return back(members.join(known, "unit"), n_shingles="n_shingles", component_id=component, **dict.fromkeys(more, "class"))
