"""Near-duplicate texts by SimHash fingerprints, joined in vantage-point trees.

A text's fingerprint has a bit for each of 64 places: 1 if over half of the hashes of its four-word shingles, repeats included,
have it. Fingerprints link at 4 or fewer differing bits; equal ones are one point.

1. Points are dealt to shards. A vantage point alone does not part random fingerprints, which lie at about 32 bits from everything,
   so the first cut is by bits on which a link must agree: of k blocks of bits, 4 differing bits leave k - 4 untouched, and a point
   goes to one shard for each choice of k - 4 blocks. k and the bits used grow with the table, so that shards keep to `SHARD` points.
2. In a shard the points make a vantage-point tree: a node takes a point, links all points within 4 bits of it, and parts the others
   at the median distance. Points then ask the tree; by the triangle bounds they enter a side only if their ball of 4 bits reaches
   it, and never a node whose points are all of their own component. So a group of copies does not cost the square of its size.
3. A shard of over `BLOCK` points, as a large group of near copies makes, is parted itself: vantage points of a sample route its
   points to leaves, which tasks hold apart, and leaves that are still too large are cut by hash. First each leaf joins its own
   points, and the first vantage points ask everywhere; then every point that is not in the shard's largest component asks in all
   leaves that its ball overlaps. Of two points that are linked and still apart at least one does, so components are exact.

Defined cases: null and empty texts, and texts without words, have the fingerprint 0, which links like any other; with fewer words than
four the whole sequence is one shingle; a null key takes part like others but is never the smallest, and a class of null keys alone has
a null component; a null fingerprint has a null component; repeated rows share a class; an empty table gives an empty table; other columns are kept, and results replace columns
of their names.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import exchange as X
from gleanery.llm import words as W
from gleanery.llm.components import connected
from gleanery.llm.frames import discard, masked, stored

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Points in a shard, about; points that a task holds in a tree at most; points in a leaf of a tree.
SHARD, BLOCK, LEAF = 1024, 8192, 48
#: Leaves that a large shard is parted into at most, sampled points for each, and vantage points that ask everywhere.
ROUTES, SAMPLE, ASKING = 256, 16, 15
#: Shingles that are hashed at once.
SLICE = 1 << 15


# 1. fingerprints


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint of each text."""
    data, off = W.buffers(texts)
    ones, total = np.zeros((len(off) - 1, BITS), np.int64), np.zeros(len(off) - 1, np.int64)
    for i, j in W.blocks(off):
        w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i], W.NOT_SPACE, lower=True)
        n = w.end - w.start + 1  # with one space
        joined = np.concatenate([w.data, np.zeros(1, np.uint8)])[X.expand(w.start, n)]
        end = np.cumsum(n) - 1
        joined[end] = 32
        raw = joined.tobytes()
        runs = np.where(w.counts > 0, np.maximum(w.counts - WORDS + 1, 1), 0)
        total[i:j] = runs
        owner = np.repeat(np.arange(i, j), runs)
        lead = X.expand(w.first[:-1], runs)
        last = lead + np.repeat(np.minimum(w.counts, WORDS), runs) - 1
        for k in range(0, len(lead), SLICE):
            at, to, own = (end - n + 1)[lead[k : k + SLICE]].tolist(), end[last[k : k + SLICE]].tolist(), owner[k : k + SLICE]
            h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(at, to, strict=True)), np.uint64, len(at))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            new = X.starts(own)
            ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text column as a long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts).view(np.int64))

    return of(F.col(text) if isinstance(text, str) else text)


def hexed(fp: Column | str) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# 2. trees


def distance(x: np.ndarray, y) -> np.ndarray:
    """Differing bits."""
    return np.bitwise_count(x ^ y).astype(np.int16)


class Links:
    """Components of a task's points."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1]

    def unite(self, points: np.ndarray) -> None:
        own = np.unique(self.of[points])
        if len(own) > 1:
            self.of[np.isin(self.of, own)] = own[0]


class Tree:
    """A vantage-point tree over points[held]; building it links each vantage point with what lies within the radius of it."""

    def __init__(self, points: np.ndarray, held: np.ndarray, links: Links):
        self.points, self.links = points, links
        self.compared = 0
        #: [vantage point, or -1 in leaves; median distance; inside; outside; points below]
        self.nodes: list[list] = []
        self._build(held)

    def _build(self, held: np.ndarray) -> None:
        stack = [(held, None, 0)] if len(held) else []
        while stack:
            own, parent, side = stack.pop()
            if parent:
                parent[side] = len(self.nodes)
            node = [-1, 0, -1, -1, own]
            self.nodes.append(node)
            if len(own) <= LEAF:
                continue
            d = distance(self.points[own], self.points[own[0]])
            self.compared += len(own)
            self.links.unite(own[d <= RADIUS])
            d, rest = d[1:], own[1:]
            mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
            if d.max() == mu:
                mu -= 1
            if (inside := d <= mu).any():  # else all lie at one distance and stay a leaf
                node[:2] = int(own[0]), mu
                stack += [(rest[inside], node, 2), (rest[~inside], node, 3)]

    def join(self, asking: np.ndarray) -> None:
        """Links each asking point with the held points within the radius."""
        stack = [(0, asking)] if self.nodes else []
        while stack:
            at, q = stack.pop()
            v, mu, inside, outside, own = self.nodes[at]
            label = self.links.of[own]
            if (label == label[0]).all():
                q = q[self.links.of[q] != label[0]]
            if not len(q):
                continue
            if v < 0:
                for k in range(0, len(q), BLOCK // 8):
                    part = q[k : k + BLOCK // 8]
                    for i in range(0, len(own), BLOCK // 8):
                        some = own[i : i + BLOCK // 8]
                        self.compared += len(part) * len(some)
                        near = distance(self.points[part][:, None], self.points[some]) <= RADIUS
                        a, b = np.nonzero(near & (self.links.of[part][:, None] != self.links.of[some]))
                        for x, y in zip(part[a].tolist(), some[b].tolist(), strict=True):
                            if self.links.of[x] != self.links.of[y]:
                                self.links.unite(np.array([x, y]))
                continue
            d = distance(self.points[q], self.points[v])
            self.compared += len(q)
            for x in q[(d <= RADIUS) & (self.links.of[q] != self.links.of[v])].tolist():
                self.links.unite(np.array([v, x]))
            stack += [(inside, q[d - RADIUS <= mu]), (outside, q[d + RADIUS > mu])]


def _stars(table: pa.Table) -> pa.Table:
    """Links (a, b) of a leaf's points: stars that make the components which its trees find. `home`: held in the tree; all `asks` ask it."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    known = table.column("component").to_numpy()
    home, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "asks"))
    # by a hash, so that the vantage points are no particular ones
    order = np.argsort(W.mix(fp + W.U(1)), kind="stable")
    links = Links(known)
    before = links.of.copy()
    tree = Tree(fp, order[home[order]], links)
    tree.join(order[asks[order]])
    # one member for each component before, linked to the first of the component after
    _, one = np.unique(before, return_index=True)
    one = one[np.argsort(links.of[one], kind="stable")]
    lead = X.starts(links.of[one])
    head = np.repeat(one[lead], np.diff(np.append(lead, len(one))))
    far = head != one
    return pa.table({"a": pa.array(fp[one[far]].view(np.int64)), "b": pa.array(fp[head[far]].view(np.int64))})


# 3. shards


def masks(points: int, shard: int = SHARD) -> list[int]:
    """The bits that a point's shards are named by, for a table of so many points: links agree on all bits of one mask at least."""
    wanted = max(0, math.ceil(math.log2(max(points, 1) / shard)))
    if not wanted:
        return [0]
    k = next((k for k in range(RADIUS + 1, 9) if (k - RADIUS) * (BITS // k) >= wanted), 8)
    edges = [BITS * i // k for i in range(k + 1)]
    out = []
    for chosen in combinations(range(k), k - RADIUS):
        bits = [b for i in chosen for b in range(edges[i], edges[i + 1])]
        # as many of each block as are wanted in all, spread over the chosen ones
        use = bits if len(bits) <= wanted else [bits[len(bits) * i // wanted] for i in range(wanted)]
        out.append(sum(1 << b for b in use))
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _routes(table: pa.Table) -> pa.Table:
    """Vantage points and median distances of a large shard, in heap order, from a sample of its points."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    fp = fp[np.argsort(W.mix(fp + W.U(1)))]
    depth = int(table.column("depth")[0].as_py())
    vantage, median = np.zeros((1 << depth) - 1, np.uint64), np.zeros((1 << depth) - 1, np.int32)
    parts = {0: fp}
    for at in range(len(vantage)):
        own = parts.pop(at)
        vantage[at] = own[0] if len(own) else fp[at % len(fp)]
        d = distance(own, vantage[at])
        median[at] = np.partition(d, len(d) // 2)[len(d) // 2] if len(d) else RADIUS
        parts[2 * at + 1], parts[2 * at + 2] = own[d <= median[at]], own[d > median[at]]
    keys = [table.column(c).slice(0, 1) for c in ("table", "key")]
    return pa.table([*keys, pa.array([vantage.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([median.tolist()], pa.list_(pa.int32()))], ["table", "key", "vantage", "median"])


def _leaves(fp: np.ndarray, vantage: np.ndarray, median: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the leaves that its ball reaches: places in fp, and leaves."""
    row, at = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    while len(at) and at[0] < len(vantage):  # all are on one level
        d = distance(fp[row], vantage[at])
        left, right = d - radius <= median[at], d + radius > median[at]
        row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    return row, at


def _routed(rows: DataFrame, routes: DataFrame, radius: int) -> DataFrame:
    """The rows (table, key, split, salt, fp, component) of large shards, in each leaf that a ball of `radius` reaches."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # without a sampled point the shard has one leaf
        vantage = np.array(right.column("vantage")[0].as_py() if right.num_rows else [], np.int64).view(np.uint64)
        median = np.array(right.column("median")[0].as_py() if right.num_rows else [], np.int32)
        row, leaf = _leaves(left.column("fp").to_numpy().view(np.uint64), vantage, median, radius)
        return left.select(["table", "key", "fp", "component"]).take(pa.array(row)).append_column("leaf", pa.array(leaf.astype(np.int32)))

    by = ["table", "key", "salt"]
    salts = rows.select(*by).distinct().join(routes, ["table", "key"]).toDF("_table", "_key", "_salt", "vantage", "median")
    return rows.groupBy(*by).cogroup(salts.groupBy("_table", "_key", "_salt")).applyInArrow(run, "table int, key long, fp long, component long, leaf int")


def _joined(rows: DataFrame) -> DataFrame:
    """Links of the rows (table, key, leaf, block, fp, component, home, asks), leaf by leaf."""
    return rows.groupBy("table", "key", "leaf", "block").applyInArrow(_stars, "a long, b long")


def components(points: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Rows (node, component) of all linked fingerprints in `points`, a stored table of distinct ones (column fp)."""
    each = [F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(points.count(), shard))]
    rows = points.select("fp", F.explode(F.array(*each)).alias("s")).select("s.*", "fp", F.col("fp").alias("component"))
    place = ["table", "key"]
    large = stored(rows.groupBy(*place).count().where(F.col("count") > block))
    whole = rows.join(large, place, "left_anti").withColumns({"leaf": F.lit(0), "block": F.lit(0), "home": F.lit(True), "asks": F.lit(True)})
    if large.isEmpty():
        links = stored(_joined(whole))
        out = connected(links)
        discard(large, links)
        return out
    depth = F.least(F.lit(int(math.log2(ROUTES))), F.ceil(F.log2(F.col("count") / F.lit(block))).cast("int"))
    hot = stored(rows.join(large.withColumn("depth", F.greatest(F.lit(1), depth)), place).withColumn("salt", F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / F.lit(4 * block))).cast("int")))
    sampled = hot.where(F.pmod(F.xxhash64("fp", "table"), F.col("count")) < F.lit(SAMPLE) * F.pow(F.lit(2), F.col("depth")))
    routes = stored(sampled.groupBy(*place).applyInArrow(_routes, "table int, key long, vantage array<long>, median array<int>"))
    homes = stored(_routed(hot, routes, 0))
    sizes = stored(homes.groupBy(*place, "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")))
    held = homes.join(sizes, [*place, "leaf"]).withColumns({"block": F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), "home": F.lit(True)}).drop("blocks")
    to_all = lambda df: df.join(sizes, [*place, "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"home": F.lit(False), "asks": F.lit(True)}).drop("blocks")
    first = routes.select(*place, F.explode(F.slice("vantage", 1, ASKING)).alias("fp")).distinct()
    seeds = to_all(first.withColumn("component", F.col("fp")).join(sizes.select(*place, "leaf"), place))
    cols = [*place, "leaf", "block", "fp", "component", "home", "asks"]
    every = whole.select(*cols).unionByName(held.withColumn("asks", F.lit(True)).select(*cols)).unionByName(seeds.select(*cols))
    links = stored(_joined(every))
    found = connected(links)
    # second round: in large shards all but the largest component ask in every leaf that their ball overlaps
    now = lambda df: df.drop("component").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    known = stored(now(hot))
    main = known.groupBy(*place, "component").count().groupBy(*place).agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("several"))
    strays = stored(known.join(main.where("several > 1"), place).where("component <> main").select("table", "key", "salt", "fp", "component"))
    visits = to_all(_routed(strays, routes, RADIUS))
    there = now(held).join(strays.select(*place).distinct(), place, "left_semi").withColumn("asks", F.lit(False))
    late = stored(_joined(there.select(*cols).unionByName(visits.select(*cols))))
    out = connected(links.unionByName(late))
    discard(large, hot, routes, homes, sizes, links, known, strays, late)
    return out


def classes(docs: DataFrame, key: str = "doc_id", fp: str = "fingerprint", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """`docs`, which have a fingerprint each, with component_id: the smallest key that links of fingerprints reach."""
    docs, (own, mark), back = masked(docs.drop("component_id"), key, fp)
    points = stored(docs.groupBy(F.col(mark).alias("fp")).agg(F.min(own).alias("least")))
    comps = components(points.select("fp"), shard, block)
    of = stored(points.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"), "least"))
    smallest = stored(of.groupBy("class").agg(F.min("least").alias("component_id")))
    known = stored(of.join(smallest, "class").select("fp", "component_id"))
    discard(points, of, smallest)
    return back(docs.join(known, docs[mark] == known["fp"], "left"), component_id="component_id")
