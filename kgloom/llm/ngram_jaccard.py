"""N-gram Jaccard self-join with count-vector R-trees.

A document is the set of its distinct word shingles.  Shingles are hashed into groups; the counts per
group are a point, and the sum of the smaller coordinates of two points bounds the overlap of their
sets.  Points are indexed in R-trees; what the bound leaves is verified on the sets themselves.

Equal sets are one node from the start, found by a 64-bit signature and not by pairs; a document's id is
looked up again only when the components are known, so documents that share an id, or have none, are
kept apart.

No tree can hold a whole corpus, so nodes are first dealt to buckets without losing a link.  Two
different sets that link differ in at most T shingles, T following from their sizes, so that of K = T + 1 + s
groups at least 1 + s hold the same shingles in both.  A set is therefore filed under the content
of each of its groups, for its own class of sizes and for the border to the next; the slack s makes it
safe to leave empty groups out, and half as many of the smallest as are then still to spare (sets with more
than s empty groups file those too).  Sets so small that they can only link to equal ones are not filed.
Buckets with the same members count once.

Trees over the points of each bucket's members give the pairs that the bound leaves, of which only a
spanning forest goes on; the components of these forests are the clusters that links stay within.  A
cluster's sets then meet in trees again and are verified; again only a forest of links goes on.

Both steps work on units of bounded size.  A bucket or cluster of more than ``BLOCK`` members is cut into
blocks, and each block also gets the group's ``PIVOTS`` pivots, which tie the blocks of near copies
together.  Where more than one component is left in such a group, its members outside the largest
component meet all blocks; members of one component are never compared.  A group of near copies so costs
rows in proportion to its size.

Components are found by spreading smallest names along links with pointer jumping; every round is a table
in the shared folder.

Cases: null and empty texts, and texts without words, have no shingles and are components of their own;
texts with fewer words than a shingle have one, the whole sequence; very long texts are whole, and blocks
get fewer members where sets are large; rows that repeat are equal sets; rows without doc_id take part,
and a component's id is the smallest doc_id that is not null (null if there is none); an empty table gives
an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.arrow_batches import slices
from kgloom.llm.storage import discard, written

NO_ID = 2**63 - 1
#: Members of a block, shingles of a block (8 bytes each), and about how many pivots a large group has.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
PIVOTS = 16
#: Signatures that a filing task remembers, so as not to file copies again; it saves work only.
SEEN = 50_000
#: Rows of crossed blocks up to which the names of their sets are broadcast, so that other sets stay where they are.
BROADCAST_ROWS = 200_000
SLICE = 4_000_000
LEAF = 16
AXES = (64, 1024)

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Join:
    """Words per shingle and the similarity ``num / den`` that links."""

    words: int = 4
    num: int = 85
    den: int = 100

    def apart(self, total: int) -> int:
        """Shingles in which linked sets of together ``total`` differ at most."""
        return total * (self.den - self.num) // (self.den + self.num)

    def need(self, total):
        """Overlap that sets of together ``total`` need at least."""
        return -(-self.num * total // (self.den + self.num))

    def bounds(self) -> np.ndarray:
        return _bounds(self.num, self.den)

    def least(self) -> int:
        """The smallest size of a set that can link to a different one: i / (i + 1) must reach the similarity."""
        return -(-self.num // (self.den - self.num)) if self.den > self.num else 2**62


@lru_cache(maxsize=4)
def _bounds(num: int, den: int) -> np.ndarray:
    """Upper ends of the classes of sizes; a link joins one class to itself or the next."""
    ratio, ends = max(2**0.5, 1.01 * den / num), [8]
    while ends[-1] < 2**40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * ratio)))
    return np.array(ends, np.int64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = x + _SALTS[salt]
    x = (x ^ (x >> np.uint64(30))) * _SALTS[0]
    x = (x ^ (x >> np.uint64(27))) * _SALTS[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> np.ndarray:
    out = np.full(size, _ODD)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").translate(_LOWER), np.uint8)
    inside = ~_SPACE[data]
    if not inside.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    longest = int(size.max())
    power = _powers(1 << max(8, (longest - 1).bit_length()))
    word = mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(size) - size) + size.astype(np.uint64))
    n = max(1, len(word) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(word))):
        total = total * _ODD + word[k : k + n]
    return np.unique(mix(total, 1))


def signature(found: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number: the mixed sum of its mixed hashes."""
    with np.errstate(over="ignore"):
        total = mix(np.array([mix(found, 1).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64), 2)
    return int(total.view(np.int64)[0])


def levels(n: int, join: Join) -> list[tuple[int, int]]:
    """Number and largest difference of each level that a set of ``n`` shingles is filed on."""
    if n < join.least():
        return []
    ends = join.bounds()
    j = int(np.searchsorted(ends, n))
    top = int(ends[j])
    out = [(2 * j, join.apart(2 * top))]
    over = lambda end: join.apart(end + join.den * end // join.num)
    if join.den * n >= join.num * (top + 1):
        out.append((2 * j + 1, over(top)))
    if j and join.num * n <= join.den * int(ends[j - 1]):
        out.append((2 * j - 1, over(int(ends[j - 1]))))
    return [x for x in out if x[1] > 0]


def file_keys(found: np.ndarray, join: Join) -> np.ndarray:
    """The buckets of a set."""
    keys = []
    for level, apart in levels(len(found), join):
        slack = 4 + apart // 24
        groups = apart + 1 + slack
        group = ((found >> np.uint64(17)) % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0])
        content = np.add.reduceat(mix(found[by], 2), first)
        which = group[by][first]
        spare = slack - (groups - len(which))
        if spare < 0:
            empty = np.setdiff1d(np.arange(groups), which)
            which, content = np.r_[which, empty], np.r_[content, np.zeros(len(empty), np.uint64)]
        elif spare > 1:
            kept = np.sort(np.argsort(np.diff(np.r_[first, len(found)]), kind="stable")[spare // 2 :])
            which, content = which[kept], content[kept]
        keys.append(mix(content + which.astype(np.uint64) * _ODD + np.array([level], np.uint64) * _SALTS[2], 0))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


class RTree:
    """A packed R-tree over count vectors; boxes keep the largest coordinates and the smallest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, join: Join):
        self.join, self.points, self.sizes = join, points, sizes
        spread = np.argsort(-points.var(axis=0))[:2] if len(points) else [0, 0]
        self.order = np.lexsort((points[:, spread[-1]], points[:, spread[0]], sizes))
        high, low = points[self.order], sizes[self.order]
        self.tiers = []
        while len(high) > LEAF or not self.tiers:
            cut = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low, cut)
            self.tiers.append((high, low))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Members whose sets may overlap enough with that of ``point``."""
        nodes = np.arange(len(self.tiers[-1][0]))
        for tier in range(len(self.tiers) - 1, -1, -1):
            high, low = self.tiers[tier]
            fits = np.minimum(high[nodes], point).sum(axis=1) >= self.join.need(low[nodes] + size)
            nodes = nodes[fits]
            below = len(self.tiers[tier - 1][0]) if tier else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        found = self.order[nodes]
        return found[np.minimum(self.points[found], point).sum(axis=1) >= self.join.need(self.sizes[found] + size)]


def point_of(found: np.ndarray, join: Join) -> np.ndarray:
    """Counts per group; the number of groups is a power of two that follows the class of sizes."""
    ends = join.bounds()
    wide = int(ends[np.searchsorted(ends, len(found))]) // 2
    axes = 1 << int(np.clip(wide - 1, AXES[0] - 1, AXES[1] - 1)).bit_length()
    return np.bincount((found >> np.uint64(40)).astype(np.int64) % axes, minlength=axes)


def packed_point(found: np.ndarray, join: Join) -> bytes:
    point = point_of(found, join)
    return point.astype(np.uint8).tobytes() + b"1" if point.max(initial=0) < 256 else point.astype(np.uint32).tobytes() + b"4"


def unpacked_points(packed: list[bytes]) -> np.ndarray:
    """Points over the fewest groups of any of them; folding a point adds the counts of groups that fall together."""
    points = [np.frombuffer(p[:-1], np.uint8 if p[-1:] == b"1" else np.uint32) for p in packed]
    axes = min(map(len, points))
    return np.array([p.reshape(-1, axes).sum(axis=0) for p in points], np.int32)


def forest(points: np.ndarray, sets: list[np.ndarray] | None, second: np.ndarray | None, joined: np.ndarray, join: Join) -> list[tuple[int, int]]:
    """Pairs that connect what is connected: by links between ``sets``, or, without sets, by what the bound leaves of the points.

    Members with the same number in ``joined`` are connected already.  With ``second``, only pairs of a
    member where it is false and one where it is true count.
    """
    if len(points) < 2:
        return []
    sizes = points.sum(axis=1, dtype=np.int64)
    root = np.unique(joined, return_inverse=True)[1]
    inner = np.arange(len(points)) if second is None else np.flatnonzero(second)
    asking = range(len(points)) if second is None else np.flatnonzero(~second)
    if not len(inner):
        return []
    tree = RTree(points[inner], sizes[inner], join)
    links = []
    for u in asking:
        near = inner[tree.search(points[u], int(sizes[u]))]
        while len(near := near[root[near] != root[u]]):
            v = int(near[0])
            both = None if sets is None else len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if both is None or join.den * both >= join.num * (sizes[u] + sizes[v] - both):
                links.append((int(u), v))
                root[root == root[v]] = root[u]
            near = near[1:]
    return links


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text")


def _signed(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        n, node = [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text, join.words)
            n.append(len(found))
            node.append(signature(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["id", "text_hash", "n", "node"])


def _filed(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in _parts(batches):
        keys, owners = [], []
        for text in batch.column(0).to_pylist():
            found = shingles(text, join.words)
            node = signature(found)
            if node not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                keys.append(file_keys(found, join))
                owners.append(np.full(len(keys[-1]), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = [shingles(t, join.words) for t in batch.column(0).to_pylist()]
        arrays = [pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([packed_point(s, join) for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "grams", "point"])


def stars(pairs: list[tuple[int, int]], names: list) -> list[tuple]:
    """The pairs' components as pairs of a member's name and the smallest; other units that connect the same members give the same pairs."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in pairs:
        a, b = top(u), top(v)
        if a != b:
            low, high = (a, b) if names[a] <= names[b] else (b, a)
            root[high] = low
    return [(names[x], names[top(x)]) for x in list(root) if names[x] != names[top(x)]]


def _pairs_of(rows: list[tuple], column: str, crossed: bool, join: Join) -> list[tuple[int, int]]:
    """Stars of the pairs that one unit gives: of points what the bound leaves, of sets the links."""
    nodes, second, labels, data = zip(*rows)
    if column == "point":
        points, sets = unpacked_points(list(data)), None
    else:
        sets = [np.frombuffer(g, np.uint64) for g in data]
        points = unpacked_points([packed_point(s, join) for s in sets])
    return stars(forest(points, sets, np.array(second) if crossed else None, np.array(labels), join), nodes)


def _by_unit(batches: Iterator[pa.RecordBatch], column: str, crossed: bool, join: Join) -> Iterator[pa.RecordBatch]:
    """The pairs of each unit; the rows of a unit follow each other."""
    unit, rows = None, []
    for whole in batches:
        for batch in slices(whole, "data", SLICE):
            out = []
            for *at, node, second, label, data in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "second", "label", "data")]):
                if at != unit:
                    if unit is not None:
                        out += _pairs_of(rows, column, crossed, join)
                    unit, rows = at, []
                rows.append((node, second, label, data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
    if unit is not None and (out := _pairs_of(rows, column, crossed, join)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def _worked(rows: DataFrame, data: DataFrame, column: str, crossed: bool, join: Join) -> DataFrame:
    """Pairs of units, rows of ``key, i, j, node, second, label``, with the members' data."""
    if crossed and rows.count() <= BROADCAST_ROWS:
        data = data.join(F.broadcast(rows.select(F.col("node").alias("_wanted")).distinct()), F.col("node") == F.col("_wanted"), "left_semi")
    joined = rows.join(data.select(F.col("node").alias("_node"), F.col(column).alias("data")).hint("shuffle_merge"), F.col("node") == F.col("_node"))
    joined = joined.select("key", "i", "j", "node", "second", "label", "data").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second")
    return joined.mapInArrow(lambda it: _by_unit(it, column, crossed, join), "a long, b long").distinct()


def own_blocks(members: DataFrame) -> DataFrame:
    """Members (``key, node, m, blocks``) dealt to their block; pivots are in all blocks."""
    place = F.xxhash64("node", "key")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.shiftrightunsigned(place, 20), F.col("m")) < PIVOTS)
    own = F.pmod(place, F.col("blocks"))
    rows = members.select("key", "node", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))).alias("i"))
    return rows.select("key", "i", F.lit(0).cast("long").alias("j"), "node", F.lit(False).alias("second"), F.col("node").alias("label"))


def cross_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of large groups in which more than one component is left, those outside the largest against all."""
    named = labels.select(F.col("node").alias("_node"), "component").hint("shuffle_merge")
    rows = members.where("blocks > 1").join(named, F.col("node") == F.col("_node"), "left").select("key", "node", "m", "blocks", F.coalesce("component", "node").alias("label"))
    rows = written(rows, "jaccard-large")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("parts"))
    sizes = sizes.where("parts > 1").select(F.col("key").alias("_key"), F.col("top.label").alias("main"), (F.col("all") - F.col("top.c")).alias("rest"))
    rows = rows.join(sizes.hint("shuffle_merge"), F.col("key") == F.col("_key"))
    place = F.xxhash64("key", "node")
    few = F.ceil(F.col("rest") * F.col("blocks") / F.col("m")).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    whole = rows.select("key", each(few).alias("i"), F.pmod(place, F.col("blocks")).alias("j"), "node", F.lit(True).alias("second"), "label")
    rest = rows.where("label <> main").select("key", F.pmod(place, few).alias("i"), each(F.col("blocks")).alias("j"), "node", F.lit(False).alias("second"), "label")
    return whole.unionByName(rest)


def connected(members: DataFrame, data: DataFrame, column: str, join: Join) -> DataFrame:
    """``node, component`` by the pairs inside groups; ``members`` (``key, node, m, blocks``) and ``data`` are written tables."""
    pairs = written(_worked(own_blocks(members), data, column, False, join), "jaccard-pairs")
    found = components(pairs)
    if members.where("blocks > 1").limit(1).count():
        rows = written(cross_blocks(members, found), "jaccard-cross")
        if rows.limit(1).count():
            more = written(_worked(rows, data, column, True, join), "jaccard-crossed")
            if more.limit(1).count():
                found = components(pairs.unionByName(more))
    return found


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links to ``node, component``: the smallest node reachable from each node that has a link."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("node"), F.least("a", "_least").alias("component")), "jaccard-labels")
    while True:
        near = both.join(labels.hint("shuffle_merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        new = labels.join(near.hint("shuffle_merge"), F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_mid"))
        jumped = labels.select(F.col("node").alias("_to"), F.col("component").alias("_jump"))
        new = new.join(jumped.hint("shuffle_merge"), F.col("_mid") == F.col("_to"), "left")
        new = written(new.select("node", F.least("_mid", "_jump").alias("component"), "_old"), "jaccard-labels")
        changed = new.where("component <> _old").limit(1).count()
        discard(labels)
        labels = new.select("node", "component")
        labels._written_to = new._written_to
        if not changed:
            discard(both)
            return labels


def links_of(docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """``node, component`` of the sets that link to different ones; ``docs`` has ``id, text_hash, text``, ``classes`` ``node, id, text_hash`` of one row of each set."""
    rows = docs.select("text").mapInArrow(lambda it: _filed(it, join), "key long, node long")
    same = W.partitionBy("key")
    low, high = F.xxhash64("node").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.xxhash64("node"), 32)
    rows = rows.select("key", "node", F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi"), F.count("*").over(same).alias("m"), F.sum(low).over(same).alias("x"), F.sum(high).over(same).alias("y"))
    first = lambda c: F.when(F.col("node") == F.col("lo"), F.col(c)).alias(c)
    shared = rows.where("lo <> hi").select("key", "node", "m", first("lo"), first("hi"), first("x"), first("y"))
    shared = written(shared.dropDuplicates(["key", "node"]), "jaccard-buckets")
    chosen = written(shared.where("lo IS NOT NULL").groupBy("x", "y", "m", "lo", "hi").agg(F.min("key").alias("_key")).select("_key"), "jaccard-chosen")
    blocks = F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")
    members = written(shared.join(chosen.hint("shuffle_merge"), F.col("key") == F.col("_key"), "left_semi").select("key", "node", "m", blocks), "jaccard-members")
    discard(shared, chosen)
    wanted = members.select(F.col("node").alias("_node")).distinct().hint("shuffle_merge")
    wanted = classes.join(wanted, F.col("node") == F.col("_node"), "left_semi").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    data = docs.join(wanted.hint("shuffle_merge"), (F.col("id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    data = written(data.select("text").mapInArrow(lambda it: _sets(it, join), "node long, n long, grams binary, point binary"), "jaccard-sets")
    clusters = connected(members, data, "point", join)
    discard(members)
    sized = clusters.join(data.select(F.col("node").alias("_node"), "n").hint("shuffle_merge"), F.col("node") == F.col("_node")).groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("_n"))
    # Written, as a join of two exchanges is split where a cluster is large.
    sized = written(sized.select(F.col("component").alias("key"), "m", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("_n") / BLOCK_SHINGLES)).cast("long").alias("blocks")), "jaccard-sizes")
    members = written(clusters.join(sized.hint("shuffle_merge"), F.col("component") == F.col("key")).select("key", "node", "m", "blocks"), "jaccard-clusters")
    discard(clusters)
    found = connected(members, data, "grams", join)
    discard(data, members)
    return found


def similar_groups(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, component, component_id`` of every row.

    Rows with the same ``node`` have equal sets, a ``component`` is connected by links (both null without
    shingles), and ``component_id`` is the smallest doc_id in it.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    hashed = rows.select("id", "text", F.xxhash64("text").alias("text_hash"))
    signed = written(hashed.mapInArrow(lambda it: _signed(it, join), "id long, text_hash long, n long, node long"), "jaccard-signed")
    classes = written(signed.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("_first")).select("node", "_first.*"), "jaccard-classes")
    found = links_of(hashed, classes, join)
    named = classes.join(found.select(F.col("node").alias("_node"), "component").hint("shuffle_merge"), F.col("node") == F.col("_node"))
    named = written(named.groupBy("component").agg(F.min("id").alias("component_id")).select(F.col("component").alias("_component"), "component_id"), "jaccard-names")
    named = found.join(named.hint("shuffle_merge"), F.col("component") == F.col("_component")).select(F.col("node").alias("_node"), "component", "component_id")
    merged = classes.join(named.hint("shuffle_merge"), F.col("node") == F.col("_node"), "left")
    merged = written(merged.select(F.col("node").alias("_node"), F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "id").alias("component_id")), "jaccard-merged")
    out = signed.join(merged.hint("shuffle_merge"), (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    shown = lambda c: F.when(c != NO_ID, c)
    some = F.col("n") > 0
    return out.select(shown(F.col("id")).alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), F.when(some, F.col("node")).alias("node"), "component", shown(F.when(some, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (none counts as the largest), of those the smallest text hash.

    Rows without shingles are components of their own; of rows that repeat in doc_id and text one stays.
    """
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("_k")
    found = similar_groups(docs, join, doc_id, text).select(key("doc_id"), F.col("text_hash").alias("_h"), "component")
    kept = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("_k", "_h")).alias("_first")).select("_first.*")
    kept = written(kept.unionByName(found.where(F.col("component").isNull()).select("_k", "_h").distinct()), "jaccard-kept")
    rows = docs.select(key(doc_id), F.xxhash64(F.col(text).cast("string")).alias("_h"), F.struct(*docs.columns).alias("_row"))
    rows = rows.join(kept.hint("shuffle_merge"), ["_k", "_h"], "left_semi")
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy("_k", "_h").orderBy("_k", "_h"))).where("_at = 1")
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
