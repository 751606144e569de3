"""Vectors at scale: best matches, neighbours, threshold graphs, average-linkage and density clusters."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.functions import vectors as V
from kgloom.sources.shared import written

#: Rows of a block at most; a table of many rows is cut into ``MANY`` blocks at least, so that their pairs are work for many tasks.
BLOCK_ROWS, LEAST_ROWS, MANY = 16384, 512, 8
#: Scores that are held at once, and pairs that are given on at once.
TILE, GIVEN = 1 << 22, 1 << 16
#: Sums of products in another order differ by less.
SLACK = 1e-11

Block = tuple[pa.Array, np.ndarray]


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "clustering")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + V.EPSILON)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.array(column.tolist(), np.float64).reshape(len(column), -1))


def _pieces(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS), min(MANY, -(-rows // LEAST_ROWS)))


def blocks(vectors: DataFrame, key: str, n: int, *by: str) -> DataFrame:
    """Vectors packed into ``n`` blocks by a hash of their key (within each ``by``): ``block``, ``ids`` and the coordinates one behind the other."""
    rows = vectors.select(*by, F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), F.struct(F.col(key).cast("string").alias("id"), "embedding").alias("v"))
    return rows.groupBy(*by, "block").agg(F.collect_list("v").alias("vs")).select(*by, "block", F.col("vs.id").alias("ids"), F.flatten("vs.embedding").alias("flat"))


def met(left: DataFrame, right: DataFrame, cells: int, work: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on each two blocks of one ``cell`` (and whether they are the same one), in ``cells`` tasks; a task holds one pair at a time."""
    side = lambda df, s: df.select("cell", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "flat")]).repartition(cells, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(batch: pa.RecordBatch, s: str, k: int) -> Block:
            ids = batch.column(f"{s}_ids")[k].values
            return ids, _unit(batch.column(f"{s}_flat")[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))

        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("l_block")[k].as_py() == batch.column("r_block")[k].as_py()
                yield from work(block(batch, "l", k), block(batch, "r", k), same)

    return side(left, "l").join(side(right, "r"), "cell").drop("cell").mapInArrow(run, schema)


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of some rows of ``a`` with all of ``b`` at a time, and the first of these rows."""
    step = max(1, TILE // max(1, len(b)))
    for start in range(0, len(a), step):
        yield start, a[start : start + step] @ b.T


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], list(columns))


def best_of(left: Block, right: Block, top: int) -> Iterator[pa.RecordBatch]:
    """Each left row's ``top`` right rows by cosine (ties: the smaller id); like vectors have like scores wherever they stand."""
    (ids, a), (names, b) = left, right
    place = np.empty(len(b), np.int64)
    place[np.argsort(names.to_numpy(zero_copy_only=False).astype(str), kind="stable")] = np.arange(len(b))
    for start, scores in _tiles(a, b):
        cut = max(0, len(b) - top)
        least = np.partition(scores, cut, axis=1)[:, cut] - SLACK
        p, q = np.nonzero(scores >= least[:, None])
        del scores
        exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[start + p[i : i + GIVEN]], b[q[i : i + GIVEN]]) for i in range(0, len(p), GIVEN))])
        order = np.lexsort((place[q], -exact, p))
        p, q, exact = p[order], q[order], exact[order]
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        p, q, exact = p[rank < top], q[rank < top], exact[rank < top]
        yield _batch(id=ids.take(pa.array(start + p)), match=names.take(pa.array(q)), score=exact)


def neighbours(queries: DataFrame, items: DataFrame, top: int, key: str = "id", others: bool = False) -> DataFrame:
    """Each query's ``top`` items by cosine, ``id, match, score, rank``: all items for a stated set of queries, in blocks of matrix products.

    A task holds two blocks and a tile of their scores; per query only ``top`` rows a block go through the shuffle.
    With ``others``, an item is no neighbour of the query that has its id.
    """
    if others:
        rows = neighbours(queries, items, top + 1, key).where("id <> match")
        by = W.partitionBy("id").orderBy("rank")
        return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    m, n = _pieces(queries.count()), _pieces(items.count())
    left = blocks(queries, key, m).withColumn("cell", F.explode(F.sequence(F.col("block") * n, F.col("block") * n + n - 1)))
    right = blocks(items, key, n).withColumn("cell", F.explode(F.sequence("block", F.col("block") + (m - 1) * n, F.lit(n))))
    return ranked(met(left, right, m * n, lambda a, b, _: best_of(a, b, top), "id string, match string, score double"), top)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` best ``match`` of each ``id`` with their ranks (ties: the smaller id)."""
    best = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("by"), "match"))), 1, top).alias("best"))
    return best.select("id", F.posexplode("best").alias("rank", "b")).select("id", F.col("b.match").alias("match"), (-F.col("b.by")).alias("score"), (F.col("rank") + 1).alias("rank"))


def best_match(rows: DataFrame, types: DataFrame, within: list[str], key: str = "id") -> DataFrame:
    """``id, best_id, best_score`` of each row's closest type; with ``within``, among types that agree in these columns."""
    if within:
        right = types.select(*within, F.col(key).cast("string").alias("_t"), F.col("embedding").alias("_e"))
        scored = rows.join(right, within).select(key, "_t", V.cosine(F.col("embedding"), F.col("_e")).alias("_s"))
        return scored.groupBy(key).agg(F.max_by("_t", "_s").alias("best_id"), F.max("_s").alias("best_score"))
    return neighbours(rows, types, 1, key).select(F.col("id").cast(rows.schema[key].dataType).alias(key), F.col("match").alias("best_id"), F.col("score").alias("best_score"))


def _each_pair(vectors: DataFrame, key: str, work: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str, both: bool = False) -> DataFrame:
    """``work`` on each two blocks of a table once, or with ``both`` in either order."""
    n = _pieces(vectors.count())
    packed = blocks(vectors, key, n)
    left = packed.withColumn("cell", F.explode(F.sequence(F.col("block") * n + (F.lit(0) if both else F.col("block")), F.col("block") * n + n - 1)))
    right = packed.withColumn("cell", F.explode(F.sequence(F.col("block"), F.col("block") + (F.lit((n - 1) * n) if both else F.col("block") * n), F.lit(n))))
    return met(left, right, n * n if both else n * (n + 1) // 2, work, schema)


def close_pairs(vectors: DataFrame, least: float, key: str = "id") -> DataFrame:
    """Pairs ``a < b`` with a cosine above ``least``, block against block; only such pairs leave a task."""

    def work(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
        (x, a), (y, b) = left, right
        for start, scores in _tiles(a, b):
            p, q = np.nonzero(scores > least)
            found = scores[p, q]
            for i in range(0, len(p), GIVEN):
                u, v, s = x.take(pa.array(start + p[i : i + GIVEN])), y.take(pa.array(q[i : i + GIVEN])), found[i : i + GIVEN]
                keep = pc.less(u, v) if same else pc.not_equal(u, v)
                yield _batch(a=pc.min_element_wise(u, v), b=pc.max_element_wise(u, v), score=s).filter(keep)

    return _each_pair(vectors, key, work, "a string, b string, score double")


def likely_pairs(vectors: DataFrame, least: float, key: str = "id", tables: int = 8, width: float = 1.0, seed: int = 7) -> DataFrame:
    """Most of the pairs of ``close_pairs``, without meeting all: random projections hash unit vectors, only vectors that share a bucket are compared.

    More ``tables`` find more, a smaller ``width`` compares fewer; every pair that is given is exact.
    """
    unit = vectors.select(F.col(key).cast("string").alias("id"), array_to_vector(V.normalised(F.col("embedding"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(unit)
    far = (2 * (1 - least)) ** 0.5
    pairs = model.approxSimilarityJoin(unit, unit, far, "d").select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), (1 - F.col("d") * F.col("d") / 2).alias("score"))
    return pairs.where("a < b")


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of nodes with links ``a, b``; labels spread and jump until none changes."""
    both = _kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        new = _kept(new.join(jump, F.col("mid") == F.col("to"), "left").select("node", F.least("mid", "jump").alias("component"), "old"))
        labels = new.select("node", "component")
        if not new.where("component <> old").limit(1).count():
            return labels


def _nearest(rows: np.ndarray, means: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best other cluster of some clusters and the mean cosine of the two."""
    others, where = means[alive], np.full(len(means), -1)
    where[alive] = np.arange(len(alive))
    best, partner = np.empty(len(rows)), np.empty(len(rows), np.int64)
    for start, scores in _tiles(means[rows], others):
        n = np.arange(len(scores))
        scores[n, where[rows[start : start + len(n)]]] = -np.inf
        at = scores.argmax(axis=1)
        best[start : start + len(n)], partner[start : start + len(n)] = scores[n, at], alive[at]
    return best, partner


def _chained(means: np.ndarray, size: np.ndarray, alive: np.ndarray, least: float, parent: np.ndarray) -> None:
    """Merges what is left along chains of nearest clusters, one cluster against all at a time."""
    held, m, n = alive.copy(), means[alive], size[alive]
    open_ = np.zeros(len(held))
    chain: list[int] = []
    while True:
        if not chain:
            left = np.flatnonzero(open_ == 0)
            if len(left) < 2:
                return
            if 2 * len(left) < len(held):
                held, m, n, open_, left = held[left], m[left], n[left], np.zeros(len(left)), np.arange(len(left))
            chain.append(int(left[0]))
        x = chain[-1]
        scores = m @ m[x] + open_
        scores[x] = -np.inf
        y = int(scores.argmax())
        if len(chain) > 1 and scores[chain[-2]] >= scores[y] - SLACK:
            y = chain[-2]
        if not scores[y] > least:
            open_[x] = -np.inf
            chain.pop()
        elif len(chain) > 1 and y == chain[-2]:
            del chain[-2:]
            i, j = min(x, y), max(x, y)
            m[i], n[i] = (m[i] * n[i] + m[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
            open_[j] = -np.inf
            parent[held[j]] = held[i]
        else:
            chain.append(y)


def average_linkage(vectors: np.ndarray, distance: float) -> np.ndarray:
    """Labels of clusters that average linkage by cosine distance leaves below a cut; 0 is the first row's.

    The mean cosine of two clusters is the product of the means of their unit vectors, so memory follows the number of
    vectors, not its square.  A merge never brings two clusters nearer to a third than the nearer of them was:
    all pairs that are each other's nearest are merged at once, and a cluster whose nearest is beyond the cut is done.
    Where only few pairs are (many clusters around one), the rest goes along chains.
    """
    unit = _unit(np.asarray(vectors, np.float64).reshape(len(vectors), -1))
    n, least = len(unit), 1 - distance
    parent, means, size = np.arange(n), unit.copy(), np.ones(n)
    _, first, same = np.unique(unit, axis=0, return_index=True, return_inverse=True)
    parent = np.where(np.einsum("ij,ij->i", unit, unit) > least, first[same.reshape(-1)], parent)
    alive = np.flatnonzero(parent == np.arange(n))
    size[alive] = np.bincount(parent, minlength=n)[alive]
    best, partner, asked = np.full(n, -np.inf), np.full(n, -1), alive
    while len(alive) > 1:
        best[asked], partner[asked] = _nearest(asked, means, alive)
        alive = alive[best[alive] > least]
        if len(alive) < 2:
            break
        there = np.zeros(n, bool)
        there[alive] = True
        i = alive[(partner[partner[alive]] == alive) & (alive < partner[alive]) & there[partner[alive]]]
        j = partner[i]
        if not len(i):
            x = alive[best[alive].argmax()]
            i, j = np.sort([[x], [partner[x]]], axis=0)
        means[i] = (means[i] * size[i, None] + means[j] * size[j, None]) / (size[i] + size[j])[:, None]
        size[i] += size[j]
        parent[j] = i
        there[j] = False
        alive = alive[there[alive]]
        changed = np.zeros(n, bool)
        changed[i], changed[j] = True, True
        asked = alive[changed[alive] | changed[partner[alive]]]
        if len(asked) > 15 * len(i) and len(alive) > 64:
            _chained(means, size, alive, least, parent)
            break
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return np.unique(parent, return_inverse=True)[1]


class ClusteringStrategy(ABC):
    """Assigns ``cluster`` to vectors ``id, embedding``."""

    @abstractmethod
    def fit(self, vectors: DataFrame) -> DataFrame: ...


class Agglomerative(ClusteringStrategy):
    """Average linkage, cosine, cut at a distance.

    A merge below the cut needs a pair below the cut, so clusters stay within the components of the graph of
    such pairs; each component is clustered whole by one task, so the cut must be small enough for components
    to fit one.
    """

    def __init__(self, distance: float = 0.25):
        self.distance = distance

    def fit(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("id").cast("string").alias("id"), "embedding")
        found = connected(close_pairs(rows, 1 - self.distance).select("a", "b"))
        rows = rows.join(found.withColumnRenamed("node", "id"), "id", "left")
        distance = self.distance

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            label = average_linkage(np.array(pdf["embedding"].tolist(), np.float64), distance)
            first = pdf.groupby(label)["id"].transform("min")
            return pd.DataFrame({"id": pdf["id"], "cluster": first})

        alone = rows.where(F.col("component").isNull()).select("id", F.col("id").alias("cluster"))
        return rows.where(F.col("component").isNotNull()).groupBy("component").applyInPandas(run, "id string, cluster string").unionByName(alone)


class Density(ClusteringStrategy):
    """Density clusters over the graph of pairs within a distance: core points have ``least`` neighbours; noise goes to the nearest centroid or, if asked, is dropped (``-1`` never stays)."""

    def __init__(self, distance: float = 0.5, least: int = 3, drop_noise: bool = False, size: int = 64):
        self.distance, self.least, self.drop_noise, self.size = distance, least, drop_noise, size

    def fit(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("id").cast("string").alias("id"), "embedding")
        pairs = _kept(close_pairs(rows, 1 - self.distance).select("a", "b"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        core = _kept(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= self.least).select(F.col("a").alias("core")))
        inner = pairs.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
        found = connected(inner).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
        alone = core.select(F.col("core").alias("id")).join(found, "id", "left_anti").withColumn("cluster", F.col("id"))
        cores = _kept(found.unionByName(alone))
        border = both.join(cores, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "cluster").join(cores.select("id"), "id", "left_anti").groupBy("id").agg(F.min("cluster").alias("cluster"))
        placed = _kept(cores.unionByName(border))
        if self.drop_noise:
            return placed
        noise = rows.join(placed, "id", "left_anti")
        if not placed.limit(1).count():
            return noise.select("id", F.lit("0").alias("cluster"))
        centres = centroids(rows.join(placed, "id"), "cluster", self.size).select(F.col("cluster").alias("id"), "embedding")
        nearest = best_match(noise, centres, []).select("id", F.col("best_id").alias("cluster"))
        return placed.unionByName(nearest)


STRATEGIES = {"agglomerative": Agglomerative, "density": Density}


def clustering_strategy(name: str, **options) -> ClusteringStrategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown clustering strategy {name!r}")
    return STRATEGIES[name](**options)


def centroids(vectors: DataFrame, by: str, size: int) -> DataFrame:
    """Mean vector of each group, as sums merged map-side."""
    return vectors.groupBy(by).agg(V.mean_of(F.col("embedding"), size).alias("embedding"))


def members(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("members"))


class Embedder:
    """Deterministic offline embeddings: signed hashed character n-grams, as a column expression factory."""

    def __init__(self, size: int = 64, n: int = 3):
        self.size, self.n = size, n

    def __call__(self, text: Column) -> Column:
        size, n = self.size, self.n

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            def one(t: str | None) -> list[float]:
                v = np.zeros(size)
                data = f" {t or ''} ".lower().encode()
                for i in range(len(data) - n + 1):
                    h = zlib.crc32(data[i : i + n])
                    v[h % size] += 1 if h >> 31 else -1
                return (v / (np.linalg.norm(v) + V.EPSILON)).tolist()

            return texts.map(one)

        return embed(text)
