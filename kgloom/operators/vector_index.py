"""An index over vectors: lists around centres, of which a search looks at the closest few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import vectors as V
from kgloom.operators import clustering
from kgloom.operators.clustering import _matrix

#: Vectors that the centres are fitted on, those with the smallest hashes of their ids; all vectors are indexed.
SAMPLE = 5000
ROUNDS = 8


def centres_of(vectors: DataFrame, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centres by spherical k-means on the sample."""
    rows = vectors.select(F.xxhash64("id").alias("h"), "embedding").orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    m = _matrix(pd.Series([r["embedding"] for r in rows]))
    centres = m[np.random.default_rng(seed).permutation(len(m))[: min(lists, len(m))]]
    for _ in range(ROUNDS):
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / (size + V.EPSILON), centres)
    return centres


def _closest(vectors: DataFrame, centres: np.ndarray, n: int, name: str) -> DataFrame:
    """A row for each of the ``n`` closest lists of a vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.argsort(-(_matrix(batch["embedding"]) @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                yield batch.assign(**{name: list(near)})

    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, f"id string, embedding array<double>, {name} array<int>").withColumn(name, F.explode(name))


def index(vectors: DataFrame, lists: int = 32) -> tuple[DataFrame, np.ndarray]:
    """Every vector in the list of its closest centre, and the centres."""
    centres = centres_of(vectors, lists)
    return _closest(vectors, centres, 1, "list") if len(centres) else vectors.select(F.col("id").cast("string").alias("id"), "embedding", F.lit(0).alias("list")), centres


def search(queries: DataFrame, indexed: tuple[DataFrame, np.ndarray], top: int, probes: int = 8) -> DataFrame:
    """``id, match, score, rank`` of each query's ``top`` vectors among its ``probes`` closest lists.

    More probes find more; as many as there are lists find all.  Queries meet lists block by block in matrix products,
    and only ``top`` rows of a query and block go through the shuffle.
    """
    held, centres = indexed
    probes = max(1, min(probes, len(centres)))
    asked = _closest(queries, centres, probes, "list") if len(centres) else queries.select(F.col("id").cast("string").alias("id"), "embedding", F.lit(0).alias("list"))
    lists = max(1, len(centres))
    m, n = (clustering._pieces(df.groupBy("list").count().agg(F.max("count")).first()[0] or 0) for df in (asked, held))
    first = (F.col("list") * m + F.col("block")) * n
    left = clustering.blocks(asked, "id", m, "list").withColumn("cell", F.explode(F.sequence(first, first + n - 1)))
    first = F.col("list") * m * n + F.col("block")
    right = clustering.blocks(held, "id", n, "list").withColumn("cell", F.explode(F.sequence(first, first + (m - 1) * n, F.lit(n))))
    found = clustering.met(left, right, lists * m * n, lambda x, y, _: clustering.best_of(x, y, top), "id string, match string, score double")
    return clustering.ranked(found, top)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """The share of the ``true`` neighbours that were found."""
    hit = found.select("id", "match").withColumn("hit", F.lit(1))
    return true.select("id", "match").join(hit, ["id", "match"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
