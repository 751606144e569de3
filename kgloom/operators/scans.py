"""Scans over a finished graph: motifs of types, their similarity and spread, split and merge rules, redundancy of sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import vectors as V
from kgloom.operators import clustering


def motifs(fillers: DataFrame, relations: DataFrame) -> DataFrame:
    """``type, motif, n``: how often relations of a type fill a role with a label."""
    rows = fillers.join(relations.select("relation_id", F.col("label").alias("type")), "relation_id")
    return rows.groupBy("type", F.concat("role", F.lit(">"), rows["label"]).alias("motif")).agg(F.count("*").alias("n"))


def motif_weights(counts: DataFrame) -> DataFrame:
    """Term frequency times ln(1 + types / types with the motif)."""
    totals = counts.groupBy("type").agg(F.sum("n").alias("total"))
    spread = counts.groupBy("motif").agg(F.count("*").alias("df"))
    n_types = totals.agg(F.count("*").alias("n_types"))
    rows = counts.join(totals, "type").join(spread, "motif").join(F.broadcast(n_types))
    return rows.select("type", "motif", (F.col("n") / F.col("total") * F.ln(1 + F.col("n_types") / F.col("df"))).alias("weight"))


def similar_types(weights: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs of types that share a motif, with the cosine of their weights; types without a common motif never meet."""
    norms = weights.groupBy("type").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a = weights.join(norms, "type").select(F.col("type").alias("a"), "motif", (F.col("weight") / F.col("norm")).alias("x"))
    b = a.select(F.col("a").alias("b"), "motif", F.col("x").alias("y"))
    pairs = a.join(b, "motif").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return pairs.where(F.col("cosine") >= threshold)


def jaccard_of(a: Column, b: Column) -> Column:
    """Similarity of two sets as arrays; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dispersion(vectors: DataFrame, by: str, size: int) -> DataFrame:
    """Per type its members and mean squared distance to its centroid, by moments that merge map-side."""
    unit = V.normalised(F.col("embedding"))
    sums = vectors.select(by, unit.alias("u")).groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.get("u", i)).alias(f"m{i}") for i in range(size)])
    centre = sum((F.col(f"m{i}") * F.col(f"m{i}") for i in range(1, size)), F.col("m0") * F.col("m0"))
    return sums.select(by, "n", F.greatest(F.lit(0.0), 1 - centre).alias("dispersion"))


def routed(spread: Column, silhouette: Column, wide: float = 0.5, clear: float = 0.3) -> Column:
    """What to do with a type: split where it is wide and falls apart clearly, watch where only one holds, else keep."""
    return F.when((spread >= wide) & (silhouette >= clear), "split").when((spread >= wide) | (silhouette >= clear), "watch").otherwise("keep")


def silhouette(vectors: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by cosine distance; a cluster of one scores 0."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + V.EPSILON)
    k = label.max() + 1
    if k < 2:
        return 0.0
    sums = np.zeros((k, unit.shape[1]))
    np.add.at(sums, label, unit)
    size = np.bincount(label, minlength=k).astype(float)
    total, step = 0.0, max(1, clustering.TILE // k)
    for start in range(0, len(unit), step):
        at = label[start : start + step]
        n, own = np.arange(len(at)), size[at]
        to = size[None, :] - unit[start : start + step] @ sums.T
        inner = to[n, at] / np.maximum(own - 1, 1)
        to /= size[None, :]
        to[n, at] = np.inf
        outer = to.min(axis=1)
        total += np.where(own > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), V.EPSILON), 0.0).sum()
    return float(total / len(unit))


def type_splits(vectors: DataFrame, by: str, distance: float = 0.5, least_silhouette: float = 0.3, least_share: float = 0.10) -> DataFrame:
    """Types whose relations fall into clear clusters: silhouette, number of clusters and whether to split.

    All members of a type are clustered, exactly and by one task, whose memory grows with their number.
    """
    rows = vectors.select(F.col(by).cast("string").alias(by), F.col("id").cast("string").alias("id"), "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.array(pdf["embedding"].tolist(), np.float64)
        label = clustering.average_linkage(m, distance)
        sizes = np.bincount(label)
        kept = int((sizes >= least_share * len(m)).sum())
        s = silhouette(m, label)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(m)], "n_clusters": [kept], "silhouette": [s], "is_split": [bool(kept >= 2 and s >= least_silhouette)]})

    return rows.groupBy(by).applyInPandas(run, f"{by} string, n long, n_clusters int, silhouette double, is_split boolean")


def on_trail(types: DataFrame, label: str) -> DataFrame:
    """Types that have or had a label."""
    return types.where((F.col("label") == label) | F.array_contains("trail", label))


def merge_scan(weights: DataFrame, types: DataFrame, structural: float, semantic: float) -> DataFrame:
    """Pairs of types ``a, b`` to merge: alike in what they relate, and in what their definitions say (``types`` has ``type, embedding``).

    Structure leads: only pairs that share a motif are looked at; the definitions' cosine guards against
    merging what is built alike but means something else.
    """
    side = lambda s: types.select(F.col("type").alias(s), F.col("embedding").alias(f"_{s}"))
    pairs = similar_types(weights, structural).join(side("a"), "a").join(side("b"), "b")
    return pairs.select("a", "b", "cosine", V.cosine(F.col("_a"), F.col("_b")).alias("meaning")).where(F.col("meaning") >= semantic)


def specialised(types: DataFrame, splits: DataFrame) -> DataFrame:
    """Split types (``label, child``): a child has its parent's trail and its own label behind it; the parent stays."""
    new = types.join(splits, "label").select(F.col("child").alias("label"), F.array_append("trail", F.col("child")).alias("trail"))
    return types.select("label", "trail").unionByName(new)


def abstracted(types: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged types (``label, parent``): the more general label comes in front of their trails; each parent becomes a type."""
    rows = types.join(merges, "label", "left").select("label", F.when(F.col("parent").isNull(), F.col("trail")).otherwise(F.array_prepend("trail", F.col("parent"))).alias("trail"))
    new = merges.select(F.col("parent").alias("label")).distinct().join(types.select("label"), "label", "left_anti")
    return rows.unionByName(new.select("label", F.array("label").alias("trail")))


def disambiguated(types: DataFrame, children: DataFrame) -> DataFrame:
    """A label that mixed two concepts (``label, child``) is retired; its children begin trails of their own."""
    kept = types.select("label", "trail").join(children.select("label").distinct(), "label", "left_anti")
    return kept.unionByName(children.select(F.col("child").alias("label"), F.array("child").alias("trail")))


def unified(types: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Synonyms (``label, chosen``) are retired for one chosen label, without a hierarchy."""
    kept = types.select("label", "trail").join(synonyms.select("label"), "label", "left_anti")
    new = synonyms.select(F.col("chosen").alias("label")).distinct().join(kept.select("label"), "label", "left_anti")
    return kept.unionByName(new.select("label", F.array("label").alias("trail")))


def subtypes(relations: DataFrame, fillers: DataFrame, rules: DataFrame) -> DataFrame:
    """``relation_id, subtype`` by rules ``type, role, label, subtype``."""
    rows = fillers.select("relation_id", "role", F.col("label").alias("filler")).join(relations.select("relation_id", F.col("label").alias("type")), "relation_id")
    return rows.join(F.broadcast(rules.withColumnRenamed("label", "filler")), ["type", "role", "filler"]).select("relation_id", "subtype").distinct()


def quality(measures: DataFrame, cost: float, lam: float) -> DataFrame:
    """Weighted mean of ``h`` by ``w`` minus a penalty for complexity."""
    return measures.agg((F.sum(F.col("w") * F.col("h")) / F.sum("w") - lam * cost).alias("quality"))


def improved(steps, epsilon: float = 0.01, depth: int = 3):
    """Apply steps (each gives its quality) until one gains less than ``epsilon`` or ``depth`` are done; the number applied."""
    last, done = None, 0
    for step in steps:
        if done >= depth:
            break
        value = step()
        if last is not None and value - last < epsilon:
            break
        last, done = value, done + 1
    return done


#: Words that stand for an entity named before.
ANAPHORS = ("he", "she", "it", "they", "this", "that", "these", "those", "him", "her", "them", "il", "elle", "ils", "elles", "celui-ci", "celle-ci")


def anaphor_names(fillers: DataFrame) -> DataFrame:
    return fillers.agg(F.count_if(F.lower("name").isin(*ANAPHORS)).alias("n_anaphors"), F.count("*").alias("n_fillers"))


def support(claims: DataFrame, claim: str, source: str, fingerprint: Column) -> DataFrame:
    """Per claim how often it is made and by how many sources of their own: copies of one text count once."""
    return claims.groupBy(claim).agg(F.count("*").alias("attribution_strength"), F.count_distinct(source).alias("n_sources"), F.count_distinct(fingerprint).alias("support_strength"))


def instance_groups(instances: DataFrame, keys: list[str]) -> DataFrame:
    """Instances that agree in all identifying keys, as one with the smallest id; a missing key identifies nothing."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return instances.where(known).groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("n"))
