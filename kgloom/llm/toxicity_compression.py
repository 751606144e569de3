"""Toxicity by compression distance.

zstandard dictionaries are trained, one on ordinary windows, others on the stretches that tell toxic
documents from ordinary ones (short byte grams that ordinary text all but lacks, or also longer ones
that it has more rarely); trained on whole toxic windows, which are mostly ordinary prose, they tell far
less (the README has figures).  A toxic compressor's dictionary is the trained toxic content in front of the
shared ordinary content, so a window that owes nothing to toxic text has the same length under both and
the difference of the two lengths is what the toxic dictionary adds.  A document's whole text is scored
window by window; a logistic curve, fitted on labelled documents that the dictionaries have not seen,
turns the largest and the mean differences into a probability.

Training reads the whole texts of at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled documents, those with
the smallest hashes of their ids, in one executor task.  Scoring has no bound.

Cases: null and empty texts score as a document without windows; texts of any length are scored whole;
rows that repeat are scored each; rows without a label, or with another label than 0 and 1, teach nothing; a
document labelled twice counts for each label; a score equal to the threshold is predicted toxic; columns
named ``score`` or ``predicted`` are replaced; an empty table gives an empty one.  Without labelled documents of both
kinds every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_ORDINARY = 1500, 3000
WINDOW, LEVEL = 48, 5
ORDINARY_BYTES = 8192
#: Sizes of a toxic dictionary; for each way the size with the least loss on held-back samples stays.
TOXIC_BYTES = (1024, 2048, 3072)
#: Ways to pick telling grams: bytes of a gram, and how many times more of the toxic documents must have it.
GRAMS = (((5, 40.0),), ((5, 40.0), (7, 8.0)))
MIN_SHARE, MIN_SURPRISE = 0.02, 9.0
THRESHOLD = 0.7

_BREAKS = re.compile(rb"[\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The text in lower case, words set apart by one space, cut before words into stretches of up to ``size`` bytes."""
    body = b" " + _BREAKS.sub(b" ", (text or "").encode("utf-8", "replace").translate(_LOWER)).strip() + b" "
    if len(body) <= 2:
        return []
    out, at = [], 0
    while at < len(body) - 1:
        end = at + size
        if end < len(body):
            space = body.rfind(b" ", at + 1, end)
            end = space if space > at else end
        out.append(body[at:end] + b" ")
        at = end
    return out


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: tuple[bytes, ...]
    weights: tuple[float, ...] = ()
    base: float = 0.0


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def features(text: str | None, ordinary: bytes, toxic: tuple[bytes, ...]) -> list[float]:
    """The log of the number of windows, and for each toxic dictionary the three largest gains of a window, the mean gain, and the mean above noise."""
    parts = windows(text)
    if not parts:
        return [0.0] * (1 + 5 * len(toxic))
    plain = _compressor(ordinary)
    base = np.array([len(plain(w)) for w in parts], np.float64)
    out = [float(np.log1p(len(parts)))]
    for content in toxic:
        other = _compressor(content + ordinary)
        gain = base - np.array([len(other(w)) for w in parts])
        top = np.r_[np.sort(gain)[::-1][:3], 0.0, 0.0]
        out += [float(x) for x in (*top[:3], gain.mean(), np.maximum(gain - 3, 0).mean())]
    return out


def _grams(data: bytes, size: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(b) - size + 1
    return np.zeros(0, np.int64) if n <= 0 else sum(b[i : i + n] << (8 * i) for i in range(size))


def _telling(toxic: list[bytes], ordinary: list[bytes], size: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Byte grams that far more toxic documents have than ordinary ones let expect, and how many toxic ones have each."""
    count = lambda docs: np.unique(np.concatenate([np.unique(_grams(d, size)) for d in docs]), return_counts=True)
    grams, seen = count(toxic)
    others, there = count(ordinary)
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
    rare = np.where(others[at] == grams, there[at], 0) if len(others) else np.zeros(len(grams))
    expected = (rare + 0.5) / len(ordinary) * len(toxic)
    kept = (seen >= max(3, MIN_SHARE * len(toxic))) & (seen > ratio * expected) & (seen - expected > MIN_SURPRISE * np.sqrt(expected))
    return grams[kept], seen[kept]


def _stretches(data: bytes, telling: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[bytes, int]:
    """The bytes under telling grams, and how many documents have the commonest of them."""
    hit, most = np.zeros(len(data), bool), 0
    for size, grams, seen in telling:
        own = _grams(data, size)
        starts = np.flatnonzero(np.isin(own, grams))
        for i in range(size):
            hit[starts + i] = True
        if len(starts):
            most = max(most, int(seen[np.isin(grams, own)].max()))
    return np.frombuffer(data, np.uint8)[hit].tobytes(), most


def _balanced(docs: list[bytes], telling: list[tuple[int, np.ndarray, np.ndarray]], total: int = 2000) -> list[bytes]:
    """The telling stretches of each document, repeated the more often the rarer its commonest telling gram is, so that no language crowds out the others."""
    told = [x for x in (_stretches(d, telling) for d in docs) if len(x[0]) >= 8]
    scale = total / sum(1 / most for _, most in told) if told else 0
    return [s for s, most in told for _ in range(max(1, round(scale / most)))]


def _content(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a trained dictionary; too few samples to train on are the content themselves."""
    try:
        return zstandard.train_dictionary(size + 400, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, list[list[bytes]]]:
    """Ordinary content, and for each way toxic contents of all sizes; no ways if a side has nothing to tell."""
    bad, good = [b"".join(x) for x in toxic if x], [b"".join(x) for x in ordinary if x]
    if not bad or not good:
        return b"", []
    plain = _content([w for doc in ordinary for w in doc], ORDINARY_BYTES, 32, 8)
    ways, known = [], {size: _telling(bad, good, *size) for size in sorted({g for way in GRAMS for g in way})}
    for way in GRAMS:
        told = _balanced(bad, [(g[0], *known[g]) for g in way])
        if told:
            ways.append([_content(told, size, 24, 6) for size in TOXIC_BYTES])
    return plain, ways


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; weights for unscaled features, the constant first."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - penalty * w)
    slope = w[1:] / scale
    return (float(w[0] - slope @ mean), *map(float, slope))


def loss(x: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of a curve fitted on the same rows."""
    first, *slopes = fit_logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ np.array(slopes) + first, -30, 30)))
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def _features_of(text: Column, ordinary: bytes, toxic: tuple[bytes, ...]) -> Column:
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, ordinary, toxic) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return measure(text)


def trained(rows: list[tuple[int, int, str | None]]) -> Model:
    """A model of (hash, label, text) rows: two thirds by hash train the dictionaries, the others choose their sizes and the curve."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))
    share = sum(label for _, label, _ in rows) / len(rows) if rows else 0.0
    pick = lambda value: [windows(text) for order, label, text in rows if label == value and order % 3]
    back = [(text, float(label)) for order, label, text in rows if order % 3 == 0]
    y = np.array([label for _, label in back])
    ordinary, ways = train_dictionaries(pick(1), pick(0))
    if not ways or not len(y) or y.min() == y.max():
        return Model(b"", (), (), share)
    measure = lambda toxic: np.array([features(text, ordinary, toxic) for text, _ in back])
    toxic = tuple(min(sizes, key=lambda t: loss(measure((t,)), y)) for sizes in ways)
    return Model(ordinary, toxic, fit_logistic(measure(toxic), y), share)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on the labelled documents for whose label rows ``learn`` holds; one task gets the bounded sample and gives the model."""
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64(F.col(doc_id)).alias("_order"))
    part = lambda value, most: known.where(F.col("_label") == value).orderBy("_order", "_id").limit(most)
    chosen = part(1, MAX_TOXIC).unionByName(part(0, MAX_ORDINARY))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained([r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.select("_order", "_label", "_text").repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model(b"", (), (), 0.0)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; a plain column expression, so every other column stays as it is."""
    if not model.weights:
        return F.lit(float(model.base))
    first, *slopes = model.weights
    measured = _features_of(text, model.ordinary, model.toxic)
    total = F.aggregate(F.zip_with(measured, F.array(*[F.lit(s) for s in slopes]), lambda a, b: a * b), F.lit(first), lambda a, b: a + b)
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def flagged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return docs.withColumn("score", score(F.col(text), model)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
