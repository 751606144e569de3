"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a
word is the sum over all its segmentations into pieces, found with the forward algorithm; pieces never
cross words, so a text's log-probability is the sum over its words and each distinct word is scored
once per batch.  Piece probabilities are learned by expectation-maximisation (forward-backward) on the
words of at most ``MAX_DOCS`` documents per language, those with the smallest hashes of their ids; each
language is learned in an executor.

Words are not as independent as the sum takes them, so all but the shortest texts would score 1.  The
logs of a text of n words are therefore divided by a power of n, from 0 (the sum) to 1 (the mean), the one
that gives the languages of the learning documents the largest likelihood.

Forward sums of words of up to ``LINEAR`` letters are probabilities, those of longer ones their logs, in
blocks, so that runs of letters of any length are summed over all segmentations in bounded memory.

Cases: null text and text without a letter are ``und`` with score 0; empty texts teach nothing; rows that
repeat are scored each and teach each; characters outside the vocabulary have a fixed small probability in
every language; ties go to the alphabetically first language; without any learned language (an empty
table) everything is ``und``; columns that have the name of the new one are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.storage import written

UND = "und"
MAX_DOCS = 600
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-7
#: Longest words whose probability is safely above the smallest number.
LINEAR = 40
#: Characters of texts and of new words worked on together, and characters of words that a worker remembers; all bound memory only.
CHUNK_CHARS = 400_000
CHUNK_LETTERS = 40_000
MEMO_LETTERS = 800_000
TYPE = "struct<lang:string,score:double>"

_RUNS = re.compile(r"[^\W\d_]+").findall


def letters(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in _RUNS(text.lower())]


class Pieces:
    """The vocabulary as a trie in arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        pieces = {p: i for p, i in pieces.items() if p[:1].isalpha() or p[:1] == "▁" and (len(p) == 1 or p[1:2].isalpha())}
        self.size = sp.get_piece_size() + 1  # the last is the unknown character
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for p in sorted(pieces):
            node = 0
            for c in p:
                node = nodes.setdefault((node, ord(c)), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = pieces[p]
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        by = np.argsort(keys)
        self.keys, self.child = keys[by], np.array(list(nodes.values()), np.int64)[by]
        self.piece = np.array(piece, np.int64)
        self.depth = max(map(len, pieces))

    def _down(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        key = (node << 21) | point
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def lattice(self, marked: list[str]):
        """Edges of all segmentations: start position, end position, piece; the in-word place of each edge's end; the words' positions and sizes."""
        size = np.array([len(w) for w in marked], np.int64)
        base = np.cumsum(size + 1) - (size + 1)
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(marked)), size)
        place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - place  # characters from here to the word's end
        at, node, start, length, piece = np.arange(len(points)), np.zeros(len(points), np.int64), [], [], []
        single = np.zeros(len(points), bool)
        for step in range(self.depth):
            ok = left[at] > step
            at, node = at[ok], node[ok]
            node = self._down(node, points[at + step])
            ok = node >= 0
            at, node = at[ok], node[ok]
            made = self.piece[node]
            hit = made >= 0
            if step == 0:
                single[at[hit]] = True
            start.append(at[hit])
            length.append(np.full(hit.sum(), step + 1))
            piece.append(made[hit])
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        start, length = np.concatenate([*start, lone]), np.concatenate([*length, np.ones(len(lone), np.int64)])
        piece = np.concatenate([*piece, np.full(len(lone), self.size - 1)])
        source = base[word[start]] + place[start]
        order = np.argsort(place[start] + length, kind="stable")
        ends = (place[start] + length)[order]
        return source[order], (source + length)[order], piece[order], ends, base, size

    def forward(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Log-probability of each word (rows) in each language (columns); ``chance`` is languages x pieces."""
        out = np.zeros((len(words), len(chance)))
        with np.errstate(divide="ignore"):
            logs = np.log(chance)
        for part in _parts(words):
            marked = ["▁" + words[i] for i in part]
            longest = max(map(len, marked))
            if longest > CHUNK_LETTERS:
                out[part] = self._in_blocks(marked[0], logs)
                continue
            lattice = self.lattice(marked)
            ends = lattice[4] + lattice[5]
            if longest <= LINEAR + 1:
                out[part] = np.log(self._alpha(*lattice, chance)[:, ends]).T
            else:
                out[part] = self._log_alpha(*lattice, logs)[:, ends].T
        return out

    @staticmethod
    def _steps(source, target, piece, ends):
        """Edges by the place they end at: starts, pieces, the positions they end at and where each position's edges begin."""
        cuts = np.searchsorted(ends, np.arange(1, ends[-1] + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            by = a + np.argsort(target[a:b], kind="stable")
            to = target[by]
            first = np.flatnonzero(np.r_[True, np.diff(to) > 0])
            yield source[by], piece[by], to[first], first

    def _alpha(self, source, target, piece, ends, base, size, chance):
        alpha = np.zeros((len(chance), int(base[-1] + size[-1] + 1)))
        alpha[:, base] = 1.0
        for at, made, to, first in self._steps(source, target, piece, ends):
            for k in range(len(chance)):
                alpha[k, to] = np.add.reduceat(alpha[k, at] * chance[k, made], first)
        return alpha

    def _log_alpha(self, source, target, piece, ends, base, size, logs, start=None):
        alpha = np.full((len(logs), int(base[-1] + size[-1] + 1)), -np.inf)
        alpha[:, base] = 0.0
        if start is not None:
            alpha[:, : start.shape[1]] = start
        for at, made, to, first in self._steps(source, target, piece, ends):
            if start is not None and to[0] < start.shape[1]:
                continue
            for k in range(len(logs)):
                v = alpha[k, at] + logs[k, made]
                top = np.maximum.reduceat(v, first)
                alpha[k, to] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.r_[first, len(v)]))), first))
        return alpha

    def _in_blocks(self, marked: str, logs: np.ndarray) -> np.ndarray:
        """One long word; a block begins with the sums of as many positions as a piece is long."""
        alpha = np.zeros((len(logs), 1))
        for a in range(0, len(marked), CHUNK_LETTERS):
            low = max(0, a - self.depth)
            lattice = self.lattice([marked[low : a + CHUNK_LETTERS]])
            alpha = self._log_alpha(*lattice, logs, alpha[:, low - a - 1 :])
        return alpha[:, -1]

    def learn(self, counts: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities from words and their counts; words are worked on in parts, so memory follows the longest word only."""
        words = list(counts)
        chance = np.full(self.size, 1.0 / self.size)
        chance[-1] = UNKNOWN
        if not words:
            return chance
        weight = np.array([counts[w] for w in words], np.float64)
        parts = _parts(words)
        for _ in range(rounds):
            with np.errstate(divide="ignore"):
                logs = np.log(chance)
            got = np.full(self.size, SMOOTHING)
            for part in parts:
                source, target, piece, ends, base, size = lattice = self.lattice(["▁" + words[i] for i in part])
                owner = np.searchsorted(base, source, side="right") - 1
                alpha = self._log_alpha(*lattice, logs[None])[0]
                beta = self._log_beta(source, target, piece, base, size, owner, logs)
                share = np.exp(alpha[source] + logs[piece] + beta[target] - alpha[(base + size)[owner]]) * weight[part][owner]
                got += np.bincount(piece, share, self.size)
            got[-1] = 0
            chance = got / got.sum()
            chance[-1] = UNKNOWN
        return chance

    @staticmethod
    def _log_beta(source, target, piece, base, size, owner, logs):
        beta = np.full(int(base[-1] + size[-1] + 1), -np.inf)
        beta[base + size] = 0.0
        by = np.lexsort((source, base[owner] - source))
        places = (source - base[owner])[by]
        cuts = np.flatnonzero(np.r_[True, np.diff(places) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = by[a:b]
            first = np.flatnonzero(np.r_[True, np.diff(source[e]) > 0])
            v = logs[piece[e]] + beta[target[e]]
            top = np.maximum.reduceat(v, first)
            beta[source[e][first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.r_[first, len(v)]))), first))
        return beta


def _parts(words: list[str]) -> list[list[int]]:
    """Places of words of like length, each part of at most ``CHUNK_LETTERS`` letters or one word; short and long words apart."""
    out: list[list[int]] = []
    held = 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        n = len(words[i]) + 1
        if not out or held + n > CHUNK_LETTERS or n > LINEAR + 1 >= len(words[out[-1][0]]) + 1:
            out.append([])
            held = 0
        out[-1].append(i)
        held += n
    return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass(frozen=True)
class Model:
    """Languages (sorted), their piece probabilities and the power of a text's words that divides its logs."""

    path: str
    languages: list[str]
    chance: np.ndarray
    power: float = 0.0


class Scorer:
    """Scores texts under one model, remembering words between batches."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces(model.path)
        self.index: dict[str, int] = {}
        self.held = 0
        self.logs = np.zeros((0, len(model.languages)))

    def remember(self, used: set[str]) -> None:
        new = [w for w in used if w not in self.index]
        size = sum(map(len, new))
        if self.held + size > MEMO_LETTERS:
            kept = [w for w in used if w in self.index]
            self.logs = self.logs[[self.index[w] for w in kept]] if kept else self.logs[:0]
            self.index = {w: i for i, w in enumerate(kept)}
            self.held = sum(map(len, kept))
        added = self.pieces.forward(new, self.model.chance)
        self.index.update((w, len(self.logs) + i) for i, w in enumerate(new))
        self.held += size
        self.logs = np.r_[self.logs, added]

    def total(self, words: list[str]) -> np.ndarray:
        """Log-probability of remembered words in each language."""
        return self.logs[[self.index[w] for w in words]].sum(axis=0)

    def score(self, texts: list[str | None]) -> list[dict]:
        out, group, chars = [], [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= CHUNK_CHARS:
                out += self._group(group)
                group, chars = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[dict]:
        split = [[w for w in letters(t) if w] for t in texts]
        self.remember(set().union(*split))
        out = []
        for words in split:
            if not words or not self.model.languages:
                out.append({"lang": UND, "score": 0.0})
                continue
            total = self.total(words)
            best = int(total.argmax())
            out.append({"lang": self.model.languages[best], "score": float(1 / np.exp((total - total[best]) / len(words) ** self.model.power).sum())})
        return out


_WORDS = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))


def _counted(text: Column) -> Column:
    """Distinct words of a text and their counts."""

    @F.arrow_udf("array<struct<word:string,n:long>>")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([[{"word": w, "n": n} for w, n in Counter(p for p in letters(t or "") if p).items()] for t in texts.to_pylist()], _WORDS)

    return count(text)


def damping(totals: np.ndarray, sizes: np.ndarray, true: np.ndarray) -> float:
    """The power of ``sizes`` that divides rows of log-probabilities so that the ``true`` columns are likeliest."""
    if not len(totals) or totals.shape[1] < 2:
        return 0.0
    tried = np.linspace(0.0, 1.0, 51)
    z = totals - totals[np.arange(len(true)), true][:, None]
    losses = []
    for power in tried:
        damped = z / (sizes.astype(np.float64) ** power)[:, None]
        top = damped.max(axis=1)
        losses.append(float((top + np.log(np.exp(damped - top[:, None]).sum(axis=1))).mean()))
    return float(tried[int(np.argmin(losses))])


def fit(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """A model learned from rows with text and language.

    The bounded sample is drawn with a threshold on the ids' hashes, so no language is gathered whole; its
    word counts are written once.  Executors learn the languages and score the sample; the driver gets
    one array per language and one short row per sampled document.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_003)).alias("_order"))
    sizes = known.groupBy("_lang").agg(F.count("*").alias("_n")).select(F.col("_lang").alias("_l"), (F.lit(1_000_003 * 1.2 * max_docs) / F.col("_n")).alias("_below"))
    drawn = known.join(F.broadcast(sizes), (F.col("_lang") == F.col("_l")) & (F.col("_order") < F.col("_below")))
    drawn = drawn.select("_id", "_lang", "_order", _counted(F.col("_text")).alias("_words"))
    drawn = drawn.withColumn("_rank", F.row_number().over(W.partitionBy("_lang").orderBy("_order", "_id"))).where(F.col("_rank") <= max_docs)
    drawn = written(drawn.select("_lang", "_words"), "language-sample")

    def learn(rows: pa.Table) -> pa.Table:
        counts = dict(sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())))
        return pa.table({"lang": rows.column("_lang")[:1], "chance": pa.array([pieces(path).learn(counts).tobytes()], pa.binary())})

    words = drawn.select("_lang", F.explode("_words").alias("w")).groupBy("_lang", "w.word").agg(F.sum("w.n").alias("n"))
    learned = sorted((r["lang"], bytes(r["chance"])) for r in words.groupBy("_lang").applyInArrow(learn, "lang string, chance binary").collect())
    languages = [x for x, _ in learned]
    chance = np.array([np.frombuffer(c) for _, c in learned]).reshape(len(learned), -1 if learned else 0)
    plain = Model(path, languages, chance)
    if len(languages) < 2:
        return plain

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plain)
        for batch in batches:
            found, sizes, true = [], [], []
            for name, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if counted:
                    scorer.remember({w["word"] for w in counted})
                    sizes.append(sum(w["n"] for w in counted))
                    found.append(np.array([w["n"] for w in counted]) @ scorer.logs[[scorer.index[w["word"]] for w in counted]])
                    true.append(languages.index(name))
            yield pa.RecordBatch.from_arrays([pa.array(true, pa.int32()), pa.array(sizes, pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))], ["true", "size", "totals"])

    scored = drawn.mapInArrow(totals, "true int, size long, totals array<double>").collect()
    scored.sort()
    return Model(path, languages, chance, damping(*[np.array([r[c] for r in scored]) for c in ("totals", "size", "true")]))


_SCORERS: dict[str, Scorer] = {}


def identified(text: Column, model: Model) -> Column:
    """Language and score of a text as a struct; each worker keeps one scorer."""
    key = hashlib.sha256(repr((model.path, model.languages, model.power)).encode() + model.chance.tobytes()).hexdigest()

    @F.arrow_udf(TYPE)
    def identify(texts: pa.Array) -> pa.Array:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model)
        return pa.array(_SCORERS[key].score(texts.to_pylist()), pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return identify(text)


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column of language and score."""
    return docs.withColumn(into, identified(F.col(text), model))
