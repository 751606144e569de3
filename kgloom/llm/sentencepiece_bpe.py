"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat numpy array.  A round finds the best-ranked pair of every
word with a segmented minimum, merges its leftmost occurrence in all words at once, and compacts the
array; words without a pair leave it.  Long words merge further occurrences of the same pair in the
round, as far as none of the pairs this makes would have come first.

No piece of such a vocabulary has a space mark behind another character (this is verified on
loading), so merges never cross the start of a run of spaces and each distinct word is encoded once
per batch.

Cases: null text and empty text encode to the end id alone and decode to ``""``; characters outside
the vocabulary become their UTF-8 byte pieces; a null id list decodes to ``""``; texts of any length are
encoded whole; rows that repeat get the same ids; columns that have the names of the new ones are replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kgloom.llm.arrow_batches import with_columns

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
LONG_WORD = 48
#: Texts that a model must leave as they are, apart from marking spaces: compatibility forms, marks, controls, runs of white space.
PROBES = ("ﬁ Ａ ½ e\u0301 é\xa0x\u200b", "  a  \t\n b ", "\x00\x7f\r\u3000①İß")
#: Characters of text encoded together, and words remembered by a worker; both bound memory only.
CHUNK_CHARS = 1_000_000
MEMO_WORDS = 150_000

codecs.register_error("kgloom_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Vocabulary of a BPE model as arrays: symbol of each character, rank and result of each pair, bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(sp.normalize(x) != SPACE + x.replace(" ", SPACE) for x in PROBES):
            raise ValueError("the model normalises texts")
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        index = {pieces[i]: i for i in plain}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in index):
            raise ValueError("the vocabulary has pieces that cross the start of a word")
        if any(c not in index for p in index for c in p):
            raise ValueError("the vocabulary lacks a character of one of its pieces")
        self.size, self.eos, self.unk = size, sp.eos_id(), sp.unk_id()
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in index.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        keys, ranks, results = [], [], []
        for p, i in index.items():
            for k in range(1, len(p)):
                a, b = index.get(p[:k]), index.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    ranks.append(order[sp.get_score(i)])
                    results.append(i)
        keys = np.array(keys, np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array(ranks, np.int32)[by]
        self.results = np.array(results, np.int32)[by]
        self._hash_pairs()
        text = {i: pieces[i].replace(SPACE, " ").encode() for i in plain}
        text |= {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i}
        text[self.unk] = " ⁇ ".encode()
        parts = [text.get(i, b"") for i in range(size)]
        self.piece_len = np.array([len(p) for p in parts], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.spaced = np.array([i in text and pieces[i][:1] == SPACE for i in range(size)])
        self.words: dict[str, bytes] = {}

    def _hash_pairs(self) -> None:
        """Open addressing over the pairs: lookups cost a probe or two instead of a binary search."""
        self.bits = int(len(self.keys) * 8).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            taken, who = np.unique(at[free], return_index=True)
            self.slots[taken] = left[free][who]
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
        self.slot_keys = np.where(self.slots < 0, -1, self.keys[self.slots])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; NO_RANK where there is none."""
        ranks, results = np.full(len(left), NO_RANK, np.int32), np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) * self.size + right[todo]
        at = self._slot(keys)
        for _ in range(self.probes):
            here = self.slot_keys[at]
            hit = here == keys
            found = self.slots[at[hit]]
            ranks[todo[hit]], results[todo[hit]] = self.ranks[found], self.results[found]
            go = ~hit & (here >= 0)
            if not go.any():
                break
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return ranks, results

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, in the same order, as the bytes of 32-bit numbers."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol, point = self._merged(self.symbol[points], word, points)
        return self._ids(*symbol, point, len(words))

    def _merged(self, symbol: np.ndarray, word: np.ndarray, points: np.ndarray):
        done: list[tuple[np.ndarray, ...]] = []
        first = np.arange(len(symbol))
        rank, result = self._pairs(symbol, word)
        long_words = np.bincount(word)[word] > LONG_WORD if len(word) else np.zeros(0, bool)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbol)]))
            live = best != NO_RANK
            if not live.all():
                over = ~live
                done.append((word[over], first[over], symbol[over]))
                symbol, word, first, rank, result, best, long_words = (x[live] for x in (symbol, word, first, rank, result, best, long_words))
                if not len(symbol):
                    break
            hits = np.flatnonzero(rank == best)
            lead = np.r_[True, word[hits][1:] != word[hits][:-1]]
            if long_words.any():
                hits = self._together(hits, lead, symbol, word, rank, result, long_words)
            else:
                hits = hits[lead]
            symbol[hits] = result[hits]
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, first, rank, result, long_words = (x[keep] for x in (symbol, word, first, rank, result, long_words))
            at = moved[hits]
            changed = np.r_[at, at[at > 0] - 1]
            self._renew(changed, symbol, word, rank, result)
        empty = np.zeros(0, np.int64)
        word, first, symbol = (np.concatenate(x) for x in zip(*done)) if done else (empty, empty, empty.astype(np.int32))
        by = np.argsort(first)
        return (symbol[by], word[by]), points[first[by]]

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, result = np.full(len(symbol), NO_RANK, np.int32), np.full(len(symbol), -1, np.int32)
        self._renew(np.arange(len(symbol)), symbol, word, rank, result)
        return rank, result

    def _renew(self, at, symbol, word, rank, result) -> None:
        inner = at[at < len(symbol) - 1]
        rank[at], result[at] = NO_RANK, -1
        inner = inner[word[inner] == word[inner + 1]]
        rank[inner], result[inner] = self.pair(symbol[inner], symbol[inner + 1])

    def _together(self, hits, lead, symbol, word, rank, result, long_words):
        """Leftmost hits of short words; of long words also the hits behind, up to the first that makes a pair of its own rank or better."""
        run = np.r_[True, (np.diff(hits) != 1) | lead[1:]]
        start = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        apart = (np.arange(len(hits)) - start) % 2 == 0
        hits = hits[apart & (long_words[hits] | lead)]
        many = np.flatnonzero(long_words[hits])
        if not len(many):
            return hits
        p = hits[many]
        made, w, n = result[p], word[p], len(symbol)
        behind = np.r_[False, (np.diff(p) == 2) & (w[1:] == w[:-1])]
        left = np.where(behind, np.r_[-1, made[:-1]], symbol[np.maximum(p - 1, 0)])
        left = np.where((p > 0) & (word[np.maximum(p - 1, 0)] == w), left, -1)
        after = np.minimum(p + 2, n - 1)
        right = np.where((p + 2 < n) & (word[after] == w), symbol[after], -1)
        new = np.minimum(self.pair(left, made)[0], self.pair(made, right)[0])
        stop = new <= rank[p]
        begin = np.r_[True, w[1:] != w[:-1]]
        before = np.cumsum(stop) - stop
        base = np.maximum.accumulate(np.where(begin, before, 0))
        ok = np.ones(len(hits), bool)
        ok[many] = before == base
        return hits[ok]

    def _ids(self, symbol, word, points, n: int) -> list[bytes]:
        unknown = np.flatnonzero(symbol < 0)
        if len(unknown):
            raw = [chr(c).encode("utf-8", "replace") for c in points[unknown]]
            width = np.ones(len(symbol), np.int64)
            width[unknown] = [len(r) for r in raw]
            at = np.cumsum(width) - width
            word = np.repeat(word, width)
            ids = np.repeat(symbol, width)
            spots = np.repeat(at[unknown], width[unknown]) + np.concatenate([np.arange(len(r)) for r in raw])
            ids[spots] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            ids = symbol
        ends = (4 * np.searchsorted(word, np.arange(n + 1))).tolist()
        raw = ids.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id behind each text, and the offsets of the texts."""
        flat, counts, group, chars = [], [], [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= CHUNK_CHARS:
                self._encode_group(group, flat, counts)
                group, chars = [], 0
        self._encode_group(group, flat, counts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return np.frombuffer(b"".join(flat), np.int32), offsets

    def _encode_group(self, texts: list[str], flat: list, counts: list) -> None:
        split = [_WORDS((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        memo, used = self.words, set().union(*split)
        new = list(used - memo.keys())
        if len(memo) + len(new) > MEMO_WORDS:
            memo = {w: memo[w] for w in used & memo.keys()}
        memo.update(zip(new, self.encode_words(new)))
        end = np.int32(self.eos).tobytes()
        for ws in split:
            ids = b"".join([memo[w] for w in ws]) + end
            flat.append(ids)
            counts.append(len(ids) // 4)
        self.words = memo if len(memo) <= MEMO_WORDS else {}

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of flat ids; the space that encoding puts before a text is taken off again."""
        texts, a = [], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_CHARS, side="right")) - 1)
            texts += self._decoded(ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b
        return texts

    def _decoded(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        width = self.piece_len[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        source = np.arange(ends[-1]) + np.repeat(self.piece_at[ids] - ends[:-1], width)
        data = self.piece_bytes[source].tobytes()
        texts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            at = ends[a]
            shown = a
            while shown < b and width[shown] == 0:
                shown += 1
            if shown < b and self.spaced[ids[shown]]:
                at += 1
            texts.append(data[at : ends[b]].decode("utf-8", "kgloom_each_byte"))
        return texts


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*").findall


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a worker; its file must be at this path on each machine."""
    return PieceModel(path)


_IDS = T.ArrayType(T.IntegerType())


def _encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, offsets = model(path).encode(texts.to_pylist())
    return ids, offsets, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts, the end id last, in column ``into``."""
    return with_columns(df, text, [T.StructField(into, _IDS)], lambda texts: [_encode(texts, path)[2]])


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the texts of its id lists in column ``into``."""

    def work(lists: pa.Array) -> list[pa.Array]:
        sizes = [0 if x is None else x for x in pc.list_value_length(lists).to_pylist()]
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        return [pa.array(model(path).decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.string())]

    return with_columns(df, ids, [T.StructField(into, T.StringType())], work)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass over the rows."""

    def work(texts: pa.Array) -> list[pa.Array]:
        flat, offsets, lists = _encode(texts, path)
        return [lists, pa.array(model(path).decode(flat, offsets), pa.string())]

    return with_columns(df, text, [T.StructField(ids, _IDS), T.StructField(into, T.StringType())], work)
