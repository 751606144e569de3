"""License scans by ordered signature rules.

Texts are read as sequences of lower-case ASCII-delimited words.  Each rule (see ``license_signatures``) is
a regex over the word sequence with a tier.  A keyword prefilter decides which texts are looked at and
which rules are tried on them.  A rule's keyword is not written by hand but read off its regex: a piece of
a word that every match has, so the prefilter loses nothing.  A detection inside one of the same or a
better tier is suppressed (of equal intervals the better tier and then the first rule stays); what stays
gives the labels.

Everything is DataFrame expressions.  Rules are matched where the texts are, as constant patterns; only
places, numbers of words, are shuffled.  The base phrases are counted for every text, apart from the rules.

Cases: null and empty texts, and texts without words, have no detections, score 0 and null first and last
words; texts of any length are read whole; rows that repeat in doc_id and text get the same values; a null
doc_id is kept; an empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from re import _parser as re_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.license_signatures import SIGNATURES

#: Fixed values of the contract: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tiers, best first, and how sure a detection of each is.
TIERS = {"T": 0, "G": 1, "N": 2, "O": 3}
SURE = {0: 1.0, 1: 0.95, 2: 0.8, 3: 0.5}
#: Keywords that are taken where a rule's matches have them; elsewhere it is the longest piece that all matches have.
ANCHORS = ("spdx", "licen", "permission", "redistribut", "copyright", "warrant", "gpl", "creative", "bsd")


class Rule(NamedTuple):
    number: int
    label: str
    tier: int
    keyword: str
    regex: str


def certain(regex: str) -> list[str]:
    """Pieces of words that every match of a regex has: its runs of plain characters outside groups, choices and repeats."""
    runs = [""]
    for kind, value in re_parser.parse(regex):
        if str(kind) == "LITERAL":
            runs[-1] += chr(value)
        else:
            runs.append("")
    return [piece for run in runs for piece in run.split(" ") if piece]


def keyword(regex: str) -> str:
    pieces = certain(regex)
    return next((a for a in ANCHORS if any(a in p for p in pieces)), None) or max(pieces, key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order; a regex takes the space before its first word and looks at the one behind its last."""
    out = []
    for number, line in enumerate(SIGNATURES.strip().splitlines()):
        label, tier, regex = line.split(" ", 2)
        regex = f" {regex.replace('~', 'licen[sc]e')}(?= )"
        out.append(Rule(number, label, TIERS[tier], keyword(regex), regex))
    return tuple(out)


@lru_cache(maxsize=1)
def keywords() -> tuple[str, ...]:
    """A text without any of these has no detections and no base phrase (all of which have ``licen``)."""
    return tuple(sorted({"licen", *(r.keyword for r in rules())}))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_line(text: Column) -> Column:
    """The words with a space before and behind each."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), BREAK, " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(line: Column, rule: Rule) -> Column:
    """What a rule finds in a word line: for each hit its number, the words before it since the last one, and its own; the last has no hit."""
    parts = F.arrays_zip(F.split(line, rule.regex, -1).alias("gap"), F.regexp_extract_all(line, F.lit(rule.regex), F.lit(0)).alias("hit"))
    shown = lambda x, at: F.struct(F.lit(rule.number).alias("rule"), at.alias("at"), spaces(x["gap"]).alias("gap"), F.coalesce(spaces(x["hit"]), F.lit(0)).alias("long"))
    return F.when(line.rlike(rule.regex), F.transform(parts, shown))


def _tried(line: Column) -> Column:
    """What all rules find; those of a keyword are tried on lines that have it."""
    groups = [F.when(F.contains(line, F.lit(k)), _joined([_places(line, r) for r in rules() if r.keyword == k])) for k in keywords()]
    return _joined(groups)


def _joined(arrays: list[Column]) -> Column:
    return F.flatten(F.array_compact(F.array(*arrays)))


def detections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, label, tier and the word interval [first, past) of what stays; ``lines`` has a word line with each key, null where there is nothing to find."""
    parts = lines.where(F.col("line").isNotNull()).select(*keys, F.explode(_tried(F.col("line"))).alias("p")).select(*keys, "p.*").dropDuplicates([*keys, "rule", "at"])
    before = W.partitionBy(*keys, "rule").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    found = parts.select(*keys, "rule", "long", (F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("long")).over(before), F.lit(0))).cast("long").alias("first")).where("long > 0")
    at = F.col("rule") + 1
    label, tier = F.array(*[F.lit(r.label) for r in rules()]), F.array(*[F.lit(r.tier) for r in rules()])
    found = found.select(*keys, "rule", F.element_at(label, at).alias("label"), F.element_at(tier, at).alias("tier"), "first", (F.col("first") + F.col("long")).alias("past"))
    order = W.partitionBy(*keys).orderBy("first", F.desc("past"), "tier", "rule").rowsBetween(W.unboundedPreceding, -1)
    covers = [(F.col("tier") >= t) & (F.coalesce(F.max(F.when(F.col("tier") <= t, F.col("past"))).over(order), F.lit(-1)) >= F.col("past")) for t in sorted(SURE)]
    hidden = covers[0] | covers[1] | covers[2] | covers[3]
    return found.withColumn("_hidden", hidden).where(~F.col("_hidden")).select(*keys, "label", "tier", "first", "past")


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and places, labels and score of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.lower(body).alias("low"))
    may = F.lit(False)
    for k in keywords():
        may = may | F.contains("low", F.lit(k))
    rows = rows.select("doc_id", "body", may.alias("may"))
    line = F.when(F.col("may"), word_line(F.col("body")))
    rows = rows.select("doc_id", F.xxhash64("body").alias("h"), F.regexp_count("body", F.lit(WORD)).cast("long").alias("n_words"), line.alias("line"))
    counts = {p: F.coalesce(F.regexp_count("line", F.lit(f" {p}(?= )")), F.lit(0)) for p in BASE}
    any_of = "|".join(BASE)
    total = sum(list(counts.values())[1:], list(counts.values())[0])
    first = spaces(F.substring_index(F.regexp_replace("line", F.lit(f" (?:{any_of})(?= )"), F.lit("\x01")), "\x01", 1))
    last = spaces(F.regexp_extract("line", f"(?s)^(.*) (?:{any_of}) ", 1))
    named = F.array_compact(F.array(*[F.when(c > 0, F.lit(BASE[p])) for p, c in counts.items()]))
    base = rows.select("doc_id", "h", "n_words", total.cast("long").alias("n_base"), F.when(total > 0, first).cast("long").alias("first_word"), F.when(total > 0, last).cast("long").alias("last_word"), named.alias("_base"))
    keys = ["_k", "_h"]
    lines = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.col("h").alias("_h"), "line")
    found = detections(lines, keys).groupBy(*keys).agg(F.collect_set("label").alias("_more"), F.min("tier").alias("_tier"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = base.join(found.hint("shuffle_merge"), (key == F.col("_k")) & (F.col("h") == F.col("_h")), "left")
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    sure = F.lit(0.0)
    for tier in sorted(SURE, reverse=True):
        sure = F.when(F.col("_tier") == tier, F.lit(SURE[tier])).otherwise(sure)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"), joined(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))).alias("labels"), F.greatest(sure, F.when(F.col("n_base") > 0, F.lit(SURE[2])).otherwise(0.0)).alias("score"))
