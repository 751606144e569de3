"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they occur times their length in code points (long words say more).  For every term and
sample number, hashes give two gamma(2, 1) values r and c and a uniform b; with weight w the sample's
key is  t = floor(ln w / r + b),  ln a = ln c - r (t - b) - r.  The term with the least a is the sample, and
as a is a function of term and t, the least value itself stands for it.  Two texts agree in a sample with
the generalised Jaccard similarity of their weighted terms, the sum of the smaller weights through the sum of
the larger, so the share of ``SAMPLES`` samples in which they agree has a standard error of at most 0.09.

Everything is DataFrame expressions: terms are exploded and each document's samples are ``min``
aggregates over doubles, merged before any exchange.

Cases: null text is empty; texts without terms have a fingerprint of zeros, which is like itself alone;
a null doc_id comes last in descending order; rows that repeat in doc_id and text count once in that
order and all get its values, and texts that share a doc_id follow each other by their hashes; very long texts
are read whole; a table of one document is its own next; an empty table gives an empty one; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.storage import written

SAMPLES = 32
DIGITS = 8
TERM_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_ID = -(2**63)
KEY = ["k", "h"]


def terms(text: Column) -> Column:
    """Lower-case terms of a text, each once, with how often it occurs: runs of the sorted terms."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def runs(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: ~F.get(words, i - 1).eqNullSafe(F.get(words, i)))
        return once(ends, lambda at: F.transform(at, lambda e, j: F.struct(F.get(words, e - 1).alias("term"), (e - F.coalesce(F.get(at, j - 1), F.lit(0))).alias("n"))))

    return once(F.sort_array(F.split(F.lower(text), TERM_BREAK)), runs)


def _uniform(bits: Column, shift: int) -> Column:
    """A number in (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) / float(1 << 21)


def sample_value(term_hash: Column, log_weight: Column, i: int) -> Column:
    """ln a of a term in sample ``i``."""
    one, two = F.xxhash64(term_hash, F.lit(2 * i)), F.xxhash64(term_hash, F.lit(2 * i + 1))
    r = -F.ln(_uniform(one, 0) * _uniform(one, 21))
    b = _uniform(one, 42)
    log_c = F.ln(-F.ln(_uniform(two, 0) * _uniform(two, 21)))
    t = F.floor(log_weight / r + b)
    return log_c - r * (t - b) - r


def fingerprints(bodies: DataFrame, keys: list[str], body: str) -> DataFrame:
    """``keys`` and ``fingerprint`` of every body, null where there are no terms; bodies already partitioned by some of the keys are not shuffled."""
    words = bodies.select(*keys, F.explode_outer(terms(F.col(body))).alias("_t"))
    weight = F.nullif(F.char_length("_t.term"), F.lit(0)).cast("double") * F.col("_t.n")
    words = words.select(*keys, F.xxhash64("_t.term").alias("_hash"), F.ln(weight).alias("_weight"))
    least = [F.min(sample_value(F.col("_hash"), F.col("_weight"), i)).alias(f"_s{i}") for i in range(SAMPLES)]
    parts = [F.lpad(F.lower(F.hex(F.xxhash64(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)))), DIGITS, "0") for i in range(SAMPLES)]
    return words.groupBy(*keys).agg(*least).select(*keys, F.when(F.col("_s0").isNotNull(), F.concat(*parts)).alias("fingerprint"))


def likeness(one: Column, two: Column) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = [(F.substring(one, DIGITS * i + 1, DIGITS) == F.substring(two, DIGITS * i + 1, DIGITS)).cast("int") for i in range(SAMPLES)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / float(SAMPLES)


def successors(rows: DataFrame, parts: int) -> DataFrame:
    """``k, h, n, c`` of distinct rows with ``nk, nh`` of the next in descending order, the last followed by the first.

    Rows are dealt to ranges; within a range the next is a window over it, and what follows a range's last
    row comes from a table with one row per range.
    """
    ordered = [F.desc("k"), F.asc("h")]
    dealt = written(rows.repartitionByRange(parts, *ordered).withColumn("p", F.spark_partition_id()), "cws-ranges")
    within = W.partitionBy("p").orderBy(*ordered)
    ends = dealt.groupBy("p").agg(F.min(F.struct(F.bitwise_not("k").alias("x"), "h", "k")).alias("f")).select("p", F.col("f.k").alias("fk"), F.col("f.h").alias("fh"))
    by_range = W.orderBy("p")
    whole = by_range.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("p", F.coalesce(F.lead("fk").over(by_range), F.first("fk").over(whole)).alias("fk"), F.coalesce(F.lead("fh").over(by_range), F.first("fh").over(whole)).alias("fh"))
    joined = dealt.select("*", F.lead("k").over(within).alias("lk"), F.lead("h").over(within).alias("lh")).join(F.broadcast(ends), "p")
    inside = F.col("lk").isNotNull()
    return joined.select("k", "h", "n", "c", F.when(inside, F.col("lk")).otherwise(F.col("fk")).alias("nk"), F.when(inside, F.col("lh")).otherwise(F.col("fh")).alias("nh"))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, and how alike they are."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(body).alias("h"), body.alias("body"))
    narrow = rows.groupBy(*KEY).agg(F.first(F.char_length("body")).alias("n"), F.count("*").alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = written(successors(narrow, parts), "cws-order")
    repeats = order.where("c > 1").limit(1).count() > 0
    if repeats:
        rows = rows.dropDuplicates(KEY)
    wants = order.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("pk"), F.col("h").alias("ph"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    heads = rows.join(wants.hint("shuffle_merge"), KEY).select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.expr("substring(body, 1, take)").alias("head"))
    both = rows.join(heads.hint("shuffle_merge"), KEY)
    edited = F.concat(F.expr("substring(body, 1, char_length(body) - (char_length(body) div 2))"), F.col("head"))
    both = both.select(*KEY, "body", edited.alias("edited"), F.unhex(F.sha2(edited, 256)).alias("sha"))
    two = both.select(*KEY, "sha", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("body").alias("body")), F.struct(F.lit(1).alias("w"), F.col("edited").alias("body")))).alias("v"))
    prints = written(fingerprints(two.select(*KEY, "sha", F.col("v.w").alias("w"), F.col("v.body").alias("body")), [*KEY, "sha", "w"], "body"), "cws-prints")
    zeros = F.lit("0" * (DIGITS * SAMPLES))
    own = prints.where("w = 0").select(*KEY, F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint")
    other = prints.where("w = 1").select(*KEY, F.col("fingerprint").alias("edited_fingerprint"))
    after = prints.where("w = 0").select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("fingerprint").alias("next"))
    out = order.join(own, KEY).join(other, KEY).join(after, ["nk", "nh"], "left")
    out = out.withColumns({c: F.coalesce(c, zeros) for c in ("fingerprint", "edited_fingerprint", "next")})
    if repeats:
        out = out.join(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(body).alias("h")), KEY)
    return out.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
