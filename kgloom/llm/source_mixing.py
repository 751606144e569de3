"""Mixing sources to target weights.

A token budget flows down a domain, language, source tree.  Every node's children share its budget by
weight; a child that cannot use its share (its tokens times the allowed epochs) keeps what it can use
and the rest goes to its siblings.  As a child's limit is that of all leaves below it, what is short in
a leaf is made up by its siblings first and only then by those of its ancestors.

A leaf then takes whole epochs and a prefix of one more, in an order seeded by epoch and document.
Prefixes are found from token sums of hash ranges; the range that the prefix ends in is cut again, ``LEVELS_CUT``
times in all, and only the last, with one of some 17 million parts of a leaf's rows, is summed row by row, so a
source with a third of all rows is never in one task.

All amounts are whole numbers, rounded down at each level.

Cases: null keys are the key ``""``; null and empty texts have no tokens and follow their place in the
order; a leaf without tokens gives nothing; weights that are missing are ``default_weight``, children of
weight 0 get nothing; rows that repeat have the same place and are decided in any order among
themselves; columns that have the names of the new ones are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.storage import written

LEVELS = ("domain", "lang", "source")
#: Leaves up to this many are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 20_000
MADE = ("domain_key", "n_tokens", "copies")
#: Hash digits of one cut, and how often the range that a prefix ends in is cut.
RANGE_DIGITS, LEVELS_CUT = 2, 3


@dataclass(frozen=True)
class MixPlan:
    """Target weights by level and key (whole numbers), budget as a share of all tokens, and limits."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 17
    default_weight: int = 1


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _weight(plan: MixPlan, level: str) -> Column:
    known = plan.weights.get(level, {})
    value = F.lit(plan.default_weight)
    for key in sorted(known, reverse=True):
        value = F.when(F.col(f"_{level}") == key, F.lit(known[key])).otherwise(value)
    return value.cast("long")


def _shared(nodes: DataFrame, parents: list[str], key: str, plan: MixPlan) -> DataFrame:
    """Budget of each child from ``budget`` of its parent: the closed form of filling by weight up to limits."""
    within = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(1))
    by_need = within.orderBy(F.col("cap") / F.col("_w"), F.col(f"_{key}"))
    rows = nodes.withColumn("_w", _weight(plan, key)).where("_w > 0")
    rows = rows.withColumn("_spent", F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_left_w", F.sum("_w").over(by_need.rowsBetween(0, W.unboundedFollowing)))
    full = F.col("cap") * F.col("_left_w") <= F.col("_w") * (F.col("budget") - F.coalesce("_spent", F.lit(0)))
    rows = rows.withColumn("_full", full)
    rest = F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(within)
    open_w = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(within)
    rows = rows.withColumn("_rest", rest).withColumn("_open", open_w)
    return rows.withColumn("given", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(_rest * _w) div _open")))


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """``_domain, _lang, _source, tokens`` to the same with ``given``; one row per leaf throughout."""
    caps = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    keys = [f"_{k}" for k in LEVELS]
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {plan.budget_percent} div 100").alias("budget"))
    nodes = caps.groupBy(keys[0]).agg(F.sum("cap").alias("cap")).join(F.broadcast(total))
    given = _shared(nodes, [], LEVELS[0], plan).select(keys[0], F.col("given").alias("budget"))
    nodes = caps.groupBy(*keys[:2]).agg(F.sum("cap").alias("cap")).join(given, keys[:1])
    given = _shared(nodes, keys[:1], LEVELS[1], plan).select(*keys[:2], F.col("given").alias("budget"))
    return _shared(caps.join(given, keys[:2]), keys[:2], LEVELS[2], plan).select(*keys, "tokens", "given")


def _order(plan: MixPlan, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("_full").cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def mixed(docs: DataFrame, plan: MixPlan, domain: Column, lang: str = "lang", source: str = "source", doc_id: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """The rows that are taken, each with ``n_tokens``, its leaf's ``domain_key`` and how many ``copies`` of it the mix holds."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    keys = [f"_{k}" for k in LEVELS]
    leaf = [F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in zip(keys, (domain, F.col(lang), F.col(source)))]
    narrow = written(docs.select(*leaf, F.col(doc_id).alias("_id"), tokens.alias("_n")), "mix-tokens")
    leaves = written(narrow.groupBy(*keys).agg(F.sum("_n").alias("tokens")), "mix-leaves")
    given = written(leaf_budgets(leaves, plan).where("tokens > 0").select(*keys, F.expr("given div tokens").alias("_full"), F.expr("given % tokens").alias("_rest")), "mix-given")
    small = given.count() <= BROADCAST_LEAVES
    attach = lambda rows, side: rows.join(F.broadcast(side) if small else side, keys)
    ends = given.select("*", F.lit("").alias("_cut"), F.lit(0).cast("long").alias("_before"))
    for level in range(LEVELS_CUT):
        place = F.substring(_order(plan, "_id"), 1, RANGE_DIGITS * (level + 1))
        ranged = attach(narrow, ends).withColumn("_range", place).where(F.startswith("_range", F.col("_cut")))
        sums = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_before").alias("_start"))
        before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        cut = sums.where("_before + _sum > _rest").groupBy(*keys).agg(F.min(F.struct("_range", "_before")).alias("_cut"))
        ends = written(given.join(cut, keys, "left").select(*keys, "_full", "_rest", F.col("_cut._range").alias("_cut"), F.col("_cut._before").alias("_before")), "mix-ends")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *leaf, F.col(doc_id).alias("_id"), tokens.alias("_n"))
    rows = attach(rows, ends).withColumn("_place", _order(plan, "_id")).withColumn("_range", F.substring("_place", 1, RANGE_DIGITS * LEVELS_CUT))
    inside = rows.where(F.col("_range") == F.col("_cut"))
    upto = W.partitionBy(*keys).orderBy("_place", "_id").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("_more", (F.col("_before") + F.sum("_n").over(upto) <= F.col("_rest")).cast("int"))
    outside = rows.where(F.col("_cut").isNull() | (F.col("_range") != F.col("_cut")))
    outside = outside.withColumn("_more", F.when(F.col("_cut").isNull() | (F.col("_range") < F.col("_cut")), 1).otherwise(0))
    out = outside.unionByName(inside).withColumn("copies", (F.col("_full") + F.col("_more")).cast("int")).where("copies > 0")
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in MADE]
    return out.select(*own, F.col("_domain").alias("domain_key"), F.col("_n").alias("n_tokens"), "copies")
