"""Relations, their role fillers, and the predicates that make them valid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.config import AXES, MIN_QUOTE, ROLE_GROUPS, ROLES
from kgloom.functions import text as X
from kgloom.sources.graph_store import first_rows

FILLER = ("label", "name", "definition", "confidence")


def filler(role: str, label: Column, name: Column, definition: Column | None = None, confidence: Column | None = None, pos: int = 0) -> Column:
    """One role filler as a struct, for ``role_fillers``."""
    return F.struct(
        F.lit(ROLE_GROUPS[role]).alias("role_group"),
        F.lit(role).alias("role"),
        F.lit(pos).alias("pos"),
        label.alias("label"),
        name.alias("name"),
        (F.concat(label, F.lit(" entity.")) if definition is None else definition).alias("definition"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
    )


def role_fillers(relations: DataFrame, fillers: Iterable[Column], relation_id: str = "relation_id") -> DataFrame:
    """The long table of role fillers of relations; null structs are roles a relation has not."""
    parts = F.array_compact(F.array(*fillers))
    return relations.select(F.col(relation_id).alias("relation_id"), F.inline(parts))


def cardinalities(fillers: DataFrame) -> DataFrame:
    """How often each relation fills each role; one pass with map-side partial sums."""
    return fillers.groupBy("relation_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ROLES])


def has_required_roles(counts: DataFrame, strict: bool = False) -> Column:
    """At least one agent and one theme; ``strict`` also asks for a circumstance and a context."""
    needed = (F.col("agent") >= 1) & (F.col("theme") >= 1)
    circumstances = sum((F.col(r) for r in ("purpose", "reason", "instrument", "beneficiary")), F.col("trigger"))
    return needed & (circumstances >= 1) & (F.col("context") >= 1) if strict else needed


def valid_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0, 1), F.lit(False))


def valid_axis(axis: Column) -> Column:
    return F.coalesce(axis.isin(*AXES), F.lit(False))


def valid_quote(quote: Column) -> Column:
    """Length counts before trimming."""
    return F.coalesce(F.length(quote) >= MIN_QUOTE, F.lit(False))


def stands_in(text: Column, quote: Column) -> Column:
    """Whether a text contains a quote, spaces around it apart; null where either is missing."""
    return F.contains(text, X.trimmed(quote))


def verbatim(text: Column, quote: Column) -> Column:
    """A quote stands in a text; texts that are empty or missing contradict nothing."""
    return F.coalesce(stands_in(text, quote), F.lit(True)) | (F.coalesce(text, F.lit("")) == "")


def without_generic(relations: DataFrame, fillers: DataFrame, blocklist: Iterable[str]) -> DataFrame:
    """Relations none of whose fillers has a label of the blocklist, in any case."""
    blocked = fillers.where(F.lower("label").isin(*[w.lower() for w in blocklist])).select("relation_id").distinct()
    return relations.join(blocked, "relation_id", "left_anti")


def with_roles(raw: DataFrame, fillers: DataFrame) -> DataFrame:
    """Relations joined to their fillers; a relation without any is dropped."""
    order = F.struct("role_group", "pos")
    first = lambda role: F.min_by(F.struct(*FILLER), F.when(F.col("role") == role, order)).alias(f"first_{role}")
    heads = fillers.groupBy("relation_id").agg(first("agent"), first("theme"), F.count("*").alias("n_fillers"))
    return raw.join(heads, "relation_id")


def described(relations: DataFrame) -> DataFrame:
    """Label, generic, specific and embedding texts of relations with ``first_agent`` and ``first_theme``."""
    rows = relations.withColumn("label", X.relation_label(F.col("verb"), F.col("target_category")))
    agent, theme = F.col("first_agent"), F.col("first_theme")
    rows = rows.withColumn("generic", X.generic_text(agent["label"], F.col("label"), theme["label"]))
    rows = rows.withColumn("specific", X.specific_text(agent["label"], agent["name"], F.col("label"), theme["label"], theme["name"]))
    rows = rows.withColumn("to_embed", X.relation_text(F.col("generic"), F.col("definition")))
    return rows.withColumn("labels", F.array(F.upper("verb"), "label"))


def raw_text(relations: DataFrame) -> DataFrame:
    """The text by which a relation without roles is embedded."""
    return relations.withColumn("to_embed", X.relation_text(X.relation_label(F.col("verb"), F.col("target_category")), F.col("definition")))


def evidence_chunks(evidence: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of each quote: the first of the document that contains it, else the one with the longest prefix of it (ties: the first).

    Prefixes are measured only for quotes that no chunk contains.
    """
    quotes = evidence.join(relations.select("relation_id", "document_id"), "relation_id").select("relation_id", "ev_pos", "document_id", X.trimmed(F.col("quote")).alias("quote"))
    keys = ["relation_id", "ev_pos"]
    pairs = quotes.join(chunks.select("document_id", "chunk_id", "chunk_index", "text"), "document_id")
    exact = pairs.where(F.contains("text", "quote")).groupBy(*keys).agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    rest = pairs.join(exact, keys, "left_anti").withColumn("overlap", X.overlap_prefix(F.col("text"), F.col("quote")))
    best = rest.groupBy(*keys).agg(F.max_by("chunk_id", F.struct("overlap", -F.col("chunk_index"))).alias("chunk_id"))
    return exact.select(*keys, "chunk_id", F.lit(True).alias("is_exact")).unionByName(best.select(*keys, "chunk_id", F.lit(False).alias("is_exact")))


def of_documents(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations of the given documents."""
    return relations.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def with_document(relations: DataFrame, true_id: Column) -> DataFrame:
    """Relations under the id of the document that they were found in, whatever they say themselves."""
    return relations.withColumn("document_id", true_id.cast("string"))


def relation_chunk(evidence: DataFrame) -> DataFrame:
    """The chunk of each relation's first piece of evidence."""
    return evidence.groupBy("relation_id").agg(F.min_by("chunk_id", "ev_pos").alias("chunk_id"))


def relevant(rows: DataFrame, criteria: Iterable[Column]) -> DataFrame:
    """Rows for which none of the criteria holds; a null criterion does not hold."""
    hit = F.lit(False)
    for c in criteria:
        hit = hit | F.coalesce(c, F.lit(False))
    return rows.where(~hit)


def flagged_relevant(rows: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Rows whose flag is true; no flag is false."""
    return rows.join(flags, key, "left").where(F.coalesce("is_relevant", F.lit(False))).drop("is_relevant")


def compound(description: Column) -> Column:
    """Descriptions that join several statements."""
    return F.regexp_like(F.lower(description), F.lit(r"(?U)\b(and|or|then|while|whereas|as well as)\b")) & (F.regexp_count(F.lower(description), F.lit(r"(?U)\b\w+(ed|es|ing)\b")) >= 2)


def deduplicated(fillers: DataFrame) -> DataFrame:
    """Each entity (label, name) once, as first filled."""
    return first_rows(fillers, ["label", "name"], ["relation_id", "role_group", "pos"])
