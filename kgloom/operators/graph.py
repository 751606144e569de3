"""The reified property graph: documents, chunks, relations, mentions and entities as nodes, roles as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import ids
from kgloom.functions import text as X

NONE = "map<string,string>"


def _props(**values: Column) -> Column:
    """Properties as text; null ones are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in sorted(values.items())])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def _node(df: DataFrame, key: Column, kind: str, labels: Column, props: Column) -> DataFrame:
    return df.select(key.alias("id"), F.lit(kind).alias("kind"), labels.alias("labels"), props.alias("properties"))


def _edge(df: DataFrame, source: Column, target: Column, kind: Column) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), kind.alias("relation_type"), F.create_map().cast(NONE).alias("properties"))


def document_nodes(documents: DataFrame) -> DataFrame:
    key = F.col("document_id")
    return _node(documents, ids.document_node_id(key), "Document", F.array(F.lit("Document")), _props(document_id=key))


def chunk_nodes(chunks: DataFrame, embed=None) -> DataFrame:
    """Chunks as nodes; ``embed``, which makes vectors of a text column, gives them an embedding."""
    cols = {c: F.col(c) for c in ("document_id", "chunk_index", "text", "start_char", "end_char", "token_count")}
    if embed is not None:
        chunks, cols["embedding"] = chunks.withColumn("_e", embed(F.col("text"))), F.to_json("_e")
    return _node(chunks, F.col("chunk_id"), "Chunk", F.array(F.lit("Chunk")), _props(**cols))


def chunk_edges(chunks: DataFrame) -> DataFrame:
    return _edge(chunks, ids.document_node_id(F.col("document_id")), F.col("chunk_id"), F.lit("HAS_CHUNK"))


def relation_key() -> Column:
    return ids.relation_node_id(F.col("verb"), F.col("target_category"), F.col("description"), F.col("document_id"))


def relation_nodes(relations: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Relations (with ``label``, ``labels``, ``generic``, ``specific``) as nodes; quotes are joined in order."""
    rows, quotes = relations, F.lit(None).cast("string")
    if evidence is not None:
        told = evidence.groupBy("relation_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ev_pos", "quote")))["quote"], "\n---\n").alias("_quotes"))
        rows, quotes = rows.join(told, "relation_id", "left"), F.col("_quotes")
    cols = {c: F.col(c) for c in ("document_id", "description", "confidence", "axis", "verb", "target_category", "definition", "generic", "specific")}
    meta = F.lit(None).cast("map<string,string>") if "metadata" not in rows.columns else F.transform_keys("metadata", lambda k, _: F.concat(F.lit("_meta_"), k))
    props = F.map_concat(_props(**cols, quotes=quotes), F.coalesce(meta, F.create_map().cast(NONE)))
    labels = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("Relation")))
    return _node(rows, relation_key(), "Relation", labels, props)


def extracted_edges(relations: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relation to chunk for evidence in a chunk of its document, else one edge to the document."""
    rows = relations.join(evidence.select("relation_id", "chunk_id"), "relation_id", "left")
    own = chunks.select("document_id", F.col("chunk_id").alias("_c"))
    same = (F.col("chunk_id") == F.col("_c")) & (rows["document_id"] == own["document_id"])
    found = rows.join(own, same, "left_semi")
    rest = relations.join(found.select("relation_id").distinct(), "relation_id", "left_anti")
    kind = F.lit("EXTRACTED_FROM")
    return _edge(found, relation_key(), F.col("chunk_id"), kind).unionByName(_edge(rest, relation_key(), ids.document_node_id(F.col("document_id")), kind))


def role_edges(relations: DataFrame, fillers: DataFrame) -> DataFrame:
    """Relation to entity by role; a relation's id is made once, before it meets its fillers."""
    keys = relations.select("relation_id", relation_key().alias("_r"))
    rows = keys.join(fillers.select("relation_id", "role", ids.entity_id(F.col("label"), F.col("name")).alias("_e")), "relation_id")
    return _edge(rows, F.col("_r"), F.col("_e"), F.upper("role"))


def entity_nodes(fillers: DataFrame, aliases: DataFrame | None = None, embeddings: DataFrame | None = None, embed=None) -> DataFrame:
    """One node per (label, name): the last definition and confidence win; aliases and embedding where there are any."""
    order = F.struct("relation_id", "role_group", "pos")
    rows = fillers.groupBy("label", "name").agg(F.max_by(F.struct("definition", "confidence"), order).alias("d"))
    also = F.lit(None).cast("string")
    if aliases is not None:
        rows = rows.join(aliases.select("label", "name", F.array_join("aliases", ", ").alias("_aliases")), ["label", "name"], "left")
        also = F.col("_aliases")
    vector = F.lit(None).cast("string")
    key = ids.entity_id(F.col("label"), F.col("name"))
    if embed is not None:
        rows = rows.withColumn("_e", embed(X.entity_class_text(F.col("label"), F.col("d.definition"))))
        vector = F.to_json("_e")
    if embeddings is not None:
        rows = rows.withColumn("_id", key).join(embeddings.select(F.col("id").alias("_id"), "embedding"), "_id", "left")
        vector = F.to_json("embedding")
    labels = F.array(F.lit("Entity"), X.sanitize_identifier(F.col("label"), "title"))
    return _node(rows, key, "Entity", labels, _props(label_class=F.col("label"), name=F.col("name"), definition=F.col("d.definition"), confidence=F.col("d.confidence"), aliases=also, embedding=vector))


def mention_nodes(mentions: DataFrame) -> DataFrame:
    cols = {c: F.col(c) for c in ("surface_form", "entity_name", "entity_label", "chunk_id", "role")}
    return _node(mentions, F.col("mention_id"), "Mention", F.array(F.lit("Mention")), _props(**cols))


def mention_edges(mentions: DataFrame, relations: DataFrame, fillers: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """Chunk (else document) to mention, and mention to an entity that its document's relations have.

    ``everything`` has the relations that mentions come from where those of the graph are fewer; mentions of
    refused relations are kept, but refer to an entity only if another relation has it.
    """
    where = mentions.join((everything if everything is not None else relations).select("relation_id", "document_id"), "relation_id")
    holder = F.coalesce("chunk_id", ids.document_node_id(F.col("document_id")))
    held = _edge(where, holder, F.col("mention_id"), F.lit("HAS_MENTION"))
    there = relations.select("relation_id", "document_id").join(fillers.select("relation_id", "label", "name"), "relation_id").select(F.col("document_id").alias("_d"), F.col("label").alias("_l"), F.col("name").alias("_n")).distinct()
    known = where.join(there, (F.col("document_id") == F.col("_d")) & (F.col("entity_label") == F.col("_l")) & (F.col("entity_name") == F.col("_n")), "left_semi")
    return held.unionByName(_edge(known, F.col("mention_id"), ids.entity_id(F.col("entity_label"), F.col("entity_name")), F.lit("REFERS_TO")))


def document_mentions(mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions of each document: by chunk; those without a chunk belong to every document of the batch."""
    by_chunk = mentions.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("mention_id", "document_id")
    loose = mentions.where(F.col("chunk_id").isNull()).select("mention_id", F.lit(1).alias("_one"))
    everywhere = loose.join(documents.select("document_id", F.lit(1).alias("_one")), "_one").select("mention_id", "document_id")
    return by_chunk.unionByName(everywhere)


def build(documents: DataFrame, chunks: DataFrame, relations: DataFrame, fillers: DataFrame, evidence: DataFrame, mentions: DataFrame, aliases: DataFrame | None = None, embed=None, everything: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a batch as one plan; repeated nodes are settled by the sink."""
    nodes = document_nodes(documents)
    for part in (chunk_nodes(chunks, embed), relation_nodes(relations, evidence), entity_nodes(fillers, aliases, embed=embed), mention_nodes(mentions)):
        nodes = nodes.unionByName(part)
    edges = chunk_edges(chunks)
    for part in (extracted_edges(relations, evidence, chunks), role_edges(relations, fillers), mention_edges(mentions, relations, fillers, everything)):
        edges = edges.unionByName(part)
    return nodes, edges
