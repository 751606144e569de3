"""Context for a text from the graph: similar chunks and what hangs on them, or names that the text contains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.config import DomainConfig
from kgloom.operators import chunking, clustering
from kgloom.sources.graph_store import entity_scan, first_rows


def best_chunks(hits: DataFrame, limit: int = 5) -> DataFrame:
    """``match`` with its best score over all query parts, the best ``limit``."""
    return hits.groupBy("match").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "match").limit(limit)


def chunk_context(chunk_ids: DataFrame, nodes: DataFrame, edges: DataFrame, max_entities: int = 30, max_relations: int = 20) -> tuple[DataFrame, DataFrame]:
    """Entities and relations two steps from chunks (chunk, relation, entity); limits are over ids."""
    source = edges.where("relation_type = 'EXTRACTED_FROM'").select(F.col("source_id").alias("relation"), F.col("target_id").alias("chunk"))
    found = source.join(chunk_ids.select(F.col("match").alias("chunk")), "chunk", "left_semi").select("relation").distinct()
    relations = nodes.where((F.col("kind") == "Relation") & F.col("properties")["generic"].isNotNull()).join(found.withColumnRenamed("relation", "id"), "id", "left_semi")
    steps = edges.where("relation_type <> 'EXTRACTED_FROM'").join(found, F.col("source_id") == F.col("relation"), "left_semi").select(F.col("target_id").alias("id")).distinct()
    entities = nodes.where("kind = 'Entity'").join(steps, "id", "left_semi")
    return entities.orderBy("id").limit(max_entities), relations.orderBy("id").limit(max_relations)


def contained_names(documents: DataFrame, entities: DataFrame, limit: int | None = 30, most_words: int = 6) -> DataFrame:
    """``document_id, id, name`` of entities whose name a text contains as words, in any case.

    Names meet texts on runs of words, an equi-join, and the substring is then confirmed.  Longer names meet on
    their first ``most_words`` words.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    names = entities.select("id", "name", words(F.col("name")).alias("w")).where(F.size("w") > 0)
    names = names.select("id", "name", F.least(F.size("w"), F.lit(most_words)).alias("k"), F.array_join(F.slice("w", 1, most_words), " ").alias("gram"))
    sizes = [r["k"] for r in names.select("k").distinct().collect()]  # at most ``most_words`` numbers
    texts = documents.select("document_id", F.lower("text").alias("low"), words(F.col("text")).alias("w"))
    out = None
    for k in sorted(sizes):
        grams = texts.select("document_id", "low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " ")))).alias("gram"))
        hits = grams.select("document_id", "gram").join(names.where(F.col("k") == k), "gram")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return documents.select("document_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")).limit(0)
    found = out.join(documents.select("document_id", F.lower("text").alias("low")), "document_id").where(F.contains("low", F.lower("name"))).select("document_id", "id", "name").distinct()
    if limit is None:
        return found
    return found.withColumn("_n", F.row_number().over(W.partitionBy("document_id").orderBy("id"))).where(F.col("_n") <= limit).drop("_n")


def one_hop(entity_ids: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Relations with an edge to any of the entities."""
    near = edges.join(entity_ids.select(F.col("id").alias("_e")).distinct(), F.col("target_id") == F.col("_e"), "left_semi").select(F.col("source_id").alias("id")).distinct()
    return nodes.where("kind = 'Relation'").join(near, "id", "left_semi").orderBy("id").limit(limit)


def similar_entities(queries: DataFrame, entities: DataFrame, top: int = 5, others: bool = False) -> DataFrame:
    """Known entities closest to any query, each (label, name) once at its best."""
    hits = clustering.neighbours(queries, entities, top, others=others)
    named = hits.join(entities.select(F.col("id").cast("string").alias("match"), "label", "name", "definition"), "match")
    return first_rows(named, ["label", "name"], [F.desc("score"), "id", "match"])


def _shown(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = F.col("properties")
    return (
        entities.select("id", p["name"].alias("name"), p["label_class"].alias("label"), p["definition"].alias("definition")),
        relations.select("id", p["generic"].alias("generic"), p["verb"].alias("verb"), p["description"].alias("description")),
    )


def by_chunks(text: str, nodes: DataFrame, edges: DataFrame, embed, config: DomainConfig) -> tuple[DataFrame, DataFrame]:
    """Known entities and relations by the chunks that are most like those of a text; ``embed`` makes vectors of a text column."""
    spark = nodes.sparkSession
    asked = chunking.chunks(spark.createDataFrame([("query", text)], "document_id string, text string"), config.chunk_tokens, config.chunk_overlap)
    asked = asked.select(F.col("chunk_id").alias("id"), embed(F.col("text")).alias("embedding"))
    held = nodes.where((F.col("kind") == "Chunk") & F.col("properties")["embedding"].isNotNull())
    held = held.select("id", F.from_json(F.col("properties")["embedding"], "array<double>").alias("embedding"))
    best = best_chunks(clustering.neighbours(asked, held, config.max_chunks), config.max_chunks)
    return _shown(*chunk_context(best, nodes, edges, config.max_entities, config.max_relations))


def by_names(text: str, nodes: DataFrame, edges: DataFrame, config: DomainConfig) -> tuple[DataFrame, DataFrame]:
    """Known entities, of the first ``scanned_entities``, whose name is anywhere in a text in any case, and relations one step from them."""
    scanned = entity_scan(nodes, config.scanned_entities)
    found = scanned.where(F.contains(F.lit(text.lower()), F.lower(F.col("properties")["name"]))).orderBy("id").limit(config.max_entities)
    near = one_hop(found, nodes.where(F.col("properties")["generic"].isNotNull()), edges, config.max_relations)
    return _shown(found, near)


def retrieve(text: str, nodes: DataFrame, edges: DataFrame, config: DomainConfig, embed=None) -> tuple[DataFrame, DataFrame]:
    """Context for a text: by chunks where there is an embedder and they give any, else by names."""
    if embed is not None:
        found = by_chunks(text, nodes, edges, embed, config)
        if any(part.limit(1).count() for part in found):
            return found
    return by_names(text, nodes, edges, config)


def contexts(documents: DataFrame, nodes: DataFrame, edges: DataFrame, config: DomainConfig) -> DataFrame:
    """``document_id, text, context`` of a batch: the names route for all documents at once, as text for prompts.

    A document gets the ``max_entities`` first entities that its text names and the ``max_relations`` first relations
    one step from them.
    """
    p = F.col("properties")
    scanned = entity_scan(nodes, config.scanned_entities).select("id", p["name"].alias("name"), p["label_class"].alias("label"))
    named = documents.select("document_id", F.lower("text").alias("low")).join(F.broadcast(scanned), F.contains("low", F.lower("name"))).select("document_id", "id", "name", "label")
    named = named.withColumn("_n", F.row_number().over(W.partitionBy("document_id").orderBy("id"))).where(F.col("_n") <= config.max_entities)
    said = nodes.where((F.col("kind") == "Relation") & p["generic"].isNotNull()).select(F.col("id").alias("source_id"), p["generic"].alias("generic"))
    near = named.join(edges.select("source_id", F.col("target_id").alias("id")), "id").join(said, "source_id").select("document_id", "source_id", "generic").distinct()
    near = near.withColumn("_n", F.row_number().over(W.partitionBy("document_id").orderBy("source_id"))).where(F.col("_n") <= config.max_relations)
    lines = named.select("document_id", F.lit(0).alias("part"), F.col("_n"), F.concat(F.lit("- "), "name", F.lit(" ("), "label", F.lit(")")).alias("line"))
    lines = lines.unionByName(near.select("document_id", F.lit(1).alias("part"), "_n", F.concat(F.lit("- "), "generic").alias("line")))
    told = lines.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "_n", "line")))["line"], "\n").alias("context"))
    return documents.select("document_id", "text").join(told, "document_id", "left").select("document_id", "text", F.coalesce("context", F.lit("")).alias("context"))


def prompt_text(entities: DataFrame, relations: DataFrame, limit: int = 50) -> DataFrame:
    """A context (as ``retrieve`` gives it) as one text: the first definition of each label, then each verb with up to two examples, ``limit`` of each."""
    e = first_rows(entities.where(F.trim("label") != ""), ["label"], ["id"]).orderBy("label").limit(limit)
    e = e.select(F.concat(F.lit("- "), "label", F.when(F.trim(F.coalesce("definition", F.lit(""))) != "", F.concat(F.lit(": "), "definition")).otherwise(F.lit(""))).alias("line"))
    r = relations.where(F.trim("verb") != "").groupBy("verb").agg(F.slice(F.array_sort(F.collect_set(F.substring(F.coalesce("generic", "description"), 1, 160))), 1, 2).alias("x")).orderBy("verb").limit(limit)
    r = r.select(F.concat(F.lit("- "), "verb", F.lit(": "), F.array_join("x", "; ")).alias("line"))
    both = e.select(F.lit(0).alias("part"), "line").unionByName(r.select(F.lit(1).alias("part"), "line"))
    return both.agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "line")))["line"], "\n").alias("text"))
