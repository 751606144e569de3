"""Operators over event records: clusters, classification, the earlier event graph, consistency, schema graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import ids
from kgloom.sources.graph_store import first_rows

NONE = "map<string,string>"


def cluster_events(assignments: DataFrame) -> DataFrame:
    """Events of each cluster, from each event's list of clusters."""
    return assignments.select("event_id", F.explode("clusters").alias("cluster")).groupBy("cluster").agg(F.array_sort(F.collect_list("event_id")).alias("events"))


def classified(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each event with the clusters whose rule holds."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return events.withColumn("clusters", hits)


def event_graph(events: DataFrame, fields: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    """The earlier graph: event, relation and entity nodes; EXTRACTED_FROM, SUBJECT_TO and OBJECT_OF edges; the first of repeated nodes stays."""
    subject, verb, target = (F.col(f).cast("string") for f in fields)
    key = F.col("event_id").cast("string")
    rows = events.select(
        "event_id",
        ids.content_id({"event": key}).alias("event_node"),
        ids.content_id({"event": key, "object": target, "subject": subject, "verb": verb}).alias("relation_node"),
        ids.content_id({"name": subject}).alias("subject_node"),
        ids.content_id({"name": target}).alias("object_node"),
        subject.alias("s"),
        verb.alias("v"),
        target.alias("o"),
    )
    part = lambda key, kind, name: rows.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), "event_id")
    nodes = part("event_node", "Event", "event_id").unionByName(part("relation_node", "Relation", "v")).unionByName(part("subject_node", "Entity", "s")).unionByName(part("object_node", "Entity", "o"))
    nodes = first_rows(nodes, ["id"], ["event_id", "kind", "name"]).select("id", "kind", "name")
    edge = lambda a, b, kind: rows.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("relation_type"))
    edges = edge("relation_node", "event_node", "EXTRACTED_FROM").unionByName(edge("subject_node", "relation_node", "SUBJECT_TO")).unionByName(edge("object_node", "relation_node", "OBJECT_OF"))
    return nodes, edges.distinct()


def inconsistent(events: DataFrame, results: DataFrame, checked: list[str], key: str = "event_id") -> DataFrame:
    """Keys whose result is missing or differs in a checked column, and which."""
    right = results.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in checked])
    rows = events.join(right, key, "left")
    wrong = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in checked]
    found = F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*wrong)))
    return rows.select(key, found.alias("problems")).where(F.size("problems") > 0)


def parsed_time(text: Column) -> Column:
    """ISO times with an offset; null for others."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def stamped(rows: DataFrame, metadata: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return rows.withColumn("metadata", F.create_map(*pairs))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A fixed sample: the rows with the smallest seeded hashes."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def schema_graph(columns: DataFrame, keys: DataFrame, enums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables as nodes with their columns, foreign keys and enumerations as edges."""
    tables = columns.groupBy("table_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_name", "data_type")))).alias("properties"))
    nodes = tables.select(F.col("table_name").alias("id"), F.lit("Class").alias("kind"), "properties")
    values = enums.groupBy("enum_name").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))
    nodes = nodes.unionByName(values.select(F.col("enum_name").alias("id"), F.lit("Enum").alias("kind"), F.create_map(F.lit("values"), "values").alias("properties")))
    edges = keys.select(F.col("table_name").alias("source_id"), F.col("target_table").alias("target_id"), F.lit("RELATES_TO").alias("relation_type"), F.col("column_name").alias("via"))
    has = enums.select("table_name", "enum_name", "column_name").distinct().select(F.col("table_name").alias("source_id"), F.col("enum_name").alias("target_id"), F.lit("HAS_ENUM").alias("relation_type"), F.col("column_name").alias("via"))
    return nodes, edges.unionByName(has)


def cluster_types(assignments: DataFrame) -> DataFrame:
    """Lookup from cluster to its sorted types."""
    return assignments.groupBy("cluster").agg(F.array_sort(F.collect_set("label")).alias("types"))


def memoised(prompts: DataFrame, memo: DataFrame | None, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers by prompt hash: known ones from the memo table, the others from ``answer``."""
    keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    if memo is None:
        return answer(keyed)
    old = memo.select("prompt_hash", "answer")
    return keyed.join(old, "prompt_hash").unionByName(answer(keyed.join(old, "prompt_hash", "left_anti")))


def sub_clusters(items: DataFrame, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Clusters split again; items for which the splitter gives nothing keep their cluster."""
    fine = split(items).select("id", F.col("cluster").alias("sub"))
    return items.join(fine, "id", "left").withColumn("sub_cluster", F.concat_ws("/", "cluster", "sub")).drop("sub")


def table_struct(spark: SparkSession, columns: DataFrame, table: str):
    """The schema of a reflected table as a type."""
    from pyspark.sql import types as T

    rows = columns.where(F.col("table_name") == table).orderBy("column_name").collect()
    return T.StructType.fromDDL(", ".join(f"`{r['column_name']}` {r['data_type']}" for r in rows))
