"""Micro-batches into a graph: each batch is upserted once, whatever is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import ids
from kgloom.sources.graph_store import ParquetGraph
from kgloom.sources.shared import fresh_path


FILES = 3


def event_elements(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and event types as entities, events as edges between them."""
    none = F.create_map().cast("map<string,string>")
    part = lambda label, name: batch.select(ids.entity_id(F.lit(label), name).alias("id"), F.lit("Entity").alias("kind"), F.array(F.lit("Entity"), F.lit(label)).alias("labels"), F.create_map(F.lit("label_class"), F.lit(label), F.lit("name"), name).alias("properties"))
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    nodes = part("User", user).unionByName(part("EventType", kind)).dropDuplicates(["id"])
    edges = batch.select(ids.entity_id(F.lit("User"), user).alias("source_id"), ids.entity_id(F.lit("EventType"), kind).alias("target_id"), F.upper("event_type").alias("relation_type"), none.alias("properties")).dropDuplicates(["source_id", "target_id", "relation_type"])
    return nodes, edges


def ingest(stream: DataFrame, graph: ParquetGraph, elements, checkpoint: str, watermark: tuple[str, str] | None = None):
    """A query that upserts every micro-batch; batches that are run again change nothing."""
    if watermark:
        stream = stream.withWatermark(*watermark)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            graph.export(*elements(batch))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, time: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide or size), key).agg(F.count("*").alias("n"))


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of several files into a fresh graph; how many edges of each type it ends with."""
    base = fresh_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(FILES).write.parquet(f"{base}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    graph = ParquetGraph(spark, f"{base}/graph")
    ingest(stream, graph, event_elements, f"{base}/checkpoint").awaitTermination()
    return graph.read()[1].groupBy("relation_type").agg(F.count("*").alias("n"))
