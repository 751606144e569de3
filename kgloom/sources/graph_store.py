"""A graph kept as two tables, with idempotent upserts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom import schema


class GraphSink(Protocol):
    """Anything that takes nodes and edges."""

    def export(self, nodes: DataFrame, edges: DataFrame) -> None: ...

    def clear(self) -> None: ...


#: Batch and place in it.
SEQUENCE = "_seq STRUCT<v: BIGINT, row: BIGINT>"


def merged_nodes(rows: DataFrame) -> DataFrame:
    """Nodes by id from rows with a sequence ``_seq``: properties of later rows win, those they lack stay; kind and labels are those of the last row.

    Only rows of one id meet, and they meet after a map-side reduction to key, value and sequence.
    """
    props = rows.select("id", "_seq", F.explode("properties").alias("k", "v")).where(F.col("v").isNotNull())
    props = props.groupBy("id", "k").agg(F.max(F.struct("_seq", "v")).alias("last"))
    props = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("last.v").alias("v"))))).alias("properties"))
    heads = rows.groupBy("id").agg(F.max(F.struct("_seq", "kind", "labels")).alias("h"))
    none = F.create_map().cast("map<string,string>")
    return heads.join(props, "id", "left").select("id", "h.kind", "h.labels", F.coalesce("properties", none).alias("properties"))


def merged_edges(rows: DataFrame) -> DataFrame:
    """Edges by both ends and type, with the properties of the last."""
    shown = F.to_json(F.array_sort(F.map_entries("properties")))
    return rows.groupBy("source_id", "target_id", "relation_type").agg(F.max_by("properties", F.struct("_seq", shown)).alias("properties"))


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def upserted_nodes(old: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Old nodes with new ones merged in by ``order``."""
    return merged_nodes(old.withColumn("_seq", F.lit(-1).cast("long")).unionByName(new.withColumn("_seq", order.cast("long"))))


def upserted_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Old edges with new ones merged in; a new edge with an end that is no node is dropped."""
    return merged_edges(old.withColumn("_seq", F.lit(0)).unionByName(with_known_ends(new, nodes).withColumn("_seq", F.lit(1))))


class ParquetGraph:
    """A graph as a base and the batches since, under one folder.

    A batch is written as it is, so an export costs what the batch has, and is complete once its marker is
    there; a failed export leaves the last state.  Reading merges the base with later batches, of which
    there are at most ``keep`` before a compaction writes a new base and removes what it replaces.  In a batch
    the later of rows with one id, by ``order``, wins.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 16):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self, kind: str) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return sorted(int(n.removeprefix(f"{kind}-")) for n in names if n.startswith(f"{kind}-"))

    def version(self) -> int:
        return max([*self._numbers("done"), *self._numbers("base")], default=0)

    def _table(self, name: str, ddl: str) -> DataFrame:
        base = max(self._numbers("base"), default=0)
        numbers = [n for n in self._numbers("done") if n > base]
        paths = [f"{self.folder}/{name}-base-{base}"] * (base > 0) + [f"{self.folder}/{name}-{n}" for n in numbers]
        return self.spark.read.schema(f"{ddl}, {SEQUENCE}").parquet(*paths) if paths else self.spark.createDataFrame([], f"{ddl}, {SEQUENCE}")

    def read(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, each once."""
        return merged_nodes(self._table("nodes", schema.NODES)), merged_edges(self._table("edges", schema.EDGES))

    def export(self, nodes: DataFrame, edges: DataFrame, order: Column | None = None) -> None:
        """Add a batch; edges with an end that no node, old or new, has are left out."""
        v = self.version() + 1
        place = lambda row: F.struct(F.lit(v).cast("long").alias("v"), row.cast("long").alias("row")).alias("_seq")
        row = F.monotonically_increasing_id() if order is None else order
        nodes.select(*[f.split()[0] for f in schema.NODES.split(", ")], place(row)).write.mode("overwrite").parquet(f"{self.folder}/nodes-{v}")
        new = self.spark.read.schema(f"{schema.NODES}, {SEQUENCE}").parquet(f"{self.folder}/nodes-{v}")
        known = self._table("nodes", schema.NODES).select("id").unionByName(new.select("id")).distinct()
        held = with_known_ends(edges, known).select(*[f.split()[0] for f in schema.EDGES.split(", ")], place(F.monotonically_increasing_id()))
        held.write.mode("overwrite").parquet(f"{self.folder}/edges-{v}")
        self._fs().create(self._path(f"done-{v}")).close()
        if len([n for n in self._numbers("done") if n > max(self._numbers("base"), default=0)]) > self.keep:
            self.compact()

    def compact(self) -> None:
        """Merge base and batches into a new base and remove them."""
        v, old = self.version(), [*[("done", n) for n in self._numbers("done")], *[("base", n) for n in self._numbers("base")]]
        nodes, edges = self.read()
        place = F.struct(F.lit(v).cast("long").alias("v"), F.lit(-1).cast("long").alias("row"))
        nodes.withColumn("_seq", place).write.mode("overwrite").parquet(f"{self.folder}/nodes-base-{v}")
        edges.withColumn("_seq", place).write.mode("overwrite").parquet(f"{self.folder}/edges-base-{v}")
        self._fs().create(self._path(f"base-{v}")).close()
        for kind, n in old:
            if (kind, n) != ("base", v):
                self._fs().delete(self._path(f"{kind}-{n}"), True)
                for name in ("nodes", "edges"):
                    self._fs().delete(self._path(f"{name}-base-{n}" if kind == "base" else f"{name}-{n}"), True)

    def clear(self) -> None:
        self._fs().delete(self._path(""), True)

    def uploaded(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """A check of an export: how many distinct nodes and edges were given, and how many of them the graph holds."""
        held, links = self.read()
        ends = ["source_id", "target_id", "relation_type"]
        given, drawn = nodes.select("id").distinct(), edges.select(*ends).distinct()
        counts = [
            given.agg(F.count("*").alias("nodes_given")),
            given.join(held, "id", "left_semi").agg(F.count("*").alias("nodes_held")),
            drawn.agg(F.count("*").alias("edges_given")),
            drawn.join(links, ends, "left_semi").agg(F.count("*").alias("edges_held")),
        ]
        out = counts[0]
        for c in counts[1:]:
            out = out.join(F.broadcast(c))
        return out


def entity_scan(nodes: DataFrame, limit: int) -> DataFrame:
    """The first named entities by id."""
    return nodes.where((F.col("kind") == "Entity") & F.col("properties")["name"].isNotNull()).orderBy("id").limit(limit)


def entity_catalogue(nodes: DataFrame, limit: int = 2000) -> DataFrame:
    """Distinct names, labels and definitions of entities."""
    rows = nodes.where(F.col("kind") == "Entity").select(F.col("properties")["name"].alias("name"), F.col("properties")["label_class"].alias("label"), F.col("properties")["definition"].alias("definition"))
    return rows.distinct().orderBy("label", "name", "definition").limit(limit)


def label_groups(nodes: DataFrame) -> DataFrame:
    """Nodes per set of labels, as batches are written."""
    return nodes.groupBy(F.array_join(F.array_sort("labels"), ":").alias("label_set")).agg(F.count("*").alias("n"))


def first_of_few(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``first_rows`` for few keys, however many rows each has: a row for a key leaves each task, and nothing is sorted.

    An aggregate over texts alone would sort its rows; next to a collected set, which has to be asked for, it hashes them.
    """
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"), F.collect_set(F.lit(None).cast("int")).alias("_none"))
    return found.where(F.size("_none") == 0).select(*keys, *[F.col("_f")[c].alias(c) for c in rest])


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
