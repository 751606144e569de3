"""Document and event sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import schema
from kgloom.functions import text as X


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """Documents given by the caller."""
    return spark.createDataFrame(list(rows), schema.DOCUMENTS)


def from_parquet(spark: SparkSession, path: str, document_id: Column | str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Documents of a table; only the columns named are read."""
    rows = spark.read.parquet(path)
    key = F.col(document_id) if isinstance(document_id, str) else document_id
    pairs = [x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(key.cast("string").alias("document_id"), F.col(text).alias("text"), held.alias("metadata"))


def from_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, its path the id."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("document_id"), F.col("value").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"))


def history_events(history: DataFrame, events: DataFrame, record: Column, fields: list[str], limit: int, order: list[str]) -> DataFrame:
    """Events of a record's history whose field is one of ``fields``; the limit is over a stated order."""
    joined = history.join(events, "event_id").where(record & F.col("field").isin(fields))
    return joined.orderBy(*order).limit(limit)


def with_object_paths(events: DataFrame, path: str = "path") -> DataFrame:
    """Bucket and key of stored bodies; rows without a path are left out."""
    return events.where(F.col(path).isNotNull()).withColumn("object", X.object_path(F.col(path))).select("*", "object.*").drop("object")


def find_by_name(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """The first row, by name, that a case-insensitive LIKE pattern fits."""
    return rows.where(F.col(column).ilike(pattern)).orderBy(column).limit(1)


def catalog_schema(spark: SparkSession, database: str = "default") -> DataFrame:
    """Tables and columns of a catalog database, one row per column."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING, data_type STRING, is_nullable BOOLEAN")


def column_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of tables, in the form of ``catalog_schema``."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING, data_type STRING, is_nullable BOOLEAN")


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, target_table, target_column``: columns whose values are all among the values of a unique column of another table that has the same name behind its prefix.

    Files and catalogs without constraints tell no keys, so they are read off the data: uniqueness by counts,
    inclusion by an anti-join for each pair of columns that share a name and a type.
    """
    tail = lambda c: c.split("_", 1)[-1]
    spark = next(iter(tables.values())).sparkSession
    unique = set()
    for t, df in tables.items():
        names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "string")]
        row = df.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in names]).first()
        unique |= {(t, c) for c in names if row["_n"] and row[c] == row["_n"]}
    found = []
    for t, df in tables.items():
        for f in df.schema.fields:
            for other, key in sorted(unique):
                if other != t and tail(key) == tail(f.name):
                    held = tables[other].select(F.col(key).alias("_k"))
                    lone = df.where(F.col(f.name).isNotNull()).join(held, F.col(f.name) == F.col("_k"), "left_anti")
                    if not lone.limit(1).count():
                        found.append((t, f.name, other, key))
    return spark.createDataFrame(found, "table_name STRING, column_name STRING, target_table STRING, target_column STRING")


def enumerations(tables: dict[str, DataFrame], most: int = 10, rows_each: int = 2) -> DataFrame:
    """``table_name, column_name, enum_name, value``: text columns of at most ``most`` values, each on ``rows_each`` rows on average at least."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "table_name STRING, column_name STRING, enum_name STRING, value STRING")
    for t, df in tables.items():
        names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        if names:
            row = df.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in names]).first()
            for c in names:
                if 0 < row[c] <= most and row["_n"] >= rows_each * row[c]:
                    values = df.where(F.col(c).isNotNull()).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(f"{t}_{c}").alias("enum_name"), F.col(c).alias("value")).distinct()
                    out = out.unionByName(values)
    return out
