"""Shared storage for intermediate tables.

Lineage is cut by writing a table under the shared folder (``spark.checkpoint.dir``): executors can be lost
and every other executor and the driver still see the files.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from kgloom.sources.shared import fresh_path

#: Bytes of an Arrow batch while a table is written; both a task's JVM and its Python worker hold some copies of a batch.
BATCH_BYTES = "6m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded size for the jobs run inside; the session's own setting comes back."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut in the lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more, and let Spark free the shuffle files of finished stages."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        collect_garbage(tables[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Free what the driver no longer needs, in Python and in the JVM."""
    gc.collect()
    spark._jvm.System.gc()
