"""New columns from one column, in Arrow slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of the source column that are worked on together; a longer single value is a slice of its own.
SLICE_BYTES = 1_000_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes in ``column``."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        sizes = pc.multiply(pc.fill_null(pc.list_value_length(values), 0), 4).to_pylist()
    else:
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(df: DataFrame, source: str, made: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``work`` makes of ``source``; columns that have their names are replaced."""
    names = {f.name.lower() for f in made}
    kept = df.select(*[c for c in df.columns if c.lower() not in names or c == source])
    shown = [f for f in kept.schema.fields if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                new = work(part.column(source))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in shown], *new], [*[f.name for f in shown], *[f.name for f in made]])

    return kept.mapInArrow(run, T.StructType([*shown, *made]))
