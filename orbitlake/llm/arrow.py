"""Small helpers for ``mapInArrow`` operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def give_back() -> None:
    """Return freed memory to the system: workers live on from task to task, and what their allocators hold counts as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def add_columns(df: DataFrame, schema: T.StructType, compute: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` plus the columns of ``schema``, computed batch by batch; a column of the same name is replaced."""
    names = {f.name.lower() for f in schema}
    kept = [f for f in df.schema if f.name.lower() not in names]
    out = T.StructType([*kept, *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            made = [a.cast(f.type) if a.type != f.type else a for a, f in zip(compute(batch), target, strict=True)]
            columns = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in names]
            yield pa.RecordBatch.from_arrays([*[c for _, c in columns], *made], names=[*[n for n, _ in columns], *target.names])
        give_back()

    return df.mapInArrow(run, out)


def rows_to_rows(df: DataFrame, schema: T.StructType, step: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, pa.Array]]]) -> DataFrame:
    """A partition-wise operator: ``step`` turns batches into dicts of equally long arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for made in step(batches):
            arrays = [made[f.name] if isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(made[f.name]) for f in target]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target, strict=True)], names=target.names)
        give_back()

    return df.mapInArrow(run, schema)
