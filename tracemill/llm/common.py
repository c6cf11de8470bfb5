"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that are Python objects at one time.
ROWS = 256


def two_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), a null text as an empty one; other columns go, whatever their names."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def groups_of(batch: pa.RecordBatch, *names: str) -> Iterator[list[tuple]]:
    """The rows of an Arrow batch as lists of at most ROWS tuples, so that long texts aren't all held twice."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield list(zip(*(part.column(n).to_pylist() for n in names), strict=True))


def map_rows(fn: Callable[..., tuple], schema: pa.Schema, *names: str) -> Callable:
    """A function for mapInArrow: one row out for each row in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups_of(batch, *names):
                yield record_batch([fn(*row) for row in rows], schema)

    return run


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_DDL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.int32(): "int", pa.list_(pa.int64()): "array<long>"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


def spare(df: DataFrame, name: str) -> str:
    """`name`, with underscores until `df` has no such column; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
