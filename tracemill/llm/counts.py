"""Token counts without moving text: a broadcast table of frequent pre-token lengths, worker caches for the rest (operator 9).

The first tier holds the lengths of the corpus's most frequent chunks. Every task counts the chunks of its own rows in bounded
memory and hands on one summary of fixed size; summaries are merged a few dozen at a time until one is left, so only summaries are
shuffled, no text and no pre-token by itself, and what reaches the driver has a fixed bound. The second tier is each worker's own bounded cache in front of the
tokenizer. Neither tier changes a count: they only save work.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, groups_of, map_rows, two_columns
from tracemill.llm.tokens import ChunkTable, chunks, vocabulary

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
SUMMARY = pa.schema([("part", pa.int64()), ("summary", pa.binary())])
#: Summaries that one task merges; chunks that a task counts at one time.
FAN, HELD = 32, 300_000

_tables: dict[tuple, ChunkTable] = {}


def _most(counts: Counter, size: int) -> bytes:
    return pickle.dumps(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])


def _merged(blobs: list[bytes]) -> Counter:
    total: Counter = Counter()
    for b in blobs:
        for chunk, n in pickle.loads(b):
            total[chunk] += n
    return total


def frequent_chunks(docs: DataFrame, size: int) -> list[str]:
    """About the `size` most frequent chunks of all texts, from summaries of 2 * size chunks for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for rows in groups_of(batch, "text"):
                for (text,) in rows:
                    found.update(chunks(text))
                while len(found) > HELD:  # lossy counting: what is rare so far goes
                    floor = sorted(found.values())[len(found) // 2]
                    found = Counter({k: n - floor for k, n in found.items() if n > floor})
        found = Counter({k: n for k, n in found.items() if len(k) <= 48})
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "summary": _most(found, 2 * size)}], SUMMARY)

    def merge(table: pa.Table) -> pa.Table:
        parts = [x for _, x in sorted(zip(table["part"].to_pylist(), table["summary"].to_pylist(), strict=True))]
        return pa.Table.from_pylist([{"part": table["part"][0].as_py() // FAN, "summary": _most(_merged(parts), 2 * size)}], SUMMARY)

    left, summaries = docs.rdd.getNumPartitions(), docs.select("text").mapInArrow(count, ddl(SUMMARY))
    while left > 1:
        summaries = summaries.groupBy((F.col("part") / FAN).cast("long").alias("by")).applyInArrow(merge, ddl(SUMMARY))
        left = -(-left // FAN)
    best = _merged([r.summary for r in summaries.collect()])  # one summary, or none of an empty table
    return [k for k, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _counter(path: str, frequent: Broadcast | None):
    v = vocabulary(path)
    whole = lambda text: len(v.whole(text))
    if frequent is None:
        return whole
    key = (path, frequent.id if hasattr(frequent, "id") else id(frequent))
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(whole)
    misses, hot = _tables[key], frequent.value
    length = lambda chunk: n if (n := hot.get(chunk)) else misses[chunk]
    return lambda text: whole(text) if any(s in text for s in v.special) else sum(map(length, chunks(text)))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, table_size: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row, as the file's library counts.

    Null texts count as empty: 0 tokens. Null and repeated ids keep a row each; an empty table gives no row. A tokenizer whose
    pattern isn't known to split like chunks() (sentencepiece, normalizers) gets each text whole.
    """
    docs = two_columns(docs, id_col, text_col)
    v, frequent = vocabulary(tokenizer_path), None
    if v.chunked:
        frequent = docs.sparkSession.sparkContext.broadcast({k: len(v.whole(k)) for k in frequent_chunks(docs, table_size)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path, frequent)

        def row(doc_id: int, text: str) -> tuple:
            n = count(text)
            return doc_id, len(text.encode()), n, n > limit

        yield from map_rows(row, COUNTS, "doc_id", "text")(batches)

    return docs.mapInArrow(run, ddl(COUNTS))
