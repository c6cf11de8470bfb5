"""Decisions that depend on the last accepted row, so that no window can make them: streamed in order within a key, in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def streamed(df: DataFrame, key: str, order: list[str], step: Callable, schema: str, start: Callable[[], dict], end: Callable | None = None) -> DataFrame:
    """step(state, row) gives rows out (dicts), for each row of a key in order; end(state, key) too, after its last row. Spark sorts and spills; a task holds one state."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if state is None or row[key] != now:
                    out += end(state, now) if state is not None and end else []
                    now, state = row[key], start()
                out += step(state, row)
            yield _batch(out, names, target)
        if state is not None and end:
            yield _batch(end(state, now), names, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in names], schema=schema)


def coalesced_health(posts: DataFrame, key: str, micros: str, losses: str, boot: str, tie: str, seconds: int = 60) -> DataFrame:
    """The posts that are stored: of a new boot, with other losses than the stored one, or `seconds` after it."""

    def step(state: dict, row: dict) -> list[dict]:
        old = state.get("stored")
        if old is not None and row[boot] == old[boot] and row[losses] == old[losses] and row[micros] - old[micros] < seconds * 1_000_000:
            return []
        state["stored"] = row
        return [{"key": row[key], "id": row[tie]}]

    return streamed(posts, key, [micros, tie], step, "key long, id long", dict)


def coalesced_blocks(rows: DataFrame, key: str, order: list[str], size: str, micros: str, most_bytes: int = 64 << 10, most: int = 1024, age_us: int = 900_000) -> DataFrame:
    """Callbacks put together until a block would pass `most_bytes`, has `most` pieces, or is `age_us` old: a row for each block."""

    def flush(state: dict, k: object) -> list[dict]:
        out = [{"key": k, "block": state["n"], "pieces": state["pieces"], "bytes": state["bytes"]}] if state.get("pieces") else []
        state |= {"n": state.get("n", 0) + bool(out), "pieces": 0, "bytes": 0, "since": None}
        return out

    def step(state: dict, row: dict) -> list[dict]:
        out = []
        if state["pieces"] and (state["bytes"] + row[size] > most_bytes or state["pieces"] >= most or row[micros] - state["since"] >= age_us):
            out = flush(state, row[key])
        state |= {"pieces": state["pieces"] + 1, "bytes": state["bytes"] + row[size], "since": row[micros] if state["since"] is None else state["since"]}
        return out

    return streamed(rows, key, order, step, "key long, block long, pieces long, bytes long", lambda: {"n": 0, "pieces": 0, "bytes": 0, "since": None}, flush)


def admission_losses(rows: DataFrame, key: str, order: list[str], size: str, budget: int, drain: int) -> DataFrame:
    """Which observations a queue of `budget` bytes, drained by `drain` bytes before each arrival, must drop; losses add up and stay."""

    def step(state: dict, row: dict) -> list[dict]:
        state["held"] = max(0, state["held"] - drain)
        dropped = state["held"] + row[size] > budget
        state["lost"] += row[size] if dropped else 0
        state["held"] += 0 if dropped else row[size]
        return [{"key": row[key], "id": row[order[-1]], "dropped": dropped, "lost_bytes": state["lost"]}]

    return streamed(rows, key, order, step, "key long, id long, dropped boolean, lost_bytes long", lambda: {"held": 0, "lost": 0})
