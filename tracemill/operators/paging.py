"""Keyset pages: filter, order, limit. Catalyst turns each into TakeOrderedAndProject over a pushed-down scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beyond(keys: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Rows that come after `cursor` in the order of `keys` (column, ascending): one predicate for the tied and the later rows."""
    steps = []
    for k, ((name, up), value) in enumerate(zip(keys, cursor, strict=True)):
        later = F.col(name) > F.lit(value) if up else F.col(name) < F.lit(value)
        steps.append(reduce(and_, [F.col(n) == F.lit(v) for (n, _), v in zip(keys[:k], cursor[:k], strict=True)], later))
    return reduce(or_, steps)


def ordered(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc(n) if up else F.desc(n) for n, up in keys]


def page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, most: int, cursor: tuple | None = None, clamp: bool = False) -> DataFrame:
    """At most `limit` rows after the cursor. A limit outside 1..most is an error, or with `clamp` the nearest one inside."""
    if clamp:
        limit = min(max(int(limit), 1), most)
    elif not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    rows = df.where(beyond(keys, cursor)) if cursor else df
    return rows.orderBy(*ordered(keys)).limit(limit)


def page_result(df: DataFrame, keys: list[tuple[str, bool]], limit: int, most: int, cursor: tuple | None = None, clamp: bool = False, size: Column | None = None, budget: int = 32 * 1024 - 256) -> dict:
    """{page, cursor, done} as a reader returns it: one row more than asked is read to know `done`, and rows stop before `budget` bytes.

    A first row that alone exceeds the budget raises, so no reader can loop on an empty page.
    """
    limit = min(max(int(limit), 1), most) if clamp else limit
    rows = page(df, keys, limit, most, cursor)
    more = df.where(beyond(keys, cursor)) if cursor else df
    found = more.orderBy(*ordered(keys)).limit(limit + 1).withColumn("_size", size if size is not None else F.octet_length(F.to_json(F.struct("*")))).collect()
    kept, used = [], 0
    for r in found[:limit]:
        if used + r._size > budget:
            break
        used += r._size
        kept.append(r)
    if found and not kept:
        raise ValueError("a row exceeds the page's bytes")
    last = kept[-1] if kept else None
    done = len(kept) == len(found)
    return {"page": [{c: r[c] for c in rows.columns} for r in kept], "cursor": tuple(last[n] for n, _ in keys) if last else cursor, "done": done}


def pages_by_key(df: DataFrame, key: str, keys: list[tuple[str, bool]], limit: int) -> DataFrame:
    """The first page of every key. Spark limits each group before the exchange, so a hot key moves `limit` rows a task."""
    w = Window.partitionBy(key).orderBy(*ordered(keys))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def fit_bytes(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """Of pages_by_key's rows, those before the running sum of `size` passes `budget`."""
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def clip(name: str, most: int = 128) -> Column:
    return F.substring(name, 1, most)


def clipped_fields(names: list[str], most: int = 128) -> Column:
    """The names of those columns that clip() shortens."""
    return F.array_compact(F.array(*(F.when(F.length(n) > most, F.lit(n)) for n in names)))


def last_of(array: str, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)
