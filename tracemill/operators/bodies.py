"""Splitting bodies into parts, putting them together again, and expanding blocks into the pieces they were coalesced from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, key: str, body: str, size: int) -> DataFrame:
    """A row for each part of at most `size` units of `body` (characters of a string, bytes of a binary): index, count, offset, total, part. An empty body has one empty part."""
    length = F.length(body)
    count = F.greatest(F.ceil(length / F.lit(size)), F.lit(1)).cast("int")
    parts = df.where(F.col(body).isNotNull()).select(key, body, count.alias("count"), length.alias("total"), F.explode(F.sequence(F.lit(0), count - 1)).alias("index"))
    offset = F.col("index") * size
    return parts.select(key, "index", "count", offset.alias("offset"), "total", F.substring(body, offset + 1, F.lit(size)).alias("part"))


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """The bodies of split() with `whole`: whether every part is there once, at its offset, of the length it must have."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "offset", "part")))
    grouped = parts.groupBy(key).agg(ordered.alias("parts"), F.max("count").alias("count"), F.max("total").alias("total"), F.min("count").alias("least"), F.countDistinct("index").alias("n"))
    texts = F.transform("parts", lambda p: p["part"])
    body = F.array_join(texts, "") if dict(parts.dtypes)["part"] == "string" else F.aggregate(texts, F.lit(b""), lambda a, b: F.concat(a, b))
    even = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, p: F.struct((a["at"] + F.length(p["part"])).cast("int").alias("at"), (a["ok"] & (p["offset"] == a["at"])).alias("ok")))
    whole = (F.col("count") == F.col("least")) & (F.size("parts") == F.col("count")) & (F.col("n") == F.col("count")) & (even["at"] == F.col("total")) & even["ok"]
    return grouped.select(key, "count", body.alias("body"), whole.alias("whole"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often and in whatever lambda it's used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, lengths: Column) -> Column:
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return once(ends, lambda at: F.transform(lengths, lambda n, k: F.substring(text, F.get(at, k) + 1, n)))


def expand_block(block: Column, lengths: Column) -> Column:
    """The pieces of a block whose lengths, one at least, add up to it, else null.

    n pieces are cut from about the root of n stretches, those from the block, so that the work grows with the block times that root. The bound on
    a captured block's pieces is the segment validator's.
    """

    def pieces(b: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(b["lengths"]))).cast("int")
        groups = F.transform(F.sequence(F.lit(1), F.size(b["lengths"]), side), lambda k: F.slice(b["lengths"], k, side))
        return once(groups, lambda gs: F.flatten(F.zip_with(gs, _cut(b["block"], F.transform(gs, lambda g: F.aggregate(g, F.lit(0), lambda a, n: a + n))), lambda g, text: _cut(text, g))))

    def checked(b: Column) -> Column:
        total = F.aggregate(b["lengths"], F.lit(0).cast("long"), lambda a, n: a + n)
        return F.when((F.size(b["lengths"]) > 0) & F.forall(b["lengths"], lambda n: n >= 0) & (total == F.length(b["block"])), pieces(b))

    return once(F.struct(block.alias("block"), lengths.alias("lengths")), checked)
