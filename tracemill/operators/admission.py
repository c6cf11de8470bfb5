"""Exactly-once admission: first wins, differing redeliveries are variants, receipts tell duplicates from conflicts.

Aggregates with map-side combination are used in place of windows wherever a key may be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, "first.*")


def variants(df: DataFrame, keys: list[str], digest: str, order: str, inline: int = 8) -> DataFrame:
    """For each key the first digest, how many other digests came later, and the first `inline` of these in order of arrival."""
    each = df.groupBy(*keys, digest).agg(F.min(order).alias("arrived"))
    firsts = each.groupBy(*keys).agg(F.min(F.struct("arrived", digest)).alias("first"), (F.count("*") - 1).alias("variant_count"))
    later = each.join(firsts.select(*keys, F.col("first.arrived").alias("first_arrived")), keys).where("arrived > first_arrived")
    w = Window.partitionBy(*keys).orderBy("arrived")
    kept = later.withColumn("place", F.row_number().over(w)).where(F.col("place") <= inline)
    arrays = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("arrived", digest))).alias("inline"))
    return firsts.join(arrays, keys, "left").select(*keys, F.col(f"first.{digest}").alias(digest), "variant_count", F.coalesce("inline", F.array().cast(arrays.schema["inline"].dataType)).alias("variants"))


def backfill(rows: DataFrame, recorded: DataFrame, keys: list[str], array: str, digest: str, match: list[str] | None = None) -> DataFrame:
    """Entries of the rows' arrays that `recorded` (keys, or those of `match`, and digest) lacks; running it again after appending them gives none."""
    return rows.select(*keys, F.explode(array).alias("v")).select(*keys, f"v.{digest}", "v.arrived").join(recorded, [*(match or keys), digest], "left_anti")


def flagged(rows: DataFrame, others: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """`rows` with whether `others` has their key, in one join."""
    there = others.select(*keys).distinct().withColumn(flag, F.lit(True))
    return rows.join(there, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def admit(incoming: DataFrame, receipts: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """`incoming` with `outcome`: new, duplicate (the receipt has its digest) or conflict (it has another)."""
    r = receipts.select(*keys, F.col(digest).alias("receipt_digest"))
    outcome = F.when(F.col("receipt_digest").isNull(), "new").when(F.col("receipt_digest") == F.col(digest), "duplicate").otherwise("conflict")
    return incoming.join(r, keys, "left").withColumn("outcome", outcome).drop("receipt_digest")


def reconcile(actual: DataFrame, counted: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose counter differs from what is there, a missing side counting as absent."""
    a, c = actual.select(key, F.col(value).alias("actual")), counted.select(key, F.col(value).alias("counted"))
    return a.join(c, key, "full").where(~F.col("actual").eqNullSafe(F.col("counted")))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; the later arrival, the last of `order`, wins ties."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")


def trim_history(df: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """All but the newest `keep` rows of each key: what a trimming pass deletes."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep).drop("place")
