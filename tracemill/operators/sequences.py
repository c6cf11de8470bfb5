"""Operators on numbered rows: watermarks, gaps, overlaps, ledgers, batches, running figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.folds import streamed


def watermarks(segments: DataFrame, key: str, first: str, through: str, start: int = 0) -> DataFrame:
    """For each key how far its segments reach without a gap from `start`, and how far at all."""
    w = Window.partitionBy(key).orderBy(first)
    broken = F.col(first) != F.coalesce(F.lag(through).over(w), F.lit(start)) + 1
    runs = segments.withColumn("broken", broken.cast("int")).withColumn("gaps", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("gaps") == 0, F.col(through))), F.lit(start)).alias("watermark"), F.max(through).alias("seen"), F.max("gaps").alias("gaps"))


def gaps(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The missing stretches between a key's numbers."""
    w = Window.partitionBy(key).orderBy(sequence)
    before = rows.withColumn("before", F.lag(sequence).over(w))
    return before.where(F.col(sequence) > F.col("before") + 1).select(key, (F.col("before") + 1).alias("gap_from"), (F.col(sequence) - 1).alias("gap_to"))


def overlaps(segments: DataFrame, key: str, first: str, through: str, tie: str) -> DataFrame:
    """Segments that reach into the one before or after them."""
    w = Window.partitionBy(key).orderBy(first, tie)
    seen = segments.withColumn("reach", F.max(through).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.lead(first).over(w))
    return seen.where((F.col("reach") >= F.col(first)) | (F.col("next") <= F.col(through))).drop("reach", "next")


def ledger(rows: DataFrame, key: str, sequence: str, terminal: Column, size: Column, start: int) -> DataFrame:
    """A line for each key: range, count, whether it is whole from `start`, its terminals, bytes. No row moves before the partial sums."""
    found = rows.groupBy(key).agg(F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count("*").alias("n"), F.countDistinct(sequence).alias("n_distinct"), F.sum(terminal.cast("long")).alias("terminals"), F.max(F.when(terminal, F.col(sequence))).alias("last_terminal"), F.sum(size).alias("n_bytes"))
    whole = (F.col("first") == start) & (F.col("n") == F.col("last") - start + 1) & (F.col("n") == F.col("n_distinct"))
    return found.select(key, "first", "last", "n", "terminals", "n_bytes", whole.alias("contiguous"), (whole & (F.col("terminals") == 1) & (F.col("last_terminal") == F.col("last"))).alias("complete"))


def first_batches(rows: DataFrame, key: str, sequence: str, size: str, most: int, budget: int) -> DataFrame:
    """The next batch of each key: from its oldest number on without a gap, at most `most` rows and `budget` of `size`; the first row always goes."""
    w = Window.partitionBy(key).orderBy(sequence)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    found = numbered.withColumn("start", F.min(sequence).over(Window.partitionBy(key))).withColumn("used", F.sum(size).over(run))
    kept = found.where((F.col(sequence) == F.col("start") + F.col("place") - 1) & ((F.col("used") <= budget) | (F.col("place") == 1)))
    return kept.groupBy(key).agg(F.min(sequence).alias("first"), F.max(sequence).alias("through"), F.count("*").alias("n"), F.sum(size).alias("size"))


def peak(rows: DataFrame, key: str, order: list[str], change: Column) -> DataFrame:
    """The highest running sum of each key's changes."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(change).over(w)).groupBy(key).agg(F.max("running").alias("peak"), F.sum(change).alias("final"))


def growth(rows: DataFrame, key: str, micros: str, allocated: str, tie: str, ceiling: float, seconds: float = 1.0) -> DataFrame:
    """For each sample the growth a second since the one it is measured from, and the seconds left to the ceiling; null where it doesn't grow.

    A sample is measured from the last one that was kept; the first is kept, and each that comes `seconds` or more after that.
    """

    def step(state: dict, row: dict) -> list[dict]:
        kept, rate = state.get("kept"), None
        elapsed = (row[micros] - kept[0]) / 1e6 if kept else None
        if kept and elapsed >= seconds and row[allocated] is not None and kept[1] is not None and row[allocated] > kept[1]:
            rate = (row[allocated] - kept[1]) / elapsed
        if not kept or elapsed >= seconds:
            state["kept"] = (row[micros], row[allocated])
        return [{key: row[key], tie: row[tie], "rate": rate, "seconds_left": None if rate is None else max(ceiling - row[allocated], 0.0) / rate}]

    kinds = dict(rows.dtypes)
    return streamed(rows.select(key, micros, allocated, tie), key, [micros, tie], step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, rate double, seconds_left double", dict)


def rank_median_p99(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The values at index n / 2 and (n - 1) * 99 / 100, whole divisions, of each key's sorted values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).count()
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("count").over(w)).join(counted.groupBy(key).agg(F.sum("count").alias("n")), key)
    at = lambda index: F.min(F.when(F.col("upto") > F.expr(index), F.col(value)))
    return placed.groupBy(key).agg(F.max("n").alias("n"), at("n div 2").alias("median"), at("(n - 1) * 99 div 100").alias("p99"))


def sessions(rows: DataFrame, key: str, micros: str, tie: str, idle_seconds: int) -> DataFrame:
    """Stretches of a key's rows that no pause longer than `idle_seconds` divides."""
    w = Window.partitionBy(key).orderBy(micros, tie)
    new = F.coalesce(F.col(micros) - F.lag(micros).over(w) > F.lit(idle_seconds * 1_000_000), F.lit(True))
    numbered = rows.withColumn("session", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(micros).alias("opened"), F.max(micros).alias("closed"), F.count("*").alias("n"))


def rank_percentiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """The value at index bround((n - 1) * q) of each key's sorted values.

    Values are counted first, so what the window orders is one row for each distinct value of a key, however often it occurs.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).count()
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = counted.groupBy(key).agg(F.sum("count").alias("n"))
    placed = counted.withColumn("upto", F.sum("count").over(w)).join(total, key)
    return placed.groupBy(key).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(q), 0), F.col(value))).alias(name) for name, q in quantiles.items()))
