"""The unified read model: spans and legacy rows as calls, and what reading adds to stored calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.rules import TOKEN_FIELDS, cost, provider, safe_count
from tracemill.operators.paging import last_of


def from_spans(spans: DataFrame, legacy: bool = False, prefix: str = "") -> DataFrame:
    """Calls out of span rows, their ids after `prefix`. Counts that aren't safe whole numbers are none; legacy rows have neither cost nor provider."""
    none = F.lit(None).cast("string")
    who = F.struct(none.alias("provider"), F.lit("unavailable").alias("provenance")) if legacy else provider(F.col("providerName"), none, F.col("requestModel"))
    price = F.lit(None).cast("double") if legacy else cost(F.col("totalCost"), F.col("openrouterUsageCost"), F.col("isByok"), F.col("byokInferenceUsageCost"))
    tokens = {f: safe_count(F.col(f)) for f in TOKEN_FIELDS}
    usage = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(f).alias("nativeField"), c.alias("value"), F.lit("final").alias("finality"))) for f, c in tokens.items())))
    start, end = F.col("startTimeUnixNano").cast("long"), F.col("endTimeUnixNano").cast("long")
    return spans.select(F.concat(F.lit(prefix or ("legacy:" if legacy else "span:")), F.coalesce("generationId", "spanId")).alias("callId"), F.lit("legacy" if legacy else "span").alias("source"), "traceId", "spanId", "requestModel", "responseModel", who["provider"].alias("provider"), who["provenance"].alias("providerProvenance"), F.lit("generation").alias("operation"), F.when(F.col("finishReason").isNotNull(), "succeeded").otherwise("unknown").alias("state"), ((end - start) / 1e6).alias("latencyMs"), price.alias("cost"), F.when(price.isNull(), "unknown").otherwise("reported").alias("costProvenance"), *(c.alias(f) for f, c in tokens.items()), usage.alias("usage"))


def summary_view(calls: DataFrame, sources: DataFrame, source: list[str], gap: str = "capture_boot_changed") -> DataFrame:
    """Calls as a reader sees them: one in progress without a terminal, whose source has moved on to another boot, is unknown; it says so among its last 8 gaps.

    `sources` has a row for each source with its current `boot`; it is as small as the fleet, which Spark sees by its size.
    """
    current = sources.select(*source, F.col("boot").alias("current_boot"))
    joined = calls.join(current, source, "left")
    stale: Column = (F.col("state") == "in_progress") & F.col("terminal_sequence").isNull() & F.col("current_boot").isNotNull() & (F.col("current_boot") != F.col("boot"))
    more = joined.withColumn("stale", F.coalesce(stale, F.lit(False))).withColumn("gaps", F.when(F.col("stale"), F.array_append("gaps", F.lit(gap))).otherwise(F.col("gaps")))
    return more.withColumn("state", F.when(F.col("stale"), "unknown").otherwise(F.col("state"))).withColumn("gaps", last_of("gaps", 8)).drop("stale", "current_boot")


def coverage(sources: DataFrame, key: str, most: int = 16) -> DataFrame:
    """The first `most` sources, and whether these are all."""
    found = sources.orderBy(key).limit(most + 1)
    total = found.agg((F.count("*") <= most).alias("complete"))
    return found.orderBy(key).limit(most).join(F.broadcast(total))  # one row
