"""Capture segments: reading, admission against receipts, and projection into calls, in batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.core.fold import CallFold, OutOfOrder, call_id
from tracemill.core.segments import SCOPE, identity, read_segment
from tracemill.core.values import dump
from tracemill.operators.admission import admit

SEGMENTS = "call_id string, destination string, segment_id string, digest string, first_sequence long, through_sequence long, observations string, error string"
CALLS = "call_id string, destination string, state string, operation string, protocol string, request_model string, response_model string, provider string, streamed boolean, finish_reason string, input_tokens long, output_tokens long, total_tokens long, reasoning_tokens long, cached_input_tokens long, cache_creation_input_tokens long, latency_ms double, first_byte_ms double, first_content_ms double, persisted_through long, projected_through long, terminal_sequence long, raw string, projection string, issue string, usage_evidence string, failure string, summary string"
#: Columns of CALLS that are fields of the summary as they stand.
FIELDS = {"destination": "destinationId", "state": "state", "operation": "operation", "protocol": "clientProtocol", "request_model": "requestModel", "response_model": "responseModel", "provider": "provider", "streamed": "streamed", "finish_reason": "finishReason", "input_tokens": "inputTokens", "output_tokens": "outputTokens", "total_tokens": "totalTokens", "reasoning_tokens": "reasoningTokens", "cached_input_tokens": "cachedInputTokens", "cache_creation_input_tokens": "cacheCreationInputTokens", "latency_ms": "latencyMs", "first_byte_ms": "timeToFirstByteMs", "first_content_ms": "timeToFirstContentMs", "projected_through": "through", "terminal_sequence": "terminalSequence", "raw": "raw", "projection": "projection", "issue": "projectionIssue", "usage_evidence": "usageEvidence"}


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment files, a JSON envelope on each line, as one string column `raw`."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def validated(raw: DataFrame) -> DataFrame:
    """SEGMENTS of the envelopes in column `raw`; refused ones have an error and no observations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["raw"]:
                e, found, error = read_segment(text or "")
                scope = [e.get(k) for k in SCOPE] if all(isinstance(e.get(k), str) for k in SCOPE) else None
                out.append((call_id(*scope) if scope else None, scope[0] if scope else None, identity(e, e.get("firstSequence"), e.get("throughSequence")) if scope else None, e.get("contentSha256"), e.get("firstSequence") if not error else None, e.get("throughSequence") if not error else None, dump(found) if found else None, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return raw.select("raw").mapInPandas(run, SEGMENTS)


def admitted(segments: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """Segments with `outcome`: invalid, new, duplicate (of a receipt or of an earlier one here), digest_conflict or sequence_conflict.

    `receipts` has segment_id, digest, call_id, first_sequence and through_sequence of what was admitted before. A segment that reaches into another
    range of its call is a sequence conflict; of two new ones that do, the one with the smaller first sequence, then digest, is admitted.
    """
    known = receipts if receipts is not None else segments.limit(0)
    seen = admit(segments, known.select("segment_id", "digest"), ["segment_id"], "digest")
    w = Window.partitionBy("segment_id").orderBy("digest")
    seen = seen.withColumn("place", F.row_number().over(w)).withColumn("first_digest", F.first("digest").over(w))
    old = known.select("call_id", F.col("first_sequence").alias("f"), F.col("through_sequence").alias("t"), F.col("segment_id").alias("sid"))
    clash = seen.join(old, (seen.call_id == old.call_id) & (F.col("f") <= F.col("through_sequence")) & (F.col("first_sequence") <= F.col("t")) & (F.col("sid") != F.col("segment_id")), "left_semi").select("segment_id").distinct().withColumn("clashes", F.lit(True))
    order = Window.partitionBy("call_id").orderBy("first_sequence", "digest").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when((F.col("place") == 1) & F.col("error").isNull(), F.col("through_sequence"))
    seen = seen.join(clash, "segment_id", "left").withColumn("reach", F.max(fresh).over(order))
    outcome = (
        F.when(F.col("error").isNotNull(), "invalid")
        .when(F.col("outcome") == "conflict", "digest_conflict")
        .when(F.col("outcome") == "duplicate", "duplicate")
        .when((F.col("place") > 1) & (F.col("digest") == F.col("first_digest")), "duplicate")
        .when(F.col("place") > 1, "digest_conflict")
        .when(F.col("clashes") | (F.col("reach") >= F.col("first_sequence")), "sequence_conflict")
        .otherwise("new")
    )
    return seen.withColumn("outcome", outcome).drop("place", "first_digest", "clashes", "reach")


def waiting_call(destination: str | None) -> dict:
    """A call of which no first segment has arrived."""
    return {"destinationId": destination, "state": "in_progress", "through": 0}


def call_row(fold: CallFold, key: str, persisted: int, failure: str | None) -> dict:
    call = fold.call or {}
    return {"call_id": key} | {c: call.get(f) for c, f in FIELDS.items()} | {"persisted_through": persisted, "failure": failure, "summary": dump(call)}


def fold_segments(fold: CallFold, segments: list[tuple[int, int, str]]) -> tuple[int, str | None]:
    """Apply segments in order as far as they reach without a gap; (persisted watermark, failure)."""
    through, failure = (fold.call or {}).get("through", 0), None
    # What a failed segment left is undone by folding again what came before it: to keep the state at each segment is quadratic in a call.
    before, done = json.dumps([fold.call, fold.state]), []
    for first, last, observations in sorted(segments):
        if first != through + 1:
            if first <= through:
                continue
            break
        if not failure:
            try:
                for o in json.loads(observations):
                    fold.apply(o)
                done.append(observations)
            except (OutOfOrder, ValueError, KeyError) as e:
                fold.call, fold.state = json.loads(before)
                for o in (o for x in done for o in json.loads(x)):
                    fold.apply(o)
                failure = str(e)[:256]
        through = last
    return through, failure


def calls(segments: DataFrame) -> DataFrame:
    """CALLS from admitted segments: one ordered fold for each call, up to its first gap.

    A call's segments meet in one task by the call's key; a call is bounded by what one model request exchanges.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fold = CallFold()
        persisted, failure = fold_segments(fold, list(zip(rows["first_sequence"], rows["through_sequence"], rows["observations"], strict=True)))
        if fold.call is None:
            fold.call = waiting_call(rows["destination"].iloc[0])
        return pd.DataFrame([call_row(fold, key[0], persisted, failure)])[[c.split()[0] for c in CALLS.split(", ")]].astype(object)

    kept = segments.where("error IS NULL AND observations IS NOT NULL").select("call_id", "destination", "first_sequence", "through_sequence", "observations")
    return kept.groupBy("call_id").applyInPandas(run, CALLS)
