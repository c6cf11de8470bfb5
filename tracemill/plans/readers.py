"""Readers over stored tables: bounded pages with cursors, as applications ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.core.content import is_reference
from tracemill.operators.paging import clip, clipped_fields, page_result

NEWEST = [("receivedAt", False), ("creationTime", False)]
OLDEST = [("creationTime", True)]
CALL_CORRELATIONS = ("requestId", "runId", "jobId", "rootExecutionId", "opencodeSessionId")
CORRELATIONS = ("requestId", "runId", "jobId")
SUMMARY = ("traceId", "spanId", "name", "requestId", "runId", "jobId", "requestModel", "responseModel", "providerName", "finishReason", "environment", "feature")
FACTS = ("inputTokens", "outputTokens", "totalTokens", "reasoningTokens", "cachedInputTokens", "totalCost", "inputUtf8Bytes", "outputUtf8Bytes", "attributeCount", "resourceAttributeCount", "cacheCreationInputTokens")


class TraceReader:
    """Pages of span rows (columns of sources.otlp with receivedAt and creationTime)."""

    def __init__(self, spans: DataFrame, variants: DataFrame | None = None) -> None:
        self.spans, self.variants = spans, variants

    def page_correlation_summaries(self, correlation: dict[str, str], limit: int = 7, cursor: tuple | None = None) -> dict:
        """Newest first by one correlation id, at most 7 rows and 32 KiB; other limits raise."""
        (name, value), *rest = correlation.items()
        if rest or name not in CORRELATIONS:
            raise ValueError(f"one of {', '.join(CORRELATIONS)}")
        if not 1 <= limit <= 7:
            raise ValueError("limit must be from 1 to 7")
        rows = self.spans.where(F.col(name) == value)
        names = [n for n in SUMMARY if n in rows.columns]
        shown = rows.select("receivedAt", "creationTime", *(clip(n).alias(n) for n in names), *(n for n in FACTS if n in rows.columns), clipped_fields([*names]).alias("clippedFields"))
        return page_result(shown, NEWEST, limit, 7, cursor)

    def page_stored_since(self, after: int | None = None, before: int | None = None, limit: int = 200) -> dict:
        """Rows in order of creation between two times, both exclusive."""
        rows = self.spans if before is None else self.spans.where(F.col("creationTime") < before)
        return page_result(rows, OLDEST, limit, 200, None if after is None else (after,), budget=1 << 30)

    def page_variants_since(self, after: int | None = None, limit: int = 200) -> dict:
        return page_result(self.variants, OLDEST, limit, 200, None if after is None else (after,), budget=1 << 30)

    def get_span(self, trace_id: str, span_id: str) -> DataFrame:
        return self.spans.where((F.col("traceId") == trace_id) & (F.col("spanId") == span_id))


class CallReader:
    """Pages of call rows (columns of sources.segments.CALLS with received_at and creation_time); limits are clamped."""

    def __init__(self, calls: DataFrame, segments: DataFrame | None = None) -> None:
        self.calls, self.segments = calls, segments

    def page_recent_summaries(self, destination: str, limit: int = 3, cursor: tuple | None = None, correlation: dict[str, str] | None = None) -> dict:
        """Newest first of a destination, or of one of its correlation ids."""
        rows = self.calls.where(F.col("destination") == destination)
        for name, value in (correlation or {}).items():
            if len(correlation) != 1 or name not in CALL_CORRELATIONS:
                raise ValueError(f"one of {', '.join(CALL_CORRELATIONS)}")
            rows = rows.where(F.col(name) == value)
        return page_result(rows, [("received_at", False), ("creation_time", False)], limit, 3, cursor, clamp=True, budget=31 * 1024 - 256)

    def page_calls_since(self, destination: str, cursor: tuple | None = None, before: int | None = None, limit: int = 50) -> dict:
        rows = self.calls.where(F.col("destination") == destination)
        rows = rows if before is None else rows.where(F.col("received_at") < before)
        return page_result(rows, [("received_at", True), ("creation_time", True)], limit, 50, cursor, clamp=True, budget=1 << 30)

    def page_event_segments(self, call_id: str, after: int = 0, limit: int = 7) -> dict:
        return page_result(self.segments.where(F.col("call_id") == call_id), [("through_sequence", True)], limit, 200, (after,), clamp=True, budget=1 << 30)

    def get_processing_state(self, call_id: str) -> DataFrame:
        """How far a call is persisted and projected, and what stopped it."""
        return self.get_call(call_id).select("call_id", "persisted_through", "projected_through", "terminal_sequence", "failure")

    def get_boot_health(self, boots: DataFrame, destination: str, instance: str, boot: str) -> DataFrame:
        return boots.where((F.col("destination") == destination) & (F.col("instance") == instance) & (F.col("boot") == boot))

    def get_call(self, call_id: str) -> DataFrame:
        return self.calls.where(F.col("call_id") == call_id)


def resolve_blobs(wanted: DataFrame, owned: DataFrame, objects: DataFrame, max_bytes: int) -> DataFrame:
    """The bytes of references that their owner really has (owner and all fields equal) and that are within `max_bytes`; wrong lengths and digests fail."""
    fields = ["owner", "key", "sha256", "byteLength", "contentType", "encoding"]
    mine = wanted.where(F.col("byteLength") <= max_bytes).join(owned.select(*fields), fields, "left_semi")
    found = mine.join(objects.select("key", "bytes"), "key", "left")
    good = F.col("bytes").isNull() | (F.octet_length("bytes") == F.col("byteLength")) & (F.sha2("bytes", 256) == F.col("sha256"))
    return found.withColumn("bytes", F.when(good, F.col("bytes")).otherwise(F.raise_error(F.lit("a blob's bytes differ from its reference"))))


__all__ = ["CallReader", "TraceReader", "is_reference", "resolve_blobs"]
