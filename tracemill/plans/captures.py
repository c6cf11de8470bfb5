"""Queries over deliveries and segments made from the driver's tables, and over ordered decisions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.core.content import Externalizer, decode_input, references
from tracemill.core.frames import Frames
from tracemill.core.segments import read_segment, write_segment
from tracemill.core.values import dump, parse
from tracemill.operators import folds
from tracemill.plans.reads import E_SQL, events
from tracemill.plans.registry import Tables, query
from tracemill.session import spread
from tracemill.sources import otlp, segments



def delivery_rows(t: Tables) -> DataFrame:
    """Every event as a delivery of one span."""
    e = spread(events(t))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    attributes = F.concat_ws(",", *(F.concat(F.lit(f'{{"key":"{k}","value":{{"{f}":'), v, F.lit("}}")) for k, f, v in (
        ("user.id", "stringValue", quoted(F.col("user_id").cast("string"))), ("gen_ai.request.model", "stringValue", quoted(F.col("event_type"))), ("gen_ai.usage.input_tokens", "intValue", quoted(F.get_json_object("props", "$.k"))),
        ("gen_ai.usage.output_tokens", "intValue", F.lit('"007"')), ("gen_ai.usage.total_cost", "doubleValue", F.lit("0.25")), ("trace.metadata.environment", "stringValue", F.lit('"dev"')), ("span.metadata.environment", "stringValue", F.lit('"dev"')), ("span.metadata.x", "boolValue", F.lit("true")), ("trace.metadata.x", "boolValue", F.lit("true")),
    )))
    span = F.concat(F.lit('{"traceId":"t'), F.col("user_id"), F.lit('","spanId":"s'), F.col("event_id"), F.lit('","name":"n","attributes":['), attributes, F.lit("]}"))
    return e.select(F.col("event_id").alias("delivery_id"), "received_at", F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"spans":['), span, F.lit("]}]}]}")).alias("body"))


@query(f"""SELECT event_id AS delivery_id, 't' || user_id AS "traceId", 's' || event_id AS "spanId", user_id::VARCHAR AS "userId", event_type AS "requestModel", (props->>'k')::BIGINT AS "inputTokens",
  CAST(NULL AS BIGINT) AS "outputTokens", 0.25::DOUBLE AS "totalCost", 'dev' AS environment, 'gen_ai.usage.output_tokens,trace.metadata.x' AS residual FROM {E_SQL}""")
def otlp_parse(t: Tables) -> DataFrame:
    """Projected columns; a non-canonical integer stays an attribute, and a span.metadata copy of an equal trace.metadata attribute goes, projected or not."""
    s = otlp.spans(otlp.deliveries(delivery_rows(t)))
    return s.select("delivery_id", "traceId", "spanId", "userId", "requestModel", "inputTokens", "outputTokens", "totalCost", "environment", F.array_join(F.transform("attributes", lambda a: a["key"]), ",").alias("residual"))


def _sse(said: list[str]) -> bytes:
    events_ = [{"type": "message_start", "message": {"type": "message", "id": "m", "role": "assistant", "model": "claude-x", "content": [], "usage": {"input_tokens": len(said)}}}, {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}]
    events_ += [{"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": x}} for x in said]
    events_ += [{"type": "content_block_stop", "index": 0}, {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": sum(map(len, said))}}, {"type": "message_stop"}]
    return "".join(f"event: {e['type']}\ndata: {dump(e)}\n\n" for e in events_).encode()


CONVERSATION_SEGMENTS = "raw string"


def conversation_segments(t: Tables, piece: int = 700) -> DataFrame:
    """Every conversation as a captured call: its turns are streamed as text deltas, cut into chunks of bytes, two or three observations to a segment."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        said = [x or "" for x in rows.sort_values(["turn", "role", "text"])["text"]]
        body = _sse(said)
        bodies = [("request", dump({"stream": True}).encode()), ("stream_init", b""), *(("stream_chunk", body[k : k + piece]) for k in range(0, len(body), piece)), ("completion", b"")]
        out = []
        for k, (kind, data) in enumerate(bodies):
            o = {"schemaVersion": 1, "destinationId": "d", "instanceId": "i", "pluginBootId": "b", "requestId": f"c{key[0]}", "configRevision": "r", "sequence": k + 1, "kind": kind, "route": "POST /v1/messages", "observedAt": "2026-01-01T00:00:00Z", "offsetNs": k * 10**6, "contentBytes": len(data), "contentSha256": hashlib.sha256(data).hexdigest()}
            o |= {"body": base64.b64encode(data).decode()} if data else {}
            o |= {"completionOutcome": "succeeded", "executionStartedAt": "2026-01-01T00:00:00Z", "executionCompletedAt": "2026-01-01T00:00:01.5Z"} if kind == "completion" else {}
            out.append(o)
        return pd.DataFrame({"raw": [write_segment(out[k : k + 3]) for k in range(0, len(out), 3)]})

    return t.conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, CONVERSATION_SEGMENTS)


FOLDED = """SELECT sha256('["d","i","b","c' || conv_id || '"]') AS call_id, 'succeeded' AS state, 'anthropic_messages' AS protocol, count(*) AS input_tokens, sum(length(text)) AS output_tokens, 'complete' AS raw, 'complete' AS projection, 1500.0::DOUBLE AS latency_ms
  FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id"""
SHOWN = ("call_id", "state", "protocol", "input_tokens", "output_tokens", "raw", "projection", "latency_ms")


@query(FOLDED)
def segment_calls(t: Tables) -> DataFrame:
    """Segments validated, every one delivered twice, admitted once and folded."""
    # Both deliveries of a segment come from one row, so that conversations are read and captured once; each is validated and admitted by itself.
    twice = conversation_segments(t).select("raw", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    kept = segments.admitted(segments.validated(twice)).where("outcome = 'new'")
    return segments.calls(kept).select(*SHOWN)


@query("SELECT sha256('[\"d\",\"i\",\"b\",\"c' || conv_id || '\"]') AS call_id, outcome, n FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('new', 1), ('duplicate', 1), ('digest_conflict', 1)) v(outcome, n)")
def segment_outcomes(t: Tables) -> DataFrame:
    """Of every call the first segment has a receipt and comes again, once as it was and once with other bytes; the second is new."""

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"raw": [write_segment([o | {"offsetNs": 7} for o in read_segment(r)[1]]) for r in b["raw"]]})

    every = conversation_segments(t)
    first = F.get_json_object("raw", "$.firstSequence").cast("long")
    firsts, seconds = every.where(first == 1), every.where(first == 4)
    again = segments.validated(firsts.unionAll(firsts.mapInPandas(changed, "raw string")).unionAll(seconds))
    return segments.admitted(again, segments.validated(firsts)).groupBy("call_id", "outcome").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) + 5 AS n_frames, sum(length(text)) AS n_chars FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id")
def sse_frames(t: Tables) -> DataFrame:
    """Frames read back from bytes cut at every 113."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        body, frames, found = _sse([x or "" for x in rows.sort_values(["turn", "role", "text"])["text"]]), Frames(), []
        for k in range(0, len(body), 113):
            found += frames.feed(body[k : k + 113])
        said = [parse(data)["delta"]["text"] for data, event in found if event == "content_block_delta"]
        return pd.DataFrame({"conv_id": [key[0]], "n_frames": [len(found)], "n_chars": [sum(map(len, said))]})

    return t.conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, "conv_id long, n_frames long, n_chars long")


@query("SELECT doc_id, strlen(text) > 4096 AS moved, CASE WHEN strlen(text) > 4096 THEN sha256(text) END AS sha256, CASE WHEN strlen(text) > 4096 THEN strlen(text) END AS n_bytes, CASE WHEN strlen(text) > 4096 THEN 'blob_text' ELSE 'text' END AS decoded FROM documents")
def externalize(t: Tables) -> DataFrame:
    """Each text as a user message; those over 4,096 bytes become blobs, and decoding finds the reference."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                x = Externalizer("delivery", inline=4096)
                content = x.content(dump({"messages": [{"role": "user", "content": text}]}))
                found, refs = decode_input(content)["messages"][0]["content"], references(parse(content))
                out.append((doc_id, bool(refs), refs[0]["sha256"] if refs else None, refs[0]["byteLength"] if refs else None, found["kind"] if isinstance(found, dict) else "text"))
            yield pd.DataFrame(out, columns=["doc_id", "moved", "sha256", "n_bytes", "decoded"]).astype({"n_bytes": "Int64"})

    return t.documents.select("doc_id", "text").mapInPandas(run, "doc_id long, moved boolean, sha256 string, n_bytes long, decoded string")


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_at, event_id) AS k, (event_type = 'error')::INT AS l FROM {E_SQL}),
s AS (SELECT user_id, k, event_id, received_at AS t, l AS losses, true AS stored FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.l <> s.losses OR o.received_at - s.t >= 21600000000 THEN o.received_at ELSE s.t END, o.l * (o.l <> s.losses OR o.received_at - s.t >= 21600000000)::INT + s.losses * (NOT (o.l <> s.losses OR o.received_at - s.t >= 21600000000))::INT, o.l <> s.losses OR o.received_at - s.t >= 21600000000
  FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id AS key, event_id AS id FROM s WHERE stored""")
def health_coalesce(t: Tables) -> DataFrame:
    posts = events(t).withColumn("losses", F.when(F.col("event_type") == "error", 1).otherwise(0)).withColumn("boot", F.lit(1))
    return folds.coalesced_health(posts.select("user_id", "received_at", "losses", "boot", "event_id"), "user_id", "received_at", "losses", "boot", "event_id", 6 * 3600)


@query("""WITH RECURSIVE o AS (SELECT conv_id, strlen(coalesce(text, '')) AS size, turn * 400000 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
s AS (SELECT conv_id, i, 0 AS block, 1 AS pieces, size AS bytes, t AS since FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, s.block + f::INT, CASE WHEN f THEN 1 ELSE s.pieces + 1 END, CASE WHEN f THEN o.size ELSE s.bytes + o.size END, CASE WHEN f THEN o.t ELSE s.since END
  FROM s JOIN o ON o.conv_id = s.conv_id AND o.i = s.i + 1, LATERAL (SELECT s.bytes + o.size > 2048 OR s.pieces >= 1024 OR o.t - s.since >= 900000 AS f))
SELECT conv_id AS key, block, max(pieces) AS pieces, max(bytes) AS bytes FROM s GROUP BY conv_id, block""")
def block_coalesce(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (F.col("turn") * 400_000).alias("micros"))
    return folds.coalesced_blocks(turns, "conv_id", ["turn", "role", "text"], "size", "micros", most_bytes=2048)


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 900 + 100 AS size, row_number() OVER (PARTITION BY user_id ORDER BY received_at, event_id) AS i FROM {E_SQL}),
s AS (SELECT user_id, event_id, i, size AS held, 0::BIGINT AS lost, false AS dropped FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.i, h + CASE WHEN h + o.size > 4096 THEN 0 ELSE o.size END, s.lost + CASE WHEN h + o.size > 4096 THEN o.size ELSE 0 END, h + o.size > 4096
  FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1, LATERAL (SELECT greatest(0, s.held - 400) AS h))
SELECT user_id AS key, event_id AS id, dropped, lost AS lost_bytes FROM s""")
def queue_losses(t: Tables) -> DataFrame:
    sized = events(t).select("user_id", "received_at", "event_id", (F.col("event_id") % 900 + 100).alias("size"))
    return folds.admission_losses(sized, "user_id", ["received_at", "event_id"], "size", 4096, 400)
