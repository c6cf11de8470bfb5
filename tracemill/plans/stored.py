"""Queries of validators, stored rows, readers and folds of the other protocols."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.core.replay import replay
from tracemill.core.segments import write_segment
from tracemill.core.values import dump
from tracemill.operators import calls, delivery, validators
from tracemill.plans import readers
from tracemill.plans.captures import delivery_rows
from tracemill.plans.reads import E_SQL, events
from tracemill.plans.registry import Tables, query
from tracemill.sources import otlp, segments


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'stream_chunk' WHEN 'purchase' THEN 'completion' END AS kind FROM events")
def hook_kinds(t: Tables) -> DataFrame:
    method = F.when(F.col("event_type") == "view", "request.intercept_before").when(F.col("event_type") == "click", "response.intercept_stream_chunk").when(F.col("event_type") == "purchase", "request.complete").otherwise("other")
    return t.events.select("event_id", validators.hook_kind(method).alias("kind"))


def _json(**fields) -> F.Column:
    """A JSON object of columns; null ones are left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


@query("""SELECT l_orderkey, l_linenumber, l_quantity::BIGINT <= 30 AND l_linenumber <> 3 AND l_returnflag <> 'R' AND l_shipdate IS NOT NULL AS valid FROM lineitem""")
def capacity_valid(t: Tables) -> DataFrame:
    """Reports with more remaining than the budget of 30, a negative count (line 3) or an unknown field (flag R) are refused."""
    n = lambda x: F.lit(x).cast("long")
    report = _json(budgetBytes=n(30), allocatedBytes=F.when(F.col("l_linenumber") == 3, -1).otherwise(1).cast("long"), reusableBytes=n(0), remainingBytes=F.col("l_quantity").cast("long"), pendingBytes=n(5), acknowledgedEvents=n(7), observedAt=F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), growthBytesPerSecond=F.lit(0.5), extra=F.when(F.col("l_returnflag") == "R", 1))
    return t.lineitem.select("l_orderkey", "l_linenumber", validators.valid_capacity(report).alias("valid"))


@query("""SELECT o_orderkey, o_custkey % 7 <> 0 AND o_orderstatus <> 'P' AND o_orderkey % 5 <= 3 AS valid FROM orders""")
def content_valid(t: Tables) -> DataFrame:
    """Counters that aren't whole (every seventh customer), that lack a field (status P), or retain more than their peak of 3 are refused."""
    one = F.lit(1).cast("long")
    counters = {f: one for f in validators.CONTENT if f != "missedCalls"} | {"observedBytes": F.when(F.col("o_custkey") % 7 == 0, 1.5).otherwise(1.0), "streamCallbacks": F.when(F.col("o_orderstatus") != "P", one), "retainedChargedBytes": F.col("o_orderkey") % 5, "peakChargedBytes": F.lit(3)}
    return t.orders.select("o_orderkey", validators.valid_content(_json(**counters)).alias("valid"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'too_large' WHEN o_custkey % 5 = 1 THEN 'capacity' WHEN o_custkey % 5 = 2 THEN 'time' WHEN o_custkey % 5 = 3 THEN 'counter' END AS error FROM orders""")
def health_errors(t: Tables) -> DataFrame:
    kind, zero = F.col("o_custkey") % 5, F.lit(0).cast("long")
    record = _json(**{f: zero for f in validators.HEALTH_COUNTS} | {"activeCalls": F.when(kind == 3, -1).otherwise(2).cast("long")}, observedAt=F.when(kind == 2, "soon").otherwise("2026-01-01T00:00:00Z"), startedAt=F.lit("2026-01-01T00:00:00Z"), capacity=F.when(kind == 1, F.struct(F.lit(1).alias("budgetBytes"))), note=F.when(kind == 0, F.repeat(F.lit("x"), 5000)))
    return t.orders.select("o_orderkey", validators.health_error(record).alias("error"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL OR c_acctbal <= 0 THEN 'new' WHEN c_nationkey = o_orderkey % 25 THEN 'same' ELSE 'changed' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def destination_pins(t: Tables) -> DataFrame:
    stored = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("binding"))
    return validators.pinned(t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 25).alias("binding")), stored, "o_custkey", "binding").select("o_orderkey", "o_custkey", "outcome")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 8")
def delivery_statuses(t: Tables) -> DataFrame:
    return validators.delivery_status(t.orders.select("o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN sha256(text) WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality END AS digest, CASE WHEN l.quality = 1 THEN 'pending' WHEN l.doc_id IS NOT NULL THEN 'receipt' END AS store FROM (SELECT DISTINCT doc_id, text FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def digest_lookup(t: Tables) -> DataFrame:
    """Labelled documents are receipts, those of good quality pending too; the pending digest comes first."""
    pending = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest"))
    return validators.digest_lookup(pending, t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("digest")), t.documents, "doc_id")


@query("""SELECT path FROM (SELECT 'd/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.ndjson' WHEN p_size % 3 = 1 THEN '.txt' ELSE '.ndjson' END AS path, p_partkey FROM part) WHERE path LIKE '%.ndjson' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'N')""")
def orphan_files(t: Tables) -> DataFrame:
    name = lambda key, size: F.concat(F.lit("d/"), key, F.when(size % 3 == 1, ".txt").otherwise(".ndjson"))
    batches = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(name(F.col("l_partkey"), F.col("p_size")).alias("path"), F.when(F.col("l_returnflag") == "N", "delivered").otherwise("pending").alias("state"))
    return validators.orphan_files(t.part.select(name(F.col("p_partkey"), F.col("p_size")).alias("path")), batches, "path")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'old' END, m) AS payload FROM orders LEFT JOIN (SELECT l_orderkey, 'p' || min(l_linenumber) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def archived_marks(t: Tables) -> DataFrame:
    rows, marks = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "old").alias("payload")), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("payload"))
    return validators.archived_marks(validators.archived_marks(rows, marks, "o_orderkey"), marks, "o_orderkey")


@query("""SELECT doc_id, used FROM (SELECT *, sum(size) OVER (ORDER BY doc_id) AS used, row_number() OVER (ORDER BY doc_id) AS k FROM (SELECT doc_id, strlen(text) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 120)) WHERE used <= 65536 OR k = 1""")
def inline_page(t: Tables) -> DataFrame:
    labelled = t.labels.select("doc_id", F.lit("p").alias("payload"))
    return validators.inline_pages(t.documents.join(labelled, "doc_id", "left"), "doc_id", F.octet_length("text").cast("long"), budget=65536).select("doc_id", "used")


@query("SELECT o_orderkey, o_custkey, k AS last FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) USING (o_custkey)")
def last_prepared(t: Tables) -> DataFrame:
    prepared = t.orders.select("o_custkey", F.col("o_orderkey").alias("ordinal"))
    return validators.last_prepared(t.orders.select("o_orderkey", "o_custkey"), prepared, "o_custkey", "ordinal").select("o_orderkey", "o_custkey", F.col("prepared.ordinal").alias("last"))


@query("SELECT l_orderkey, l_linenumber, least(300.0, greatest(pow(2.0, least(l_linenumber + 2, 8)) * 0.75, coalesce(CASE WHEN l_returnflag = 'R' THEN l_quantity * 10 END, 0))) AS delay_s FROM lineitem")
def retry_delays(t: Tables) -> DataFrame:
    delay = validators.retry_delay(F.col("l_linenumber") + 2, F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 10), F.lit(0.5))
    return t.lineitem.select("l_orderkey", "l_linenumber", delay.alias("delay_s"))


@query("""SELECT o_orderkey, half, CASE WHEN half = 0 THEN f ELSE f + (h - f) // 2 + 1 END AS "first", CASE WHEN half = 0 THEN f + (h - f) // 2 ELSE h END AS through FROM (SELECT o_orderkey, o_custkey % 9 AS f, o_custkey % 9 + 1 + o_orderkey % 8 AS h FROM orders), (VALUES (0), (1)) v(half)""")
def batch_halves(t: Tables) -> DataFrame:
    first = F.col("o_custkey") % 9
    rows = t.orders.select(F.col("o_orderkey").alias("batch_id"), first.alias("first"), (first + 1 + F.col("o_orderkey") % 8).alias("through"))
    return delivery.split_batches(rows).withColumnRenamed("batch_id", "o_orderkey")


@query("""SELECT page_id, CASE WHEN NOT u THEN url END AS url, CASE WHEN NOT h THEN html END AS html, concat_ws(',', CASE WHEN u THEN 'url' END, CASE WHEN h THEN 'html' END) AS omissions
  FROM (SELECT page_id, url, html, coalesce(length(html) > 256 OR contains(html, chr(10)) OR contains(html, 'a'), false) AS h, coalesce(length(url) > 256 OR contains(url, 'a'), false) AS u FROM pages)""")
def credential_exclusion(t: Tables) -> DataFrame:
    """A bound key of one letter, so that many fields hold it."""
    rows = t.pages.select("page_id", "url", "html", F.lit("a").alias("key"))
    return delivery.without_credentials(rows, ["url", "html"], "key").select("page_id", "url", "html", F.array_join("omissions", ",").alias("omissions"))


@query(f"""SELECT event_id AS delivery_id, user_id::VARCHAR AS "userId", sha256('trace-spans/t' || user_id || '/s' || event_id || '/') AS prefix, true AS referenced, 2 AS n_attributes FROM {E_SQL}""")
def archive_roundtrip(t: Tables) -> DataFrame:
    """Spans archived, their payloads found again by key and checked against their digests."""
    slim, objects = otlp.archived(otlp.spans(otlp.deliveries(delivery_rows(t))))
    back = otlp.loaded(slim, objects)
    return back.select("delivery_id", "userId", F.sha2(F.concat(F.substring_index("payload.key", "/", 3), F.lit("/")), 256).alias("prefix"), (F.element_at(F.split("payload.key", "/"), 4) == F.concat("payload.sha256", F.lit(".json"))).alias("referenced"), F.size("attributes").alias("n_attributes"))


@query(f"""SELECT 'span:s' || event_id AS "callId", event_type AS "requestModel", 'unavailable' AS "providerProvenance", (props->>'k')::BIGINT AS "inputTokens", 0.25::DOUBLE AS cost, 'reported' AS "costProvenance", 'unknown' AS state FROM {E_SQL}""")
def span_calls(t: Tables) -> DataFrame:
    rows = calls.from_spans(otlp.spans(otlp.deliveries(delivery_rows(t))))
    return rows.select("callId", "requestModel", "providerProvenance", "inputTokens", "cost", "costProvenance", "state")


@query(f"""SELECT 'legacy:s' || event_id AS "callId", CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS DOUBLE) AS cost, 'unknown' AS "costProvenance" FROM {E_SQL}""")
def legacy_calls(t: Tables) -> DataFrame:
    return calls.from_spans(otlp.spans(otlp.deliveries(delivery_rows(t))), legacy=True).select("callId", "provider", "cost", "costProvenance")


def _page(t: Tables, found: dict, *columns: str) -> DataFrame:
    """A reader's page as a table, with whether it was the last."""
    rows = [tuple(r[c] for c in columns) + (found["done"],) for r in found["page"]]
    return t.spark.createDataFrame(rows, ", ".join([f"{c} {'string' if c in ('requestId', 'name') else 'long'}" for c in columns] + ["done boolean"]))


READ_SQL = f"(SELECT event_id AS \"creationTime\", received_at AS \"receivedAt\", user_id FROM {E_SQL}) e"


def _spans(t: Tables) -> DataFrame:
    return events(t).select(F.concat(F.lit("t"), "user_id").alias("traceId"), F.concat(F.lit("s"), "event_id").alias("spanId"), F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("requestId"), F.col("received_at").alias("receivedAt"), F.col("event_id").alias("creationTime"))


@query(f"""SELECT "receivedAt", "creationTime", (SELECT count(*) FROM {READ_SQL} WHERE user_id = 1) <= 7 AS done FROM {READ_SQL} WHERE user_id = 1 ORDER BY 1 DESC, 2 DESC LIMIT 4 OFFSET 3""")
def reader_correlation_page(t: Tables) -> DataFrame:
    """The second page of a request's spans, four rows after three."""
    r = readers.TraceReader(_spans(t))
    first = r.page_correlation_summaries({"requestId": "1"}, 3)
    return _page(t, r.page_correlation_summaries({"requestId": "1"}, 4, first["cursor"]), "receivedAt", "creationTime")


@query(f"""SELECT "creationTime", false AS done FROM {READ_SQL} WHERE "creationTime" > 50 AND "creationTime" < 900 ORDER BY 1 LIMIT 20""")
def reader_stored_since(t: Tables) -> DataFrame:
    return _page(t, readers.TraceReader(_spans(t)).page_stored_since(50, 900, 20), "creationTime")


def _calls(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("creation_time"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("received_at"), F.col("o_orderstatus").alias("destination"), F.col("o_custkey").cast("string").alias("requestId"), F.col("o_orderpriority").alias("name"))


CALLS_SQL = "(SELECT o_orderkey AS creation_time, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS received_at, o_orderstatus AS destination, o_custkey FROM orders) c"


@query(f"SELECT received_at, creation_time, false AS done FROM {CALLS_SQL} WHERE destination = 'F' ORDER BY 1 DESC, 2 DESC LIMIT 3")
def reader_recent_calls(t: Tables) -> DataFrame:
    """A limit over 3 is clamped."""
    return _page(t, readers.CallReader(_calls(t)).page_recent_summaries("F", 99), "received_at", "creation_time")


@query(f"SELECT received_at, creation_time, (SELECT count(*) FROM {CALLS_SQL} WHERE destination = 'F' AND o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'F')) <= 3 AS done FROM {CALLS_SQL} WHERE destination = 'F' AND o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'F') ORDER BY 1 DESC, 2 DESC LIMIT 3")
def reader_correlated_calls(t: Tables) -> DataFrame:
    key = t.orders.where("o_orderstatus = 'F'").agg(F.min("o_custkey")).first()[0]
    return _page(t, readers.CallReader(_calls(t)).page_recent_summaries("F", correlation={"requestId": str(key)}), "received_at", "creation_time")


@query(f"SELECT received_at, creation_time, false AS done FROM {CALLS_SQL} WHERE destination = 'O' ORDER BY 1, 2 LIMIT 50 OFFSET 50")
def reader_calls_since(t: Tables) -> DataFrame:
    r = readers.CallReader(_calls(t))
    return _page(t, r.page_calls_since("O", r.page_calls_since("O")["cursor"]), "received_at", "creation_time")


@query("""SELECT doc_id, n_bytes, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN sha256(text) END AS sha256 FROM (SELECT doc_id, text, strlen(text) AS n_bytes FROM documents) WHERE n_bytes <= 2000 AND n_bytes % 2 = 0""")
def blob_resolution(t: Tables) -> DataFrame:
    """References to every text; those of odd lengths have another owner's, those over 2,000 bytes pass the bound, those without a label have no object."""
    ref = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("owner"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byteLength"), F.lit("text/plain").alias("contentType"), F.lit("utf8").alias("encoding"), "text").withColumn("key", F.concat("owner", F.lit("-"), "sha256"))
    owned = ref.withColumn("owner", F.when(F.col("byteLength") % 2 == 0, F.col("owner")).otherwise("other"))
    objects = ref.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("key", F.col("text").cast("binary").alias("bytes"))
    found = readers.resolve_blobs(ref.drop("text"), owned, objects, 2000)
    return found.select("doc_id", F.col("byteLength").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'absent' WHEN doc_id % 4 = 1 THEN 'invalid' WHEN doc_id % 4 = 2 THEN 'unsupported' ELSE 'decoded' END AS kind, CASE WHEN doc_id % 4 = 3 THEN sha256(text) END AS sha256 FROM documents""")
def decoded_outputs(t: Tables) -> DataFrame:
    from tracemill.functions.udfs import decode_output

    case = F.col("doc_id") % 4
    raw = F.when(case == 1, "{").when(case == 2, "[]").when(case == 3, F.to_json(F.struct(F.col("text").alias("completion"))))
    out = t.documents.select("doc_id", decode_output(raw).alias("o"))
    return out.select("doc_id", F.get_json_object("o", "$.kind").alias("kind"), F.sha2(F.get_json_object("o", "$.text"), 256).alias("sha256"))


@query("""SELECT l_orderkey, l_linenumber, q AS i, l_linenumber::BIGINT AS o, CASE WHEN l_returnflag = 'R' THEN 3 END AS c, p AS protocol FROM (SELECT *, l_quantity::BIGINT AS q, CASE WHEN l_linestatus = 'O' THEN 'responses' ELSE 'chat_completions' END AS p FROM lineitem)""")
def usage_normalized(t: Tables) -> DataFrame:
    """Token fields of the two protocols that report totals."""
    from tracemill.functions.udfs import normalize_usage

    chat = F.col("l_linestatus") != "O"
    q, n, c = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", 3)
    raw = F.when(chat, _json(prompt_tokens=q, completion_tokens=n, prompt_tokens_details=F.struct(c.alias("cached_tokens")))).otherwise(_json(input_tokens=q, output_tokens=n, input_tokens_details=F.struct(c.alias("cached_tokens"))))
    protocol = F.when(chat, "chat_completions").otherwise("responses")
    out = t.lineitem.select("l_orderkey", "l_linenumber", protocol.alias("protocol"), normalize_usage(protocol, raw).alias("u"))
    part = lambda f: F.get_json_object("u", f"$.{f}").cast("long")
    return out.select("l_orderkey", "l_linenumber", part("inputTokens").alias("i"), part("outputTokens").alias("o"), part("cachedInputTokens").alias("c"), "protocol")


def _frames(events_: list) -> bytes:
    return "".join((f"event: {e['type']}\n" if isinstance(e, dict) and "type" in e else "") + f"data: {e if isinstance(e, str) else dump(e)}\n\n" for e in events_).encode()


def _chat(said: list[str]) -> bytes:
    deltas = [{"id": "c", "model": "gpt-x", "choices": [{"index": 0, "delta": {"content": x}}]} for x in said]
    return _frames([*deltas, {"id": "c", "choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}, {"id": "c", "choices": [], "usage": {"prompt_tokens": len(said), "completion_tokens": sum(map(len, said)), "total_tokens": len(said) + sum(map(len, said))}}, "[DONE]"])


def _responses(said: list[str]) -> bytes:
    item = {"type": "message", "id": "o", "role": "assistant", "content": []}
    whole = {"object": "response", "id": "r", "status": "completed", "model": "gpt-x", "output": [item | {"content": [{"type": "output_text", "text": "".join(said)}]}], "usage": {"input_tokens": len(said), "output_tokens": sum(map(len, said)), "total_tokens": len(said) + sum(map(len, said))}}
    deltas = [{"type": "response.output_text.delta", "output_index": 0, "item_id": "o", "content_index": 0, "delta": x} for x in said]
    return _frames([{"type": "response.created", "response": {"object": "response", "id": "r"}}, {"type": "response.output_item.added", "output_index": 0, "item": item}, {"type": "response.content_part.added", "output_index": 0, "item_id": "o", "content_index": 0, "part": {"type": "output_text", "text": ""}}, *deltas, {"type": "response.completed", "response": whole}])


def protocol_observations(key: int, said: list[str]) -> list[dict]:
    """A conversation as a captured call: even ones as chat completions, odd ones as responses. By the number modulo 3 it succeeds, is canceled, or loses its stream's last bytes to a gap."""
    chat, case = key % 2 == 0, key % 3
    route, body = ("POST /v1/chat/completions", _chat(said)) if chat else ("POST /v1/responses", _responses(said))
    chunks = [body[k : k + 900] for k in range(0, len(body), 900)]
    bodies = [("request", b'{"stream":true}'), ("stream_init", b""), *(("stream_chunk", x) for x in (chunks[:-1] if case == 2 else chunks)), ("completion", b"")]
    out = []
    for k, (kind, data) in enumerate(bodies):
        o = {"schemaVersion": 1, "destinationId": "d", "instanceId": "i", "pluginBootId": "b", "requestId": f"p{key}", "configRevision": "r", "sequence": k + 1, "kind": kind, "route": route, "observedAt": "2026-01-01T00:00:00Z", "offsetNs": k * 10**6, "contentBytes": len(data), "contentSha256": hashlib.sha256(data).hexdigest()}
        o |= {"body": base64.b64encode(data).decode()} if data else {}
        if kind == "completion":
            o |= [{"completionOutcome": "succeeded"}, {"completionOutcome": "canceled"}, {"captureIncomplete": True, "gap": "capture_content_capacity", "lostContentBytes": len(chunks[-1])}][case]
        out.append(o)
    return out


def _said(rows: pd.DataFrame) -> list[str]:
    return [x or "" for x in rows.sort_values(["turn", "role", "text"])["text"]]


PROTOCOL_SQL = """SELECT conv_id, n, c, conv_id % 2 = 0 AS chat, conv_id % 3 AS k FROM (SELECT conv_id, count(*) AS n, sum(length(text)) AS c FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id)"""


@query(f"""SELECT sha256('["d","i","b","p' || conv_id || '"]') AS call_id, CASE k WHEN 0 THEN 'succeeded' WHEN 1 THEN 'aborted' ELSE 'unknown' END AS state, CASE WHEN chat THEN 'chat_completions' ELSE 'responses' END AS protocol, CASE WHEN k < 2 THEN n END AS input_tokens, CASE WHEN k < 2 THEN c END AS output_tokens, CASE WHEN k < 2 THEN n + c END AS total_tokens, CASE WHEN k < 2 THEN 'complete' ELSE 'partial' END AS raw FROM ({PROTOCOL_SQL})""")
def protocol_calls(t: Tables) -> DataFrame:
    """Chat and Responses calls folded from their segments; canceled ones keep their tokens, those with a gap have none."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = protocol_observations(key[0], _said(rows))
        return pd.DataFrame({"raw": [write_segment(out[k : k + 4]) for k in range(0, len(out), 4)]})

    raw = t.conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, "raw string")
    kept = segments.admitted(segments.validated(raw)).where("outcome = 'new'")
    return segments.calls(kept).select("call_id", "state", "protocol", "input_tokens", "output_tokens", "total_tokens", "raw")


@query(f"""SELECT conv_id, CASE WHEN k < 2 THEN 'decoded' ELSE 'cut' END AS response_state, CASE WHEN k < 2 THEN s END AS completion_sha256, CASE WHEN k < 2 THEN n + c END AS total_tokens FROM ({PROTOCOL_SQL}) JOIN (SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text)) AS s FROM conversations GROUP BY 1) USING (conv_id)""")
def replayed_calls(t: Tables) -> DataFrame:
    """Whole calls replayed from their observations into normalized output; a call whose end is lost isn't decoded."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = replay(protocol_observations(key[0], _said(rows)))
        good = r["responseState"] == "decoded"
        return pd.DataFrame({"conv_id": [key[0]], "response_state": ["decoded" if good else "cut"], "completion_sha256": [hashlib.sha256(r["completion"].encode()).hexdigest() if good else None], "total_tokens": pd.array([r["tokens"]["totalTokens"] if good else None], "Int64")})

    return t.conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, "conv_id long, response_state string, completion_sha256 string, total_tokens long")
