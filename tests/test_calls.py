"""The ordered fold, framing, assembly, segments and streaming, on calls made here."""

import base64
import hashlib
import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.core import usage
from tracemill.core.assembly import assemble
from tracemill.core.fold import CallFold, OutOfOrder, nano_time
from tracemill.core.frames import FrameLimit, Frames
from tracemill.core.replay import replay, split_messages
from tracemill.core.segments import observation_error, read_segment, write_segment
from tracemill.core.values import dump, number_text, unsafe_number
from tracemill.sources import segments


def observation(kind, data=b"", route="POST /v1/messages", **more):
    o = {"schemaVersion": 1, "destinationId": "d", "instanceId": "i", "pluginBootId": "b", "requestId": "r1", "configRevision": "v1", "kind": kind, "route": route, "observedAt": "2026-01-01T00:00:00Z", "offsetNs": 5_000_000, "contentBytes": len(data), "contentSha256": hashlib.sha256(data).hexdigest()}
    return o | ({"body": base64.b64encode(data).decode()} if data else {}) | more


def numbered(observations, first=1):
    return [o | {"sequence": k} for k, o in enumerate(observations, first)]


def sse(events):
    return "".join((f"event: {e['type']}\n" if isinstance(e, dict) and "type" in e else "") + f"data: {e if isinstance(e, str) else dump(e)}\n\n" for e in events).encode()


MESSAGES = [{"type": "message_start", "message": {"type": "message", "id": "m1", "role": "assistant", "model": "claude-x", "content": [], "usage": {"input_tokens": 10, "cache_read_input_tokens": 20, "cache_creation_input_tokens": 30}}}, {"type": "ping"}, {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "CAP"}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "TURE é"}}, {"type": "content_block_stop", "index": 0}, {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 5}}, {"type": "message_stop"}]
CHAT = [{"id": "c", "model": "gpt-5", "choices": [{"index": 0, "delta": {"role": "assistant", "content": "CAPTURE é"}}]}, {"id": "c", "choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}, {"id": "c", "choices": [], "usage": {"prompt_tokens": 60, "completion_tokens": 5, "total_tokens": 65, "prompt_tokens_details": {"cached_tokens": 20, "cached_creation_tokens": 30}, "completion_tokens_details": {"reasoning_tokens": 2}}}, "[DONE]"]
FINAL = {"object": "response", "id": "resp", "status": "completed", "model": "gpt-5-1", "output": [{"type": "message", "id": "o", "role": "assistant", "content": [{"type": "output_text", "text": "CAPTURE é"}]}], "usage": {"input_tokens": 60, "input_tokens_details": {"cached_tokens": 20, "cache_write_tokens": 30}, "output_tokens": 5, "output_tokens_details": {"reasoning_tokens": 2}, "total_tokens": 65}}
RESPONSES = [{"type": "response.created", "response": {"object": "response", "id": "resp", "model": "gpt-5-1"}}, {"type": "keepalive", "sequence_number": 1}, {"type": "response.output_item.added", "output_index": 0, "item": {"type": "message", "id": "o", "role": "assistant", "content": []}}, {"type": "response.content_part.added", "output_index": 0, "item_id": "o", "content_index": 0, "part": {"type": "output_text", "text": ""}}, {"type": "response.output_text.delta", "output_index": 0, "item_id": "o", "content_index": 0, "delta": "CAPTURE é"}, {"type": "response.completed", "response": FINAL}]
STREAMS = {"POST /v1/messages": MESSAGES, "POST /v1/chat/completions": CHAT, "POST /v1/responses": RESPONSES}
TOKENS = {"POST /v1/messages": (60, 5, None, None, 20, 30), "POST /v1/chat/completions": (60, 5, 65, 2, 20, 30), "POST /v1/responses": (60, 5, 65, 2, 20, 30)}


def call(route, cut=40, **end):
    body = sse(STREAMS[route])
    return numbered([observation("request", b'{"stream":true}', route, requestedModel="gpt-5"), observation("stream_init", route=route), *(observation("stream_chunk", body[k : k + cut], route, observedBodyBytes=cut) for k in range(0, len(body), cut)), observation("completion", route=route, **({"completionOutcome": "succeeded", "executionStartedAt": "2026-01-01T00:00:00.000000001Z", "executionCompletedAt": "2026-01-01T01:00:00.5+01:00"} | end))])


def folded(observations):
    f = CallFold()
    for o in observations:
        f.apply(json.loads(dump(o)))
        f = CallFold(*json.loads(dump([f.call, f.state])))  # as a state store would give it back
    return f.call


@pytest.mark.parametrize("route", STREAMS)
def test_streams_fold_and_replay_alike(route):
    c = folded(call(route))
    assert (c["state"], c["projection"], c["raw"], c["usageEvidence"], c["streamed"]) == ("succeeded", "complete", "complete", "complete", True)
    assert tuple(c[k] for k in ("inputTokens", "outputTokens", "totalTokens", "reasoningTokens", "cachedInputTokens", "cacheCreationInputTokens")) == TOKENS[route]
    r = replay(call(route))
    assert (r["responseState"], r["completion"]) == ("decoded", "CAPTURE é") and tuple(r["tokens"].values()) == TOKENS[route]
    assert c["timeToFirstByteMs"] == 5.0 and c["latencyMs"] == 499.999999


@pytest.mark.parametrize("route", STREAMS)
def test_every_split_of_the_bytes(route):
    body = sse(STREAMS[route])
    whole = Frames().feed(body)
    for k in range(len(body) + 1):
        f = Frames()
        assert f.feed(body[:k]) + Frames(f.pending).feed(body[k:]) == whole


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(STREAMS)), st.integers(1, 200))
def test_cuts_dont_matter(route, cut):
    a, b = folded(call(route, cut)), folded(call(route, 10_000))
    assert {k: v for k, v in a.items() if k not in ("through", "terminalSequence")} == {k: v for k, v in b.items() if k not in ("through", "terminalSequence")}


def test_frames():
    f = Frames()
    assert f.feed(b": comment\ndata: a\ndata:b\r\n\r\nevent: x\rdata: c\r\r\n\n") == [("a\nb", None), ("c", "x")]
    assert not f.truncated() and Frames(b"data: x").truncated()
    with pytest.raises(FrameLimit):
        Frames(limit=4).feed(b"data: 12345")
    stock = Frames()
    assert stock.feed_stock(b'{"a":', "chat_completions") == [] and stock.feed_stock(b"1}", "chat_completions") == [('{"a":1}', None)]
    stock = Frames()
    assert stock.feed_stock(b"event: response.created", "responses") == [] and stock.feed_stock(b'data: {"a":1}', "responses") == [('{"a":1}', "response.created")]


def test_endings():
    assert folded(call("POST /v1/messages", completionOutcome="canceled"))["state"] == "aborted"
    cut = call("POST /v1/messages")[:-3]
    end = numbered([observation("completion", completionOutcome=None, captureIncomplete=True, gap="capture_content_capacity", lostContentBytes=7)], len(cut) + 1)
    c = folded(cut + end)
    assert (c["state"], c["raw"], c["gaps"], c["lostContentBytes"], c["inputTokens"]) == ("unknown", "partial", ["capture_content_capacity"], 7, None)
    assert all(m["finality"] == "partial" for m in c["usage"])
    with pytest.raises(OutOfOrder):
        folded([call("POST /v1/messages")[1]])
    bad = numbered([observation("request", b"{}"), observation("response", b"[1]"), observation("completion", completionOutcome="succeeded")])
    assert (folded(bad)["projection"], folded(bad)["projectionIssue"], folded(bad)["state"]) == ("invalid", "malformed_payload", "unknown")


def test_split_bodies_and_blocks():
    body = dump(FINAL).encode()
    half, sha = len(body) // 2, hashlib.sha256(body).hexdigest()
    part = lambda k, data, at: observation("response", data, "POST /v1/responses", bodyPart={"index": k, "count": 2, "offset": at, "totalBytes": len(body), "totalSha256": sha})
    rows = numbered([observation("request", b"{}", "POST /v1/responses"), part(0, body[:half], 0), part(1, body[half:], half), observation("completion", route="POST /v1/responses", completionOutcome="succeeded")])
    assert folded(rows)["state"] == "succeeded" and folded(rows)["inputTokens"] == 60
    with pytest.raises(OutOfOrder):
        folded([rows[0], rows[1], rows[3] | {"sequence": 3}])
    raw = sse(MESSAGES)
    lengths = [7, 0, 20, len(raw) - 27]
    block = observation("stream_chunk", raw, bodyFraming="stock_hook_block", stockHookChunkLengths=lengths)
    assert folded(numbered([observation("request", b"{}"), block, observation("completion", completionOutcome="succeeded")]))["outputTokens"] == 5
    assert observation_error(block | {"sequence": 1}) is None and observation_error(block | {"sequence": 1, "stockHookChunkLengths": [1]}) == "block_lengths"


def test_assembly():
    tools = [{"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 1, "id": "b", "function": {"name": "g", "arguments": "{"}}, {"index": 0, "id": "a", "function": {"name": "f", "arguments": ""}}]}}]}, {"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 1, "function": {"arguments": "}"}}]}, "finish_reason": "tool_calls"}]}]
    a = assemble("chat_completions", tools, True)
    assert [t["function"] for t in a.response["choices"][0]["message"]["tool_calls"]] == [{"name": "f", "arguments": ""}, {"name": "g", "arguments": "{}"}]
    m = assemble("anthropic_messages", [{"type": "content_block_start", "index": 0, "content_block": {"type": "tool_use", "id": "t", "name": "f", "input": {}}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "input_json_delta", "partial_json": '{"a":'}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "input_json_delta", "partial_json": "1}"}}, {"type": "message_stop"}])
    assert m.response["content"][0]["input"] == {"a": 1} and not m.invalid
    r = assemble("responses", [*RESPONSES[:-1], {"type": "response.failed", "response": FINAL | {"status": "failed", "output": []}}])
    assert r.response["output"][0]["content"][0]["text"] == "CAPTURE é" and r.terminal
    assert assemble("responses", [{"type": "response.unheard_of"}]).unsupported
    assert split_messages([{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "tool_result", "tool_use_id": "t", "content": "y"}]}])[1]["role"] == "tool"


def test_values():
    assert [number_text(x) for x in (0.0003885, 0.002, 1e-7, 1.5e21, 100.0, 1e-6, 123456.75)] == ["0.0003885", "0.002", "1e-7", "1.5e+21", "100", "0.000001", "123456.75"]
    assert [unsafe_number(x) for x in ("1e400", "1.10", "9007199254740993", "0.1", "-0")] == [True, False, True, False, True]
    assert nano_time("2026-01-01T00:00:00.123456789Z") - nano_time("2026-01-01T01:00:00+01:00") == 123456789 and nano_time("x") is None
    assert usage.normalized("anthropic_messages", {"cache_read_input_tokens": 3})["inputTokens"] is None
    assert usage.normalized("anthropic_messages", {"input_tokens": 2**53 - 1, "cache_read_input_tokens": 3})["inputTokens"] is None


def cut_up(route, n=4):
    rows = call(route)
    return [write_segment(rows[k : k + n]) for k in range(0, len(rows), n)]


def test_segment_validation():
    raw = cut_up("POST /v1/messages")[0]
    assert read_segment(raw)[2] is None and len(read_segment(raw)[1]) == 4
    e = json.loads(raw)
    assert read_segment(dump(e | {"contentSha256": "0" * 64}))[2] == "digest"
    assert read_segment(dump(e | {"throughSequence": 5}))[2] == "lines"
    assert read_segment("{")[2] == "json"


def test_admission_and_projection(spark):
    raws = cut_up("POST /v1/chat/completions")
    changed = json.loads(raws[1])
    other = write_segment([o | {"offsetNs": 1} for o in read_segment(raws[1])[1]])
    overlap = write_segment(read_segment(raws[0])[1][2:4])
    df = spark.createDataFrame([(r,) for r in [*raws, raws[0], overlap, "{}"]], "raw string")
    found = segments.admitted(segments.validated(df))
    assert sorted(r.outcome for r in found.collect()) == sorted(["new"] * len(raws) + ["duplicate", "sequence_conflict", "invalid"])
    done = segments.calls(found.where("outcome = 'new'")).collect()
    assert len(done) == 1 and done[0].state == "succeeded" and done[0].projected_through == done[0].persisted_through == len(call("POST /v1/chat/completions"))
    receipts = found.where("outcome = 'new'").select("segment_id", "digest", "call_id", "first_sequence", "through_sequence")
    again = segments.admitted(segments.validated(spark.createDataFrame([(raws[1],), (other,)], "raw string")), receipts)
    assert sorted(r.outcome for r in again.collect()) == ["digest_conflict", "duplicate"] and changed["firstSequence"] == 5
    gap = segments.calls(segments.admitted(segments.validated(spark.createDataFrame([(raws[0],), (raws[2],)], "raw string"))).where("outcome = 'new'")).first()
    assert (gap.persisted_through, gap.state, gap.projected_through) == (4, "in_progress", 4)


def test_stream_equals_batch(spark, tmp_path):
    from tracemill.streaming.calls import call_stream

    raws = cut_up("POST /v1/messages", 3)
    late = raws[1:] + raws[:1] + raws[2:3]
    (tmp_path / "in").mkdir()
    for k, r in enumerate(late):
        (tmp_path / "in" / f"{k:03}.txt").write_text(r + "\n")
        os.utime(tmp_path / "in" / f"{k:03}.txt", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in this order
    source = spark.readStream.schema("value string").option("maxFilesPerTrigger", 4).text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
    q = call_stream(segments.validated(source)).writeStream.format("memory").queryName("calls").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("calls").orderBy("revision").collect()
    batch = segments.calls(segments.admitted(segments.validated(spark.createDataFrame([(r,) for r in raws], "raw string")))).first()
    assert rows[-1].summary == batch.summary and rows[-1].state == "succeeded" and rows[-1].conflicts == 0
    waiting = segments.calls(segments.admitted(segments.validated(spark.createDataFrame([(r,) for r in late[:4]], "raw string")))).first()
    shown = [c for c in waiting.asDict() if c != "persisted_through"]
    assert rows[0].state == "in_progress" and rows[0].destination == "d" and [rows[0][c] for c in shown] == [waiting[c] for c in shown]


def test_shuffled_segments(spark):
    rows = [(f, t, dump(o)) for r in cut_up("POST /v1/responses", 2) for e, o, _ in [read_segment(r)] for f, t in [(e["firstSequence"], e["throughSequence"])]]
    expected = CallFold()
    segments.fold_segments(expected, rows)
    for seed in range(5):
        f = CallFold()
        segments.fold_segments(f, random.Random(seed).sample(rows, len(rows)))
        assert f.call == expected.call


def test_data_source(spark, tmp_path):
    from tracemill.sources.datasource import register

    register(spark)
    for k, r in enumerate(cut_up("POST /v1/messages", 4)):
        (tmp_path / f"{k}.ndjson").write_text(r + "\n")
    (tmp_path / "bad.ndjson").write_text("{}\n")
    found = spark.read.format("capture_segments").load(str(tmp_path)).collect()
    assert sum(r.error is None for r in found) == len(cut_up("POST /v1/messages", 4)) and sum(r.error == "identity" for r in found) == 1


def test_sql_functions(spark):
    from tracemill.functions.udfs import register

    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM sse_frames(encode('event: a\ndata: 1\n\ndata: x', 'utf-8'))").collect()] == [(0, "a", "1", None), (1, None, None, "truncated_frame")]
    assert [bytes(r.piece) for r in spark.sql("SELECT * FROM expand_block(encode('abcde', 'utf-8'), array(2, 0, 3))").collect()] == [b"ab", b"", b"cde"]
    row = spark.sql("""SELECT normalize_usage('responses', '{"input_tokens": 60, "output_tokens": 5}') u, provider_identity(NULL, 'codex', 'claude-1') p, decode_input('{"messages":[]}') d""").first()
    assert json.loads(row.u)["inputTokens"] == 60 and tuple(row.p) == ("openai", "derived_from_wire_format") and json.loads(row.d) == {"kind": "decoded", "messages": []}
