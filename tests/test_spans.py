"""Deliveries into rows, archives and pages; content; rules."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.core.content import MARKER, BoundExceeded, Externalizer, decode_input, decode_output, references
from tracemill.functions import rules
from tracemill.operators import admission, bodies, paging
from tracemill.sources import otlp


def attribute(key, **value):
    return {"key": key, "value": value}


def delivery(attributes, resource=(), **more):
    return json.dumps({"resourceSpans": [{"resource": {"attributes": list(resource)}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "n", "attributes": attributes} | more]}]}]})


def parsed(spark, *bodies_):
    return otlp.deliveries(spark.createDataFrame([(k, k, b) for k, b in enumerate(bodies_)], "delivery_id long, received_at long, body string"))


def test_projection(spark):
    a = [attribute("user.id", stringValue="u"), attribute("gen_ai.usage.input_tokens", intValue="13"), attribute("gen_ai.usage.output_tokens", intValue=5), attribute("gen_ai.usage.total_tokens", intValue="007"), attribute("gen_ai.usage.total_cost", doubleValue=8.85e-06), attribute("trace.metadata.openrouter_generation.usage", intValue="0"), attribute("trace.metadata.openrouter_generation.is_byok", boolValue=True), attribute("session.id", intValue="3"), attribute("trace.metadata.feature", stringValue="x"), attribute("trace.metadata.feature", stringValue="y"), attribute("trace.input", stringValue="café"), attribute("gen_ai.prompt", stringValue="café"), attribute("trace.output", stringValue="a"), attribute("span.output", stringValue="b"), attribute("trace.metadata.z", stringValue="1"), attribute("span.metadata.z", stringValue="1"), attribute("span.metadata.z", stringValue="1"), attribute("gen_ai.usage.input_tokens.cache_write", intValue="759")]
    r = otlp.spans(parsed(spark, delivery(a, [attribute("service.name", stringValue="svc"), attribute("other", intValue="1")], events=[{"x": 1}]))).first()
    assert (r.userId, r.inputTokens, r.outputTokens, r.totalTokens, r.totalCost, r.openrouterUsageCost, r.isByok, r.sessionId, r.feature, r.input, r.output, r.serviceName) == ("u", 13, 5, None, 8.85e-06, 0.0, True, None, None, "café", None, "svc")
    assert [x.key for x in r.attributes] == ["gen_ai.usage.total_tokens", "session.id", "trace.metadata.feature", "trace.metadata.feature", "trace.output", "span.output", "trace.metadata.z", "span.metadata.z", "gen_ai.usage.input_tokens.cache_write"]
    assert (r.inputUtf8Bytes, r.attributeCount, r.resourceAttributeCount, r.cacheCreationInputTokens, json.loads(r.eventsJson)) == (5, 9, 1, 759, [{"x": 1}])


def test_delivery_errors(spark):
    many = json.dumps({"resourceSpans": [{"scopeSpans": []}] * 65})
    found = parsed(spark, "{", "[]", many, delivery([attribute("", stringValue="x")]), delivery([], name=""), json.dumps({"resourceSpans": []}), delivery([attribute(f"k{k}", stringValue="") for k in range(257)])).orderBy("delivery_id").collect()
    assert [r.error for r in found] == ["malformed", "malformed", "bound", "malformed", "malformed", None, "bound"]
    assert [r.test for r in found][5] is True


def test_malformed_types(spark):
    """Values of a wrong JSON type, which reading them as strings would let through."""
    span = lambda **more: delivery([], **more)
    scope = lambda x: json.dumps({"resourceSpans": [x]})
    bad = [span(traceId=5), span(spanId=""), span(parentSpanId=1), span(kind="x"), span(startTimeUnixNano=3), span(events={}), span(links=3), span(status="bad"), span(status=None), delivery([attribute(7, stringValue="x")]), delivery([{"key": "k", "value": "v"}]), delivery([{"key": "k"}]), delivery([]).replace("\"attributes\": [], ", "").replace("\"attributes\": []", "\"attributes\": {}"), scope({}), scope({"scopeSpans": [{}]}), scope({"resource": [], "scopeSpans": []}), scope({"resource": {"attributes": 3}, "scopeSpans": []}), scope(3), '{"resourceSpans":[]} trailing', '{"resourceSpans":{}}', "", "null"]
    good = [span(kind=2, status={}, events=[], links=[], parentSpanId="", endTimeUnixNano="1"), scope({"scopeSpans": []}), '{"resourceSpans":[]}']
    found = parsed(spark, *bad, *good).orderBy("delivery_id").collect()
    assert [(b, r.error) for b, r in zip(bad, found)] == [(b, "malformed") for b in bad]
    assert [r.error for r in found[len(bad) :]] == [None] * len(good) and [r.test for r in found] == [False] * (len(found) - 1) + [True]
    raw = spark.createDataFrame([(1, 1, span().encode()), (2, 2, span().encode()[:-1] + b"\xff"), (3, 3, span(name="x" * (901 << 10)).encode())], "delivery_id long, received_at long, body binary")
    assert [r.error for r in otlp.deliveries(raw).orderBy("delivery_id").collect()] == [None, "malformed", "bound"]


def test_response_status(spark):
    rows = [(False, "application/json", None, False, 1), (True, "text/plain", None, False, 1), (True, "application/json; charset=utf-8", "too_large", False, 0), (True, "Application/JSON", "bound", False, 0), (True, "application/json", None, True, 0), (True, "application/json", None, False, 0), (True, "application/json", None, False, 2)]
    df = spark.createDataFrame(rows, "authorized boolean, content_type string, error string, test boolean, admitted long")
    assert [r[0] for r in df.select(otlp.response_status(*map(F.col, df.columns))).collect()] == [401, 415, 413, 400, 204, 204, 202]


def test_stored_rows(spark):
    a = [attribute("user.id", stringValue="u"), attribute("trace.metadata.run_id", stringValue="r"), attribute("trace.metadata.z", stringValue="1"), attribute("span.metadata.z", stringValue="1"), attribute("trace.metadata.environment", stringValue="dev"), attribute("span.metadata.environment", stringValue="dev")]
    rows = otlp.spans(parsed(spark, delivery(a)))
    assert [x.key for x in rows.first().attributes] == ["trace.metadata.z"]
    original = F.from_json(F.lit(json.dumps([{"key": x["key"], "value": x["value"]} for x in a])), otlp.ATTRIBUTES)
    assert rows.select(otlp.reconstructs(original)).first()[0] is True
    assert rows.withColumn("userId", F.lit("v")).select(otlp.reconstructs(original)).first()[0] is False
    stored = rows.select(otlp.stored_correlations(original).alias("c"), otlp.stored_correlations(F.concat(original, F.array(F.struct(F.lit("x").alias("key"), F.lit("{").alias("value"))))).alias("d")).first()
    assert (stored.c.runId, stored.c.jobId, stored.d.runId) == ("r", None, None)


def test_archive(spark):
    rows = otlp.spans(parsed(spark, delivery([attribute("trace.input", stringValue="text"), attribute("k", intValue=1)], traceId="a b/c")))
    slim, objects = otlp.archived(rows)
    assert "input" not in slim.columns and slim.first().payload.key.startswith("trace-spans/a%20b%2Fc/s/")
    back = otlp.loaded(slim, objects).first()
    assert back.input == "text" and back.attributes[0].key == "k"
    assert otlp.loaded(slim, objects.limit(0)).first().input is None
    with pytest.raises(Exception, match="digest"):
        otlp.loaded(slim, objects.withColumn("bytes", F.lit(b"{}"))).collect()


def test_variants(spark):
    rows = spark.createDataFrame([("a\0b", "c", "first", 0), ("a", "b\0c", "first", 1)] + [("t", "s", f"v{k % 11}", 10 + k) for k in range(30)], "t string, s string, digest string, at long")
    found = {(r.t, r.s): r for r in admission.variants(rows, ["t", "s"], "digest", "at").collect()}
    assert len(found) == 3 and found["t", "s"].variant_count == 10 and [v.arrived for v in found["t", "s"].variants] == list(range(11, 19)) and found["t", "s"].digest == "v0"
    all_ = admission.variants(rows, ["t", "s"], "digest", "at")
    recorded = admission.backfill(all_.drop("digest"), rows.limit(0).select("t", "s", "digest"), ["t", "s"], "variants", "digest")
    assert recorded.count() == 8 and admission.backfill(all_.drop("digest"), recorded, ["t", "s"], "variants", "digest").count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(k, 100 if k < 4 else 200) for k in range(8)], "id long, at long")
    keys, cursor, sizes, seen = [("at", False), ("id", False)], None, [], []
    while True:
        p = paging.page_result(df, keys, 3, 7, cursor)
        sizes.append(len(p["page"]))
        seen += [r["id"] for r in p["page"]]
        cursor = p["cursor"]
        if p["done"]:
            break
    assert sizes == [3, 3, 2] and seen == list(range(7, -1, -1))
    with pytest.raises(ValueError):
        paging.page(df, keys, 8, 7)
    with pytest.raises(ValueError):
        paging.page_result(df, keys, 3, 7, size=F.lit(10**6))
    assert paging.page(df, keys, 8, 7, clamp=True).count() == 7


def test_bodies(spark):
    df = spark.createDataFrame([(1, "é" * 1000), (2, ""), (3, "abc")], "id long, body string")
    parts = bodies.split(df, "id", "body", 256)
    assert {r.id: (r.body, r.whole) for r in bodies.reassemble(parts, "id").collect()} == {1: ("é" * 1000, True), 2: ("", True), 3: ("abc", True)}
    assert {r.id: r.whole for r in bodies.reassemble(parts.where("index <> 1"), "id").collect()}[1] is False
    binary = bodies.split(df.withColumn("body", F.encode("body", "utf-8")), "id", "body", 100)
    assert {r.id: bytes(r.body).decode() for r in bodies.reassemble(binary, "id").collect()}[1] == "é" * 1000


def test_rules(spark):
    one = spark.range(1)
    show = lambda *c: list(one.select(*c).first())
    assert show(*(rules.canonical_integer(F.lit(x)) for x in ("0", "-7", "007", "-0", "+1", "9007199254740991", "9007199254740992"))) == [0, -7, None, None, None, 2**53 - 1, None]
    assert show(*(rules.strict_base64(F.lit(x)).isNotNull() for x in ("YWI=", "YWI", "a$b=", ""))) == [True, False, False, True]
    assert show(rules.cost(F.lit(0.0), F.lit(None).cast("double"), F.lit(True), F.lit(0.0003885)), rules.cost(F.lit(0.1), F.lit(None).cast("double"), F.lit(True), F.lit(None).cast("double")), rules.cost(F.lit(None).cast("double"), F.lit(0.002), F.lit(None).cast("boolean"), F.lit(None).cast("double"))) == [0.0003885, None, 0.002]
    assert show(rules.percent_encoded(F.lit("a b/~!'()*é"))) == ["a%20b%2F~!'()*%C3%A9"]


def test_content():
    x = Externalizer("dd", inline=20)
    moved = json.loads(x.content(json.dumps({"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "data:image/png;base64,AAEC"}}, {"type": "text", "text": "short"}]}, {"role": "system", "content": "long text " * 9}]})))
    assert [b for _, b in x.blobs] == [b"\0\1\2", ("long text " * 9).encode()] and len(references(moved)) == 2 and x.blobs[1][0]["key"].startswith("trace-blobs/dd/1-")
    decoded = decode_input(json.dumps(moved))
    assert decoded["kind"] == "decoded" and decoded["messages"][0]["content"][0]["image"]["kind"] == "blob"
    same = '{"a": 1.50, "b": [true]}'
    assert Externalizer("d").content(same) == same and Externalizer("d").content("not json") == "not json"
    y = Externalizer("d")
    y.content('{"a": 1e400}')
    assert y.blobs[0][1] == b'{"a": 1e400}'
    z = Externalizer("d")
    z.content(json.dumps({MARKER: {"kind": "forged"}}))
    assert len(z.blobs) == 1
    with pytest.raises(ValueError):
        Externalizer("d").content('{"x": "data:image/png;base64,A"}')
    with pytest.raises(BoundExceeded):
        Externalizer("d", inline=1, max_blob=3).content('{"x": "abcdef"}')
    assert [decode_input(r)["kind"] for r in (None, "{", "{}", '{"messages":[{"role":"critic","content":"x"},{"role":5}]}', '{"messages":[{"role":"user"}]}')] == ["absent", "invalid", "unsupported", "unsupported", "invalid"]
    assert decode_output('{"completion":"x","reasoning":null,"tools":[{"type":"function","function":{"name":"f"}}]}') == {"kind": "decoded", "text": "x", "tool_definitions": [{"name": "f"}], "reasoning": None}
    assert [decode_output(r)["kind"] for r in ('{"x":1}', '{"completion":5}')] == ["unsupported", "invalid"]


def test_readers_and_delivery(spark):
    from tracemill.operators import calls
    from tracemill.operators import delivery as batches
    from tracemill.plans.readers import TraceReader, resolve_blobs

    rows = spark.createDataFrame([("t", f"s{k}", "n" * 200, "r", 5 + k // 4, k) for k in range(8)], "traceId string, spanId string, name string, requestId string, receivedAt long, creationTime long")
    reader, cursor, seen = TraceReader(rows), None, []
    for _ in range(3):
        p = reader.page_correlation_summaries({"requestId": "r"}, 3, cursor)
        seen += [x["spanId"] for x in p["page"]]
        cursor = p["cursor"]
    assert seen == [f"s{k}" for k in range(7, -1, -1)] and p["done"] and len(p["page"][0]["name"]) == 128 and p["page"][0]["clippedFields"] == ["name"]
    with pytest.raises(ValueError):
        reader.page_correlation_summaries({"requestId": "r"}, 8)
    halves = batches.split_batches(spark.createDataFrame([(1, 5, 9)], "batch_id long, first long, through long")).orderBy("half").collect()
    assert [(h.first, h.through) for h in halves] == [(5, 7), (8, 9)]
    clean = batches.without_credentials(spark.createDataFrame([("has sekret", "ok", "sekret"), ("a\nb", None, "k")], "x string, y string, key string"), ["x", "y"], "key").collect()
    assert [(r.x, r.y, r.omissions) for r in clean] == [(None, "ok", ["x"]), (None, None, ["x"])]
    a = [attribute("gen_ai.usage.input_tokens", intValue=3), attribute("gen_ai.request.model", stringValue="gpt-5"), attribute("gen_ai.usage.total_cost", doubleValue=0.5)]
    s = otlp.spans(parsed(spark, delivery(a)))
    one, old = calls.from_spans(s).first(), calls.from_spans(s, legacy=True).first()
    assert (one.provider, one.cost, one.inputTokens, one.callId, old.provider, old.cost) == ("openai", 0.5, 3, "span:s", None, None)
    ref = ("o", "k", "0" * 64, 3, "t", "binary")
    schema = "owner string, key string, sha256 string, byteLength long, contentType string, encoding string"
    wanted = spark.createDataFrame([ref], schema)
    objects = spark.createDataFrame([("k", b"abc")], "key string, bytes binary")
    assert resolve_blobs(wanted, wanted.limit(0), objects, 10).count() == 0
    with pytest.raises(Exception, match="reference"):
        resolve_blobs(wanted, wanted, objects, 10).collect()
