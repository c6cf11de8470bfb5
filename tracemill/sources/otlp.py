"""Trace deliveries: OTLP JSON flattened and projected into typed columns without Python, in one plan.

Attribute values are handled as raw JSON text, so what isn't projected keeps its bytes up to what Spark's JSON reader normalizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.rules import SAFE

# Projected field <- attribute key, by decoder.
STRINGS = {
    "userId": "user.id",
    "sessionId": "session.id",
    "requestId": "trace.metadata.request_id",
    "runId": "trace.metadata.run_id",
    "jobId": "trace.metadata.job_id",
    "rootExecutionId": "trace.metadata.root_execution_id",
    "opencodeSessionId": "trace.metadata.opencode_session_id",
    "environment": "trace.metadata.environment",
    "feature": "trace.metadata.feature",
    "traceName": "trace.name",
    "spanType": "span.type",
    "entityType": "trace.metadata.entity_type",
    "entityId": "trace.metadata.entity_id",
    "requestModel": "gen_ai.request.model",
    "responseModel": "gen_ai.response.model",
    "generationId": "gen_ai.response.id",
    "providerName": "trace.metadata.openrouter.provider_name",
    "finishReason": "gen_ai.response.finish_reason",
    "apiKeyName": "trace.metadata.openrouter.api_key_name",
    "creditPoolId": "trace.metadata.openrouter_generation.credit_pool_id",
    "creditPoolExpiresAt": "trace.metadata.openrouter_generation.credit_pool_expires_at",
}
INTEGERS = {
    "inputTokens": "gen_ai.usage.input_tokens",
    "outputTokens": "gen_ai.usage.output_tokens",
    "totalTokens": "gen_ai.usage.total_tokens",
    "reasoningTokens": "gen_ai.usage.output_tokens.reasoning",
    "cachedInputTokens": "gen_ai.usage.input_tokens.cached",
    "openrouterPromptTokens": "trace.metadata.openrouter_generation.tokens_prompt",
    "openrouterCompletionTokens": "trace.metadata.openrouter_generation.tokens_completion",
}
DOUBLES = {
    "inputCost": "gen_ai.usage.input_cost",
    "outputCost": "gen_ai.usage.output_cost",
    "totalCost": "gen_ai.usage.total_cost",
}
NUMBERS = {
    "openrouterUsageCost": "trace.metadata.openrouter_generation.usage",
    "upstreamUsageCost": "trace.metadata.openrouter_generation.usage_upstream",
    "cacheUsageCost": "trace.metadata.openrouter_generation.usage_cache",
    "dataUsageCost": "trace.metadata.openrouter_generation.usage_data",
    "webUsageCost": "trace.metadata.openrouter_generation.usage_web",
    "webFetchUsageCost": "trace.metadata.openrouter_generation.usage_web_fetch",
    "upstreamWebFetchUsageCost": "trace.metadata.openrouter_generation.usage_upstream_web_fetch",
    "fileUsageCost": "trace.metadata.openrouter_generation.usage_file",
    "byokInferenceUsageCost": "trace.metadata.openrouter_generation.byok_usage_inference",
    "creditPoolUsageCost": "trace.metadata.openrouter_generation.credit_pool_usage",
}
BOOLEANS = {
    "streamed": "trace.metadata.openrouter_generation.streamed",
    "isByok": "trace.metadata.openrouter_generation.is_byok",
}
RESOURCE = {
    "serviceName": "service.name",
    "openrouterTraceId": "openrouter.trace.id",
}
CONTENT = {
    "input": ("trace.input", "span.input", "gen_ai.prompt"),
    "output": ("trace.output", "span.output", "gen_ai.completion"),
}
CACHE_WRITE = ("gen_ai.usage.input_tokens.cache_write", "trace.metadata.openrouter_generation.cache_write_tokens")
SPAN_METADATA, TRACE_METADATA = "span.metadata.", "trace.metadata."
# Bounds of a delivery and of a span.
MAX_RESOURCES = MAX_SCOPES = MAX_SPANS = 64
MAX_ATTRIBUTES, MAX_EVENTS, MAX_LINKS = 256, 16, 16
MAX_STORED_SPAN = 900 << 10

ATTRIBUTES = "array<struct<key string, value string>>"
SPAN = f"struct<traceId string, spanId string, parentSpanId string, name string, kind double, startTimeUnixNano string, endTimeUnixNano string, status string, events string, links string, attributes {ATTRIBUTES}>"
DELIVERY = f"struct<resourceSpans array<struct<resource struct<attributes {ATTRIBUTES}>, scopeSpans array<struct<spans array<{SPAN}>>>>>>"
#: The same document with the types of its values, which reading them as strings would lose.
TYPES = "struct<resourceSpans array<struct<resource variant, scopeSpans array<struct<spans array<variant>>>>>>"


def _only(value: Column, field: str) -> Column:
    """The raw JSON of a typed value's field, if that is its only one."""
    return F.when(F.array_distinct(F.json_object_keys(value)) == F.array(F.lit(field)), F.get_json_object(value, f"$.{field}"))


def _written(value: Column, field: str, shape: str) -> Column:
    """The field's token as it is written, if it has that shape."""
    found = F.regexp_extract(value, rf'^\s*\{{\s*"{field}"\s*:\s*({shape})\s*\}}\s*$', 1)
    return F.when(found != "", found)


NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def string_value(v: Column) -> Column:
    plain = v.rlike(r'^\{"stringValue":"[^"\\]*"\}$')
    return F.when(plain, F.substring(v, F.lit(len('{"stringValue":"') + 1), F.length(v) - len('{"stringValue":""}'))).when(v.rlike(r'^\s*\{\s*"stringValue"\s*:\s*"'), _only(v, "stringValue"))


def boolean_value(v: Column) -> Column:
    return _written(v, "boolValue", "true|false").cast("boolean")


def double_value(v: Column) -> Column:
    found = _written(v, "doubleValue", NUMBER).cast("double")
    return F.when(F.abs(found) < float("inf"), found)


def integer_value(v: Column) -> Column:
    """A safe integer: a number, also one written as 3.0 or 3e2, or a canonical decimal string."""
    text = F.translate(_written(v, "intValue", '"(?:0|-?[1-9][0-9]{0,15})"'), '"', "").cast("long")
    number = _written(v, "intValue", NUMBER).cast("double")
    found = F.coalesce(text, F.when((number == F.floor(number)) & (F.abs(number) <= SAFE), number.cast("long")))
    return F.when(F.abs(found) <= SAFE, found)


#: Projected fields and the decoded part of a value that each takes.
GROUPS = [(STRINGS, "text"), (INTEGERS, "whole"), (DOUBLES, "double"), (NUMBERS, "number"), (BOOLEANS, "flag")]


def decoded(v: Column) -> Column:
    """A raw value as each decoder reads it; all but one part are null."""
    read = {"text": ("stringValue", string_value), "whole": ("intValue", integer_value), "double": ("doubleValue", double_value), "flag": ("boolValue", boolean_value)}
    return F.struct(*(F.when(F.contains(v, F.lit(f'"{field}"')), decode(v)).alias(part) for part, (field, decode) in read.items()))


def unique_values(attributes: Column) -> Column:
    """A map from each key that exactly one attribute has to its decoded value. Only arrays with repeated keys are gone through key by key."""
    keys = F.transform(attributes, lambda a: a["key"])
    every = F.map_from_arrays(keys, F.transform(attributes, lambda a: decoded(a["value"])))
    alone = F.map_filter(every, lambda k, _: F.size(F.filter(keys, lambda x: x == k)) == 1)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), every).otherwise(alone)


def copies(attributes: Column, keys: tuple[str, ...]) -> Column:
    """The texts under any of `keys`, null for one that isn't a string."""
    return F.transform(F.filter(attributes, lambda a: a["key"].isin(*keys)), lambda a: string_value(a["value"]))


def agreed(texts: Column) -> Column:
    """The text that all copies are; null if there is none, or one differs or isn't a string."""
    return F.when((F.size(F.array_distinct(texts)) == 1) & ~F.array_contains(F.transform(texts, lambda x: x.isNull()), True), F.get(texts, F.lit(0)))


def left_over(attributes: Column, claimed: Column) -> Column:
    """The attributes whose keys aren't claimed, in order."""
    return F.filter(attributes, lambda a: ~F.array_contains(claimed, a["key"]))


def without_copies(attributes: Column) -> Column:
    """The attributes less each span.metadata copy of an equal trace.metadata attribute, one for one, whether or not a column holds that."""

    def copy_of(a: Column, k: Column) -> Column:
        twin = F.concat(F.lit(TRACE_METADATA), F.substring(a["key"], F.lit(len(SPAN_METADATA) + 1), F.length(a["key"])))
        twins = F.filter(attributes, lambda b: (b["key"] == twin) & (b["value"] == a["value"]))
        earlier = F.filter(F.slice(attributes, F.lit(1), k), lambda b: (b["key"] == a["key"]) & (b["value"] == a["value"]))
        return a["key"].startswith(SPAN_METADATA) & (F.size(earlier) < F.size(twins))

    some = F.exists(attributes, lambda a: a["key"].startswith(SPAN_METADATA))
    return F.when(some, F.filter(attributes, lambda a, k: ~copy_of(a, k))).otherwise(attributes)


def cache_write_tokens(keys: Column, by_key: Column) -> Column:
    """From the first of two keys that is present; it must be there once, as an integer, else nothing."""
    first, second = (F.element_at(by_key, k)["whole"] for k in CACHE_WRITE)
    return F.when(F.array_contains(keys, CACHE_WRITE[0]), first).otherwise(second)


def _type(v: Column, path: str) -> Column:
    """The type of what is at a path, VOID of a null, and null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _attributes_bad(of: Column) -> Column:
    """Whether an object's attributes are there but no array of keys, strings that aren't empty, with objects."""
    entries = F.try_variant_get(of, "$.attributes", "array<variant>")

    def bad(a: Column) -> Column:
        return ~F.coalesce((_type(a, "$.key") == "STRING") & (F.try_variant_get(a, "$.key", "string") != "") & _type(a, "$.value").startswith("OBJECT"), F.lit(False))

    return _type(of, "$.attributes").isNotNull() & (entries.isNull() | F.coalesce(F.exists(entries, bad), F.lit(False)))


def _span_bad(s: Column) -> Column:
    required = [F.coalesce((_type(s, f"$.{k}") == "STRING") & (F.try_variant_get(s, f"$.{k}", "string") != ""), F.lit(False)) for k in ("traceId", "spanId", "name")]
    shapes = {"parentSpanId": "STRING", "startTimeUnixNano": "STRING", "endTimeUnixNano": "STRING", "kind": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "events": "ARRAY.*", "links": "ARRAY.*", "status": "OBJECT.*"}
    optional = [F.coalesce(_type(s, f"$.{k}").rlike(f"^{shape}$"), F.lit(True)) for k, shape in shapes.items()]
    return ~reduce(lambda a, b: a & b, [*required, *optional]) | _attributes_bad(s)


#: Types in a document's schema that call for a look at each value: the wrong ones, and what arrays of unlike values are merged to.
UNUSUAL = r"\b(?:%s)" % "|".join((
    "(traceId|spanId|name|parentSpanId|startTimeUnixNano|endTimeUnixNano|key): (?!STRING)",
    "kind: (?!BIGINT|DOUBLE|FLOAT|DECIMAL)",
    "(resource|status|value): (?!OBJECT)",
    "(events|links): (?!ARRAY)",
    "(resourceSpans|scopeSpans|spans|attributes): (?!ARRAY<(OBJECT|VOID))",
))


def type_error(types: Column) -> Column:
    """Whether any value of a document, read as TYPES, has a type that it must not have."""
    resources = types["resourceSpans"]
    scopes = F.flatten(F.transform(resources, lambda r: r["scopeSpans"]))
    resource_bad = lambda r: r["resource"].isNotNull() & (~F.schema_of_variant(r["resource"]).startswith("OBJECT") | _attributes_bad(r["resource"]))
    return F.coalesce(F.exists(resources, resource_bad), F.lit(False)) | F.coalesce(F.exists(scopes, lambda s: F.exists(s["spans"], _span_bad)), F.lit(False))


def deliveries(raw: DataFrame, body: str = "body", max_bytes: int = 8 << 20) -> DataFrame:
    """`raw` with the parsed delivery and `error`: too_large, malformed, bound, or null; `test` tells an empty envelope, which writes nothing.

    A binary body must be strict UTF-8. A delivery is taken whole or not at all. Spans over MAX_STORED_SPAN are measured as they arrive.
    The schema of the whole document tells most deliveries to be well formed; only others are looked at value by value.
    """
    text = F.when(F.is_valid_utf8(F.col(body).cast("string")), F.col(body).cast("string"))
    # JSON readers stop at the end of a value; in an array whose last element can't be in the text, what follows it is an error.
    end = F.sha2(text, 256)
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), end, F.lit('"]')))
    one = raw.withColumns({"_text": text, "_boxed": boxed, "delivery": F.from_json(text, DELIVERY)})
    schema = F.when(F.try_variant_get("_boxed", "$[1]", "string") == F.sha2("_text", 256), F.schema_of_variant(F.try_variant_get("_boxed", "$[0]", "variant")))
    resources = F.col("delivery.resourceSpans")
    two = one.withColumns({"_schema": schema, "_scopes": F.flatten(F.transform(resources, lambda r: r["scopeSpans"]))}).withColumn("_spans", F.flatten(F.transform("_scopes", lambda s: s["spans"])))
    no_attributes = F.array().cast(ATTRIBUTES)
    attributes = lambda s: F.coalesce(s["attributes"], no_attributes)
    length = lambda j: F.coalesce(F.json_array_length(j), F.lit(0))
    missing = F.col("_scopes").isNull() | F.col("_spans").isNull()
    empty = F.exists("_spans", lambda s: F.coalesce((s["traceId"] == "") | (s["spanId"] == "") | (s["name"] == ""), F.lit(True)) | F.exists(attributes(s), lambda a: F.coalesce((a["key"] == "") | a["value"].isNull(), F.lit(True))))
    large = F.exists("_spans", lambda s: (F.size(attributes(s)) > MAX_ATTRIBUTES) | (length(s["events"]) > MAX_EVENTS) | (length(s["links"]) > MAX_LINKS))
    heavy = (F.octet_length("_text") > MAX_STORED_SPAN) & F.exists("_spans", lambda s: F.octet_length(F.to_json(s)) > MAX_STORED_SPAN)
    unusual = F.col("_schema").rlike(UNUSUAL) | F.contains("_text", F.lit("null"))
    error = (
        F.when(F.octet_length(body) > max_bytes, "too_large")
        .when(~F.coalesce(F.col("_schema").startswith("OBJECT"), F.lit(False)) | resources.isNull() | missing, "malformed")
        .when((F.size(resources) > MAX_RESOURCES) | (F.size("_scopes") > MAX_SCOPES) | (F.size("_spans") > MAX_SPANS) | F.coalesce(large | heavy, F.lit(False)), "bound")
        .when(F.coalesce(empty, F.lit(False)), "malformed")
        .when(unusual & type_error(F.from_json("_text", TYPES)), "malformed")
    )
    named = two.withColumn("error", error).drop("_text", "_boxed", "_schema", "_scopes", "_spans")
    return named.withColumn("test", F.coalesce(F.col("error").isNull() & (F.size(resources) == 0), F.lit(False)))


def response_status(authorized: Column, content_type: Column, error: Column, test: Column, admitted: Column) -> Column:
    """What a delivery is answered: 401, 415, 413, 400, 204 where nothing new was in it, else 202."""
    json = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1))) == "application/json"
    return F.when(~authorized, 401).when(~json, 415).when(error == "too_large", 413).when(error.isNotNull(), 400).when(test | (admitted == 0), 204).otherwise(202)


def projections(by_key: Column) -> dict[str, Column]:
    value = lambda key, part: F.coalesce(value(key, "double"), value(key, "whole").cast("double")) if part == "number" else F.element_at(by_key, key)[part]
    return {field: value(key, part) for group, part in GROUPS for field, key in group.items()}


def claimed() -> Column:
    """The keys that a projected row's columns hold."""
    held = [F.when(F.col(field).isNotNull(), F.lit(key)) for group, _ in GROUPS for field, key in group.items()]
    return F.array_compact(F.array(*held, *(F.when(F.col(field).isNotNull(), F.lit(key)) for field, keys in CONTENT.items() for key in keys)))


def spans(parsed: DataFrame, keep: tuple[str, ...] = ("delivery_id", "received_at")) -> DataFrame:
    """A row for each span of the deliveries without an error: structure, 45 projected fields, content, what is left, facts."""
    # A filter on the error, or one that Spark infers from an inner explode, would be pushed down and repeat the parsing in its condition.
    good = F.when(F.col("error").isNull(), F.col("delivery.resourceSpans"))
    one = parsed.select(*keep, F.posexplode_outer(good).alias("r", "res")).where("r IS NOT NULL")
    two = one.select(*keep, "r", F.coalesce("res.resource.attributes", F.array().cast(ATTRIBUTES)).alias("_resource"), F.posexplode("res.scopeSpans").alias("s", "scope"))
    three = two.select(*keep, "r", "_resource", "s", F.posexplode("scope.spans").alias("p", "span")).withColumn("_all", F.coalesce("span.attributes", F.array().cast(ATTRIBUTES)))
    # Each step is a projection of its own: what a later one uses many times is computed once.
    four = three.withColumns({"_by_key": unique_values(F.col("_all")), "_by_resource_key": unique_values(F.col("_resource")), "_keys": F.transform("_all", lambda a: a["key"]), **{f"_{field}": copies(F.col("_all"), keys) for field, keys in CONTENT.items()}})
    fields = {field: F.element_at("_by_resource_key", key)["text"] for field, key in RESOURCE.items()} | projections(F.col("_by_key")) | {field: agreed(F.col(f"_{field}")) for field in CONTENT}
    five = four.withColumns(fields)
    six = five.withColumns({"_claimed": claimed(), "_resource_claimed": F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(k)) for f, k in RESOURCE.items()))), "_rest": without_copies(F.col("_all"))})
    structure = [F.col(f"span.{k}").alias(k) for k in ("traceId", "spanId", "parentSpanId", "name", "kind", "startTimeUnixNano", "endTimeUnixNano")]
    rest = [left_over(F.col("_rest"), F.col("_claimed")).alias("attributes"), left_over(F.col("_resource"), F.col("_resource_claimed")).alias("resourceAttributes"), F.col("span.events").alias("eventsJson"), F.col("span.links").alias("linksJson"), F.col("span.status").alias("statusJson"), cache_write_tokens(F.col("_keys"), F.col("_by_key")).alias("cacheCreationInputTokens")]
    found = six.select(*keep, F.struct("r", "s", "p").alias("ordinal"), *structure, *fields, *rest)
    facts = {"inputUtf8Bytes": F.octet_length("input").cast("long"), "outputUtf8Bytes": F.octet_length("output").cast("long"), "attributeCount": F.size("attributes").cast("long"), "resourceAttributeCount": F.size("resourceAttributes").cast("long")}
    return found.withColumns(facts)


def stored_correlations(attributes: Column) -> Column:
    """The correlation ids among a stored span's attributes, as a struct; none of them if any value isn't a JSON object."""
    broken = F.exists(attributes, lambda a: ~F.coalesce(F.schema_of_variant(F.try_parse_json(a["value"])).startswith("OBJECT"), F.lit(False)))
    by_key = unique_values(attributes)
    names = ("requestId", "runId", "jobId", "rootExecutionId", "opencodeSessionId")
    return F.struct(*(F.when(~broken, F.element_at(by_key, STRINGS[n])["text"]).alias(n) for n in names))


def reconstructs(original: Column) -> Column:
    """Whether a projected span's columns and left-over attributes are what its original attributes give: a check of stored rows."""
    same = [F.col(field).eqNullSafe(value) for field, value in projections(unique_values(original)).items()]
    same += [F.col(field).eqNullSafe(agreed(copies(original, keys))) for field, keys in CONTENT.items()]
    return reduce(lambda a, b: a & b, same) & (F.col("attributes") == left_over(without_copies(original), claimed()))


PAYLOAD = ("input", "output", "attributes", "resourceAttributes", "eventsJson", "linksJson", "statusJson")


def archived(rows: DataFrame, prefix: str = "trace-spans") -> tuple[DataFrame, DataFrame]:
    """(slim rows with a payload reference, payload objects by key): content leaves the rows, under its digest."""
    from tracemill.functions.rules import percent_encoded

    body = F.to_json(F.struct(*PAYLOAD))
    sha = F.sha2("payload_json", 256)
    found = rows.withColumn("payload_json", body).withColumn("payload", F.struct(F.concat_ws("/", F.lit(prefix), percent_encoded(F.col("traceId")), percent_encoded(F.col("spanId")), F.concat(sha, F.lit(".json"))).alias("key"), sha.alias("sha256"), F.octet_length("payload_json").cast("long").alias("byteLength")))
    return found.drop(*PAYLOAD, "payload_json"), found.select("payload.key", "payload.sha256", "payload.byteLength", F.col("payload_json").cast("binary").alias("bytes")).dropDuplicates(["key"])


def loaded(slim: DataFrame, objects: DataFrame) -> DataFrame:
    """Slim rows with their content again; a row whose object is absent has none, one whose bytes differ from its digest fails."""
    o = objects.select(F.col("key").alias("k"), "bytes")
    joined = slim.join(o, F.col("payload.key") == F.col("k"), "left")
    checked = F.when(F.col("bytes").isNull() | (F.sha2("bytes", 256) == F.col("payload.sha256")) & (F.octet_length("bytes") == F.col("payload.byteLength")), F.col("bytes")).otherwise(F.raise_error(F.lit("a payload's bytes differ from its digest")))
    schema = f"input string, output string, attributes {ATTRIBUTES}, resourceAttributes {ATTRIBUTES}, eventsJson string, linksJson string, statusJson string"
    return joined.withColumn("c", F.from_json(checked.cast("string"), schema)).select(*slim.columns, "c.*")
