"""Queries of the decision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import rules
from tracemill.plans.registry import Tables, query


@query("SELECT event_id, CASE WHEN regexp_full_match(props->>'k', '0|-?[1-9][0-9]{0,15}') THEN (props->>'k')::BIGINT END AS k FROM events")
def attr_project_int(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.canonical_integer(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT user_id, CASE WHEN sum((event_type = 'purchase')::BIGINT) = 1 THEN max(CASE WHEN event_type = 'purchase' THEN value END) END AS purchase, CASE WHEN sum((event_type = 'error')::BIGINT) = 1 THEN max(CASE WHEN event_type = 'error' THEN value END) END AS error FROM events GROUP BY user_id")
def attr_unique_key(t: Tables) -> DataFrame:
    """A key projects only where exactly one attribute has it."""

    def unique(kind: str):
        has = F.col("event_type") == kind
        return F.when(F.count_if(has) == 1, F.max(F.when(has, F.col("value")))).alias(kind)

    return t.events.groupBy("user_id").agg(unique("purchase"), unique("error"))


@query("""SELECT l_orderkey, l_linenumber, q + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0 END AS "inputTokens", l_linenumber::BIGINT AS "outputTokens",
  CASE WHEN l_returnflag = 'R' THEN 3 END AS "cachedInputTokens", CASE WHEN l_linestatus = 'O' THEN 5 END AS "cacheCreationInputTokens", CAST(NULL AS BIGINT) AS "totalTokens", CAST(NULL AS BIGINT) AS "reasoningTokens"
  FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)""")
def token_normalize(t: Tables) -> DataFrame:
    reported = {"input_tokens": F.col("l_quantity").cast("long"), "output_tokens": F.col("l_linenumber").cast("long"), "cache_read_input_tokens": F.when(F.col("l_returnflag") == "R", 3).cast("long"), "cache_creation_input_tokens": F.when(F.col("l_linestatus") == "O", 5).cast("long")}
    return t.lineitem.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in rules.normalized_tokens("anthropic_messages", reported).items()))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN base >= 0 AND (NOT own OR byok >= 0) THEN CASE WHEN own THEN base + byok ELSE base END END AS cost FROM
  (SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, l_tax - 0.01) AS base, l_returnflag = 'A' AS own, CASE WHEN l_linenumber <> 2 THEN l_tax END AS byok FROM lineitem)""")
def cost_rule(t: Tables) -> DataFrame:
    total, usage = F.when(F.col("l_discount") > 0.05, F.col("l_discount")), F.col("l_tax") - 0.01
    return t.lineitem.select("l_orderkey", "l_linenumber", rules.cost(total, usage, F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") != 2, F.col("l_tax"))).alias("cost"))


MODELS = ("claude-x", "gpt-5", "o3-mini", "codex-1", "gemini-2", "llama", "my-gpt-5")


@query("""WITH m AS (SELECT p_partkey, ['claude-x', 'gpt-5', 'o3-mini', 'codex-1', 'gemini-2', 'llama', 'my-gpt-5'][p_partkey % 7 + 1] AS model, CASE WHEN p_size % 5 = 0 THEN 'acme' END AS observed, CASE p_size % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'other' END AS wire FROM part),
n AS (SELECT *, CASE wire WHEN 'claude' THEN 'anthropic' WHEN 'codex' THEN 'openai' END AS w, CASE WHEN starts_with(model, 'claude-') THEN 'anthropic' WHEN regexp_matches(model, '^(gpt-|o[0-9]|codex)') THEN 'openai' WHEN starts_with(model, 'gemini-') THEN 'google' END AS b FROM m)
SELECT p_partkey, coalesce(observed, w, b) AS provider, CASE WHEN observed IS NOT NULL THEN 'observed' WHEN w IS NOT NULL THEN 'derived_from_wire_format' WHEN b IS NOT NULL THEN 'derived_from_model' ELSE 'unavailable' END AS provenance FROM n""")
def provider_identity(t: Tables) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    wire = F.when(F.col("p_size") % 4 == 0, "claude").when(F.col("p_size") % 4 == 1, "codex").when(F.col("p_size") % 4 == 2, "other")
    return t.part.select("p_partkey", rules.provider(F.when(F.col("p_size") % 5 == 0, "acme"), wire, model).alias("p")).select("p_partkey", "p.*")


@query("""SELECT o_orderkey, CASE WHEN outcome IS NULL AND inc THEN 'unknown' WHEN outcome = 'canceled' THEN 'aborted' WHEN outcome IN ('failed', 'rejected') THEN outcome WHEN term = 'completed' THEN 'succeeded' WHEN term IN ('failed', 'incomplete') THEN 'failed' ELSE 'unknown' END AS state FROM
  (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'canceled' WHEN '2' THEN 'failed' WHEN '3' THEN 'succeeded' WHEN '4' THEN 'rejected' END AS outcome, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'incomplete' END AS term, o_orderkey % 2 = 0 AS inc FROM orders)""")
def state_table(t: Tables) -> DataFrame:
    first = F.left("o_orderpriority", F.lit(1))
    outcome = F.when(first == "1", "canceled").when(first == "2", "failed").when(first == "3", "succeeded").when(first == "4", "rejected")
    terminal = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "incomplete")
    return t.orders.select("o_orderkey", rules.call_state(outcome, terminal, F.col("o_orderkey") % 2 == 0).alias("state"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s BETWEEN 200 AND 299 THEN 'delivered' WHEN s IN (0, 408, 429) OR s >= 500 THEN 'retry' WHEN s = 413 AND l_quantity > 1 THEN 'split' ELSE 'quarantine' END AS class, least(300.0, pow(2.0, least(l_linenumber, 8))) AS wait_s FROM
  (SELECT *, [0, 200, 204, 400, 408, 409, 413, 429, 500, 503][l_partkey % 10 + 1] AS s FROM lineitem)""")
def retry_class(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (0, 200, 204, 400, 408, 409, 413, 429, 500, 503))), (F.col("l_partkey") % 10 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", rules.retry_class(status, F.col("l_quantity")).alias("class"), rules.backoff_seconds(F.col("l_linenumber")).alias("wait_s"))


@query("SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events")
def rfc3339_nanoseconds(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    text = F.concat(F.date_format(F.timestamp_seconds(F.floor(micros / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z"))
    return t.events.select("event_id", rules.nanoseconds(text).alias("ns"))


@query("SELECT item_id, base64(encode(text)) AS encoded, strlen(text) AS n_bytes, true AS same, false AS bad FROM benchmark")
def base64_strict(t: Tables) -> DataFrame:
    encoded = F.base64(F.col("text").cast("binary"))
    return t.benchmark.select("item_id", encoded.alias("encoded"), F.octet_length("text").cast("long").alias("n_bytes"), (rules.strict_base64(encoded) == F.col("text").cast("binary")).alias("same"), rules.strict_base64(F.concat(encoded, F.lit("$"))).isNotNull().alias("bad"))


@query("SELECT doc_id, CASE WHEN route IN ('POST /v1/messages', 'POST /v1/responses', 'POST /v1/chat/completions') THEN 'generation' WHEN route = 'POST /v1/messages/count_tokens' THEN 'token_count' WHEN route = 'GET /v1/models' THEN 'discovery' ELSE 'unknown' END AS operation, CASE route WHEN 'POST /v1/messages' THEN 'anthropic_messages' WHEN 'POST /v1/messages/count_tokens' THEN 'anthropic_messages' WHEN 'POST /v1/responses' THEN 'responses' WHEN 'POST /v1/chat/completions' THEN 'chat_completions' ELSE 'unknown' END AS protocol FROM (SELECT doc_id, ['POST /v1/messages', 'POST /v1/responses', 'POST /v1/chat/completions', 'POST /v1/messages/count_tokens', 'GET /v1/models', '/x'][doc_id % 6 + 1] AS route FROM documents)")
def route_protocol(t: Tables) -> DataFrame:
    route = F.element_at(F.array(*map(F.lit, (*rules.ROUTES, "/x"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", rules.operation_for(route).alias("operation"), rules.protocol_for(route).alias("protocol"))
