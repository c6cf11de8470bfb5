"""Decision tables of the read model as column expressions: routes, providers, costs, states, retries, token normalization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 2**53 - 1

# Routes with a decoded protocol, and all routes admitted.
PROTOCOLS = {"POST /v1/messages": "anthropic_messages", "POST /v1/responses": "responses", "POST /v1/chat/completions": "chat_completions"}
COUNT_ROUTE, DISCOVERY_ROUTE = "POST /v1/messages/count_tokens", "GET /v1/models"
ROUTES = (*PROTOCOLS, COUNT_ROUTE, DISCOVERY_ROUTE)

# Provider by wire format, and by the start of a model's name, in order.
WIRE_PROVIDERS = {
    "claude": "anthropic",
    "openai": "openai",
    "openai-response": "openai",
    "codex": "openai",
    "gemini": "google",
    "gemini-cli": "google",
    "antigravity": "google",
}
MODEL_PROVIDERS = (
    ("^claude-", "anthropic"),
    ("^gpt-", "openai"),
    (r"^o\d", "openai"),
    ("^codex", "openai"),
    ("^gemini-", "google"),
)

# Where each protocol reports a token field; a sum counts absent addends as 0 but needs its first part.
TOKEN_FIELDS = ("inputTokens", "outputTokens", "totalTokens", "reasoningTokens", "cachedInputTokens", "cacheCreationInputTokens")
NORMALIZATION = {
    "anthropic_messages": {
        "inputTokens": ("sum", ["input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]),
        "outputTokens": ("first", ["output_tokens"]),
        "totalTokens": ("first", ["total_tokens"]),
        "reasoningTokens": ("first", ["output_tokens_details.thinking_tokens"]),
        "cachedInputTokens": ("first", ["cache_read_input_tokens"]),
        "cacheCreationInputTokens": ("first", ["cache_creation_input_tokens"]),
    },
    "responses": {
        "inputTokens": ("first", ["input_tokens"]),
        "outputTokens": ("first", ["output_tokens"]),
        "totalTokens": ("first", ["total_tokens"]),
        "reasoningTokens": ("first", ["output_tokens_details.reasoning_tokens"]),
        "cachedInputTokens": ("first", ["input_tokens_details.cached_tokens"]),
        "cacheCreationInputTokens": ("first", ["input_tokens_details.cache_write_tokens", "input_tokens_details.cache_creation_tokens"]),
    },
    "chat_completions": {
        "inputTokens": ("first", ["prompt_tokens"]),
        "outputTokens": ("first", ["completion_tokens"]),
        "totalTokens": ("first", ["total_tokens"]),
        "reasoningTokens": ("first", ["completion_tokens_details.reasoning_tokens"]),
        "cachedInputTokens": ("first", ["prompt_tokens_details.cached_tokens"]),
        "cacheCreationInputTokens": ("first", ["prompt_tokens_details.cache_write_tokens", "prompt_tokens_details.cached_creation_tokens", "prompt_tokens_details.cache_creation_tokens"]),
    },
}


def safe_count(c: Column) -> Column:
    """A whole number from 0 to 2**53 - 1, else null."""
    return F.when((c >= 0) & (c <= SAFE) & (c == F.floor(c)), c.cast("long"))


def normalized_tokens(protocol: str, reported: dict[str, Column]) -> dict[str, Column]:
    """The token fields from the counts that a call reports natively (names as in NORMALIZATION)."""
    none = F.lit(None).cast("long")
    out = {}
    for field, (how, names) in NORMALIZATION[protocol].items():
        found = [safe_count(reported[n]) if n in reported else none for n in names]
        out[field] = F.coalesce(*found) if how == "first" else safe_count(reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), found))
    return out


def protocol_for(route: Column) -> Column:
    return reduce(lambda c, kv: c.when(route == kv[0], kv[1]), PROTOCOLS.items(), F.when(route == COUNT_ROUTE, "anthropic_messages")).otherwise("unknown")


def operation_for(route: Column) -> Column:
    return F.when(route.isin(*PROTOCOLS), "generation").when(route == COUNT_ROUTE, "token_count").when(route == DISCOVERY_ROUTE, "discovery").otherwise("unknown")


def provider(observed: Column, wire: Column, model: Column) -> Column:
    """struct(name, provenance): what was observed, else the wire format's provider, else the model's, else unavailable."""
    by_wire = reduce(lambda c, kv: c.when(wire == kv[0], kv[1]), WIRE_PROVIDERS.items(), F)
    by_model = reduce(lambda c, kv: c.when(model.rlike(kv[0]), kv[1]), MODEL_PROVIDERS, F)
    name = F.coalesce(observed, by_wire, by_model)
    how = F.when(observed.isNotNull(), "observed").when(by_wire.isNotNull(), "derived_from_wire_format").when(by_model.isNotNull(), "derived_from_model").otherwise("unavailable")
    return F.struct(name.alias("provider"), how.alias("provenance"))


def cost(total: Column, usage: Column, is_byok: Column, byok: Column) -> Column:
    """The cost of a call, null where it is unknown: the total, else the usage cost, plus the inference cost of an own key; neither may be negative."""
    base = F.coalesce(total, usage)
    whole = F.when(F.coalesce(is_byok, F.lit(False)), base + byok).otherwise(base)
    return F.when((base >= 0) & (~F.coalesce(is_byok, F.lit(False)) | (byok >= 0)), whole)


def call_state(outcome: Column, terminal: Column, incomplete: Column) -> Column:
    """How a call ended, from the completion's outcome, the protocol's terminal event and whether capture was incomplete."""
    return (
        F.when(outcome.isNull() & F.coalesce(incomplete, F.lit(False)), "unknown")
        .when(outcome == "canceled", "aborted")
        .when(outcome.isin("failed", "rejected"), outcome)
        .when(terminal == "completed", "succeeded")
        .when(terminal.isin("failed", "incomplete"), "failed")
        .otherwise("unknown")
    )


def retry_class(status: Column, records: Column) -> Column:
    """What delivery does after a response: 0, 408, 429 and 5xx are tried again, 413 is split while it can be, all else is set aside."""
    return F.when(status.between(200, 299), "delivered").when(status.isin(0, 408, 429) | (status >= 500), "retry").when((status == 413) & (records > 1), "split").otherwise("quarantine")


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempt, F.lit(8))))


def canonical_integer(text: Column) -> Column:
    """A decimal string without leading zeros, plus sign or negative zero, within the safe range; else null."""
    value = F.try_to_number(text, F.lit("S9999999999999999")).cast("long")
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,15})$") & (F.abs(value) <= SAFE), value)


def nanoseconds(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time with up to nine decimals, exactly; null for other texts."""
    shape = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 3))))
    return F.when(text.rlike(shape), seconds * 1_000_000_000 + F.rpad(F.regexp_extract(text, shape, 2), 9, "0").cast("long"))


def strict_base64(text: Column) -> Column:
    """The bytes of canonical base64, else null."""
    good = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(good, F.unbase64(F.when(good, text)))


def percent_encoded(text: Column) -> Column:
    """A path part as encodeURIComponent writes it; url_encode is for forms."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
