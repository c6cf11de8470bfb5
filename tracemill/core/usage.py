"""Token usage as calls report it, bounded, flattened and normalized."""

from __future__ import annotations

from functools import lru_cache

from tracemill.core.values import SAFE, count, dump, parse_record, record
from tracemill.functions.rules import NORMALIZATION, TOKEN_FIELDS

SEMANTICS = "client_protocol_usage_v2"
# The usage fields that are kept, flat and in detail objects.
FLAT = ("input_tokens", "output_tokens", "total_tokens", "prompt_tokens", "completion_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
DETAILS = ("input_tokens_details", "output_tokens_details", "prompt_tokens_details", "completion_tokens_details", "cache_creation")
DETAIL = ("cached_tokens", "cache_write_tokens", "cached_creation_tokens", "cache_creation_tokens", "reasoning_tokens", "thinking_tokens", "ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens")


def bounded(raw: object) -> dict:
    """Of a usage object the known fields that are counts."""
    raw = record(raw)
    out: dict = {f: n for f in FLAT if f in raw and (n := count(raw[f])) is not None}
    for group in DETAILS:
        if (given := record(raw.get(group))) and (inner := {f: n for f in DETAIL if f in given and (n := count(given[f])) is not None}):
            out[group] = inner
    return out


def reported(usage: dict) -> dict[str, int]:
    """Counts by name, those of inner objects as outer.inner."""
    out = {}
    for key, value in usage.items():
        if (n := count(value)) is not None:
            out[key] = n
        elif isinstance(value, dict):
            out |= {f"{key}.{inner}": n for inner, x in value.items() if (n := count(x)) is not None}
    return out


def normalized(protocol: str, counts: dict[str, int]) -> dict[str, int | None]:
    """The six token fields; a sum outside the safe range is none."""
    out: dict[str, int | None] = {}
    for field in TOKEN_FIELDS:
        how, names = NORMALIZATION[protocol][field]
        if how == "first":
            out[field] = next((counts[n] for n in names if n in counts), None)
        else:
            total = counts[names[0]] + sum(counts.get(n, 0) for n in names[1:]) if names[0] in counts else None
            out[field] = total if total is not None and total <= SAFE else None
    return out


@lru_cache(1 << 14)
def normalized_text(protocol: str, raw: str) -> str | None:
    """The fields of a usage object's JSON as JSON, null where it isn't one. A worker keeps the last texts: small counts come again."""
    try:
        return dump(normalized(protocol, reported(bounded(parse_record(raw)))))
    except (ValueError, KeyError, TypeError):
        return None


def measurements(usage: dict, final: bool) -> list[dict]:
    flat = {f: n for f in FLAT if (n := count(usage.get(f))) is not None}
    nested = {f"{k}.{f}": n for k, v in usage.items() if isinstance(v, dict) for f, x in v.items() if (n := count(x)) is not None}
    return [{"nativeField": name, "value": n, "source": "client_protocol", "scope": "call", "unit": "tokens", "finality": "final" if final else "partial", "semanticsVersion": SEMANTICS} for name, n in (flat | nested).items()]
