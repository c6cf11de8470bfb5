"""Guards for values out of JSON, and JSON that keeps numbers as they are written."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

SAFE = 2**53 - 1


def record(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def items(x: object) -> list:
    return x if isinstance(x, list) else []


def count(x: object) -> int | None:
    """A whole number from 0 to 2**53 - 1, also one written as 3.0."""
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or x in (float("inf"), float("-inf")) or x != int(x) or not 0 <= x <= SAFE:
        return None
    return int(x)


def _no_constants(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


# Made once: json.loads and json.dumps make a new one at each call that has options.
_DECODER = json.JSONDecoder(parse_constant=_no_constants)
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def parse(text: str) -> object:
    plain = isinstance(text, str) and not text.startswith("\ufeff")
    return _DECODER.decode(text) if plain else json.loads(text, parse_constant=_no_constants)


def parse_record(text: str) -> dict:
    if not isinstance(value := parse(text), dict):
        raise ValueError("an object is needed")
    return value


def dump(value: object) -> str:
    """Compact JSON, as JavaScript writes it."""
    return _ENCODER.encode(value)


def number_text(x: float) -> str:
    """A number's shortest text that reads back as it, in JavaScript's form: plain from 1e-6 to below 1e21, else 1e-7, 1.5e+21."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = f"{x!r}".lower().partition("e")
    if not power:
        whole, _, rest = digits.partition(".")
        if abs(x) >= 1e-6:
            return digits
        significant = rest.lstrip("0")
        return number_text_of(x < 0, significant, -(len(rest) - len(significant)) - 1)
    sign, significant = digits.startswith("-"), digits.lstrip("-").replace(".", "")
    exponent = int(power)
    if -7 < exponent < 0:
        return ("-" if sign else "") + "0." + "0" * (-exponent - 1) + significant
    if 0 <= exponent < 21:
        return ("-" if sign else "") + significant.ljust(exponent + 1, "0")
    return number_text_of(sign, significant, exponent)


def number_text_of(negative: bool, significant: str, exponent: int) -> str:
    significant = significant.rstrip("0") or "0"
    return ("-" if negative else "") + significant[0] + (f".{significant[1:]}" if len(significant) > 1 else "") + f"e{'+' if exponent >= 0 else '-'}{abs(exponent)}"


def unsafe_number(text: str) -> bool:
    """Whether a JSON number would not survive as a double: its value or, for whole numbers, its digits would change."""
    value = float(text)
    if value in (float("inf"), float("-inf")):
        return True
    if re.fullmatch(r"-?\d+", text):
        return abs(int(text)) > SAFE or text == "-0"
    from decimal import Decimal

    return Decimal(text) != Decimal(repr(value))


class Exact(str):
    """A number kept as its text."""


def parse_exact(text: str, keep: Callable[[str], bool] = unsafe_number) -> object:
    """JSON in which each number that `keep` names stays as Exact text; duplicate keys keep the last value."""
    return json.loads(text, parse_constant=_no_constants, parse_int=lambda t: Exact(t) if keep(t) else int(t), parse_float=lambda t: Exact(t) if keep(t) else float(t))
