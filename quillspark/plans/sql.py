"""Small builders of DuckDB expressions for the oracles."""

from __future__ import annotations

from ..functions.patterns import wide


def q(text: str) -> str:
    """A string literal; control characters become chr() calls."""
    out, plain = [], ""
    for c in text:
        if ord(c) < 32:
            out += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += "''" if c == "'" else c
    out.append(f"'{plain}'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


def rx(pattern: str, flags: str = "") -> str:
    return q((f"(?{flags})" if flags else "") + wide(pattern))


def has(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {rx(pattern, flags)})"


def count(x: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern, flags)}))"


def swap(x: str, pattern: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {rx(pattern, flags)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return swap(x, "\\A<s>+|<s>+\\z", "")


def holds(x: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def one(condition: str, value: float = 1.0) -> str:
    return f"(CASE WHEN {condition} THEN {value}::DOUBLE ELSE 0::DOUBLE END)"


def clamp(x: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"
