"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Interval units in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_TOKEN = re.compile(
    rf"""(?P<space>\s+|--[^\n]*)
    |(?P<interval>(?:\d+(?:{_UNIT}))+)(?![A-Za-z0-9_])
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*|"(?:[^"]|"")+")
    |(?P<op><=|>=|!=|<>|[=<>+\-*/%(),;.])""",
    re.X,
)


class QueryError(ValueError):
    """The text is no valid statement."""


@dataclass(frozen=True)
class Token:
    kind: str  # interval, number, string, name, op or end
    text: str
    value: object
    at: int


def interval_nanos(text: str) -> int:
    if not re.fullmatch(rf"(?:\d+(?:{_UNIT}))+", text):
        raise QueryError(f"not an interval: {text}")
    return sum(int(n) * UNITS[u] for n, u in re.findall(rf"(\d+)({_UNIT})", text))


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character at {at}: {text[at : at + 10]!r}")
        kind, raw = m.lastgroup, m[0]
        if kind != "space":
            value: object = raw
            if kind == "interval":
                value = interval_nanos(raw)
            elif kind == "number":
                value = float(raw) if re.search(r"[.eE]", raw) else int(raw)
            elif kind == "string":
                value = raw[1:-1].replace("''", "'")
            elif kind == "name" and raw[0] == '"':
                value = raw[1:-1].replace('""', '"')
            out.append(Token(kind, raw, value, at))
        at = m.end()
    return [*out, Token("end", "", None, at)]
