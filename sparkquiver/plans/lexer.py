"""Tokens of the Cypher subset."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sparkquiver.schema import ParseError

KEYWORDS = frozenset("MATCH OPTIONAL WHERE RETURN DISTINCT ORDER BY ASC DESC LIMIT AS UNION ALL AND NOT IN STARTS WITH CONTAINS COUNT UNWIND".split())
_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<string>'[^']*'|"[^"]*")|(?P<float>[0-9]+\.[0-9]+)|(?P<int>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<sign><=|>=|!=|->|\.\.|[()\[\]{}:,.*=<>|+/-])"""
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, ident, string, int, float or sign
    value: str | int | float

    def __str__(self) -> str:
        return f"'{self.value}'"


def tokenize(text: str) -> list[Token]:
    """Keywords are upper case only; true, false and null are strings; `--` starts a comment; strings have no escapes."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at] in "'\"":
                raise ParseError(f"unterminated string literal at byte {len(text[:at].encode())}")
            raise ParseError(f"unexpected character {text[at]!r} at byte {len(text[:at].encode())}")
        at, value = m.end(), m[0]
        if m.lastgroup == "string":
            out.append(Token("string", value[1:-1]))
        elif m.lastgroup == "int":
            if int(value) > 2**63 - 1:
                raise ParseError(f"invalid integer {value!r}: number too large")
            out.append(Token("int", int(value)))
        elif m.lastgroup == "float":
            out.append(Token("float", float(value)))
        elif m.lastgroup == "sign":
            out.append(Token("sign", value))
        elif m.lastgroup == "word":
            if value in KEYWORDS:
                out.append(Token("keyword", value))
            else:
                out.append(Token("string" if value in ("true", "false", "null") else "ident", value))
    return out
