"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

DIMENSIONS = ("WHO", "WHAT", "WHEN", "WHERE", "WHY", "HOW")
WORD_OPERATORS = ("CONTAINS", "PREFIX")
KEYWORDS = ("AND", "OR", "NOT", "BETWEEN", "ONLY")


class QuerySyntaxError(ValueError):
    """A query that cannot be read: ``error``, ``position`` in the stripped text, and the offending ``token``."""

    def __init__(self, error: str, position: int = 0, token: Any = None) -> None:
        super().__init__(error)
        self.error, self.position, self.token = error, position, token


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    position: int


_SYMBOLS = {"*": "STAR", "|": "PIPE", ".": "DOT", ",": "COMMA", "(": "LPAREN", ")": "RPAREN"}
_SCANNER = re.compile(
    r"""(?P<space>\s+)
      | (?P<string>"(?:\\.|[^"\\]|\\(?=$))*" | '(?:\\.|[^'\\])*')
      | (?P<open>["'])
      | (?P<operator>>=|<=|!=|=|>|<)
      | (?P<symbol>[*|.,()])
      | (?P<number>-?\d+(?:\.\d*)?)
      | (?P<word>[^\W\d]\w*)""",
    re.VERBOSE | re.DOTALL,
)


def _word(text: str, at: int) -> Token:
    upper = text.upper()
    if upper in DIMENSIONS:
        return Token("DIMENSION", upper, at)
    if upper in ("TRUE", "FALSE"):
        return Token("BOOLEAN", upper == "TRUE", at)
    if upper in WORD_OPERATORS:
        return Token("OPERATOR", upper, at)
    if upper in KEYWORDS:
        return Token("KEYWORD", upper, at)
    return Token("IDENTIFIER", text.lower(), at)


def tokenize(text: str) -> list[Token]:
    """All tokens, ended by EOF. A backslash in a string stands for the character after it."""
    tokens, at = [], 0
    while at < len(text):
        m = _SCANNER.match(text, at)
        if m is None:
            raise QuerySyntaxError(f"Unexpected character '{text[at]}'", at, text[at])
        kind, value = m.lastgroup, m.group()
        if kind == "open":
            raise QuerySyntaxError("Unterminated string literal", at, value)
        if kind == "string":
            tokens.append(Token("STRING", re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.DOTALL), at))
        elif kind == "operator":
            tokens.append(Token("OPERATOR", value, at))
        elif kind == "symbol":
            tokens.append(Token(_SYMBOLS[value], value, at))
        elif kind == "number":
            tokens.append(Token("NUMBER", float(value), at))
        elif kind == "word":
            tokens.append(_word(value, at))
        at = m.end()
    tokens.append(Token("EOF", None, len(text)))
    return tokens
