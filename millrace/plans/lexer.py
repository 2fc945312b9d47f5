"""Query text to tokens.

Keywords and boolean words are read in any case, ORDER BY and GROUP BY with any white space between.
Strings stand in double quotes, without escapes or line ends; a character stands in single quotes.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from millrace.errors import ParseError

KEYWORDS = {"SELECT", "FROM", "WHERE", "ORDER", "GROUP", "BY", "AND", "OR", "NOT", "SUM", "COUNT", "AVG", "MAX", "MIN"}

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<string>"[^"\n]*")
    |(?P<char>'[^\n]')
    |(?P<double>\d+\.\d+)
    |(?P<name>[A-Za-z0-9_]+(?:\.(?:[A-Za-z0-9_]+|\*))*)
    |(?P<op><=|>=|!=|[-+*/%<>=(),;])""",
    re.VERBOSE,
)


class Token(NamedTuple):
    kind: str  # keyword, name, int, double, bool, char, string, op, end
    text: str
    at: int


def tokenize(text: str) -> list[Token]:
    """The tokens up to the first semicolon or the end."""
    tokens: list[Token] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"Unexpected character {text[at]!r} at {at}")
        kind, found = m.lastgroup or "", m[0]
        at = m.end()
        if kind == "space":
            continue
        if found == ";":
            break
        if kind == "name":
            upper = found.upper()
            if found.isdigit():
                kind = "int"
            elif upper in KEYWORDS:
                kind, found = "keyword", upper
            elif upper in ("TRUE", "FALSE"):
                kind, found = "bool", upper
        elif kind in ("string", "char"):
            found = found[1:-1]
        tokens.append(Token(kind, found, m.start()))
    tokens.append(Token("end", "", at))
    return tokens
