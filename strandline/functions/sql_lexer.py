"""Tokens of SQL text, for the canonical form of statements and for the lineage parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_BLANKS = "[\\s\x85\xa0  -​    　﻿]+"
_QUOTED = {
    "string": r"'(?:[^'\\]|\\.|'')*(?:'|\Z)",
    "backtick": r"`(?:[^`]|``)*(?:`|\Z)",
    "dquoted": r'"(?:[^"\\]|\\.|"")*(?:"|\Z)',
}
_NUMBER = r"(?:\d+\.\d*(?:[eE][+-]?\d+)?|(?<![\w`\"\]])\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)(?![\w.])"
_WORD = r"[\w$@#]+"
_COMMENT = r"--[^\r\n]*|/\*.*?(?:\*/|\Z)"

_PLAIN = re.compile("|".join([f"(?P<blank>{_BLANKS})", *(f"(?P<{k}>{v})" for k, v in _QUOTED.items()), f"(?P<number>{_NUMBER})", f"(?P<word>{_WORD})", "(?P<op>.)"]), re.S)
_OPERATORS = r"<=>|\|\||&&|::|->>?|=>|<>|!=|>=|<=|==|."
_PARSING = re.compile("|".join([f"(?P<blank>{_BLANKS})", f"(?P<comment>{_COMMENT})", *(f"(?P<{k}>{v})" for k, v in _QUOTED.items()), f"(?P<number>{_NUMBER})", f"(?P<word>{_WORD})", f"(?P<op>{_OPERATORS})"]), re.S)


class Token(NamedTuple):
    kind: str  #: word, backtick, dquoted, string, number or op
    text: str  #: as written
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "op" else ""

    @property
    def name(self) -> str:
        """The identifier meant, without its quotes."""
        if self.kind in ("backtick", "dquoted"):
            return unquoted(self.text)
        return self.text


def plain_tokens(sql: str) -> list[Token]:
    """Single-character operators, comments not told apart: differing blanks can't move a boundary."""
    return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in _PLAIN.finditer(sql) if m.lastgroup != "blank"]


def parser_tokens(sql: str) -> list[Token]:
    """Tokens for parsing: blanks and comments dropped, operators whole."""
    return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in _PARSING.finditer(sql) if m.lastgroup not in ("blank", "comment")]


def plain_pieces(sql: str) -> Iterator[tuple[str, str]]:
    """Kind and text of the tokens of :func:`plain_tokens`, for callers that need no places."""
    for m in _PLAIN.finditer(sql):
        if m.lastgroup != "blank":
            yield m.lastgroup, m.group()


def unquoted(text: str) -> str:
    """The identifier inside backticks or double quotes."""
    quote = text[0]
    return (text[1:-1] if len(text) > 1 and text[-1] == quote else text[1:]).replace(quote * 2, quote)
