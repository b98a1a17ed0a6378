"""A plain layout for SQL text: keywords in capitals, one clause a line, even blanks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions.sql_lexer import Token, parser_tokens

_CLAUSES = frozenset("SELECT FROM WHERE GROUP ORDER HAVING LIMIT UNION INTERSECT EXCEPT MINUS WITH QUALIFY WINDOW LATERAL".split())
_JOINS = frozenset("JOIN INNER LEFT RIGHT FULL CROSS NATURAL".split())
_KEYWORDS = _CLAUSES | _JOINS | frozenset(
    "AS ON USING BY ALL DISTINCT AND OR NOT IN IS NULL LIKE RLIKE BETWEEN CASE WHEN THEN ELSE END ASC DESC OUTER SEMI ANTI OFFSET EXISTS OVER PARTITION ROWS RANGE "
    "PRECEDING FOLLOWING UNBOUNDED CURRENT ROW VIEW VALUES CAST INTERVAL TRUE FALSE NULLS RECURSIVE SETS ROLLUP CUBE".split()
)
_TIGHT_BEFORE, _TIGHT_AFTER = frozenset((",", ")", ".", ";", "]", "[", "::")), frozenset(("(", ".", "[", "::"))


def format_sql(sql: str | None) -> str | None:
    """The same tokens in a plain layout; comments are dropped, text that doesn't parse is laid out too.

    Names, numbers and strings stay as written.  Formatting what is formatted changes nothing.
    """
    if sql is None:
        return None
    out: list[str] = []
    depth: list[bool] = []  # per open bracket whether it holds a query
    tokens = parser_tokens(sql)
    for k, token in enumerate(tokens):
        word = token.upper if token.kind == "word" else ""
        before = tokens[k - 1] if k else None
        qualified = before is not None and before.text == "."
        text = word if word in _KEYWORDS and not qualified else token.text
        line = word in _CLAUSES and not qualified and not (before and before.upper == "UNION") and all(depth)
        line = line or word in _JOINS and not qualified and all(depth) and not (before and before.upper in _JOINS | {"OUTER", "SEMI", "ANTI"}) and not _called(tokens, k)
        if out and line and k and before.text != "(":
            out.append("\n" + "  " * len(depth))
        elif out and not (token.text in _TIGHT_BEFORE or before.text in _TIGHT_AFTER or token.text == "(" and before.kind != "op" and before.upper not in _KEYWORDS):
            out.append(" ")
        out.append(text)
        if token.text == "(" and token.kind == "op":
            following = tokens[k + 1].upper if k + 1 < len(tokens) else ""
            depth.append(following in ("SELECT", "WITH"))
        elif token.text == ")" and token.kind == "op" and depth:
            depth.pop()
    return "".join(out)


def _called(tokens: list[Token], k: int) -> bool:
    return k + 1 < len(tokens) and tokens[k + 1].text == "("


def _format(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([format_sql(t if isinstance(t, str) else None) for t in batch], dtype=object)


def formatted(c: Column) -> Column:
    """``format_sql`` of a column, in Arrow batches."""
    return F.pandas_udf(_format, StringType())(c)
