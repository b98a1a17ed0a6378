"""The canonical form of an SQL statement, equal for statements that differ in spelling only."""

from __future__ import annotations

import hashlib
import re
import struct

from strandline.functions.sql_lexer import plain_pieces, unquoted

#: Words that end a WHERE condition on their level.
_AFTER_WHERE = frozenset("group order having limit union intersect except minus window qualify cluster distribute sort offset fetch".split())
#: Words that end a select list on their level.
_AFTER_FIELDS = _AFTER_WHERE | frozenset(("from", "where", "lateral", "into"))
_TWO = struct.Struct("<qq")
_DOTTED = re.compile(r"[\w$@#]+(?:\.[\w$@#]+)*")


class _Group(list):
    """The parts of one bracket, in canonical form."""


def _render(parts: list) -> str:
    out: list[str] = []
    stack = [iter(parts)]
    while stack:
        for part in stack[-1]:
            if isinstance(part, _Group):
                out.append("(")
                stack.append(iter(part))
                break
            out.append(part)
        else:
            stack.pop()
            if stack:
                out.append(")")
    return " ".join(out)


def _level(parts: list) -> list:
    """One bracket level: sorted select lists, no brackets round a whole WHERE condition."""
    out: list = []
    i, n = 0, len(parts)
    while i < n:
        part = parts[i]
        out.append(part)
        i += 1
        if part == "where":
            j = i
            while j < n and not (isinstance(parts[j], str) and parts[j] in _AFTER_WHERE or parts[j] == ";"):
                j += 1
            condition = parts[i:j]
            while len(condition) == 1 and isinstance(condition[0], _Group):
                condition = list(condition[0])
            out.extend(condition)
            i = j
        elif part == "select":
            if i < n and parts[i] in ("distinct", "all"):
                out.append(parts[i])
                i += 1
            fields: list[list] = [[]]
            while i < n and not (isinstance(parts[i], str) and parts[i] in _AFTER_FIELDS or parts[i] == ";"):
                if parts[i] == ",":
                    fields.append([])
                else:
                    fields[-1].append(parts[i])
                i += 1
            for k, field in enumerate(sorted(fields, key=_render)):
                out.extend(field if k == 0 else [",", *field])
    return out


def canonical(sql: str | None) -> str | None:
    """The canonical form, or None for text without any word.

    Blanks and line breaks, letter case, quotes round identifiers, trailing semicolons, brackets round
    a whole WHERE condition and the order of fields in select lists don't count; operators, numbers
    and text in single quotes count as written.  Unclosed brackets or quotes end with the text.
    """
    if sql is None:
        return None
    stack: list[list] = [[]]
    words = False
    for kind, text in plain_pieces(sql):
        if kind == "word":
            words = words or not text.isdigit()
            stack[-1].append(text.lower())
        elif kind == "op":
            if text == "(":
                stack.append(_Group())
            elif text == ")" and len(stack) > 1:
                group = _Group(_level(stack.pop()))
                stack[-1].append(group)
            else:
                stack[-1].append(text)
        elif kind == "string":
            stack[-1].append(text)
        elif kind == "number":
            stack[-1].append(text.lower())
        else:
            name = unquoted(text).lower()
            words = True
            if _DOTTED.fullmatch(name):
                for k, piece in enumerate(name.split(".")):
                    stack[-1].extend([piece] if k == 0 else [".", piece])
            else:
                stack[-1].append(f'"{name}"')
    if not words:
        return None
    while len(stack) > 1:
        group = _Group(_level(stack.pop()))
        stack[-1].append(group)
    parts = stack[0]
    while parts and parts[-1] == ";":
        parts.pop()
    return _render(_level(parts))


def canonical_key(sql: str | None) -> tuple[int, int] | None:
    """128 bits of the canonical form as two signed numbers."""
    form = canonical(sql)
    return None if form is None else _TWO.unpack(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
