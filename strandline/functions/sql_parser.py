"""Lineage facts of one SQL query: select items, table references, CTEs, features.

A recursive-descent parser over the query grammar of the Spark family of dialects.  It keeps no tree:
expressions come back as normalised text with what lineage needs, so that a task can parse millions
of statements in Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from strandline.functions.sql_lexer import Token, parser_tokens

#: Words that can't name a column, table or alias unless quoted.
RESERVED = frozenset(
    "SELECT FROM WHERE GROUP ORDER HAVING LIMIT UNION INTERSECT EXCEPT MINUS JOIN ON USING WITH AS CASE WHEN THEN ELSE END AND OR NOT IN IS "
    "BETWEEN LIKE RLIKE ILIKE DISTINCT INNER LEFT RIGHT FULL CROSS NATURAL LATERAL BY QUALIFY OFFSET FETCH WINDOW TABLESAMPLE PIVOT UNPIVOT INTO SET".split()
)
#: Words that may follow a table and so can't be its alias; the rest of RESERVED applies too.
_NO_ALIAS = RESERVED | frozenset("STRAIGHT_JOIN CLUSTER DISTRIBUTE SORT ANTI SEMI OUTER FOR".split())
_AGGREGATES = frozenset(
    "COUNT SUM AVG MEAN MIN MAX COUNT_IF STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP COLLECT_LIST COLLECT_SET ARRAY_AGG FIRST LAST FIRST_VALUE LAST_VALUE "
    "APPROX_COUNT_DISTINCT PERCENTILE PERCENTILE_APPROX MEDIAN MODE BOOL_AND BOOL_OR EVERY SOME ANY_VALUE CORR COVAR_POP COVAR_SAMP SKEWNESS KURTOSIS MAX_BY MIN_BY GROUP_CONCAT LISTAGG STRING_AGG".split()
)
_TYPE_WORDS = {"INTEGER": "INT"}
_COMPARISONS = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "<=>": "<=>"}
_ADDITIVE = {x: x for x in ("+", "-", "||", "&", "|", "^")}
_MULTIPLICATIVE = {x: x for x in ("*", "/", "%", "DIV", "->>")}
_UNITS = frozenset("YEAR QUARTER MONTH WEEK DAY HOUR MINUTE SECOND MILLISECOND MICROSECOND YEARS MONTHS WEEKS DAYS HOURS MINUTES SECONDS".split())
#: Nested brackets, queries and CASEs; about two a bracket.  Python calls are no limit: see parse_facts.
_MAX_DEPTH = 10_000
_CALLS = 200_000


class SqlParseError(ValueError):
    """The text isn't one query."""


@dataclass
class Facts:
    """What lineage needs of one query."""

    items: list[dict[str, Any]] = field(default_factory=list)
    tables: list[dict[str, Any]] = field(default_factory=list)
    ctes: list[str] = field(default_factory=list)
    has_with: bool = False
    has_subquery: bool = False
    joins: int = 0
    has_where: bool = False
    has_group: bool = False


class _Expr:
    __slots__ = ("aggregate", "columns", "kind", "name", "qualifier", "text")

    def __init__(self, text: str, kind: str = "expr", qualifier: str = "", name: str = "", columns: list | None = None, aggregate: bool = False) -> None:
        self.text, self.kind, self.qualifier, self.name = text, kind, qualifier, name
        self.columns = columns if columns is not None else []
        self.aggregate = aggregate


def _joined(text: str, *parts: _Expr) -> _Expr:
    return _Expr(text, columns=[c for p in parts for c in p.columns], aggregate=any(p.aggregate for p in parts))


class _Parser:
    def __init__(self, sql: str) -> None:
        self.tokens = parser_tokens(sql)
        self.at = 0
        self.depth = 0
        self.facts = Facts()
        self.scope = ("main", "")  # or ("cte", name)

    # --- tokens -------------------------------------------------------------------------------

    def peek(self, ahead: int = 0) -> Token | None:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else None

    def word(self, ahead: int = 0) -> str:
        token = self.peek(ahead)
        return token.upper if token else ""

    def fail(self, wanted: str) -> SqlParseError:
        token = self.peek()
        return SqlParseError(f"expected {wanted}, found {token.text!r} at {token.start}" if token else f"expected {wanted}, found the end")

    def accept(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise self.fail(" ".join(words))

    def is_name(self, ahead: int = 0) -> bool:
        token = self.peek(ahead)
        if token is None:
            return False
        return token.kind == "backtick" or token.kind == "word" and token.upper not in RESERVED and not token.text.isdigit()

    def name(self, any_word: bool = False, quoted: bool = True) -> str:
        token = self.peek()
        if token and (self.is_name() or any_word and token.kind == "word" or quoted and token.kind == "dquoted"):
            self.at += 1
            return token.name
        raise self.fail("a name")

    # --- queries ------------------------------------------------------------------------------

    def statement(self) -> Facts:
        self.query(top=True)
        while self.accept(";"):
            pass
        if self.peek() is not None:
            raise self.fail("the end")
        return self.facts

    def query(self, top: bool) -> None:
        self.depth += 1
        if self.depth > _MAX_DEPTH:
            raise SqlParseError("nested too deeply")
        if self.accept("WITH"):
            self.accept("RECURSIVE")
            if top:
                self.facts.has_with = True
            while True:
                self.cte(top)
                if not self.accept(","):
                    break
        self.query_term(top)
        while self.word() in ("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            self.at += 1
            if not self.accept("ALL"):
                self.accept("DISTINCT")
            if top:  # a set operation has no FROM of its own
                for table in self.facts.tables:
                    if table["scope"] == "main":
                        table["is_top_level"] = False
            self.query_term(top=False)
        self.tail()
        self.depth -= 1

    def cte(self, top: bool) -> None:
        name = self.name()
        if self.word() == "(":
            self.bracketed_names()
        self.accept("AS")
        self.expect("(")
        outer = self.scope
        if top:
            self.facts.ctes.append(name)
            self.scope = ("cte", name)
        self.query(top=False)
        self.scope = outer
        self.expect(")")

    def bracketed_names(self) -> None:
        self.expect("(")
        self.name(any_word=True)
        while self.accept(","):
            self.name(any_word=True)
        self.expect(")")

    def query_term(self, top: bool) -> None:
        if self.word() == "(":
            self.at += 1
            if top:
                self.facts.has_subquery = True
            kept = len(self.facts.tables)
            self.query(top)
            if top:
                for table in self.facts.tables[kept:]:
                    table["is_top_level"] = False
            self.expect(")")
        elif self.accept("VALUES"):
            self.expression_list()
        elif self.accept("TABLE"):
            self.relation_primary(top)
        elif self.accept("FROM"):  # FROM t SELECT a
            self.relations(top)
            if self.word() == "SELECT":
                self.select(top, has_from=True)
            elif top:
                raise self.fail("SELECT")
        else:
            self.select(top)

    def select(self, top: bool, has_from: bool = False) -> None:
        self.expect("SELECT")
        if self.word() == "ALL" and self.peek(1) and self.word(1) not in (",", "FROM", "."):
            self.at += 1
        elif self.accept("DISTINCT") and self.accept("ON"):
            self.expect("(")
            self.expression_list()
            self.expect(")")
        while True:
            self.select_item(top)
            if not self.accept(","):
                break
        if not has_from and self.accept("FROM"):
            self.relations(top)
        while self.accept("LATERAL", "VIEW"):
            self.accept("OUTER")
            self.expression()
            if self.is_name() and self.word() not in _NO_ALIAS:
                self.name()
            if self.accept("AS"):
                self.name()
                while self.accept(","):
                    self.name()
        if self.accept("WHERE"):
            self.facts.has_where = self.facts.has_where or top
            self.expression()
        if self.accept("GROUP", "BY"):
            self.facts.has_group = self.facts.has_group or top
            self.grouping()
        if self.accept("HAVING"):
            self.expression()
        if self.accept("QUALIFY"):
            self.expression()
        if self.accept("WINDOW"):
            while True:
                self.name()
                self.expect("AS")
                self.window_spec()
                if not self.accept(","):
                    break

    def grouping(self) -> None:
        while True:
            if self.accept("GROUPING", "SETS"):
                self.expect("(")
                self.expression_list(empty_brackets=True)
                self.expect(")")
            else:
                self.expression()
            if not self.accept(","):
                break
        if self.accept("WITH"):
            if not (self.accept("ROLLUP") or self.accept("CUBE")):
                raise self.fail("ROLLUP or CUBE")

    def tail(self) -> None:
        while True:
            if self.accept("ORDER", "BY") or self.accept("SORT", "BY"):
                self.ordering()
            elif self.accept("CLUSTER", "BY") or self.accept("DISTRIBUTE", "BY"):
                self.expression_list()
            elif self.accept("LIMIT"):
                self.accept("ALL") or self.expression()
                if self.accept(","):
                    self.expression()
            elif self.accept("OFFSET"):
                self.expression()
                self.accept("ROWS")
            else:
                return

    def ordering(self) -> str:
        out = []
        while True:
            text = self.expression().text
            for w in ("ASC", "DESC"):
                if self.accept(w):
                    text += f" {w}" if w == "DESC" else ""
            if self.accept("NULLS"):
                text += f" NULLS {self.name(any_word=True).upper()}"
            out.append(text)
            if not self.accept(","):
                return ", ".join(out)

    def select_item(self, top: bool) -> None:
        first = self.peek()
        e = self.expression()
        if e.kind == "star":
            if self.accept("EXCEPT") or self.accept("EXCLUDE"):
                self.bracketed_names()
            if self.accept("REPLACE"):
                self.expect("(")
                self.expression()
                while self.accept("AS") and self.name() and self.accept(","):
                    self.expression()
                self.expect(")")
        last = self.tokens[self.at - 1]
        alias = ""
        token = self.peek()
        if self.accept("AS"):
            if self.word() == "(":
                self.bracketed_names()
            elif self.peek() and self.peek().kind == "string":
                alias = self.peek().text[1:-1]
                self.at += 1
            else:
                alias = self.name()
        elif token and (self.is_name() or token.kind == "dquoted") and self.word() not in _NO_ALIAS:
            alias = self.name()
        if not top:
            return
        self.facts.items.append(
            {
                "pos": len(self.facts.items), "kind": e.kind, "alias": alias, "qualifier": e.qualifier, "column_name": e.name,
                "name": alias or e.text, "expression": e.text,
                "source_type": "unknown" if not alias and (e.kind == "column" or e.kind == "star" and e.qualifier) else "expression",
                "is_aggregate": e.aggregate,
                "columns": [{"qualifier": q, "name": n} for q, n in dict.fromkeys(e.columns)],
                "start": first.start, "end": last.end,
            }
        )

    # --- relations ----------------------------------------------------------------------------

    def relations(self, top: bool) -> None:
        self.relation(top)
        while self.accept(","):
            self.relation(top)

    def relation(self, top: bool) -> None:
        self.accept("LATERAL")
        self.relation_primary(top)
        while True:
            k = self.at
            self.accept("NATURAL")
            cross = self.accept("CROSS")
            if not cross:
                for w in ("INNER", "LEFT", "RIGHT", "FULL"):
                    if self.accept(w):
                        break
                for w in ("OUTER", "SEMI", "ANTI"):
                    if self.accept(w):
                        break
            if not self.accept("JOIN") and not self.accept("STRAIGHT_JOIN"):
                self.at = k
                return
            self.facts.joins += 1
            self.accept("LATERAL")
            self.relation_primary(top)
            if self.accept("ON"):
                self.expression()
            elif self.accept("USING"):
                self.bracketed_names()

    def relation_primary(self, top: bool) -> None:
        if self.word() == "(":
            self.at += 1
            if self.word() in ("SELECT", "WITH", "VALUES", "FROM") or self.word() == "(" and self._opens_query():
                self.facts.has_subquery = True
                self.query(top=False)
                self.expect(")")
            else:
                self.relation(top=False)
                self.expect(")")
            self.table_alias()
            return
        if self.accept("VALUES"):
            self.expression_list()
            self.table_alias()
            return
        parts = [self.name()]
        while self.accept("."):
            parts.append(self.name(any_word=True))
        if self.word() == "(":  # table-valued function
            self.call(parts[-1])
            self.table_alias()
            return
        if self.accept("TABLESAMPLE"):
            self.skip_brackets()
        alias = self.table_alias()
        if self.accept("TABLESAMPLE"):
            self.skip_brackets()
        if self.word() in ("PIVOT", "UNPIVOT"):
            self.at += 1
            self.skip_brackets()
            alias = self.table_alias() or alias
        kind, scope = self.scope
        self.facts.tables.append(
            {
                "pos": len(self.facts.tables), "scope": kind, "scope_name": scope, "full_name": ".".join(p for p in parts if p),
                "alias": alias or parts[-1], "is_top_level": top and kind == "main",
            }
        )

    def _opens_query(self) -> bool:
        k = 0
        while self.word(k) == "(":
            k += 1
        return self.word(k) in ("SELECT", "WITH", "VALUES", "FROM")

    def table_alias(self) -> str:
        token = self.peek()
        alias = ""
        if self.accept("AS"):
            alias = self.name()
        elif token and (self.is_name() or token.kind == "dquoted") and self.word() not in _NO_ALIAS:
            alias = self.name()
        if alias and self.word() == "(":
            self.bracketed_names()
        return alias

    def skip_brackets(self) -> str:
        """Balanced brackets whose inside doesn't matter."""
        self.expect("(")
        level, begin = 1, self.at
        while level:
            token = self.peek()
            if token is None:
                raise self.fail(")")
            level += (token.upper == "(") - (token.upper == ")")
            self.at += 1
        return " ".join(t.text for t in self.tokens[begin : self.at - 1])

    # --- expressions --------------------------------------------------------------------------

    def expression_list(self, empty_brackets: bool = False) -> list[_Expr]:
        out = []
        while True:
            if empty_brackets and self.word() == "(" and self.word(1) == ")":
                self.at += 2
                out.append(_Expr("()"))
            else:
                out.append(self.expression())
            if not self.accept(","):
                return out

    def expression(self) -> _Expr:
        self.depth += 1
        if self.depth > _MAX_DEPTH:
            raise SqlParseError("nested too deeply")
        found = self.chain(self.conjunction, {"OR": "OR"})
        self.depth -= 1
        return found

    def chain(self, operand: Callable[[], _Expr], operators: dict[str, str]) -> _Expr:
        """Operands joined by operators of one rank, put together once however many there are."""
        parts = [operand()]
        texts = [parts[0].text]
        while operator := operators.get(self.word()):
            self.at += 1
            parts.append(operand())
            texts += [operator, parts[-1].text]
        return parts[0] if len(parts) == 1 else _joined(" ".join(texts), *parts)

    def conjunction(self) -> _Expr:
        return self.chain(self.negation, {"AND": "AND", "&&": "AND"})

    def negation(self) -> _Expr:
        nots = 0
        while self.accept("NOT") or self.accept("!"):
            nots += 1
        e = self.predicate()
        return _joined("NOT " * nots + e.text, e) if nots else e

    def predicate(self) -> _Expr:
        left = self.additive()
        while True:
            operator = _COMPARISONS.get(self.word())
            if operator:
                self.at += 1
                right = self.additive()
                left = _joined(f"{left.text} {operator} {right.text}", left, right)
                continue
            if self.accept("IS"):
                no = "NOT " if self.accept("NOT") else ""
                if self.accept("DISTINCT", "FROM"):
                    right = self.additive()
                    left = _joined(f"{left.text} IS {no}DISTINCT FROM {right.text}", left, right)
                elif self.word() in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                    left = _joined(f"{no}{left.text} IS {self.name(any_word=True).upper()}", left)
                else:
                    raise self.fail("NULL")
                continue
            k = self.at
            no = "NOT " if self.accept("NOT") else ""
            if self.accept("IN"):
                if self.word() == "(":
                    self.at += 1
                    if self.word() in ("SELECT", "WITH", "FROM") or self.word() == "(" and self._opens_query():
                        inner = _Expr(self.subquery_text())
                        self.facts.has_subquery = True
                        left = _joined(f"{no}{left.text} IN ({inner.text})", left)
                    else:
                        values = self.expression_list() if self.word() != ")" else []
                        left = _joined(f"{no}{left.text} IN ({', '.join(v.text for v in values)})", left, *values)
                    self.expect(")")
                else:
                    right = self.additive()
                    left = _joined(f"{no}{left.text} IN {right.text}", left, right)
            elif self.accept("BETWEEN"):
                low = self.additive()
                self.expect("AND")
                high = self.additive()
                left = _joined(f"{no}{left.text} BETWEEN {low.text} AND {high.text}", left, low, high)
            elif self.word() in ("LIKE", "RLIKE", "ILIKE", "REGEXP"):
                operator = self.word()
                self.at += 1
                if self.word() in ("ANY", "ALL", "SOME") and self.word(1) == "(":
                    quantifier = self.word()
                    self.at += 1
                    right = self.primary()
                    right.text = f"{quantifier} {right.text}"
                else:
                    right = self.additive()
                text = f"{no}{left.text} {operator} {right.text}"
                if self.accept("ESCAPE"):
                    text += f" ESCAPE {self.additive().text}"
                left = _joined(text, left, right)
            else:
                self.at = k
                return left

    def additive(self) -> _Expr:
        return self.chain(self.multiplicative, _ADDITIVE)

    def multiplicative(self) -> _Expr:
        return self.chain(self.unary, _MULTIPLICATIVE)

    def unary(self) -> _Expr:
        if self.word() in ("-", "+", "~"):
            operator = self.word()
            self.at += 1
            e = self.unary()
            return _joined(("" if operator == "+" else operator) + e.text, e)
        return self.postfix(self.primary())

    def postfix(self, e: _Expr) -> _Expr:
        while True:
            if self.accept("["):
                index = self.expression()
                self.expect("]")
                e = _joined(f"{e.text}[{index.text}]", e, index)
            elif self.accept("::"):
                e = _joined(f"CAST({e.text} AS {self.data_type()})", e)
            elif self.word() == "." and e.kind == "expr" and self.peek(1) and self.peek(1).kind in ("word", "backtick", "dquoted"):
                self.at += 1
                e = _joined(f"{e.text}.{self.peek().text}", e)
                self.at += 1
            else:
                return e

    def subquery_text(self) -> str:
        """Parse a nested query and return its tokens; its select list isn't ours."""
        begin = self.at
        self.query(top=False)
        return " ".join(t.text for t in self.tokens[begin : self.at])

    def primary(self) -> _Expr:
        token = self.peek()
        if token is None:
            raise self.fail("an expression")
        word = token.upper
        if token.kind in ("string", "dquoted"):
            self.at += 1
            texts = [token.text if token.kind == "string" else "'" + token.name.replace("'", "\\'") + "'"]
            while self.peek() and self.peek().kind == "string":
                texts.append(self.peek().text)
                self.at += 1
            return _Expr(" ".join(texts))
        if token.kind == "number" or token.kind == "word" and token.text[0].isdigit() and token.text.rstrip("LlSsDdFfYyBb").isdigit():
            self.at += 1
            return _Expr(token.text)
        if word == "*":
            self.at += 1
            return _Expr("*", kind="star")
        if word == "(":
            self.at += 1
            if self.word() in ("SELECT", "WITH") or self.word() == "(" and self._opens_query():
                self.facts.has_subquery = True
                text = self.subquery_text()
                self.expect(")")
                return _Expr(f"({text})")
            inner = self.expression_list()
            self.expect(")")
            if self.accept("->"):
                body = self.expression()
                return _joined(f"({', '.join(i.text for i in inner)}) -> {body.text}", body)
            return _joined(f"({', '.join(i.text for i in inner)})", *inner)
        if word == "CASE":
            return self.case()
        if word in ("CAST", "TRY_CAST") and self.word(1) == "(":
            self.at += 2
            e = self.expression()
            self.expect("AS")
            kind = self.data_type()
            self.expect(")")
            return _joined(f"{word}({e.text} AS {kind})", e)
        if word == "EXISTS" and self.word(1) == "(" and self.word(2) in ("SELECT", "WITH", "FROM"):
            self.at += 2
            text = self.subquery_text()
            self.expect(")")
            return _Expr(f"EXISTS({text})")
        if word == "INTERVAL" and self.peek(1) and (self.peek(1).kind in ("string", "number", "dquoted") or self.peek(1).text.isdigit()):
            self.at += 2
            text = f"INTERVAL {self.tokens[self.at - 1].text}"
            if self.word() in _UNITS:
                text += f" {self.name(any_word=True).upper()}"
                if self.accept("TO"):
                    text += f" TO {self.name(any_word=True).upper()}"
            return _Expr(text)
        if word in ("DATE", "TIMESTAMP") and self.peek(1) and self.peek(1).kind == "string":
            self.at += 2
            return _Expr(f"CAST({self.tokens[self.at - 1].text} AS {word})")
        if word in ("NULL", "TRUE", "FALSE") and self.word(1) != ".":
            self.at += 1
            return _Expr(word)
        if word in ("LEFT", "RIGHT") and self.word(1) == "(":
            self.at += 1
            return self.call(token.text)
        if not self.is_name():
            raise self.fail("an expression")
        if self.word(1) == "(" and token.kind == "word":
            self.at += 1
            return self.call(token.text)
        if self.word(1) == "->" and token.kind in ("word", "backtick"):
            self.at += 2
            body = self.expression()
            return _joined(f"{token.text} -> {body.text}", body)
        return self.column()

    def column(self) -> _Expr:
        first = self.peek()
        names, texts = [self.name(quoted=False)], [first.text]
        while self.word() == "." and self.peek(1):
            if self.word(1) == "*":
                self.at += 2
                return _Expr(".".join(texts) + ".*", kind="star", qualifier=names[-1] if len(names) == 1 else ".".join(names))
            self.at += 1
            texts.append(self.peek().text)
            names.append(self.name(any_word=True))
            if self.word() == "(":  # a function of a schema
                e = self.call(texts.pop())
                e.text = ".".join([*texts, e.text])
                return e
        qualifier = names[-2] if len(names) > 1 else ""
        column = (qualifier, names[-1])
        return _Expr(".".join(texts), "column" if len(names) < 5 else "expr", qualifier, names[-1], [column])

    def call(self, written: str) -> _Expr:
        name = written.upper()
        self.expect("(")
        distinct = ""
        parts: list[_Expr] = []
        if self.word() != ")":
            if self.accept("DISTINCT"):
                distinct = "DISTINCT "
            elif self.word() == "ALL" and self.word(1) not in (",", ")", "."):
                self.at += 1
            if self.word() in ("SELECT", "WITH"):
                self.facts.has_subquery = True
                parts.append(_Expr(self.subquery_text()))
            else:
                parts = self.argument_list()
        self.expect(")")
        text = f"{name}({distinct}{', '.join(p.text for p in parts)})"
        e = _joined(text, *parts)
        e.aggregate = e.aggregate or name in _AGGREGATES
        if self.accept("WITHIN", "GROUP"):
            self.expect("(")
            self.expect("ORDER", "BY")
            e.text += f" WITHIN GROUP (ORDER BY {self.ordering()})"
            self.expect(")")
        if self.word() == "FILTER" and self.word(1) == "(":
            self.at += 2
            self.expect("WHERE")
            condition = self.expression()
            self.expect(")")
            e = _Expr(f"{e.text} FILTER(WHERE {condition.text})", columns=e.columns + condition.columns, aggregate=e.aggregate)
        for nulls in ("IGNORE", "RESPECT"):
            if self.accept(nulls, "NULLS"):
                e.text += f" {nulls} NULLS"
        if self.accept("OVER"):
            e.text += f" OVER {self.window_spec() if self.word() == '(' else self.name()}"
            e.aggregate = False
        return e

    def argument_list(self) -> list[_Expr]:
        out = []
        while True:
            if self.peek() and self.peek().kind == "word" and self.word(1) == "=>":
                name = self.name(any_word=True)
                self.at += 1
                value = self.expression()
                out.append(_joined(f"{name} => {value.text}", value))
            else:
                value = self.expression()
                for between in ("FROM", "FOR", "AS"):  # extract(year FROM x), substring(x FROM 1 FOR 2)
                    if self.accept(between):
                        more = _Expr(self.data_type()) if between == "AS" else self.expression()
                        value = _joined(f"{value.text} {between} {more.text}", value, more)
                if self.accept("ORDER", "BY"):
                    value.text += f" ORDER BY {self.ordering()}"
                out.append(value)
            if not self.accept(","):
                return out

    def window_spec(self) -> str:
        self.expect("(")
        parts = []
        if self.accept("PARTITION", "BY") or self.accept("DISTRIBUTE", "BY"):
            parts.append("PARTITION BY " + ", ".join(e.text for e in self.expression_list()))
        if self.accept("ORDER", "BY") or self.accept("SORT", "BY"):
            parts.append("ORDER BY " + self.ordering())
        if self.word() in ("ROWS", "RANGE"):
            frame = []
            while self.word() != ")":
                token = self.peek()
                if token is None:
                    raise self.fail(")")
                frame.append(token.upper or token.text)
                self.at += 1
            parts.append(" ".join(frame))
        self.expect(")")
        return "(" + " ".join(parts) + ")"

    def case(self) -> _Expr:
        self.expect("CASE")
        parts: list[_Expr] = []
        text = "CASE"
        if self.word() != "WHEN":
            parts.append(self.expression())
            text += f" {parts[-1].text}"
        if self.word() != "WHEN":
            raise self.fail("WHEN")
        while self.accept("WHEN"):
            when = self.expression()
            self.expect("THEN")
            then = self.expression()
            parts += [when, then]
            text += f" WHEN {when.text} THEN {then.text}"
        if self.accept("ELSE"):
            parts.append(self.expression())
            text += f" ELSE {parts[-1].text}"
        self.expect("END")
        return _joined(f"{text} END", *parts)

    def data_type(self) -> str:
        word = self.name(any_word=True).upper()
        word = _TYPE_WORDS.get(word, word)
        if self.accept("PRECISION"):
            word += " PRECISION"
        if self.accept("("):
            sizes = []
            while not self.accept(")"):
                token = self.peek()
                if token is None:
                    raise self.fail(")")
                if token.text != ",":
                    sizes.append(token.text)
                self.at += 1
            word += f"({', '.join(sizes)})"
        elif self.accept("<"):
            inner = []
            while True:
                if self.word(1) == ":":
                    field_name = self.name(any_word=True)
                    self.at += 1
                    inner.append(f"{field_name}: {self.data_type()}")
                else:
                    inner.append(self.data_type())
                if not self.accept(","):
                    break
            self.expect(">")
            word += f"<{', '.join(inner)}>"
        return word


def parse_facts(sql: str | None, dialect: str = "") -> tuple[Facts | None, str | None]:
    """(facts, None), or (None, message) where the text isn't one query.

    All dialects share one grammar; the message names the ``dialect`` that was asked for.
    """
    name = f" ({dialect})" if dialect else ""
    if sql is None or not sql.strip():
        return None, f"SQL parse error{name}: the statement is empty"
    if sys.getrecursionlimit() < _CALLS:  # calls between Python functions take no stack of the process
        sys.setrecursionlimit(_CALLS)
    try:
        return _Parser(sql).statement(), None
    except SqlParseError as error:
        return None, f"SQL parse error{name}: {error}"
    except RecursionError:
        return None, f"SQL parse error{name}: nested too deeply"
