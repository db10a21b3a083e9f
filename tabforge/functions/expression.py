"""Row expressions of user configurations, translated to Spark SQL.

The language: comparisons, and/or/not (also && || !), + - * / %, parentheses, quoted strings, numbers, null, true and
false, column names, x.isEmpty(), x.substring(a, b), x.length(), NumberUtils.max(...) and min(...), and empty(x).  Columns are
text, so a side that meets a number is read as a number; two columns are compared as numbers where both are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*(?:::[\w$]+)*)|(?P<op>==|!=|<=|>=|=~|&&|\|\||[-+*/%<>!().,]))""")
_WORDS = {"and": "&&", "or": "||", "not": "!", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_LEVELS = [("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]


class ExpressionError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if text[at:].strip():
                raise ExpressionError(f"can't read {text[at:][:20]!r}")
            break
        kind = m.lastgroup
        value = m[kind]
        out.append(("op", _WORDS[value]) if kind == "name" and value in _WORDS else (kind, value))
        at = m.end()
    return out


class _Parser:
    """Recursive descent; values carry (sql, type) with type text, number, bool or null."""

    def __init__(self, text: str, columns: list[str] | None = None):
        self.tokens, self.at, self.columns, self.names = _tokens(text), 0, columns, []

    def peek(self, *ops: str) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops else None

    def take(self, *ops: str) -> str:
        op = self.peek(*ops)
        if op is None:
            raise ExpressionError(f"expected {' or '.join(ops)}")
        self.at += 1
        return op

    def whole(self) -> tuple[str, str]:
        out = self.level(0)
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def level(self, i: int) -> tuple[str, str]:
        if i == len(_LEVELS):
            return self.unary()
        left = self.level(i + 1)
        while op := self.peek(*_LEVELS[i]):
            self.at += 1
            left = self.joined(op, left, self.level(i + 1))
        return left

    def joined(self, op: str, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
        if op in ("&&", "||"):
            return f"({truth(a)} {'AND' if op == '&&' else 'OR'} {truth(b)})", "bool"
        if op in ("==", "!=") and "null" in (a[1], b[1]):
            other = a if b[1] == "null" else b
            return f"({other[0]} IS {'NOT ' if op == '!=' else ''}NULL)", "bool"
        if op in ("==", "!=", "<", "<=", ">", ">="):
            sql = {"==": "=", "!=": "<>"}.get(op, op)
            if "bool" in (a[1], b[1]):
                return f"({truth(a)} {sql} {truth(b)})", "bool"
            if "number" in (a[1], b[1]):
                return f"({numeric(a)} {sql} {numeric(b)})", "bool"
            if "string" in (a[1], b[1]):
                return f"({a[0]} {sql} {b[0]})", "bool"
            x, y = numeric(a), numeric(b)
            return f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} {sql} {y} ELSE {a[0]} {sql} {b[0]} END)", "bool"
        if op == "+" and "string" in (a[1], b[1]):
            return f"concat(CAST({a[0]} AS STRING), CAST({b[0]} AS STRING))", "string"
        if op == "/":
            return f"try_divide({numeric(a)}, {numeric(b)})", "number"
        if op == "%":
            return f"try_mod(CAST({numeric(a)} AS BIGINT), CAST({numeric(b)} AS BIGINT))", "number"
        return f"({numeric(a)} {op} {numeric(b)})", "number"

    def unary(self) -> tuple[str, str]:
        if self.peek("!"):
            self.at += 1
            return f"(NOT {truth(self.unary())})", "bool"
        if self.peek("-"):
            self.at += 1
            return f"(- {numeric(self.unary())})", "number"
        return self.postfix()

    def arguments(self) -> list[tuple[str, str]]:
        self.take("(")
        out = []
        while not self.peek(")"):
            out.append(self.level(0))
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return out

    def postfix(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("it ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if (kind, value) == ("op", "("):
            out = self.level(0)
            self.take(")")
        elif kind == "num":
            return f"{float(value)!r}D", "number"
        elif kind == "str":
            body = re.sub(r"\\(.)", r"\1", value[1:-1])
            out = ("'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'", "string")
        elif kind == "name" and value in ("null", "true", "false"):
            out = ({"null": "NULL"}.get(value, value), "null" if value == "null" else "bool")
        elif kind == "name" and value in ("NumberUtils", "Math") and self.peek("."):
            self.at += 1
            call = self.tokens[self.at][1]
            self.at += 1
            args = ", ".join(numeric(a) for a in self.arguments())
            if call not in ("max", "min", "abs"):
                raise ExpressionError(f"unknown function {value}.{call}")
            return f"{ {'max': 'greatest', 'min': 'least', 'abs': 'abs'}[call] }({args})".replace("{ ", "").replace(" }", ""), "number"
        elif kind == "name" and value in ("empty", "size") and self.peek("("):
            (x,) = self.arguments()
            return (f"(coalesce({x[0]}, '') = '')", "bool") if value == "empty" else (f"length({x[0]})", "number")
        elif kind == "name":
            out = self.name(value)
        else:
            raise ExpressionError(f"unexpected {value!r}")
        while self.peek("."):
            self.at += 1
            method = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            self.at += 1
            args = self.arguments()
            out = self.method(out, method, args)
        return out

    def name(self, value: str) -> tuple[str, str]:
        if self.columns is not None:
            from tabforge.functions.scalar import resolve

            try:
                value = resolve(value, self.columns)
            except KeyError as e:
                raise ExpressionError(str(e)) from None
        self.names.append(value)
        return f"CAST(`{value}` AS STRING)", "text"

    def method(self, x, method, args) -> tuple[str, str]:
        if method == "isEmpty" and not args:
            return f"({x[0]} = '')", "bool"
        if method == "length" and not args:
            return f"length({x[0]})", "number"
        if method == "substring" and len(args) in (1, 2):
            a = f"CAST({numeric(args[0])} AS INT)"
            return (f"substring({x[0]}, {a} + 1, CAST({numeric(args[1])} AS INT) - {a})" if len(args) == 2 else f"substring({x[0]}, {a} + 1)"), "text"
        if method in ("startsWith", "endsWith", "contains") and len(args) == 1:
            return f"{method.lower()}({x[0]}, {args[0][0]})", "bool"
        if method in ("toLowerCase", "toUpperCase", "trim") and not args:
            return f"{ {'toLowerCase': 'lower', 'toUpperCase': 'upper', 'trim': 'trim'}[method] }({x[0]})".replace("{ ", "").replace(" }", ""), "text"
        if method == "equals" and len(args) == 1:
            return f"({x[0]} = {args[0][0]})", "bool"
        raise ExpressionError(f"unknown method {method}")


def numeric(x: tuple[str, str]) -> str:
    return x[0] if x[1] == "number" else "CAST(NULL AS DOUBLE)" if x[1] == "null" else f"try_cast({x[0]} AS DOUBLE)"


def truth(x: tuple[str, str]) -> str:
    if x[1] == "number":
        raise ExpressionError("a number isn't a condition")
    return x[0] if x[1] == "bool" else f"(lower({x[0]}) = 'true')" if x[1] == "text" else f"CAST({x[0]} AS BOOLEAN)"


def condition_sql(text: str, columns: list[str] | None = None) -> str:
    """Spark SQL of a boolean expression."""
    return truth(_Parser(text, columns).whole())


def value_sql(text: str, columns: list[str] | None = None) -> str:
    """Spark SQL of a numeric expression."""
    return numeric(_Parser(text, columns).whole())


def variables(text: str) -> list[str]:
    """Names of the columns an expression reads, in order of their first use."""
    p = _Parser(text)
    p.whole()
    return list(dict.fromkeys(p.names))


def keep_rows(df: DataFrame, text: str | None, strict: bool = False) -> DataFrame:
    """Rows for which the expression holds.  Blank keeps all; one that can't be read keeps all too, or raises if strict."""
    if not text or not text.strip():
        return df
    try:
        return df.filter(F.expr(condition_sql(text, df.columns)))
    except ExpressionError:
        if strict:
            raise
        return df


def weight_of(df: DataFrame, text: str | None) -> Column:
    """Weight column of an expression; missing, unreadable and negative weights count 1."""
    if not text or not text.strip():
        return F.lit(1.0)
    w = F.expr(value_sql(text, df.columns))
    return F.when(w >= 0, w).otherwise(F.lit(1.0))
