"""Calculated columns: a closed formula language that becomes a Spark Column.

``IF([Margin %] >= 20, "high", "low")``, ``ROUND([a] / [b] * 100, 1)``. Nothing is evaluated as code: a formula is read,
checked against the sheet's column types on the driver, and turned into built-in Column functions, so Catalyst prunes,
pushes down and generates code as for any other expression.

Semantics: ``/`` gives a number and null on zero; nulls propagate, AND/OR are three-valued, a null condition gives null;
MIN and MAX skip nulls; ROUND is half away from zero; numbers compare as doubles; other types compare with their own kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, MAX_DEPTH, MAX_PARTS, MAX_DIGITS = 1000, 32, 500, 15
NUMBER, INTEGER, TEXT, BOOLEAN, DATE = "number", "integer", "text", "boolean", "date"
SQL_TYPE = {NUMBER: "double", INTEGER: "bigint", TEXT: "string", BOOLEAN: "boolean"}
NUMERIC = (NUMBER, INTEGER)
ARITY = {"IF": (3, 3), "ROUND": (1, 2), "ABS": (1, 1), "MIN": (1, None), "MAX": (1, None)}
LEVEL = {"OR": 1, "AND": 2, "=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}
TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<num>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<str>"(?:[^"]|"")*")|\[(?P<col>(?:[^\]]|\]\])+)\]'
    r"|(?P<name>[^\W\d_]\w*)|(?P<op><=|>=|<>|[-+*/=<>(),]))"
)


class FormulaError(ValueError):
    """code: too_long, syntax, too_deep, too_complex, unknown_column, unknown_function or type_mismatch; position counts from 0."""

    def __init__(self, code: str, message: str, position: int):
        super().__init__(message)
        self.code, self.position = code, position


@dataclass(frozen=True)
class Formula:
    column: Column
    type: str
    columns_used: tuple[str, ...]


def sheet_types(schema: T.StructType) -> dict[str, str]:
    """Formula types of a DataFrame's columns; others can't be used in formulas."""
    out = {}
    for f in schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[f.name] = INTEGER
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            out[f.name] = NUMBER
        elif isinstance(f.dataType, (T.StringType, T.BooleanType, T.DateType)):
            out[f.name] = {"string": TEXT, "boolean": BOOLEAN, "date": DATE}[f.dataType.typeName()]
    return out


class _Reader:
    """Tokens to nested tuples (kind, position, parts...), by operator level; a chain of one level is one node."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                at += len(text[at:]) - len(text[at:].lstrip())
                raise FormulaError("syntax", "The formula has a character that isn't allowed here.", at)
            kind = m.lastgroup
            value, where = m[kind], m.start(kind) - (kind == "col")
            if kind == "name" and value.upper() in ("AND", "OR", "NOT", "TRUE", "FALSE"):
                kind, value = "op", value.upper()
            self.tokens.append((kind, value, where))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = self.parts = 0

    def take(self, *values: str):
        kind, value, where = self.tokens[self.at]
        if kind == "op" and value in values:
            self.at += 1
            return value
        return None

    def node(self, *node):
        self.parts += 1
        return node

    def fail(self):
        raise FormulaError("syntax", "The formula can't be read here.", self.tokens[self.at][2])

    def read(self, level: int = 1):
        where = self.tokens[self.at][2]
        if level == 3 and self.take("NOT"):
            return self.node("not", where, self.read(3))
        if level == 7:
            return self.node("neg", where, self.read(7)) if self.take("-") else self.atom()
        first = self.read(level + 1)
        if level == 3:
            return first
        rest = []
        ops = [op for op, at in LEVEL.items() if at == level]
        while op := self.take(*ops):
            rest.append((op, self.read(level + 1)))
            if level == 4:
                break  # comparisons don't chain
        return self.node("chain", where, first, rest) if rest else first

    def atom(self):
        kind, value, where = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return self.node("num", where, value)
        if kind == "str":
            return self.node("str", where, value[1:-1].replace('""', '"'))
        if kind == "col":
            return self.node("col", where, value.replace("]]", "]"))
        if kind == "op" and value in ("TRUE", "FALSE"):
            return self.node("bool", where, value == "TRUE")
        if kind == "op" and value == "(":
            inner = self.read()
            return self.node("group", where, inner) if self.take(")") else self.fail()
        if kind == "name":
            if not self.take("("):
                return self.node("col", where, value)
            args = []
            if not self.take(")"):
                args.append(self.read())
                while self.take(","):
                    args.append(self.read())
                if not self.take(")"):
                    self.fail()
            return self.node("call", where, value, args)
        self.at -= 1
        return self.fail()


def _inside(node) -> list:
    kind = node[0]
    return [node[2], *(x for _, x in node[3])] if kind == "chain" else node[3] if kind == "call" else [node[2]] if kind in ("not", "neg", "group") else []


def _check_size(tree, parts: int) -> None:
    level, depth = [tree], 0
    while level:
        level = [x for node in level for x in _inside(node)]
        depth += bool(level)
    if depth > MAX_DEPTH:
        raise FormulaError("too_deep", "The formula is nested too deeply.", 0)
    if parts > MAX_PARTS:
        raise FormulaError("too_complex", "The formula has too many parts.", 0)


class _Typed:
    """Tree to Columns, checking types from left to right."""

    def __init__(self, types: dict[str, str]):
        self.types, self.used = types, {}

    def wrong(self, what: str, node):
        raise FormulaError("type_mismatch", f"{what} doesn't take values of this type.", node[1])

    def numeric(self, what: str, node):
        got = self.of(node)
        return got if got[1] in NUMERIC else self.wrong(what, node)

    def boolean(self, what: str, node):
        got = self.of(node)
        return got if got[1] == BOOLEAN else self.wrong(what, node)

    def of(self, node) -> tuple[Column, str]:
        return getattr(self, node[0])(node)

    def num(self, node):
        whole = re.fullmatch("[0-9]+", node[2])
        if whole and int(node[2]) < 2**63:
            return F.lit(int(node[2])).cast("bigint"), INTEGER
        value = float(node[2])
        if value == float("inf"):
            raise FormulaError("syntax", "The number is too large.", node[1])
        return F.lit(value), NUMBER

    def str(self, node):
        return F.lit(node[2]), TEXT

    def bool(self, node):
        return F.lit(node[2]), BOOLEAN

    def group(self, node):
        return self.of(node[2])

    def col(self, node):
        name = node[2]
        if name not in self.types:
            close = [c for c in self.types if c.strip().casefold() == name.strip().casefold()]
            if len(close) != 1:
                raise FormulaError("unknown_column", f"There is no column {name}.", node[1])
            name = close[0]
        self.used[name] = None
        kind = self.types[name]
        column = F.col("`" + name.replace("`", "``") + "`")
        return (column if kind == DATE else column.cast(SQL_TYPE[kind])), kind

    def neg(self, node):
        if node[2][0] == "num":
            value, kind = self.num(node[2])
            return -value, kind
        c, kind = self.numeric("-", node[2])
        return -c, kind

    def chain(self, node):
        op, level = node[3][0][0], LEVEL[node[3][0][0]]
        if level <= 2:
            out = self.boolean(op, node[2])[0]
            for op, x in node[3]:
                c = self.boolean(op, x)[0]
                out = out & c if op == "AND" else out | c
            return out, BOOLEAN
        if level == 4:
            return self.compare(op, self.of(node[2]), self.of(node[3][0][1]), node)
        out, kind = self.numeric(op, node[2])
        for op, x in node[3]:
            c, k = self.numeric(op, x)
            kind = NUMBER if op == "/" or NUMBER in (kind, k) else INTEGER
            a, b = out.cast(SQL_TYPE[kind]), c.cast(SQL_TYPE[kind])
            out = F.try_divide(a, b) if op == "/" else a * b if op == "*" else a + b if op == "+" else a - b
        return out, kind

    def compare(self, op, left, right, node):
        if left[1] in NUMERIC and right[1] in NUMERIC:
            a, b = left[0].cast("double"), right[0].cast("double")
        elif left[1] == right[1]:
            a, b = left[0], right[0]
        else:
            self.wrong(op, node)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], BOOLEAN

    def not_(self, node):
        return ~self.boolean("NOT", node[2])[0], BOOLEAN

    def call(self, node):
        name, args = node[2].upper(), node[3]
        if name not in ARITY:
            raise FormulaError("unknown_function", f"There is no function {node[2]}.", node[1])
        got = [self.of(a) for a in args]
        least, most = ARITY[name]
        if len(args) < least or most is not None and len(args) > most:
            raise FormulaError("syntax", f"{name} takes another number of values.", node[1])
        if name == "IF":
            (c, kind), (a, ka), (b, kb) = got
            if kind != BOOLEAN:
                self.wrong(name, args[0])
            if ka != kb and not (ka in NUMERIC and kb in NUMERIC):
                self.wrong(name, args[2])
            if ka != kb:
                a, b, ka = a.cast("double"), b.cast("double"), NUMBER
            return F.when(c.isNull(), F.lit(None)).when(c, a).otherwise(b), ka
        if name == "ROUND" and len(args) == 2:
            digits = self.digits(args[1])
        for a, (_, kind) in zip(args[:1] if name == "ROUND" else args, got):
            if kind not in NUMERIC:
                self.wrong(name, a)
        c, kind = got[0]
        if name == "ABS":
            return F.abs(c), kind
        if name == "ROUND":
            n = digits if len(args) == 2 else 0
            return (c if kind == INTEGER and n >= 0 else F.round(c, n)), kind
        kind = NUMBER if any(k == NUMBER for _, k in got) else INTEGER
        cast = [x.cast(SQL_TYPE[kind]) for x, _ in got]
        return (cast[0] if len(cast) == 1 else (F.least if name == "MIN" else F.greatest)(*cast)), kind

    def digits(self, node) -> int:
        sign, x = (-1, node[2]) if node[0] == "neg" else (1, node)
        if x[0] != "num" or not re.fullmatch("[0-9]+", x[2]) or int(x[2]) > MAX_DIGITS:
            self.wrong("ROUND", node)
        return sign * int(x[2])


setattr(_Typed, "not", _Typed.not_)


def compile_formula(text: str, types: dict[str, str], as_type: str | None = None) -> Formula:
    """The Column of a formula; raises FormulaError before any plan is built."""
    if len(text) > MAX_CHARS:
        raise FormulaError("too_long", "The formula is too long.", MAX_CHARS)
    if not text.strip():
        raise FormulaError("syntax", "The formula is empty.", 0)
    reader = _Reader(text)
    try:
        tree = reader.read()
        if reader.tokens[reader.at][0] != "end":
            reader.fail()
    except RecursionError:
        raise FormulaError("too_deep", "The formula is nested too deeply.", 0) from None
    _check_size(tree, reader.parts)
    typed = _Typed(types)
    column, kind = typed.of(tree)
    if as_type and as_type != kind and DATE not in (as_type, kind):
        column, kind = column.cast(SQL_TYPE[as_type]), as_type
    return Formula(column, kind, tuple(typed.used))


def add_calculated_column(df: DataFrame, name: str, text: str, as_type: str | None = None) -> DataFrame:
    return df.withColumn(name, compile_formula(text, sheet_types(df.schema), as_type).column)
