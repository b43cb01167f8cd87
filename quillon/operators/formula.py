"""Table formulas compiled to columns: tokenizer, recursive-descent parser, lowering.

A grid is a DataFrame with a table key, a row number from 1 and the cells of columns A, B, ... as
double columns. A formula becomes one Column, so all rows of all tables are evaluated by one plan:
references to other rows become windows over the table, those to the same row plain columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>[0-9]+(?:\.[0-9]+)?)|(?P<ref>[A-Za-z?](?:[0-9]+|\?)(?![A-Za-z0-9]))|(?P<word>[A-Za-z][A-Za-z0-9]*)|(?P<op>[-+*/(),:]))")
DIRECTIONS = ("above", "below", "left", "right")
AGGREGATES = ("SUM", "AVERAGE", "AVG", "PRODUCT", "MIN", "MAX", "COUNT")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Ref:
    col: str  # a letter, or ? for the current column
    row: int | None  # None is the current row


@dataclass(frozen=True)
class Area:
    first: Ref
    last: Ref


@dataclass(frozen=True)
class Direction:
    name: str


@dataclass(frozen=True)
class Neg:
    arg: object


@dataclass(frozen=True)
class Bin:
    op: str
    a: object
    b: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


def tokenize(formula: str) -> list[tuple[str, str]]:
    if formula[:1] not in ("=", "@"):
        raise FormulaError("a formula starts with = or @")
    out, at, text = [], 1, formula.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise FormulaError(f"unexpected {text[at]!r} at {at}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


def parse(formula: str):
    """sum := term (('+'|'-') term)*; term := unary (('*'|'/') unary)*; unary := '-' unary | atom."""
    toks, at = tokenize(formula), 0

    def peek(value: str) -> bool:
        return at < len(toks) and toks[at][1] == value

    def take(value: str | None = None):
        nonlocal at
        if at >= len(toks) or value is not None and toks[at][1] != value:
            raise FormulaError(f"expected {value or 'more'}")
        at += 1
        return toks[at - 1]

    def ref(text: str) -> Ref:
        row = None if text[1:] == "?" else int(text[1:])
        if row == 0:
            raise FormulaError("rows count from 1")
        return Ref(text[0].upper(), row)

    def atom():
        kind, text = take()
        if kind == "num":
            return Num(float(text))
        if kind == "ref":
            first = ref(text)
            if peek(":"):
                take(":")
                kind, text = take()
                if kind != "ref":
                    raise FormulaError("a range ends with a cell")
                return Area(first, ref(text))
            return first
        if kind == "word":
            if text.lower() in DIRECTIONS:
                return Direction(text.lower())
            take("(")
            args = []
            while not peek(")"):
                args.append(sum_())
                if not peek(")"):
                    take(",")
            take(")")
            return Call(text.upper(), tuple(args))
        if text == "(":
            inner = sum_()
            take(")")
            return inner
        raise FormulaError(f"unexpected {text}")

    def unary():
        if peek("-"):
            take()
            return Neg(unary())
        return atom()

    def term():
        left = unary()
        while peek("*") or peek("/"):
            op = take()[1]
            left = Bin(op, left, unary())
        return left

    def sum_():
        left = term()
        while peek("+") or peek("-"):
            op = take()[1]
            left = Bin(op, left, term())
        return left

    out = sum_()
    if at != len(toks):
        raise FormulaError(f"unexpected {toks[at][1]}")
    return out


def _one(f):
    return lambda x: f(x)


SCALARS = {
    "COS": F.cos, "SIN": F.sin, "TAN": F.tan, "ACOS": F.acos, "ASIN": F.asin, "ATAN": F.atan, "ABS": F.abs, "EXP": F.exp,
    "LOG": lambda x: F.when(x > 0, F.ln(x)), "LOG10": lambda x: F.when(x > 0, F.log10(x)), "SQRT": F.sqrt, "RADIAN": F.radians, "SIGN": F.signum,
    "CEILING": lambda x: F.ceil(x).cast("double"), "FLOOR": lambda x: F.floor(x).cast("double"),
    "TRUNC": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), "INT": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
}


class Grid:
    """Lowers formulas for grids with these keys and columns; target is the column a formula stands in."""

    def __init__(self, table: str | list[str], row: str, columns: dict[str, str], target: str):
        self.keys = [table] if isinstance(table, str) else table
        self.row, self.columns, self.target = row, columns, target
        self.whole = Window.partitionBy(*self.keys)
        self.ordered = Window.partitionBy(*self.keys).orderBy(row)

    def cell(self, letter: str) -> Column:
        if letter == "?":
            letter = self.target
        if letter not in self.columns:
            raise FormulaError(f"no column {letter}")
        return F.col(self.columns[letter])

    def parts(self, node) -> list[tuple[Column, object]]:
        """The cells that an argument covers: (value, window over which it ranges, or None for this row)."""
        if isinstance(node, Direction):
            letters = sorted(self.columns)
            if node.name == "left":
                return [(self.cell(x), None) for x in letters if x < self.target]
            if node.name == "right":
                return [(self.cell(x), None) for x in letters if x > self.target]
            lo, hi = (Window.unboundedPreceding, -1) if node.name == "above" else (1, Window.unboundedFollowing)
            return [(self.cell(self.target), self.ordered.rowsBetween(lo, hi))]
        if isinstance(node, Area):
            a, b = sorted((self._letter(node.first), self._letter(node.last)))
            letters = [x for x in sorted(self.columns) if a <= x <= b]
            if node.first.row is None and node.last.row is None:
                return [(self.cell(x), None) for x in letters]
            here = F.col(self.row)
            r1, r2 = (F.lit(r.row) if r.row is not None else here for r in (node.first, node.last))
            if node.first.row is None or node.last.row is None:
                raise FormulaError("a range has both rows fixed or neither")
            inside = here.between(F.least(r1, r2), F.greatest(r1, r2))
            return [(F.when(inside, self.cell(x)), self.whole) for x in letters]
        return [(self.lower(node), None)]

    def _letter(self, r: Ref) -> str:
        return self.target if r.col == "?" else r.col

    def aggregate(self, name: str, args: tuple) -> Column:
        parts = [p for a in args for p in self.parts(a)]
        if not parts:
            return F.lit(0.0) if name in ("SUM", "COUNT") else F.lit(None).cast("double")
        over = lambda f, x, w: f(x) if w is None else f(x).over(w)
        if name == "COUNT":
            return sum((F.when(x.isNotNull(), 1.0).otherwise(0.0) if w is None else F.count(x).over(w).cast("double") for x, w in parts), F.lit(0.0))
        if name == "SUM":
            return sum((F.coalesce(x if w is None else F.sum(x).over(w), F.lit(0.0)) for x, w in parts), F.lit(0.0))
        if name in ("AVERAGE", "AVG"):
            n = self.aggregate("COUNT", args)
            return F.when(n > 0, self.aggregate("SUM", args) / n)
        if name == "PRODUCT":
            out = F.lit(1.0)
            for x, w in parts:
                out = out * F.coalesce(x if w is None else F.product(x).over(w), F.lit(1.0))
            return out
        f = F.min if name == "MIN" else F.max
        cols = [x if w is None else over(f, x, w) for x, w in parts]
        return cols[0] if len(cols) == 1 else (F.least if name == "MIN" else F.greatest)(*cols)

    def lower(self, node) -> Column:
        if isinstance(node, Num):
            return F.lit(node.value)
        if isinstance(node, Ref):
            if node.row is None:
                return self.cell(node.col)
            return F.max(F.when(F.col(self.row) == node.row, self.cell(node.col))).over(self.whole)
        if isinstance(node, Neg):
            return -self.lower(node.arg)
        if isinstance(node, Bin):
            a, b = self.lower(node.a), self.lower(node.b)
            if node.op == "/":
                return F.try_divide(a, b)
            return a + b if node.op == "+" else a - b if node.op == "-" else a * b
        if isinstance(node, Call):
            if node.name in AGGREGATES:
                return self.aggregate(node.name, node.args)
            args = [self.lower(a) for a in node.args]
            if node.name in SCALARS and len(args) == 1:
                return SCALARS[node.name](args[0].cast("double"))
            if node.name == "ROUND" and args:
                digits = node.args[1] if len(node.args) > 1 else Num(0)
                if not isinstance(digits, Num):
                    raise FormulaError("ROUND's digits are a number")
                return F.round(args[0], int(digits.value))
            if node.name == "MOD" and len(args) == 2:
                return F.when(args[1] != 0, args[0] % args[1])
            if node.name == "IF" and len(args) == 3:
                return F.when(F.coalesce(args[0], F.lit(0.0)) != 0, args[1]).otherwise(args[2])
            raise FormulaError(f"unknown function {node.name}")
        raise FormulaError("a range or direction stands alone")


def evaluate(grid: DataFrame, formula: str, table: str | list[str], row: str, columns: dict[str, str], target: str, out: str) -> DataFrame:
    """Adds out: the formula as it stands in column target of each row."""
    return grid.withColumn(out, Grid(table, row, columns, target).lower(parse(formula)).cast("double"))


def block(grid: DataFrame, function: str, table: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Block calculation: one value of a function for each column of each table."""
    f = {"SUM": F.sum, "AVERAGE": F.avg, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "PRODUCT": F.product}[function.upper()]
    return grid.groupBy(table).agg(*[f(c).cast("double").alias(x) for x, c in columns.items()])
