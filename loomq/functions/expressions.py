"""Typed compilation of expressions to Spark columns.

The dialect is dynamically typed: it never coerces text to numbers, division by zero and operands that do not fit give
NULL, and any value can stand as a condition. Spark's own operators differ on each of these, so operands' kinds, which the
schema gives, choose the column at compile time. No UDF is used anywhere.

Kinds: int, float, text, bool, null (a bare NULL) and other (dates, arrays and so on, which pass through; text compared
with one of them is cast to its type).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import PlanError
from ..plans import tree as T

NUMBERS = ("int", "float")


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    type: S.DataType | None = None  # of kind other

    def number(self) -> Column:
        """As bigint or double; a bool counts as 0 or 1."""
        return self.column.cast("double") if self.kind == "float" else self.column.cast("bigint")

    def text(self) -> Column:
        """As text, the way LIKE sees it."""
        if self.kind == "bool":
            return F.when(self.column, "True").when(~self.column, "False")
        return self.column.cast("string")

    def condition(self) -> Column:
        """As a truth value: numbers other than 0 and texts other than '' are true."""
        if self.kind == "bool":
            return self.column
        if self.kind in NUMBERS:
            return self.column != 0
        if self.kind == "text":
            return self.column != ""
        if self.kind == "null":
            return F.lit(None).cast("boolean")
        return F.when(self.column.isNotNull(), F.lit(True))


def kind_of(type_: S.DataType) -> str:
    if isinstance(type_, S.IntegralType):
        return "int"
    if isinstance(type_, S.FractionalType):
        return "float"
    if isinstance(type_, S.StringType):
        return "text"
    if isinstance(type_, S.BooleanType):
        return "bool"
    return "null" if isinstance(type_, S.NullType) else "other"


def typed(column: Column, type_: S.DataType) -> Typed:
    kind = kind_of(type_)
    return Typed(column, kind, type_ if kind == "other" else None)


def constant(value: object) -> Typed:
    kind = {bool: "bool", int: "int", float: "float", str: "text", type(None): "null"}[type(value)]
    return Typed(F.lit(value), kind)


def _null(kind: str) -> Typed:
    return Typed(F.lit(None).cast({"bool": "boolean", "float": "double", "int": "bigint"}.get(kind, "string")), kind)


def _either_null(a: Typed, b: Typed) -> Column:
    return a.column.isNull() | b.column.isNull()


def compare(op: str, a: Typed, b: Typed) -> Typed:
    if "null" in (a.kind, b.kind):
        return _null("bool")
    if a.kind == "other" or b.kind == "other":
        if a.kind != b.kind:
            a, b = (Typed(x.column.cast(y.type), "other", y.type) if x.kind == "text" and y.type else x for x, y in ((a, b), (b, a)))
        left, right = a.column, b.column
    elif (a.kind == "text") != (b.kind == "text"):
        if op not in ("=", "<>"):
            return _null("bool")
        return Typed(F.when(~_either_null(a, b), F.lit(op == "<>")), "bool")
    elif a.kind == b.kind:
        left, right = a.column, b.column
    else:  # a bool beside a number is one
        left, right = (x.number() if x.kind == "bool" else x.column for x in (a, b))
    apply = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
    return Typed(apply(left, right), "bool")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    kinds = {a.kind, b.kind}
    if "null" in kinds:
        return _null("float" if op == "/" or "float" in kinds else "text" if "text" in kinds else "int")
    if "text" in kinds:
        if op == "+" and kinds == {"text"}:
            return Typed(F.concat(a.column, b.column), "text")
        if op == "*" and kinds & {"int", "bool"}:
            text, times = (a, b) if a.kind == "text" else (b, a)
            return Typed(F.repeat(text.column, times.column.cast("int")), "text")
        return _null("text")
    if "other" in kinds:
        raise PlanError(f"'{op}' does not apply to dates and nested values")
    if op == "/":
        return Typed(F.try_divide(a.column.cast("double"), b.column.cast("double")), "float")
    apply = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[op]
    left, right = a.number(), b.number()
    return Typed(apply(left, right), "float" if "float" in kinds else "int")


def negative(a: Typed) -> Typed:
    if a.kind in ("text", "other"):
        raise PlanError("unary '-' does not apply to text or dates")
    return _null("int") if a.kind == "null" else Typed(-a.number(), "float" if a.kind == "float" else "int")


def like(a: Typed, pattern: Typed, literal: object = None) -> Typed:
    """% and _ are wild, everything else stands for itself: a backslash too."""
    if "null" in (a.kind, pattern.kind):
        return _null("bool")
    if isinstance(literal, str):
        return Typed(a.text().like(literal.replace("\\", "\\\\")), "bool")
    return Typed(F.like(a.text(), F.replace(pattern.text(), F.lit("\\"), F.lit("\\\\"))), "bool")


def among(a: Typed, items: list[Typed], values: list[object]) -> Typed:
    """Constants of one kind become one IN, which the scan can use; anything else a chain of comparisons."""
    if a.kind in ("int", "float", "text") and all(type(v) is {"int": int, "float": float, "text": str}[a.kind] for v in values):
        return Typed(a.column.isin(*values), "bool")
    return Typed(reduce(Column.__or__, [compare("=", a, x).column for x in items]), "bool")


def within(a: Typed, low: Typed, high: Typed, plain: bool) -> Typed:
    """NULL if any of the three is. With constant bounds (plain), two comparisons say the same."""
    above, below = compare(">=", a, low), compare("<=", a, high)
    both = above.column & below.column
    if plain:
        return Typed(both, "bool")
    return Typed(F.when(above.column.isNotNull() & below.column.isNotNull(), both), "bool")


def compile_expression(x: object, leaf: Callable[[object], Typed | None]) -> Typed:
    """x as a column. leaf gives the column of names and of whatever else is already worked out, such as aggregates."""
    known = leaf(x)
    if known is not None:
        return known
    again = lambda y: compile_expression(y, leaf)
    match x:
        case T.Const(value):
            return constant(value)
        case T.Unary("-", T.Const(value)) if type(value) in (int, float):
            return constant(-value)
        case T.Unary("-", of):
            return negative(again(of))
        case T.Unary("NOT", of):
            return Typed(~again(of).condition(), "bool")
        case T.NullTest(of):
            return Typed(again(of).column.isNull(), "bool")
        case T.Binary("AND", left, right):
            return Typed(again(left).condition() & again(right).condition(), "bool")
        case T.Binary("OR", left, right):
            return Typed(again(left).condition() | again(right).condition(), "bool")
        case T.Binary("LIKE", left, right):
            return like(again(left), again(right), right.value if isinstance(right, T.Const) else None)
        case T.Binary(("+" | "-" | "*" | "/") as op, left, right):
            return arithmetic(op, again(left), again(right))
        case T.Binary(op, left, right):
            return compare(op, again(left), again(right))
        case T.Among(of, items):
            return among(again(of), [again(i) for i in items], [i.value if isinstance(i, T.Const) else i for i in items])
        case T.Within(of, low, high):
            plain = all(isinstance(b, T.Const) and b.value is not None for b in (low, high))
            return within(again(of), again(low), again(high), plain)
        case T.Aggregate(name):
            raise PlanError(f"{name} is not allowed here")
        case T.Star():
            raise PlanError("'*' stands only in a select list")
    raise PlanError(f"not an expression: {x!r}")
