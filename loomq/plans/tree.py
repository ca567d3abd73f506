"""Expressions and statements as frozen dataclasses. Equal trees are equal values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # - or NOT
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class NullTest:
    of: object


@dataclass(frozen=True)
class Among:
    of: object
    items: tuple


@dataclass(frozen=True)
class Within:
    of: object
    low: object
    high: object


@dataclass(frozen=True)
class Aggregate:
    name: str
    of: object | None  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Item:
    of: object
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full or cross
    table: Table
    on: object | None = None


@dataclass(frozen=True)
class Order:
    of: object
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: Table | None = None
    joins: tuple[Join, ...] = ()
    where: object | None = None
    group: tuple = ()
    having: object | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, object], ...]
    where: object | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Transaction:
    verb: str  # BEGIN, COMMIT or ROLLBACK


@dataclass(frozen=True)
class Explain:
    of: Select


@dataclass(frozen=True)
class Analyze:
    table: str


@dataclass(frozen=True)
class UserChange:
    verb: str  # CREATE, ALTER or DROP
    user: str
    password: str | None = field(default=None, repr=False)


def children(x: object) -> tuple:
    """The expressions directly inside an expression."""
    match x:
        case Unary(_, of) | NullTest(of):
            return (of,)
        case Binary(_, left, right):
            return left, right
        case Among(of, items):
            return of, *items
        case Within(of, low, high):
            return of, low, high
        case Aggregate(_, of, _) if of is not None:
            return (of,)
    return ()


def aggregates(x: object) -> list[Aggregate]:
    """The aggregates in an expression, outermost only."""
    return [x] if isinstance(x, Aggregate) else [a for c in children(x) for a in aggregates(c)]
