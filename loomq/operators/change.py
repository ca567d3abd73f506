"""INSERT, UPDATE and DELETE: each gives the table's next manifest and the number of rows it changed.

Constraints are checked on sets, before anything is committed. Nothing is collected but the names of files that hold
matching rows, their counts, bounds of changed keys, and one offending row. Files that cannot hold a match by their bounds are
not opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError, LoomError
from ..functions.expressions import Typed, compile_expression
from ..plans import tree as T
from ..plans.limits import Limit, limits
from ..sources import store as st
from .scope import Scope

#: Values of one INSERT up to which its keys go into the scan's filter; more are joined.
KEYS_IN_FILTER = 1000
FILE = "__file"


def constants(rows: tuple[tuple, ...], store: st.Store) -> list[list[object]]:
    """The values of VALUES rows. Literals are taken as they are; all other expressions are worked out in one Spark row."""
    rest: list[Typed] = []

    def value(x: object) -> object:
        match x:
            case T.Const(v):
                return v
            case T.Unary("-", T.Const(v)) if type(v) in (int, float):
                return -v
        rest.append(compile_expression(Scope().bind(x), lambda _: None))
        return rest[-1]

    out = [[value(x) for x in row] for row in rows]
    if rest:
        one = store.spark.range(1).select(*[t.column.alias(f"v{k}") for k, t in enumerate(rest)]).first()
        found = {id(t): one[k] for k, t in enumerate(rest)}
        out = [[found[id(v)] if isinstance(v, Typed) else v for v in row] for row in out]
    return out


def duplicate(values: tuple, index: st.Index) -> ExecutionError:
    return ExecutionError(f"Duplicate key ({', '.join(map(repr, values))}) violates unique index '{index.name}'")


def repeated_key(df: DataFrame, columns: tuple[str, ...]) -> tuple | None:
    """A key without nulls that two rows of df have, if any."""
    keys = [F.col(f"`{c}`") for c in columns]
    row = df.where(reduce(Column.__and__, [k.isNotNull() for k in keys])).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").first()
    return tuple(row)[:-1] if row else None


def insert(stmt: T.Insert, m: st.Manifest, store: st.Store) -> tuple[st.Manifest, int]:
    places = [m.columns.index(m.column(c)) for c in stmt.columns] if stmt.columns else list(range(len(m.columns)))
    rows: list[list[object]] = []
    for given in constants(stmt.rows, store):
        if len(given) < len(places):
            raise LoomError(f"{len(given)} values for {len(places)} columns")
        row: list[object] = [None] * len(m.columns)
        for place, value in zip(places, given, strict=False):
            row[place] = m.columns[place].coerce(value)
        rows.append(row)
    counted = [k for k, c in enumerate(m.columns) if c.primary and c.type == "INTEGER"]
    nextid = m.next
    for row in rows:  # row by row, as a given value moves the numbers of later rows on
        for k in counted:
            if row[k] is None:
                (row[k],), nextid = store.numbers(replace(m, next=nextid), [], 1)
            else:
                _, nextid = store.numbers(replace(m, next=nextid), [row[k]], 0)
    for row in rows:
        for c, v in zip(m.columns, row, strict=True):
            if v is None and not c.nullable:
                raise ExecutionError(f"NULL value in column '{c.name}' violates NOT NULL")
    for index in m.indexes:
        if index.unique:
            _check_new_keys(rows, index, m, store)
    if not rows:
        return m, 0
    new = store.write(m, store.spark.createDataFrame(rows, m.schema).coalesce(1))
    return store.merged(replace(m.with_files(m.files, new), rows=m.rows + len(rows), next=nextid)), len(rows)


def _check_new_keys(rows: list[list[object]], index: st.Index, m: st.Manifest, store: st.Store) -> None:
    places = [m.columns.index(m.column(c)) for c in index.columns]
    keys = [key for row in rows if None not in (key := tuple(row[p] for p in places))]
    seen: set[tuple] = set()
    for key in keys:
        if key in seen:
            raise duplicate(key, index)
        seen.add(key)
    within = [Limit(T.Name(c), "in", tuple({k[p] for k in keys})) for p, c in enumerate(index.columns)]
    files = store.pruned(m, within if len(keys) <= KEYS_IN_FILTER else _span(keys, index.columns))
    if not keys or not files:
        return
    there = store.frame(m, files).select(*[F.col(f"`{c}`") for c in index.columns])
    if len(places) == 1 and len(keys) <= KEYS_IN_FILTER:  # reaches the scan, which skips row groups by it
        found = there.where(F.col(f"`{index.columns[0]}`").isin([k[0] for k in keys]))
    else:
        schema = store.frame(m).select(*index.columns).schema
        found = there.join(store.spark.createDataFrame(keys, schema), list(index.columns), "left_semi")
    if row := found.first():
        raise duplicate(tuple(row), index)


def _span(keys: list[tuple], columns: tuple[str, ...]) -> list[Limit]:
    """Limits that all of keys are within."""
    return [Limit(T.Name(c), op, (f(k[p] for k in keys),)) for p, c in enumerate(columns) if keys for op, f in ((">=", min), ("<=", max))]


def _scope(m: st.Manifest, df: DataFrame) -> tuple[Scope, DataFrame]:
    scope = Scope()
    named = scope.scan(T.Table(m.name), df)
    return scope, named


def stored(value: Typed, column: st.Column) -> Column:
    """An expression's value as a column stores it."""
    if column.type == "INTEGER":
        return value.column.cast("bigint")
    if column.type == "FLOAT":
        return value.column.cast("double")
    return value.condition() if column.type == "BOOLEAN" else value.text()


def _matching(m: st.Manifest, where: object | None, store: st.Store) -> tuple[Column, tuple[str, ...], int]:
    """WHERE as a condition that is never null, the files with a row that meets it, and the number of such rows."""
    df = store.frame(m)
    scope, _ = _scope(m, df)
    condition = F.lit(True) if where is None else F.coalesce(compile_expression(scope.bind(where), scope.leaf).condition(), F.lit(False))
    if not m.files:
        return condition, (), 0
    if where is None:
        return condition, m.files, m.rows
    files = store.pruned(m, limits(where))
    if not files:
        return condition, (), 0
    df = store.frame(m, files)
    named = df.select(*[F.col(f"`{c.name}`").alias(f"{m.name}.{c.name}") for c in m.columns], F.col("_metadata.file_path").alias(FILE))
    counts = {st.tail(r[FILE]): r["count"] for r in named.where(condition).groupBy(FILE).count().collect()}
    found = tuple(f for f in files if st.tail(f) in counts)
    if len(found) != len(counts):
        raise ExecutionError(f"Table '{m.name}': files with matching rows are not among its own")
    return condition, found, sum(counts.values())


def _shown(m: st.Manifest, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{m.name}.{c.name}`").alias(c.name) for c in m.columns])


def delete(stmt: T.Delete, m: st.Manifest, store: st.Store) -> tuple[st.Manifest, int]:
    condition, files, n = _matching(m, stmt.where, store)
    rest, new = tuple(f for f in m.files if f not in set(files)), {}
    if stmt.where is not None and files:
        _, named = _scope(m, store.frame(m, files))
        new = store.write(m, _shown(m, named.where(~condition)))
    return replace(m.with_files(rest, new), rows=m.rows - n), n


def update(stmt: T.Update, m: st.Manifest, store: st.Store) -> tuple[st.Manifest, int]:
    """Files with a match are written anew, once; the checks read what was written, which counts only if they pass."""
    sets = {m.column(c).name: x for c, x in stmt.sets}
    condition, files, n = _matching(m, stmt.where, store)
    scope, named = _scope(m, store.frame(m, files))
    new = {c: stored(compile_expression(scope.bind(x), scope.leaf), m.column(c)) for c, x in sets.items()}
    if not n:
        return m, 0
    after = named.select(*[(F.when(condition, new[c.name]).otherwise(F.col(f"`{m.name}.{c.name}`")) if c.name in new else F.col(f"`{m.name}.{c.name}`")).alias(c.name) for c in m.columns])
    written = store.write(m, after)
    held = store.frame(m, tuple(written))
    for c in new:
        if not m.column(c).nullable and held.where(F.col(f"`{c}`").isNull()).first():
            raise ExecutionError(f"NULL value in column '{c}' violates NOT NULL")
    rest = tuple(f for f in m.files if f not in set(files))
    nextid = m.next
    for index in m.indexes:
        if index.unique and any(m.column(c).name in new for c in index.columns):
            _check_changed_keys(held, written, rest, index, m, store)
    for c in m.columns:
        if c.primary and c.type == "INTEGER" and c.name in new:
            most = max((x["of"][c.name][1] for x in written.values() if x["of"][c.name][1] is not None), default=None)
            _, nextid = store.numbers(replace(m, next=nextid), [most] if most is not None else [], 0)
    return replace(m.with_files(rest, written), next=nextid), n


def _check_changed_keys(held: DataFrame, written: dict[str, dict], rest: tuple[str, ...], index: st.Index, m: st.Manifest, store: st.Store) -> None:
    """Keys of the files that were written must differ among themselves, and from those of the other files that may have one of them.

    The rest of the table is unique already, so it is not grouped again.
    """
    if key := repeated_key(held, index.columns):
        raise duplicate(key, index)
    spans = []
    for c in index.columns:
        bounds = [x["of"].get(m.column(c).name) for x in written.values()]
        if None in bounds or all(b[0] is None for b in bounds):
            continue
        known = [b for b in bounds if b[0] is not None]
        spans += [Limit(T.Name(c), ">=", (min(b[0] for b in known),)), Limit(T.Name(c), "<=", (max(b[1] for b in known),))]
    others = store.pruned(m, spans, rest)
    if others:
        keys = [F.col(f"`{c}`") for c in index.columns]
        if row := held.select(*keys).join(store.frame(m, others).select(*keys), list(index.columns), "left_semi").first():
            raise duplicate(tuple(row), index)


Change = Callable[[object, st.Manifest, st.Store], tuple[st.Manifest, int]]
CHANGES: dict[type, tuple[Change, str]] = {T.Insert: (insert, "inserted"), T.Update: (update, "updated"), T.Delete: (delete, "deleted")}
