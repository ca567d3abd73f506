"""SELECT as a lazy DataFrame: scans, joins, WHERE, aggregation, HAVING, ORDER BY, projection, DISTINCT, OFFSET, LIMIT.

Nothing is collected and nothing is hinted: Catalyst prunes columns, pushes filters into scans and through joins, and
picks join strategies by size. Chains of inner joins begin with the smallest filtered table. Sorting comes before
projection, so ORDER BY may use columns that are not selected, and with LIMIT becomes one top-k operator.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.expressions import Typed, compile_expression
from ..plans import tree as T
from ..plans.limits import Limit, limits_by_table
from .scope import Bound, Scope


def label(item: T.Item) -> str:
    """The output name of a select item: alias, the column as typed, FN(column), FN(*), FN(?) or ?."""
    match item:
        case T.Item(_, str(alias)):
            return alias
        case T.Item(T.Name(column)):
            return column
        case T.Item(T.Aggregate(name, None)):
            return f"{name}(*)"
        case T.Item(T.Aggregate(name, T.Name(column))):
            return f"{name}({column})"
        case T.Item(T.Aggregate(name)):
            return f"{name}(?)"
    return "?"


Read = Callable[..., DataFrame]


def from_clause(select: T.Select, scope: Scope, read: Read, columns: Callable[[str], list[str]]) -> DataFrame:
    tables = [select.table, *(j.table for j in select.joins)]
    found = limits_by_table(select, [columns(t.name) for t in tables])
    frames, conditions = [], [None]
    for k, table in enumerate(tables):
        frames.append(scope.scan(table, read(table.name, found[k])))
        if k:  # a condition sees the tables up to its own
            on = select.joins[k - 1].on
            conditions.append(None if on is None else scope.bind(on))
    compiled = lambda x: compile_expression(x, scope.leaf).condition()
    if len(tables) > 2 and all(j.kind in ("inner", "cross") for j in select.joins) and not any(f.isStreaming for f in frames):
        return _inner_chain(scope, frames, [c for x in conditions for c in conjuncts(x)], found, compiled)
    df = frames[0]
    for join, right, on in zip(select.joins, frames[1:], conditions[1:], strict=True):
        if join.kind == "cross":
            df = df.crossJoin(right) if on is None else df.crossJoin(right).filter(compiled(on))
        else:
            df = df.join(right, F.lit(True) if on is None else compiled(on), join.kind)
    return df


def conjuncts(x: object) -> list[object]:
    match x:
        case None:
            return []
        case T.Binary("AND", left, right):
            return conjuncts(left) + conjuncts(right)
    return [x]


def _columns(x: object) -> set[str]:
    return {x.column} if isinstance(x, Bound) else {c for y in T.children(x) for c in _columns(y)}


def _inner_chain(scope: Scope, frames: list[DataFrame], on: list[object], limits: list[list[Limit]], compiled: Callable[[object], Column]) -> DataFrame:
    """Inner joins in any order give the same rows: the smallest filtered table first, then whatever is tied to what is there by an equality, smaller ones before.

    So filters on small tables thin out the large ones before these meet. Sizes are Spark's own of the files; a limit counts
    for a tenth or a half. How each join is carried out stays Catalyst's choice.
    """
    table_of = {own: k for k, (_, columns) in enumerate(scope.tables) for own in columns.values()}
    uses = [{table_of[c] for c in _columns(x)} for x in on]
    ties = [u for x, u in zip(on, uses, strict=True) if isinstance(x, T.Binary) and x.op == "=" and len(u) > 1]

    def size(k: int) -> float:
        known = int(str(frames[k]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return known * math.prod(0.1 if x.op == "in" else 0.5 for x in limits[k])

    sizes = [size(k) for k in range(len(frames))]
    tied = [k for k in range(len(frames)) if any(k in u for u in ties)]
    done = [min(tied or range(len(frames)), key=sizes.__getitem__)]
    df, used = frames[done[0]], [not u for u in uses]
    while True:
        ready = [k for k, u in enumerate(uses) if not used[k] and u <= set(done)]
        fits = [on[k] for k, u in enumerate(uses) if not u and len(done) == len(frames)] + [on[k] for k in ready]
        if len(done) > 1 and fits:
            df = df.join(right, reduce(Column.__and__, map(compiled, fits)), "inner")
        elif len(done) > 1:
            df = df.crossJoin(right)
        elif fits:
            df = df.filter(reduce(Column.__and__, map(compiled, fits)))
        for k in ready:
            used[k] = True
        if len(done) == len(frames):
            return df
        left = [k for k in range(len(frames)) if k not in done]
        near = [k for k in left if any(k in u and u - {k} <= set(done) for u in ties)]
        done.append(min(near, key=sizes.__getitem__) if near else left[0])
        right = frames[done[-1]]


def _aggregate(name: str, arg: Typed | None, distinct: bool) -> tuple[Column, str]:
    """The aggregate over its argument, which is a column by now, and the result's kind."""
    if arg is None:
        return F.count(F.lit(1)), "int"
    if name in ("SUM", "AVG"):
        if arg.kind in ("text", "other"):
            raise PlanError(f"{name} does not apply to text or dates")
        value = arg.column.cast("bigint") if arg.kind in ("bool", "null") else arg.column
    else:
        value = arg.column
    kinds = {"COUNT": "int", "AVG": "float", "SUM": "float" if arg.kind == "float" else "int"}
    if name == "COUNT":
        return (F.count_distinct(value) if distinct else F.count(value)), "int"
    if name == "SUM":
        return (F.sum_distinct(value) if distinct else F.sum(value)), kinds[name]
    if name == "AVG":
        return F.avg(value), "float"
    return (F.min(value) if name == "MIN" else F.max(value)), arg.kind


def aggregated(df: DataFrame, scope: Scope, keys: list[object], wanted: list[T.Aggregate]) -> tuple[DataFrame, Callable[[object], Typed | None]]:
    """df grouped by keys with the wanted aggregates, and the leaf function for expressions over the result.

    Arguments are projected first, so a scan reads only what the aggregates need and partial aggregation sees plain
    columns. Two averages of one argument, plain and distinct, stay apart.
    """
    key_of = {x: f"__key{k}" for k, x in enumerate(dict.fromkeys(keys))}
    arg_of = {x: f"__arg{k}" for k, x in enumerate(dict.fromkeys(a.of for a in wanted if a.of is not None))}
    compiled = {x: compile_expression(x, scope.leaf) for x in (*key_of, *arg_of)}
    df = df.select(*[compiled[x].column.alias(n) for x, n in (*key_of.items(), *arg_of.items())])
    results: dict[T.Aggregate, tuple[str, Typed]] = {}
    columns = []
    for k, a in enumerate(dict.fromkeys(wanted)):
        arg = None if a.of is None else Typed(F.col(arg_of[a.of]), compiled[a.of].kind, compiled[a.of].type)
        column, kind = _aggregate(a.name, arg, a.distinct)
        if a.name == "AVG" and a.distinct:  # over the argument as it is, so that all distinct aggregates of it share one
            column = F.expr(f"avg(DISTINCT {arg_of[a.of]})" if arg.kind in ("int", "float") else f"avg(DISTINCT CAST({arg_of[a.of]} AS DOUBLE))")
        columns.append(column.alias(f"__agg{k}"))
        results[a] = f"__agg{k}", Typed(F.col(f"__agg{k}"), kind, arg.type if arg else None)
    grouped = df.groupBy(*key_of.values())
    df = grouped.agg(*columns) if columns else df.select(*key_of.values()).distinct()

    def leaf(x: object) -> Typed | None:
        if x in key_of:
            return Typed(F.col(key_of[x]), compiled[x].kind, compiled[x].type)
        if isinstance(x, T.Aggregate):
            return results[x][1]
        if isinstance(x, Bound):
            raise PlanError(f"column '{scope.shown[x.column]}' must be grouped by or stand in an aggregate")
        return None

    return df, leaf


def select_frame(select: T.Select, spark: SparkSession, read: Read, columns: Callable[[str], list[str]]) -> DataFrame:
    """read(name, limits) gives a table's rows, of which it may leave out those that fail a limit; columns(name) its columns."""
    scope = Scope()
    df = from_clause(select, scope, read, columns) if select.table else spark.range(1).select()
    if select.where is not None:
        df = df.filter(compile_expression(scope.bind(select.where), scope.leaf).condition())

    items: list[tuple[str, object]] = []
    for item in select.items:
        if isinstance(item.of, T.Star):
            items += [(scope.shown[own], Bound(own)) for own in scope.star(item.of)]
        else:
            items.append((label(item), scope.bind(item.of)))
    aliases = {i.alias.lower(): scope.bind(i.of) for i in reversed(select.items) if i.alias}

    def ordered_by(x: object) -> object:
        match x:
            case T.Const(int(n)) if not isinstance(n, bool):
                if not 1 <= n <= len(items):
                    raise PlanError(f"ORDER BY position {n} is not in the select list")
                return items[n - 1][1]
            case T.Name(column, None) if column.lower() in aliases:
                return aliases[column.lower()]
        return scope.bind(x)

    keys = [aliases[x.column.lower()] if isinstance(x, T.Name) and not x.table and x.column.lower() in aliases and not _known(scope, x) else scope.bind(x) for x in select.group]
    having = None if select.having is None else scope.bind(select.having)
    order = [(ordered_by(o.of), o.descending) for o in select.order]
    wanted = [a for x in (*(x for _, x in items), having, *(x for x, _ in order)) for a in T.aggregates(x)]
    leaf: Callable[[object], Typed | None] = scope.leaf
    if wanted or keys or having is not None:
        df, leaf = aggregated(df, scope, keys, wanted)
        if having is not None:
            df = df.filter(compile_expression(having, leaf).condition())
    compiled = partial(compile_expression, leaf=leaf)

    if select.distinct:
        return _paged(_distinct(df, items, order, compiled), select)
    if order:
        df = df.orderBy(*[_sorted(compiled(x).column, down) for x, down in order])
    return _paged(df.select(*[compiled(x).column.alias(n) for n, x in items]), select)


def _known(scope: Scope, name: T.Name) -> bool:
    try:
        return bool(scope.find(name))
    except PlanError:
        return False


def _sorted(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_first()


def _distinct(df: DataFrame, items: list[tuple[str, object]], order: list[tuple[object, bool]], compiled: Callable[[object], Typed]) -> DataFrame:
    """Distinct rows, then the order, which must be of what is selected."""
    own = {x: f"__out{k}" for k, (_, x) in reversed(list(enumerate(items)))}
    df = df.select(*[compiled(x).column.alias(f"__out{k}") for k, (_, x) in enumerate(items)]).distinct()
    if missing := [x for x, _ in order if x not in own]:
        raise PlanError(f"ORDER BY of SELECT DISTINCT must be in the select list: {missing[0]}")
    if order:
        df = df.orderBy(*[_sorted(F.col(own[x]), down) for x, down in order])
    return df.select(*[F.col(f"__out{k}").alias(n) for k, (n, _) in enumerate(items)])


def _paged(df: DataFrame, select: T.Select) -> DataFrame:
    if select.offset:
        df = df.offset(select.offset)
    return df if select.limit is None else df.limit(max(0, select.limit))
