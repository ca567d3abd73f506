"""CREATE TABLE, CREATE INDEX and ANALYZE as changes of a manifest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..plans import tree as T
from ..sources import store as st
from .change import repeated_key


def create_table(stmt: T.CreateTable) -> st.Manifest:
    columns = tuple(st.Column(c.name, st.type_name(c.type), c.nullable, c.primary) for c in stmt.columns)
    names = [c.name.lower() for c in columns]
    if len(set(names)) < len(names):
        raise ExecutionError(f"Table '{stmt.table}' names a column twice")
    key = tuple(c.name for c in columns if c.primary)
    return st.Manifest(stmt.table, columns, (st.Index(f"pk_{stmt.table}", key, True),) if key else ())


def create_index(stmt: T.CreateIndex, m: st.Manifest, store: st.Store) -> st.Manifest:
    """Adds the index: bounds of its columns in each file, by which scans and changes skip files; a unique one is checked on each change.

    Files keep their order; Engine.compact() writes them anew by ranges of the first index's columns.
    """
    columns = tuple(m.column(c).name for c in stmt.columns)
    if stmt.unique and (key := repeated_key(store.frame(m), columns)):
        raise ExecutionError(f"Cannot create unique index '{stmt.name}': duplicate key ({', '.join(map(repr, key))})")
    found = store.measured(m, m.files, tuple(c for c in columns if c not in m.indexed))
    facts = {f: x | {"of": x.get("of", {}) | found.get(f, {}).get("of", {})} for f, x in m.facts.items()}
    return replace(m, indexes=(*m.indexes, st.Index(stmt.name, columns, stmt.unique)), facts=facts)


def measure(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and distinct values of each column, nulls not among them; exact, one pass over the data."""
    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in names]).first()
    return row["__rows"], {c: row[c] for c in names}


def analysis(name: str, rows: int, pages: int, distinct: dict[str, int]) -> str:
    parts = [f"row_count={rows}", f"page_count={pages}", *(f"{c}.ndv={distinct[c]}" for c in sorted(distinct))]
    return f"ANALYZE {name}: {', '.join(parts)}"
