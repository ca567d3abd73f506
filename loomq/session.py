"""Engine and Session: SQL text in, DataFrame or result dict out.

    engine = Engine(spark, "/data/db")
    engine.sql("SELECT name FROM users WHERE age > 26")      # a lazy DataFrame; raises on error
    engine.execute("SELECT name FROM users WHERE age > 26")  # {"columns": ..., "rows": ..., "message": ...}

Names also reach read-only tables that were registered: DataFrames (streaming ones too) and Parquet files.

Deliberate differences from a lenient dialect: an unknown column, trailing text and characters without meaning are
errors; uniqueness is checked on the whole statement, and a failed statement changes nothing, inside a transaction too;
BIGINT overflow is an error; groups come in no fixed order unless ORDER BY says so; ORDER BY n means the n-th column;
no user exists until one is created.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import answers as A
from .auth import Users
from .errors import ExecutionError, LoomError
from .functions.expressions import kind_of
from .operators import define
from .operators.change import CHANGES, duplicate, repeated_key
from .operators.select import select_frame
from .plans import tree as T
from .plans.explain import Facts, explained
from .plans.grammar import parse
from .plans.lexer import statements
from .plans.limits import Limit, limits_by_table
from .sources.locks import TIMEOUT, TableLocks
from .sources.store import SPARK_TYPES, Manifest, Store


#: Bytes of JSON up to which execute() gives a result as one dict.
MOST_BYTES = 256 << 20


class Engine:
    """The tables and users under one folder, on one SparkSession. Without a path: registered tables only."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, lock_timeout: float = TIMEOUT):
        self.spark = spark
        self.store = Store(spark, path) if path else None
        self.users = Users(self.store.folder if self.store else None)
        self.locks = TableLocks(lock_timeout)
        self.views: dict[str, DataFrame | str] = {}
        self.view_facts: dict[str, Facts] = {}
        self._local = threading.local()
        self._transactions = 0
        self._sessions: list[Session] = []
        self._lock = threading.Lock()

    def register(self, name: str, table: DataFrame | str) -> None:
        """Makes a DataFrame, or a Parquet path, readable under name. A path is not looked at before its first use."""
        self.views[name.lower()] = table

    def view(self, name: str) -> DataFrame:
        table = self.views[name.lower()]
        if isinstance(table, str):
            table = self.views[name.lower()] = self.spark.read.parquet(table)
        return table

    def register_parquet(self, folder: str, names: list[str]) -> None:
        for n in names:
            self.register(n, str(PurePosixPath(folder) / f"{n}.parquet") if "://" not in folder else f"{folder}/{n}.parquet")

    def create_table_as(self, name: str, df: DataFrame, primary: tuple[str, ...] = (), *, files: int | None = None) -> None:
        """A new table of the store with the rows of df, whose types must be of the dialect's four kinds; primary names its key.

        A table with a key is written by ranges of it, in `files` files, by default as many as df has partitions. It appears whole
        or, if a check fails, not at all.
        """
        kinds = {"int": "INTEGER", "float": "FLOAT", "text": "TEXT", "bool": "BOOLEAN"}
        specs = []
        for f in df.schema.fields:
            if kind_of(f.dataType) not in kinds:
                raise LoomError(f"Unknown column type: {f.dataType.simpleString()}")
            specs.append(T.ColumnSpec(f.name, kinds[kind_of(f.dataType)], f.name not in primary, f.name in primary))
        store = self.mine.new_table(name)
        m = define.create_table(T.CreateTable(name, tuple(specs)))
        cast = df.select(*[F.col(f"`{c.name}`").cast(SPARK_TYPES[c.type]).alias(c.name) for c in m.columns])
        if primary:
            cast = cast.repartitionByRange(files or max(1, df.rdd.getNumPartitions()), *[F.col(f"`{c}`") for c in primary])
        elif files:
            cast = cast.repartition(files)
        m = m.with_files((), store.write(m, cast))
        held = store.frame(m)
        for index in m.indexes:
            if held.where(" OR ".join(f"`{c}` IS NULL" for c in index.columns)).first():
                raise ExecutionError(f"NULL value in column '{index.columns[0]}' violates NOT NULL")
            if key := repeated_key(held, index.columns):
                raise duplicate(key, index)
        key_column = next((c.name for c in m.columns if c.primary and c.type == "INTEGER"), None)
        most = max((x["of"][key_column][1] for x in m.facts.values()), default=0) if key_column else 0
        store.commit({name.lower(): replace(m, rows=sum(x["rows"] for x in m.facts.values()), next=max(most, 0) + 1)}, {})

    def compact(self, table: str) -> None:
        """Writes a table's files anew, by ranges of its first index's columns: fewer files, and bounds that tell them apart."""
        mine = self.mine
        if mine.open:
            raise ExecutionError(A.IN_PROGRESS)
        try:
            mine.staged[table.lower()] = mine.store.compacted(mine._stage(table))
            mine.commit()
        finally:
            mine.rollback()

    def session(self) -> Session:
        s = Session(self)
        with self._lock:
            self._sessions.append(s)
        return s

    @property
    def mine(self) -> Session:
        """This thread's session."""
        if not hasattr(self._local, "session"):
            self._local.session = self.session()
        return self._local.session

    def sql(self, sql: str) -> DataFrame:
        return self.mine.sql(sql)

    def execute(self, sql: str) -> dict:
        return self.mine.execute(sql)

    def script(self, sql: str) -> list[dict]:
        return [self.execute(s) for s in statements(sql)]

    def next_transaction(self) -> int:
        with self._lock:
            self._transactions += 1
            return self._transactions

    def tables(self) -> list[str]:
        return sorted({*(self.store.names() if self.store else ()), *self.views})

    def close(self) -> None:
        """Rolls open transactions back. The SparkSession stays."""
        for s in self._sessions:
            s.rollback()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Session:
    """One user's statements in turn, with at most one open transaction."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.open = False
        self.staged: dict[str, Manifest] = {}
        self.bases: dict[str, str | None] = {}

    # tables

    @property
    def store(self) -> Store:
        if self.engine.store is None:
            raise ExecutionError("this engine has no folder to keep tables in")
        return self.engine.store

    def manifest(self, name: str) -> Manifest:
        return self.staged.get(name.lower()) or self.store.get(name)

    def stored(self, name: str) -> bool:
        return bool(self.engine.store) and (name.lower() in self.staged or name.lower() in self.engine.store.paths)

    def columns(self, name: str) -> list[str]:
        return [c.name for c in self.manifest(name).columns] if self.stored(name) else self.read(name).columns

    def read(self, name: str, limits: list[Limit] | None = None) -> DataFrame:
        """The table's rows; of a stored table, those of files that may hold a row which meets limits."""
        key = name.lower()
        if self.stored(name):
            if self.open:
                self.engine.locks.read(key, self)
            m = self.manifest(name)
            return self.store.frame(m, self.store.pruned(m, limits or []))
        if key in self.engine.views:
            return self.engine.view(key)
        raise LoomError(A.TABLE_MISSING.format(name))

    def facts(self, name: str) -> Facts:
        key = name.lower()
        if self.stored(name):
            m = self.manifest(name)
            return Facts(m.rows, len(m.files), m.distinct, tuple((i.name, i.columns) for i in m.indexes))
        self.read(name)
        return self.engine.view_facts.get(key, Facts())

    # transactions

    def begin(self) -> str:
        if self.open:
            raise ExecutionError(A.IN_PROGRESS)
        self.open = True
        return A.BEGUN.format(self.engine.next_transaction())

    def commit(self) -> None:
        try:
            if self.staged:
                self.store.commit(dict(self.staged), self.bases)
        finally:
            self._end()

    def rollback(self) -> None:
        self._end()

    def _end(self) -> None:
        self.open, self.staged, self.bases = False, {}, {}
        self.engine.locks.release(self)

    def _stage(self, name: str) -> Manifest:
        """The table to change, locked and as it is now."""
        key = name.lower()
        if key in self.engine.views and key not in self.store.paths:
            raise ExecutionError(f"Table '{name}' is read-only")
        self.engine.locks.write(key, self)
        if key not in self.staged:
            self.store.refresh()
            self.store.get(name)
            self.bases[key] = self.store.paths.get(key)
        return self.manifest(name)

    # statements

    def sql(self, sql: str) -> DataFrame:
        """The result as a DataFrame: of a SELECT lazily, of any other statement its message."""
        stmt = parse(sql)
        if isinstance(stmt, T.Select):
            return self.select(stmt)
        if isinstance(stmt, T.Explain):
            return self.engine.spark.createDataFrame([(self.explain(stmt.of),)], "plan string")
        return self.engine.spark.createDataFrame([(self.run(stmt),)], "message string")

    def select(self, stmt: T.Select) -> DataFrame:
        return select_frame(stmt, self.engine.spark, self.read, self.columns)

    def explain(self, select: T.Select) -> str:
        """The plan with estimates, the files of stored tables that are opened, then what Spark makes of it."""
        physical = self.select(select)._jdf.queryExecution().executedPlan().toString()
        parts = [explained(select, self.facts)]
        tables = [t for t in (select.table, *(j.table for j in select.joins)) if t]
        if any(self.stored(t.name) for t in tables):
            found = limits_by_table(select, [self.columns(t.name) for t in tables])
            lines = [f"  {t.name}: {len(self.store.pruned(m, x))} of {len(m.files)}" for t, x in zip(tables, found, strict=True) if self.stored(t.name) and (m := self.manifest(t.name))]
            parts.append("\n".join(["Files opened", *lines]))
        return "\n\n".join([*parts, f"Spark plan\n{physical.rstrip()}"])

    def run(self, stmt: object) -> str:
        """Carries out any statement but SELECT and EXPLAIN; its message."""
        match stmt:
            case T.Transaction("BEGIN"):
                return self.begin()
            case T.Transaction("COMMIT"):
                self.commit()
                return "COMMIT"
            case T.Transaction("ROLLBACK"):
                self.rollback()
                return "ROLLBACK"
            case T.Insert() | T.Update() | T.Delete():
                return self._change(stmt)
            case T.UserChange(verb, user, password):
                return self.engine.users.change(verb, user, password)
            case T.Analyze(table):
                return self._analyze(table)
        return self._define(stmt)

    def _change(self, stmt: T.Insert | T.Update | T.Delete) -> str:
        change, done = CHANGES[type(stmt)]
        try:
            new, n = change(stmt, self._stage(stmt.table), self.store)
            self.staged[stmt.table.lower()] = new
        except BaseException:
            if not self.open:
                self._end()
            raise
        if not self.open:
            self.commit()
        return A.CHANGED.format(n, done)

    def new_table(self, name: str) -> Store:
        """The store, if name is free in it."""
        self.store.refresh()
        if name.lower() in self.store.paths or name.lower() in self.engine.views:
            raise LoomError(A.TABLE_EXISTS.format(name))
        return self.store

    def _define(self, stmt: T.CreateTable | T.DropTable | T.CreateIndex) -> str:
        """DDL commits at once, also within a transaction."""
        key, store = stmt.table.lower(), self.store
        if isinstance(stmt, T.CreateTable):
            self.new_table(stmt.table).commit({key: define.create_table(stmt)}, {})
            return A.TABLE_CREATED.format(stmt.table)
        store.refresh()
        m = store.get(stmt.table)
        if isinstance(stmt, T.DropTable):
            self.engine.locks.write(key, self)
            store.commit({key: None}, {key: store.paths[key]})
            self.staged.pop(key, None)
            if not self.open:
                self._end()
            return A.TABLE_DROPPED.format(stmt.table)
        taken = {i.name.lower() for p in store.paths.values() for i in store.manifest(p).indexes}
        if stmt.name.lower() in taken:
            raise LoomError(A.INDEX_EXISTS.format(stmt.name))
        if key in self.staged:
            self.staged[key] = define.create_index(stmt, self.staged[key], store)
        else:
            store.commit({key: define.create_index(stmt, m, store)}, {key: store.paths[key]})
        return A.INDEX_CREATED.format(stmt.name, stmt.table, ", ".join(stmt.columns))

    def _analyze(self, table: str) -> str:
        rows, distinct = define.measure(self.read(table))
        key = table.lower()
        if not self.stored(table):
            pages = len(self.read(table).inputFiles())
            self.engine.view_facts[key] = Facts(rows, pages, distinct)
            return define.analysis(table, rows, pages, distinct)
        m = replace(self.manifest(table), rows=rows, distinct=distinct)
        if key in self.staged:
            self.staged[key] = m
        else:
            self.store.commit({key: m}, {key: self.store.paths[key]})
        return define.analysis(table, rows, len(m.files), distinct)

    def parts(self, sql: str, part_bytes: int) -> Iterator[dict]:
        """The result in dicts of about part_bytes of JSON, one row at least; `more` says that another follows. Errors are their message, with their kind in front.

        Rows come from Spark partition by partition, so the driver holds one partition and one part, whatever the result.
        """
        try:
            stmt = parse(sql)
            if isinstance(stmt, T.Select):
                df = self.select(stmt)
                rows, size, n = [], 0, 0
                for r in df.toLocalIterator(prefetchPartitions=True):
                    row = list(r)
                    length = len(json.dumps(row, default=str, ensure_ascii=False).encode()) + 2
                    if rows and size + length > part_bytes:
                        yield {"columns": df.columns, "rows": rows, "message": "", "more": True}
                        rows, size = [], 0
                    rows.append(row)
                    size, n = size + length, n + 1
                yield {"columns": df.columns, "rows": rows, "message": A.SELECTED.format(n)}
            elif isinstance(stmt, T.Explain):
                yield {"columns": ["plan"], "rows": [[self.explain(stmt.of)]], "message": "EXPLAIN"}
            else:
                yield {"columns": [], "rows": [], "message": self.run(stmt)}
        except LoomError as e:
            yield {"columns": [], "rows": [], "message": f"{e.prefix}: {e}"}
        except (PySparkException, Py4JJavaError) as e:  # rows that come one by one fail with the latter
            cause = e.java_exception.getCause() if isinstance(e, Py4JJavaError) else None
            yield {"columns": [], "rows": [], "message": f"Error: {cause.getMessage() if cause else e}"}

    def execute(self, sql: str, most_bytes: int = MOST_BYTES) -> dict:
        """The whole result as a dict, if it is of most_bytes at most; else an error that says so: sql() has no such bound."""
        found = list(islice(self.parts(sql, most_bytes), 2))
        if len(found) > 1:
            return {"columns": [], "rows": [], "message": f"Error: {A.TOO_LARGE.format(f'more than {most_bytes} bytes; use a DataFrame, or LIMIT')}"}
        return found[0]
