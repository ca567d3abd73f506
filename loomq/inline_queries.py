"""Queries over small tables of odd values, and over what statements answer: NULLs, mixed kinds, clashing names, errors, surfaces.

The star schema holds no NULL and no odd value, so these tables are part of the query; DuckDB gets them as VALUES.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .client import Client, ConnectionPool
from .plans.lexer import statements
from .repl import Shell
from .server import Server
from .session import Engine
from .sources.scratch import shared_folder

INLINE: dict[str, tuple[str, list[tuple]]] = {
    "mix": ("id bigint, a bigint, f double, s string, b boolean", [(1, 0, 0.0, "", True), (2, 5, 1.5, "a_b", False), (3, None, None, None, None), (4, -3, -1.0, "a\\b", True), (5, 7, 2.0, "axb", False), (6, 1, 1.0, "x%y", True), (7, 5, 9.5, "B", None), (8, None, 2.5, "é", False)]),
    "lhs": ("k bigint, v string", [(1, "a"), (1, "b"), (2, "c"), (None, "d")]),
    "rhs": ("k bigint, v string", [(1, "x"), (3, "y"), (None, "z"), (1, "w")]),
    "empty": ("id bigint, x double", []),
}

#: name -> (dialect, DuckDB or None if it is the same)
SELECTS: dict[str, tuple[str, str | None]] = {
    "inline_null_order": ("SELECT id, a FROM mix ORDER BY a, id LIMIT 4", "SELECT id, a FROM mix ORDER BY a NULLS FIRST, id LIMIT 4"),
    "inline_null_order_desc": ("SELECT id, f FROM mix ORDER BY f DESC, id LIMIT 7", "SELECT id, f FROM mix ORDER BY f DESC NULLS LAST, id LIMIT 7"),
    "inline_null_group": ("SELECT a, COUNT(*) AS n, COUNT(s) AS m, SUM(f) AS t, MAX(DISTINCT f) AS hi, COUNT(DISTINCT a) AS d FROM mix GROUP BY a", None),
    "inline_null_filter": ("SELECT id FROM mix WHERE a IS NULL OR f IS NOT NULL AND s IS NULL OR NOT (b IS NULL) AND a > 4", None),
    "inline_three_valued": ("SELECT id, a > 1 AND b AS x, a > 1 OR b AS y, NOT b AS z, a IN (5, NULL) AS i, a NOT IN (5, NULL) AS j, a BETWEEN 0 AND f AS k FROM mix", None),
    "inline_null_keys_left": ("SELECT lhs.v AS x, rhs.v AS y FROM lhs LEFT JOIN rhs ON lhs.k = rhs.k", None),
    "inline_null_keys_right": ("SELECT lhs.v AS x, rhs.v AS y FROM lhs RIGHT JOIN rhs ON lhs.k = rhs.k", None),
    "inline_left_without_on": ("SELECT v, x FROM lhs LEFT JOIN empty", "SELECT v, x FROM lhs LEFT JOIN empty ON TRUE"),
    "inline_right_without_on": ("SELECT v, x FROM empty RIGHT JOIN lhs", "SELECT v, x FROM empty RIGHT JOIN lhs ON TRUE"),
    "inline_bare_name": ("SELECT v, k FROM lhs JOIN rhs ON lhs.k = rhs.k", "SELECT lhs.v, lhs.k FROM lhs JOIN rhs ON lhs.k = rhs.k"),
    "inline_qualifier_dropped": ("SELECT wrong.v FROM lhs WHERE LHS.K = 2", "SELECT v FROM lhs WHERE k = 2"),
    "inline_output_names": ("SELECT V, k + 1, COUNT(*), COUNT(k), SUM(k + 1) FROM lhs GROUP BY V, k", 'SELECT v AS "V", k + 1 AS "?", COUNT(*) AS "COUNT(*)", COUNT(k) AS "COUNT(k)", CAST(SUM(k + 1) AS BIGINT) AS "SUM(?)" FROM lhs GROUP BY v, k'),
    "inline_comments": ("SELECT id -- all of them\nFROM mix -- here\nWHERE a = 5;", "SELECT id FROM mix WHERE a = 5"),
    "inline_compare_mixed": ("SELECT id, a < s AS lt, s >= a AS ge, a = s AS eq, a <> s AS ne, b = a AS ba, f = a AS fa FROM mix", "SELECT id, CAST(NULL AS BOOLEAN) AS lt, CAST(NULL AS BOOLEAN) AS ge, CASE WHEN a IS NOT NULL AND s IS NOT NULL THEN FALSE END AS eq, CASE WHEN a IS NOT NULL AND s IS NOT NULL THEN TRUE END AS ne, b::BIGINT = a AS ba, f = a AS fa FROM mix"),
    "inline_text_mixed": ("SELECT id, s + 1 AS p, s - s AS m, s * 1.5 AS t, s * b AS r, s + s AS d FROM mix", "SELECT id, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS m, CAST(NULL AS VARCHAR) AS t, repeat(s, b::BIGINT) AS r, s || s AS d FROM mix"),
    "inline_bool_arithmetic": ("SELECT id, b + b AS two, b * f AS bf, -b AS minus, a - b AS ab, b / 2 AS half FROM mix", "SELECT id, b::BIGINT + b::BIGINT AS two, b::INT * f AS bf, -(b::BIGINT) AS minus, a - b::BIGINT AS ab, b::INT / 2.0::DOUBLE AS half FROM mix"),
    "inline_bool_aggregates": ("SELECT SUM(b) AS s, AVG(b) AS a, MIN(b) AS lo, MAX(b) AS hi, COUNT(b) AS n FROM mix", "SELECT CAST(SUM(b::INT) AS BIGINT) AS s, AVG(b::INT) AS a, MIN(b) AS lo, MAX(b) AS hi, COUNT(b) AS n FROM mix"),
    "inline_like_kinds": ("SELECT id, a LIKE '5%' AS x, b LIKE 'T%' AS y, s LIKE 'a\\_b' AS z, s LIKE 'a_b' AS w, s NOT LIKE '%' AS v FROM mix", "SELECT id, CAST(a AS VARCHAR) LIKE '5%' AS x, CASE WHEN b THEN TRUE WHEN NOT b THEN FALSE END AS y, s = 'a\\_b' OR (s LIKE 'a\\%b' AND length(s) = 4) AS z, s LIKE 'a_b' AS w, NOT s LIKE '%' AS v FROM mix"),
    "inline_text_order": ("SELECT s, id FROM mix WHERE s > 'A' AND s <= 'é' ORDER BY s DESC", "SELECT s, id FROM mix WHERE s > 'A' AND s <= 'é'"),
    "inline_truthy": ("SELECT id, NOT s AS ns, a AND s AS both, f OR b AS either FROM mix WHERE a OR s", "SELECT id, NOT (s <> '') AS ns, a <> 0 AND s <> '' AS both, f <> 0 OR b AS either FROM mix WHERE a <> 0 OR s <> ''"),
    "inline_division": ("SELECT id, a / f AS q, 7 / 2 AS r, a / 0 AS z FROM mix", "SELECT id, CASE WHEN f <> 0 THEN a / f END AS q, 3.5::DOUBLE AS r, CAST(NULL AS DOUBLE) AS z FROM mix"),
    "inline_having_alone": ("SELECT COUNT(*) AS n, SUM(a) AS s FROM mix HAVING COUNT(*) > 3", "SELECT COUNT(*) AS n, CAST(SUM(a) AS BIGINT) AS s FROM mix HAVING COUNT(*) > 3"),
    "inline_column_then_star": ("SELECT k * 10 AS ten, * FROM lhs", None),
    "inline_where_without_from": ("SELECT 1 + 1 AS a WHERE 1 = 0", "SELECT 2::BIGINT AS a WHERE FALSE"),
    "inline_tail_without_from": ("SELECT 'x' AS a, TRUE AS b ORDER BY a LIMIT 1 OFFSET 0", "SELECT 'x' AS a, TRUE AS b"),
    "inline_distinct_nulls": ("SELECT DISTINCT a, a IS NULL AS gone FROM mix", None),
    "inline_empty": ("SELECT COUNT(*) AS n, SUM(x) AS s, MAX(id) AS hi FROM empty", None),
    "inline_any_order": ("SELECT a.id AS i, b.k AS k, c.v AS v FROM mix a JOIN lhs b ON a.id = b.k JOIN rhs c ON b.k = c.k WHERE a.f >= 0", None),
}


def _engine(spark: SparkSession) -> Engine:
    engine = Engine(spark)
    for name, (schema, rows) in INLINE.items():
        engine.register(name, spark.createDataFrame(rows, schema))
    return engine


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def _values(name: str) -> str:
    schema, rows = INLINE[name]
    types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    columns = [(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")]
    held = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows) or f"({', '.join(['NULL'] * len(columns))})"
    typed = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns)
    return f"{name} AS (SELECT {typed} FROM (VALUES {held}) x({', '.join(c for c, _ in columns)}){'' if rows else ' WHERE FALSE'})"


def _select(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark).sql(sql)


#: name -> (statements of a fresh store, what they answer in turn: messages, or rows as text)
SAID: dict[str, tuple[str, list[str]]] = {
    "said_keys": (
        "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT NOT NULL, e TEXT); INSERT INTO t (v) VALUES ('a'), ('b'); INSERT INTO t VALUES (2, 'c', NULL); INSERT INTO t (id, v) VALUES (7, 'x'), (7, 'y'); INSERT INTO t (e) VALUES ('z'); UPDATE t SET v = NULL WHERE id = 1; UPDATE t SET id = 2 WHERE id = 1; UPDATE t SET id = id + 10; CREATE UNIQUE INDEX ue ON t (e); INSERT INTO t VALUES (20, 'q', 'one'); INSERT INTO t VALUES (21, 'q', 'one'); CREATE UNIQUE INDEX uv ON t (v); INSERT INTO t (v) VALUES ('next'); SELECT id, v, e FROM t ORDER BY id",
        ["Table 't' created", "2 row(s) inserted", "Execution error: Duplicate key (2) violates unique index 'pk_t'", "Execution error: Duplicate key (7) violates unique index 'pk_t'", "Execution error: NULL value in column 'v' violates NOT NULL", "Execution error: NULL value in column 'v' violates NOT NULL", "Execution error: Duplicate key (2) violates unique index 'pk_t'", "2 row(s) updated", "Index 'ue' created on t(e)", "1 row(s) inserted", "Execution error: Duplicate key ('one') violates unique index 'ue'", "Index 'uv' created on t(v)", "1 row(s) inserted", "[[11, 'a', None], [12, 'b', None], [20, 'q', 'one'], [22, 'next', None]]"],
    ),
    "said_definitions": (
        "CREATE TABLE t (a INT, b REAL); CREATE TABLE T (a INT); CREATE TABLE u (x DECIMAL); CREATE INDEX i ON t (a); CREATE INDEX i ON t (b); CREATE INDEX j ON t (c); DROP TABLE t; DROP TABLE t; SELECT * FROM t; INSERT INTO t VALUES (1); CREATE INDEX i ON t (a)",
        ["Table 't' created", "Error: Table 'T' already exists", "Error: Unknown column type: DECIMAL", "Index 'i' created on t(a)", "Error: Index 'i' already exists", "Execution error: Column 'c' does not exist in table 't'", "Table 't' dropped", "Error: Table 't' does not exist", "Error: Table 't' does not exist", "Error: Table 't' does not exist", "Error: Table 't' does not exist"],
    ),
    "said_transactions": (
        "CREATE TABLE t (a INT); BEGIN; BEGIN; INSERT INTO t VALUES (1), (2); CREATE TABLE u (x INT); SELECT COUNT(*) FROM t; ROLLBACK; SELECT COUNT(*) FROM t; SELECT COUNT(*) FROM u; BEGIN; INSERT INTO t VALUES (3); DELETE FROM t WHERE a / 0; COMMIT; COMMIT; SELECT a FROM t",
        ["Table 't' created", "BEGIN (txn 1)", "Execution error: A transaction is already in progress", "2 row(s) inserted", "Table 'u' created", "[[2]]", "ROLLBACK", "[[0]]", "[[0]]", "BEGIN (txn 2)", "1 row(s) inserted", "0 row(s) deleted", "COMMIT", "COMMIT", "[[3]]"],
    ),
    "said_users": (
        "CREATE USER Bob IDENTIFIED BY 'pw'; CREATE USER bob IDENTIFIED BY 'x'; ALTER USER BOB SET PASSWORD 'new'; DROP USER bob; DROP USER bob; ALTER USER bob SET PASSWORD 'x'",
        ["User 'Bob' created", "Error: User 'bob' already exists", "Password updated for 'BOB'", "User 'bob' dropped", "Error: User 'bob' does not exist", "Error: User 'bob' does not exist"],
    ),
    "said_analyze": (
        "CREATE TABLE t (id INTEGER PRIMARY KEY, g INT); INSERT INTO t (g) VALUES (1), (1), (NULL); ANALYZE t; EXPLAIN SELECT g FROM t WHERE id = 2",
        ["Table 't' created", "3 row(s) inserted", "ANALYZE t: row_count=3, page_count=1, g.ndv=1, id.ndv=3", "Projection\n  SeqScan(t filter=(id = 2)) [est_rows=3, cost=1]"],
    ),
}

#: statements without meaning, each of which must be refused: kind of error, statement
REFUSED = [
    ("Parse error", "SELECT id FROM mix garbage more"), ("Parse error", "SELECT id FROM mix; SELECT 1"), ("Parse error", "SELECT f(x) FROM mix"), ("Parse error", "SELECT id FROM mix UNION SELECT 1"), ("Parse error", "SELECT id FROM mix, lhs"),
    ("Parse error", "SELECT a % 2 FROM mix"), ("Parse error", 'SELECT "id" FROM mix'), ("Parse error", "SELECT id FROM (SELECT 1)"), ("Parse error", "WITH x AS (SELECT 1) SELECT 1"), ("Parse error", "SELECT id FROM mix WHERE id IN (SELECT 1)"), ("Parse error", "CREATE TABLE IF NOT EXISTS t (a INT)"),
    ("Parse error", "DROP INDEX i"), ("Parse error", "CREATE TABLE t (a INT DEFAULT 1)"), ("Parse error", "SELECT id FROM mix LIMIT 1 ORDER BY id"), ("Plan error", "SELECT nothing FROM mix"), ("Plan error", "SELECT id FROM mix GROUP BY a"), ("Plan error", "SELECT SUM(s) FROM mix"), ("Plan error", "SELECT -s FROM mix"),
    ("Plan error", "SELECT DISTINCT a FROM mix ORDER BY id"), ("Error", "SELECT 9223372036854775807 + id FROM mix"), ("Error", "SELECT * FROM gone"),
]


def _rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "nth bigint, said string").coalesce(1)


def _answers(session, sql: str) -> list[str]:
    """What statements answer: rows as text, of a plan the tree alone, else the message."""
    out = []
    for s in statements(sql):
        r = session.execute(s)
        out.append(r["rows"][0][0].split("\n\n")[0] if r["columns"] == ["plan"] else str(r["rows"]) if r["columns"] else r["message"])
    return out


def _said(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rows(spark, _answers(Engine(spark, shared_folder(spark)), sql))


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of error that statements without meaning give."""
    engine = _engine(spark)
    return _rows(spark, [engine.execute(sql)["message"].split(":")[0] for _, sql in REFUSED])


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store opened again after a driver that left a transaction open: what was committed is there, and nothing else."""
    folder = shared_folder(spark)
    Engine(spark, folder).script("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t (v) VALUES ('a'), ('b'); UPDATE t SET v = 'c' WHERE id = 2; BEGIN; DELETE FROM t; INSERT INTO t (v) VALUES ('lost')")
    return Engine(spark, folder).sql("SELECT id, v FROM t")


def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions: a reader sees the old version until the commit, a writer waits and is refused."""
    engine = Engine(spark, shared_folder(spark), lock_timeout=0.2)
    one, two = engine.session(), engine.session()
    said = _answers(one, "CREATE TABLE t (a INT); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2)")
    said += _answers(two, "SELECT COUNT(*) FROM t; DELETE FROM t")
    said += _answers(one, "SELECT COUNT(*) FROM t; COMMIT")
    return _rows(spark, said + _answers(two, "SELECT COUNT(*) FROM t; DELETE FROM t"))


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements through the TCP server: a log-in that is refused, a client, a pool whose connections are rolled back on release."""
    engine = Engine(spark, shared_folder(spark))
    engine.execute("CREATE USER bob IDENTIFIED BY 'pw'")
    server = Server(engine, port=0).start()
    said = []
    try:
        try:
            Client(port=server.port, username="bob", password="no")
        except ConnectionError as e:
            said.append(str(e))
        with Client(port=server.port, username="BOB", password="pw") as db:
            said += _answers(db, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t (v) VALUES ('it''s'), (NULL); SELECT id, v FROM t ORDER BY id; SELECT x")
        pool = ConnectionPool(port=server.port, min_size=1, max_size=1, username="bob", password="pw")
        with pool.connection() as db:
            said += _answers(db, "BEGIN; DELETE FROM t; SELECT COUNT(*) FROM t")
        with pool.connection() as db:
            said += _answers(db, "SELECT COUNT(*) FROM t")
        pool.close()
    finally:
        server.stop()
    return _rows(spark, said)


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the shell prints."""
    out = io.StringIO()
    Shell(Engine(spark, shared_folder(spark)), out).run([".tables", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT);", "INSERT INTO t (name)", " VALUES ('Ann'), (NULL);", "SELECT * FROM t ORDER BY id;", ".nothing", ".quit", "SELECT 1;"])
    return _rows(spark, [x for x in out.getvalue().split("\n") if x.strip()])


def explained_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN's plan, a row a line."""
    engine = _engine(spark)
    text = engine.sql("EXPLAIN SELECT lhs.v, COUNT(*) FROM lhs JOIN rhs ON lhs.k = rhs.k WHERE lhs.v > 'a' GROUP BY lhs.v ORDER BY lhs.v LIMIT 3").first().plan
    return _rows(spark, text.split("\n\n")[0].split("\n"))


#: what the queries above give, as lines
LINES: dict[str, list[str]] = {
    "refused": [kind for kind, _ in REFUSED],
    "isolated": ["Table 't' created", "1 row(s) inserted", "BEGIN (txn 1)", "1 row(s) inserted", "[[1]]", "Execution error: Lock timeout on table 't' (possible deadlock)", "[[2]]", "COMMIT", "[[2]]", "2 row(s) deleted"],
    "served": ["Authentication failed", "Table 't' created", "2 row(s) inserted", "[[1, \"it's\"], [2, None]]", "Plan error: column 'x' does not exist", "BEGIN (txn 1)", "2 row(s) deleted", "[[0]]", "[[2]]"],
    "shown": ["(no tables)", "Table 't' created", "2 row(s) inserted", "+----+------+", "| id | name |", "+----+------+", "| 1  | Ann  |", "| 2  | NULL |", "+----+------+", "2 row(s)", "Unknown command: .nothing  (try .help)"],
    "explained_tree": ["Limit(3 offset=0)", "  Sort", "    Projection", "      Aggregate", "        Filter((lhs.v > 'a'))", "          Join(INNER)", "            SeqScan(lhs) [est_rows=0, cost=1]", "            SeqScan(rhs) [est_rows=0, cost=1]"],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _select(sql) for name, (sql, _) in SELECTS.items()} | {name: _said(sql) for name, (sql, _) in SAID.items()}
    return found | {f.__name__: f for f in (refused, reopened, isolated, served, shown, explained_tree)}


def oracle_sql() -> dict[str, str]:
    lines = lambda x: "SELECT CAST(nth AS BIGINT) AS nth, said FROM (VALUES " + ", ".join(f"({k}, {_literal(v)})" for k, v in enumerate(x)) + ") x(nth, said)"
    tables = "WITH " + ", ".join(map(_values, INLINE)) + " "
    found = {name: tables + (oracle or sql) for name, (sql, oracle) in SELECTS.items()}
    found |= {name: lines(said) for name, (_, said) in SAID.items()} | {name: lines(said) for name, said in LINES.items()}
    return found | {"reopened": "SELECT 1::BIGINT AS id, 'a' AS v UNION ALL SELECT 2, 'c'"}
