import io
import socket

import pytest

from loomq.client import Client, ConnectionPool
from loomq.repl import Shell, boxed
from loomq.server import Server, receive, send
from loomq.session import Engine


@pytest.fixture
def engine(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        e.execute("CREATE USER Bob IDENTIFIED BY 'pw'")
        yield e


@pytest.fixture
def server(engine):
    s = Server(engine, port=0).start()
    yield s
    s.stop()


def test_users(engine, spark, tmp_path):
    assert engine.users.accepts("bob", "pw") and not engine.users.accepts("bob", "PW") and not engine.users.accepts("x", "pw")
    assert engine.execute("CREATE USER BOB IDENTIFIED BY 'x'")["message"] == "Error: User 'BOB' already exists"
    assert engine.execute("ALTER USER bob SET PASSWORD 'new'")["message"] == "Password updated for 'bob'"
    assert Engine(spark, str(tmp_path / "db")).users.accepts("BOB", "new")
    assert engine.execute("DROP USER bob")["message"] == "User 'bob' dropped"
    assert engine.execute("DROP USER bob")["message"] == "Error: User 'bob' does not exist"


def test_client_and_server(server):
    with Client(port=server.port, username="bob", password="pw") as db:
        db.execute("CREATE TABLE boats (id INTEGER PRIMARY KEY, berth TEXT, length FLOAT)")
        db.execute("INSERT INTO boats (berth, length) VALUES ('north 4', 7.25)")
        assert db.execute("SELECT * FROM boats")["rows"] == [[1, "north 4", 7.25]]
        assert db.execute("   ") == {"columns": [], "rows": [], "message": ""}
        assert db.execute("SELECT x")["message"].startswith("Plan error")
    with pytest.raises(ConnectionError, match="was closed"):
        db.execute("SELECT 1")
    with pytest.raises(ConnectionError, match="Authentication failed"):
        Client(port=server.port, username="bob", password="no")
    with socket.create_connection(("127.0.0.1", server.port)) as raw:
        send(raw, "SELECT 1")
        assert "Expected auth message" in receive(raw)


def test_a_lost_connection_is_rolled_back(server, engine):
    engine.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    lost = Client(port=server.port, username="bob", password="pw")
    lost.execute("BEGIN")
    lost.execute("DELETE FROM t")
    lost._sock.close()
    assert engine.execute("INSERT INTO t VALUES (2)")["message"] == "1 row(s) inserted"
    assert engine.execute("SELECT a FROM t ORDER BY a")["rows"] == [[1], [2]]


def test_pool_and_crud_scenario(server):
    pool = ConnectionPool(port=server.port, min_size=1, max_size=2, wait=0.3, username="bob", password="pw")
    with pool.connection() as db:
        assert "created" in db.execute("CREATE TABLE loans (id INTEGER PRIMARY KEY, reader TEXT NOT NULL, note TEXT, back BOOLEAN NOT NULL)")["message"]
    with pool.connection() as db:
        assert "already exists" in db.execute("CREATE TABLE loans (id INTEGER PRIMARY KEY)")["message"]
        db.execute("BEGIN")
        db.execute("INSERT INTO loans (reader, back) VALUES ('O''Hara', FALSE)")
        (new,) = db.execute("SELECT id FROM loans ORDER BY id DESC LIMIT 1")["rows"]
        db.execute("COMMIT")
    with pool.connection() as db:
        db.execute(f"UPDATE loans SET back = TRUE, note = 'd' WHERE id = {new[0]}")
        assert db.execute("SELECT * FROM loans")["rows"] == [[1, "O'Hara", "d", True]]
        assert db.execute("DELETE FROM loans WHERE id = 1")["message"] == "1 row(s) deleted"
    with pool.connection(), pool.connection():
        with pytest.raises(TimeoutError):
            pool.acquire()
    with pool.connection() as db:
        db.execute("BEGIN")
    with pool.connection() as db:
        assert db.execute("BEGIN")["message"].startswith("BEGIN")
    pool.close()
    with pytest.raises(RuntimeError):
        pool.acquire()


def test_shell(engine):
    out = io.StringIO()
    Shell(engine, out).run([
        ".tables", "CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, age INTEGER);", "INSERT INTO users (name, age)", "VALUES ('Alice', 30), ('Bob', NULL);", "SELECT * FROM users ORDER BY id;", ".schema users", ".schema", ".indexes",
        ".schema gone", ".nothing", ".help", ".quit", "SELECT 1;",
    ])
    text = out.getvalue()
    assert "(no tables)" in text and "2 row(s) inserted" in text
    assert "+----+-------+------+\n| id | name  | age  |\n+----+-------+------+\n| 1  | Alice | 30   |\n| 2  | Bob   | NULL |\n+----+-------+------+\n2 row(s)" in text
    assert "Table: users" in text and "pk_users ON users UNIQUE (id)" in text and "Usage: .schema TABLE" in text
    assert "Error: Table 'gone' does not exist" in text and "Unknown command: .nothing  (try .help)" in text and not text.rstrip().endswith("| 1 |")


def test_boxed():
    assert boxed([], []) == ""
    assert boxed(["a"], []) == "+---+\n| a |\n+---+\n+---+"


def test_a_server_without_users(spark, tmp_path):
    with Engine(spark, str(tmp_path / "open")) as e:
        s = Server(e, port=0).start()
        try:
            with Client(port=s.port) as db:
                assert db.connected and db.execute("SELECT 1 AS a")["rows"] == [[1]]
            assert not db.connected
            with Client(port=s.port, username="any", password="one") as db:
                assert db.execute("SELECT 2 AS a")["rows"] == [[2]]
            with socket.create_connection(("127.0.0.1", s.port)) as raw:  # SQL from the first message on
                send(raw, "SELECT 3 AS a")
                assert '"rows": [[3]]' in receive(raw)
                send(raw, ".QUIT")
                assert "Goodbye" in receive(raw)
        finally:
            s.stop()


def test_results_larger_than_a_message(spark, tmp_path):
    with Engine(spark) as e:
        e.register("big", spark.range(60_000).selectExpr("id", "repeat('x', 400) AS v"))
        s = Server(e, port=0).start()
        try:
            with Client(port=s.port) as db:
                sizes = [len(p["rows"]) for p in db.parts("SELECT id, v FROM big ORDER BY id")]
                assert len(sizes) > 4 and sum(sizes) == 60_000
                got = db.execute("SELECT id, v FROM big ORDER BY id")
                assert [r[0] for r in got["rows"]] == list(range(60_000)) and got["message"] == "60000 row(s)"
            with socket.create_connection(("127.0.0.1", s.port)) as raw:  # a client that knows no parts
                send(raw, "SELECT id, v FROM big")
                assert "Message too large" in receive(raw)
        finally:
            s.stop()
        assert e.mine.execute("SELECT v FROM big", most_bytes=1000)["message"].startswith("Error: Message too large")
