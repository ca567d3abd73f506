import threading

import pytest

from loomq.errors import ExecutionError, LoomError
from loomq.session import Engine


@pytest.fixture
def engine(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db"), lock_timeout=0.5) as e:
        yield e


@pytest.fixture
def users(engine):
    engine.script("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, age INTEGER); INSERT INTO users (name, age) VALUES ('Alice', 30), ('Bob', 25)")
    return engine


def rows(engine, sql):
    r = engine.execute(sql)
    assert r["columns"], r["message"]
    return r["rows"]


def message(engine, sql):
    return engine.execute(sql)["message"]


def test_quick_start(users):
    assert users.execute("SELECT * FROM users WHERE age > 26") == {"columns": ["id", "name", "age"], "rows": [[1, "Alice", 30]], "message": "1 row(s)"}
    assert message(users, "INSERT INTO users (name) VALUES ('C')") == "1 row(s) inserted"
    assert rows(users, "SELECT id FROM users WHERE name = 'C'") == [[3]]


def test_numbers_go_on_from_given_ones_and_are_not_given_twice(users):
    message(users, "INSERT INTO users VALUES (10, 'x', 1)")
    message(users, "INSERT INTO users (name) VALUES ('y')")
    message(users, "BEGIN")
    message(users, "INSERT INTO users (name) VALUES ('gone')")
    assert message(users, "ROLLBACK") == "ROLLBACK"
    message(users, "INSERT INTO users (name) VALUES ('z')")
    assert rows(users, "SELECT id, name FROM users WHERE id > 9 ORDER BY id") == [[10, "x"], [11, "y"], [13, "z"]]


def test_keys_and_nulls(users):
    assert message(users, "INSERT INTO users VALUES (1, 'again', 0)") == "Execution error: Duplicate key (1) violates unique index 'pk_users'"
    assert message(users, "INSERT INTO users VALUES (7, 'a', 0), (7, 'b', 0)") == "Execution error: Duplicate key (7) violates unique index 'pk_users'"
    message(users, "CREATE TABLE todos (id INTEGER PRIMARY KEY, title TEXT NOT NULL, done BOOLEAN NOT NULL)")
    assert message(users, "INSERT INTO todos (done) VALUES (FALSE)") == "Execution error: NULL value in column 'title' violates NOT NULL"
    assert message(users, "UPDATE users SET id = NULL WHERE id = 1") == "Execution error: NULL value in column 'id' violates NOT NULL"
    assert message(users, "UPDATE users SET id = 2 WHERE id = 1") == "Execution error: Duplicate key (2) violates unique index 'pk_users'"
    assert message(users, "UPDATE users SET id = id + 1") == "2 row(s) updated"
    assert len(rows(users, "SELECT * FROM users")) == 2


def test_composite_key_and_unique_index(engine):
    engine.script("CREATE TABLE c (a INTEGER PRIMARY KEY, b TEXT PRIMARY KEY, e TEXT)")
    assert message(engine, "INSERT INTO c VALUES (1, 'x', NULL), (1, 'y', NULL)") == "2 row(s) inserted"
    assert message(engine, "INSERT INTO c VALUES (1, 'x', 'q')") == "Execution error: Duplicate key (1, 'x') violates unique index 'pk_c'"
    assert message(engine, "INSERT INTO c (a) VALUES (2)") == "Execution error: NULL value in column 'b' violates NOT NULL"
    assert message(engine, "CREATE UNIQUE INDEX ue ON c (e)") == "Index 'ue' created on c(e)"  # nulls never conflict
    message(engine, "INSERT INTO c VALUES (3, 'z', 'one')")
    assert message(engine, "INSERT INTO c VALUES (4, 'z', 'one')") == "Execution error: Duplicate key ('one') violates unique index 'ue'"
    assert message(engine, "CREATE UNIQUE INDEX ua ON c (a)") == "Execution error: Cannot create unique index 'ua': duplicate key (1)"
    assert message(engine, "CREATE INDEX ue ON c (a)") == "Error: Index 'ue' already exists"


def test_values_are_coerced_on_write(engine):
    engine.execute("CREATE TABLE m (i INT, f REAL, t VARCHAR(5), b BOOL)")
    assert message(engine, "INSERT INTO m VALUES (1.9, 2, 5, 'false'), ('12', '1.5', TRUE, 0)") == "2 row(s) inserted"
    assert rows(engine, "SELECT * FROM m ORDER BY i") == [[1, 2.0, "5", True], [12, 1.5, "True", False]]
    assert message(engine, "INSERT INTO m (i) VALUES ('abc')").startswith("Error: ")
    assert message(engine, "INSERT INTO m (i) VALUES (9223372036854775807 * 1.0)").startswith("Error: ")
    assert message(engine, "INSERT INTO m (i, f) VALUES (1)").startswith("Error: ")
    assert message(engine, "INSERT INTO m (i) VALUES (1, 2, 3)") == "1 row(s) inserted"  # more than asked for is left out
    assert message(engine, "UPDATE m SET i = f * 2, t = b, b = t WHERE f = 1.5") == "1 row(s) updated"
    assert rows(engine, "SELECT i, t, b FROM m WHERE f = 1.5") == [[3, "False", True]]
    assert message(engine, "CREATE TABLE d (x DECIMAL)") == "Error: Unknown column type: DECIMAL"
    assert message(engine, "CREATE TABLE M (x INT)") == "Error: Table 'M' already exists"


def test_update_sees_old_rows_and_null_conditions_keep_rows(engine):
    engine.script("CREATE TABLE t (a INTEGER, b INTEGER); INSERT INTO t VALUES (1, 2), (3, NULL), (5, 6)")
    assert message(engine, "UPDATE t SET a = b, b = a") == "3 row(s) updated"
    assert rows(engine, "SELECT a, b FROM t ORDER BY b") == [[2, 1], [None, 3], [6, 5]]
    assert message(engine, "DELETE FROM t WHERE a > 5") == "1 row(s) deleted"
    assert rows(engine, "SELECT a FROM t ORDER BY a") == [[None], [2]]
    assert message(engine, "DELETE FROM t") == "2 row(s) deleted"
    assert rows(engine, "SELECT COUNT(*), SUM(a) FROM t") == [[0, None]]


def test_only_files_with_matching_rows_are_written_anew(users):
    message(users, "INSERT INTO users VALUES (100, 'far', 1)")
    before = set(users.store.get("users").files)
    message(users, "UPDATE users SET age = 2 WHERE id = 100")
    after = set(users.store.get("users").files)
    assert len(before & after) == len(before) - 1
    message(users, "DELETE FROM users WHERE id = 999")
    assert set(users.store.get("users").files) == after


def test_transactions(users):
    assert message(users, "BEGIN").startswith("BEGIN (txn ")
    assert message(users, "BEGIN") == "Execution error: A transaction is already in progress"
    message(users, "DELETE FROM users WHERE id = 1")
    other = users.session()
    assert len(other.execute("SELECT * FROM users")["rows"]) == 2
    assert other.execute("DELETE FROM users")["message"] == "Execution error: Lock timeout on table 'users' (possible deadlock)"
    assert message(users, "INSERT INTO users VALUES (2, 'dup', 0)").startswith("Execution error: Duplicate key")
    assert len(rows(users, "SELECT * FROM users")) == 1  # a failed statement leaves the transaction as it was
    assert message(users, "COMMIT") == "COMMIT"
    assert other.execute("SELECT name FROM users")["rows"] == [["Bob"]]
    assert message(users, "COMMIT") == "COMMIT"


def test_a_reader_in_a_transaction_holds_writers_off(users):
    other = users.session()
    other.execute("BEGIN")
    other.execute("SELECT * FROM users")
    assert "Lock timeout" in message(users, "DELETE FROM users")
    done = threading.Timer(0.2, lambda: other.execute("COMMIT"))
    done.start()
    assert message(users, "DELETE FROM users") == "2 row(s) deleted"


def test_close_rolls_back_and_a_new_engine_sees_what_was_committed(spark, users, tmp_path):
    message(users, "BEGIN")
    message(users, "DELETE FROM users")
    users.close()
    again = Engine(spark, str(tmp_path / "db"))
    assert len(rows(again, "SELECT * FROM users")) == 2
    assert message(again, "INSERT INTO users (name) VALUES ('new')") == "1 row(s) inserted"
    assert max(rows(again, "SELECT id FROM users")) == [3]
    assert again.store.collect_garbage() > 0
    assert len(rows(again, "SELECT * FROM users")) == 3


def test_first_committer_wins_between_engines(spark, users, tmp_path):
    other = Engine(spark, str(tmp_path / "db"))
    message(users, "BEGIN")
    message(users, "DELETE FROM users WHERE id = 1")
    assert message(other, "DELETE FROM users WHERE id = 2") == "1 row(s) deleted"
    assert message(users, "COMMIT") == "Execution error: Table 'users' was changed by another session"
    assert rows(users, "SELECT id FROM users") == [[1]]


def test_tables_come_and_go(users):
    assert message(users, "DROP TABLE users") == "Table 'users' dropped"
    assert message(users, "SELECT * FROM users") == "Error: Table 'users' does not exist"
    assert message(users, "DROP TABLE users").startswith("Error: ")
    assert message(users, "CREATE TABLE users (x INT)") == "Table 'users' created"
    assert rows(users, "SELECT * FROM users") == []
    assert message(users, "CREATE TABLE twice (a INT, A INT)").startswith("Execution error")


def test_analyze_and_index_choice(users):
    users.script("INSERT INTO users (name, age) VALUES ('c', 25); INSERT INTO users (name) VALUES ('d'); INSERT INTO users (name) VALUES ('e'); INSERT INTO users (name) VALUES ('f'); INSERT INTO users (name) VALUES ('g')")
    assert message(users, "ANALYZE users") == "ANALYZE users: row_count=7, page_count=6, age.ndv=2, id.ndv=7, name.ndv=7"
    plan = rows(users, "EXPLAIN SELECT * FROM users WHERE id = 1 AND age > 2")[0][0]
    assert plan.startswith("IndexScan(users using pk_users) [est_rows=1, cost=4]")
    assert rows(users, "EXPLAIN SELECT name FROM users WHERE age = 25")[0][0].startswith("Projection\n  SeqScan(users filter=(age = 25)) [est_rows=7, cost=6]")


def test_tables_from_frames(engine, spark):
    engine.create_table_as("f", spark.range(5).selectExpr("id", "cast(id AS string) AS s"), ("id",))
    assert message(engine, "INSERT INTO f (s) VALUES ('next')") == "1 row(s) inserted"
    assert rows(engine, "SELECT id FROM f WHERE s = 'next'") == [[5]]
    with pytest.raises(ExecutionError, match="Duplicate key"):
        engine.create_table_as("g", spark.createDataFrame([(1,), (1,)], "id bigint"), ("id",))
    with pytest.raises(LoomError):
        engine.create_table_as("h", spark.sql("SELECT array(1) AS x"))
    engine.register("view", spark.range(3))
    assert message(engine, "DELETE FROM view") == "Execution error: Table 'view' is read-only"
    assert message(engine, "ANALYZE view") == "ANALYZE view: row_count=3, page_count=0, id.ndv=3"


@pytest.mark.parametrize("root", ["x/tables/db", "with blank/db", "100%25/a%20b", "tables/tables"])
def test_changes_reach_files_under_any_root(spark, tmp_path, root):
    with Engine(spark, str(tmp_path / root)) as e:
        e.script("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'); INSERT INTO t VALUES (3, 'c')")
        assert message(e, "DELETE FROM t WHERE id = 2") == "1 row(s) deleted"
        assert message(e, "UPDATE t SET v = 'z' WHERE v = 'c'") == "1 row(s) updated"
        assert rows(e, "SELECT id, v FROM t ORDER BY id") == [[1, "a"], [3, "z"]] and e.store.get("t").rows == 2
        assert len(e.store.get("t").files) == 2


def test_create_table_as_is_all_or_nothing(spark, engine):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k bigint, v string")
    with pytest.raises(ExecutionError, match="Duplicate key"):
        engine.create_table_as("t", df, ("k",))
    assert engine.tables() == []
    engine.create_table_as("t", df.where("v = 'a'"), ("k",))
    assert message(engine, "INSERT INTO t (v) VALUES ('next')") == "1 row(s) inserted" and rows(engine, "SELECT k FROM t ORDER BY k") == [[1], [2]]
    with pytest.raises(LoomError, match="already exists"):
        engine.create_table_as("T", df)


def test_the_log_entry_is_exclusive(engine):
    import threading

    made = []

    def make(k):
        made.append(engine.store.folder.create("_log/x.json", {"k": k}))

    workers = [threading.Thread(target=make, args=(k,)) for k in range(8)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert sorted(made) == [False] * 7 + [True]


@pytest.fixture
def ranged(spark, tmp_path):
    with Engine(spark, str(tmp_path / "ranged")) as e:
        e.create_table_as("t", spark.range(1000).selectExpr("id", "id % 7 AS g", "concat('n', lpad(id, 4, '0')) AS name", "cast(id AS double) / 2 AS f"), ("id",), files=10)
        yield e


def opened(engine, sql):
    return engine.execute(f"EXPLAIN {sql}")["rows"][0][0].split("Files opened\n")[1].split("\n\n")[0].strip()


def test_scans_skip_files_by_the_key(ranged):
    assert opened(ranged, "SELECT g FROM t WHERE id = 421") == "t: 1 of 10" and rows(ranged, "SELECT g FROM t WHERE id = 421") == [[1]]
    assert opened(ranged, "SELECT g FROM t WHERE 990 <= id AND g > 2") == "t: 1 of 10"
    assert opened(ranged, "SELECT g FROM t WHERE id IN (5, 7, NULL)") == "t: 1 of 10" and rows(ranged, "SELECT COUNT(*) FROM t WHERE id IN (5, 7, NULL)") == [[2]]
    assert opened(ranged, "SELECT g FROM t WHERE id BETWEEN -5 AND 1.5") == "t: 1 of 10" and rows(ranged, "SELECT COUNT(*) FROM t WHERE id BETWEEN -5 AND 1.5") == [[2]]
    for whole in ("g = 3", "id = 'x'", "id = 1 OR g = 2", "NOT (id = 1)", "id + 0 = 1", "id = g"):
        assert opened(ranged, f"SELECT g FROM t WHERE {whole}") == "t: 10 of 10", whole
    assert opened(ranged, "SELECT g FROM t WHERE id > 5000") == "t: 0 of 10" and rows(ranged, "SELECT COUNT(*) FROM t WHERE id > 5000") == [[0]]
    assert opened(ranged, "SELECT a.g FROM t a LEFT JOIN t b ON a.id = b.g WHERE b.id < 3 AND id > 990") == "t: 1 of 10\n  t: 1 of 10"
    want = [(a, b) for a in range(991, 1000) for b in range(3) if a == b % 7]
    assert len(rows(ranged, "SELECT a.g FROM t a LEFT JOIN t b ON a.id = b.g WHERE b.id < 3 AND id > 990") if want else []) == len(want)
    ranged.execute("CREATE INDEX names ON t (name)")
    assert opened(ranged, "SELECT g FROM t WHERE name >= 'n0950'") == "t: 1 of 10"


def test_changes_open_only_files_that_may_match(ranged):
    before = set(ranged.store.get("t").files)
    assert message(ranged, "UPDATE t SET f = 0 WHERE id = 421") == "1 row(s) updated"
    assert len(before & set(ranged.store.get("t").files)) == 9
    assert message(ranged, "DELETE FROM t WHERE id > 5000") == "0 row(s) deleted"
    assert message(ranged, "UPDATE t SET id = 3 WHERE id = 421").startswith("Execution error: Duplicate key (3)")
    assert message(ranged, "UPDATE t SET id = id + 1 WHERE id >= 990") == "10 row(s) updated"
    assert message(ranged, "INSERT INTO t (id) VALUES (990)") == "1 row(s) inserted" and message(ranged, "INSERT INTO t (id) VALUES (1000)").startswith("Execution error: Duplicate")
    assert rows(ranged, "SELECT COUNT(*), MIN(id), MAX(id) FROM t") == [[1001, 0, 1000]]


def test_small_files_are_merged_and_tables_compacted(spark, tmp_path, monkeypatch):
    from loomq.sources import store

    monkeypatch.setattr(store, "MANY", 5)
    with Engine(spark, str(tmp_path / "db")) as e:
        e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
        for k in range(12):
            e.execute(f"INSERT INTO t (v) VALUES ('{k}')")
            assert len(e.store.get("t").files) < 5
        assert rows(e, "SELECT COUNT(*), COUNT(DISTINCT v), MAX(id) FROM t") == [[12, 12, 12]]
        e.create_table_as("u", spark.range(100, 0, -1).selectExpr("id", "id AS w"), files=6)
        e.execute("CREATE INDEX iu ON u (id)")
        m = e.store.compacted(e.store.get("u"), file_bytes=2000)
        bounds = sorted(x["of"]["id"] for x in m.facts.values())
        assert len(bounds) > 2 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))  # by ranges of the index
        e.compact("u")
        assert len(e.store.get("u").files) == 1 and rows(e, "SELECT COUNT(*), SUM(w) FROM u WHERE id > 50") == [[50, 3775]]


def test_old_manifests_without_facts_are_read_whole(ranged):
    from dataclasses import replace

    from loomq.plans.limits import limits
    from loomq.plans.grammar import parse

    m = replace(ranged.store.get("t"), facts={})
    assert ranged.store.pruned(m, limits(parse("SELECT 1 FROM t WHERE id = 5").where)) == m.files
