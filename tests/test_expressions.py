"""Each operator on every pair of kinds, and random conditions against a Python evaluator of the same rules."""

import random

import pytest

from loomq.errors import PlanError
from loomq.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    rows = [
        (1, 0, 0.0, "", True), (2, 5, 1.5, "a_b", False), (3, None, None, None, None), (4, -3, -0.0, "a\\b", True), (5, 7, 2.0, "axb", False), (6, 1, 1.0, "x%y", True), (7, 2, 9.5, "line\nbreak", False), (8, 5, 5.0, "ABC", None),
    ]
    e.register("n", spark.createDataFrame(rows, "id bigint, a bigint, f double, s string, b boolean"))
    return e


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1 + 1", 2), ("2 * -3", -6), ("1 - -1", 2), ("7 / 2", 3.5), ("6 / 3", 2.0), ("1 / 0", None), ("1.5 / 0.0", None), ("'a' + 'b'", "ab"), ("'ab' * 2", "abab"), ("2 * 'ab'", "abab"), ("'ab' * -1", ""), ("'ab' * TRUE", "ab"),
        ("'a' + 1", None), ("'a' - 'b'", None), ("'a' * 1.5", None), ("TRUE + TRUE", 2), ("-TRUE", -1), ("1 = '1'", False), ("1 <> '1'", True), ("1 = TRUE", True), ("2 = TRUE", False), ("1 < 'a'", None), ("TRUE > FALSE", True),
        ("NULL = NULL", None), ("NULL IS NULL", True), ("NOT NULL", None), ("NULL AND FALSE", False), ("NULL OR TRUE", True), ("NULL AND TRUE", None), ("0 OR ''", False), ("'0' AND 1", True), ("NOT 0", True), ("NOT 'x'", False),
        ("3 IN (3, NULL)", True), ("3 IN (1, NULL)", None), ("3 NOT IN (1, NULL)", None), ("'1' IN (1)", False), ("1 IN (TRUE)", True), ("5 BETWEEN 10 AND NULL", None), ("5 NOT BETWEEN 10 AND NULL", None), ("5 BETWEEN 'a' AND 9", None),
        ("5 BETWEEN 5 AND 5", True), ("'ABC' LIKE 'abc'", False), ("5 LIKE '5%'", True), ("TRUE LIKE 'T%'", True), ("'a_b' LIKE 'a\\_b'", False), ("'a\\xb' LIKE 'a\\_b'", True), ("1.0 LIKE '1.0'", True), ("NULL LIKE '%'", None), ("1 + NULL", None),
    ],
)
def test_constants(engine, text, value):
    got = engine.sql(f"SELECT {text} AS x").first()[0]
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("text", ["-'a'", "unknown", "COUNT(1) + 1 IN (a)"])
def test_no_meaning(engine, text):
    with pytest.raises(PlanError):
        engine.sql(f"SELECT {text} FROM n WHERE {text}")


def ids(engine, where):
    return [r.id for r in engine.sql(f"SELECT id FROM n WHERE {where} ORDER BY id").collect()]


def test_like_has_no_escape_and_spans_lines(engine):
    assert ids(engine, "s LIKE 'a_b'") == [2, 4, 5]
    assert ids(engine, "s LIKE 'a\\b'") == [4]
    assert ids(engine, "s LIKE 'line%break'") == [7]
    assert ids(engine, "s LIKE s") == [1, 2, 4, 5, 6, 7, 8]
    assert ids(engine, "b LIKE 'True'") == [1, 4, 6]


def test_any_value_is_a_condition(engine):
    assert ids(engine, "a") == [2, 4, 5, 6, 7, 8]
    assert ids(engine, "NOT s") == [1]
    assert ids(engine, "f OR b") == [1, 2, 4, 5, 6, 7, 8]


def test_filters_reach_the_scan(engine, spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    engine.register("t", str(tmp_path / "t"))
    df = engine.sql("SELECT s FROM t WHERE id BETWEEN 2 AND 4 AND id IN (3, 4, 9)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2)" in plan and "In(id" in plan
    assert sorted(r.s for r in df.collect()) == ["3", "4"]


# an evaluator of the same rules on Python values, for random conditions


def value(x, row):
    kind = x[0]
    if kind == "col":
        return row[x[1]]
    if kind == "lit":
        return x[1]
    if kind == "not":
        v = value(x[1], row)
        return None if v is None else not v
    if kind == "null":
        return value(x[1], row) is None
    if kind in ("and", "or"):
        a, b = (None if v is None else bool(v) for v in (value(x[1], row), value(x[2], row)))
        stop = kind == "or"
        if a is stop or b is stop:
            return stop
        return None if a is None or b is None else not stop
    if kind == "between":
        v, lo, hi = (value(y, row) for y in x[1:])
        if v is None or lo is None or hi is None or len({isinstance(y, str) for y in (v, lo, hi)}) > 1:
            return None
        return lo <= v <= hi
    if kind == "in":
        v, items = value(x[1], row), [value(y, row) for y in x[2]]
        if v is None:
            return None
        if any(i is not None and isinstance(i, str) == isinstance(v, str) and i == v for i in items):
            return True
        return None if None in items else False
    a, b = value(x[1], row), value(x[2], row)
    if a is None or b is None:
        return None
    mixed = isinstance(a, str) != isinstance(b, str)
    if kind in ("+", "-", "*", "/"):
        if isinstance(a, str) or isinstance(b, str):
            return None
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b if b else None}[kind]()
    if mixed:
        return {"=": False, "<>": True}.get(kind)
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[kind]


def text(x):
    kind = x[0]
    if kind == "col":
        return x[1]
    if kind == "lit":
        return "NULL" if x[1] is None else repr(x[1]).upper() if isinstance(x[1], bool) else repr(x[1]) if not isinstance(x[1], str) else "'" + x[1].replace("'", "''") + "'"
    if kind == "not":
        return f"(NOT {text(x[1])})"
    if kind == "null":
        return f"({text(x[1])} IS NULL)"
    if kind == "between":
        return f"({text(x[1])} BETWEEN {text(x[2])} AND {text(x[3])})"
    if kind == "in":
        return f"({text(x[1])} IN ({', '.join(map(text, x[2]))}))"
    return f"({text(x[1])} {kind.upper()} {text(x[2])})"


def random_value(r, depth):
    if depth == 0 or r.random() < 0.5:
        return r.choice([("col", "a"), ("col", "f"), ("col", "s"), ("col", "b"), ("lit", r.randrange(-3, 8)), ("lit", 1.5), ("lit", "axb"), ("lit", ""), ("lit", None), ("lit", True)])
    numeric = lambda: r.choice([("col", "a"), ("col", "f"), ("lit", r.randrange(-2, 4))])
    return (r.choice("+-*/"), numeric(), numeric())


def random_condition(r, depth):
    kind = r.choice(["and", "or", "not", "null", "between", "in", "=", "<>", "<", ">", "<=", ">="] if depth else ["=", "<>", "<", "null"])
    if kind in ("and", "or"):
        return (kind, random_condition(r, depth - 1), random_condition(r, depth - 1))
    if kind == "not":
        return (kind, random_condition(r, depth - 1))
    if kind == "null":
        return (kind, random_value(r, 1))
    if kind == "between":
        return (kind, *(random_value(r, 1) for _ in range(3)))
    if kind == "in":
        return (kind, random_value(r, 1), [random_value(r, 0) for _ in range(r.randrange(1, 4))])
    return (kind, random_value(r, 1), random_value(r, 1))


def test_random_conditions(engine):
    r = random.Random(11)
    trees = [random_condition(r, 3) for _ in range(120)]
    items = ", ".join(f"{text(t)} AS c{k}" for k, t in enumerate(trees))
    rows = engine.sql("SELECT * FROM n ORDER BY id").collect()
    for row, got in zip(rows, engine.sql(f"SELECT {items} FROM n ORDER BY id").collect(), strict=True):
        for k, t in enumerate(trees):
            want = value(t, row.asDict())
            assert got[k] == want, (text(t), row)
