import pytest

from loomq.errors import LoomError, PlanError
from loomq.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("l", spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k bigint, v string"))
    e.register("r", spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (1, "w")], "k bigint, v string"))
    e.register("empty", spark.createDataFrame([], "id bigint, x double"))
    return e


def rows(engine, sql):
    return sorted((tuple(r) for r in engine.sql(sql).collect()), key=str)


def test_outer_joins_pad_and_null_keys_never_match(engine):
    inner = [("a", "w"), ("a", "x"), ("b", "w"), ("b", "x")]
    assert rows(engine, "SELECT l.v, r.v FROM l JOIN r ON l.k = r.k") == inner
    assert rows(engine, "SELECT l.v, r.v FROM l LEFT JOIN r ON l.k = r.k") == [*inner, ("c", None), ("d", None)]
    assert rows(engine, "SELECT l.v, r.v FROM l RIGHT JOIN r ON l.k = r.k") == sorted([*inner, (None, "y"), (None, "z")], key=str)
    assert len(rows(engine, "SELECT * FROM l FULL JOIN r ON l.k = r.k")) == 8
    assert len(rows(engine, "SELECT * FROM l CROSS JOIN r")) == 16
    assert len(rows(engine, "SELECT * FROM l LEFT JOIN empty")) == 4


def test_names(engine):
    assert rows(engine, "SELECT v FROM l JOIN r ON l.k = r.k")[0] == ("a",)  # leftmost wins
    assert rows(engine, "SELECT wrong.v FROM l WHERE L.K = 2") == [("c",)]  # a qualifier that fits nothing is dropped
    assert rows(engine, "SELECT a.v, b.v FROM l a JOIN l b ON a.k = b.k AND a.v < b.v") == [("a", "b")]
    with pytest.raises(PlanError):
        engine.sql("SELECT nothing FROM l")
    with pytest.raises(LoomError, match="Table 'gone' does not exist"):
        engine.sql("SELECT 1 FROM gone")


def test_output_names(engine):
    assert engine.sql("SELECT V, k + 1, COUNT(*), COUNT(k), SUM(k + 1), AVG(DISTINCT k) AS m FROM l GROUP BY V, k").columns == ["V", "?", "COUNT(*)", "COUNT(k)", "SUM(?)", "m"]
    assert engine.sql("SELECT * FROM l JOIN r ON l.k = r.k").columns == ["k", "v", "k", "v"]


def test_aggregates_on_nothing(engine):
    assert rows(engine, "SELECT COUNT(*), COUNT(x), SUM(x), AVG(x), MIN(x), MAX(id) FROM empty") == [(0, 0, None, None, None, None)]
    assert rows(engine, "SELECT id, COUNT(*) FROM empty GROUP BY id") == []


def test_nulls_group_and_having_uses_hidden_aggregates(engine):
    assert rows(engine, "SELECT k, COUNT(*) FROM l GROUP BY k") == [(1, 2), (2, 1), (None, 1)]
    assert rows(engine, "SELECT k FROM l GROUP BY k HAVING MAX(v) > 'b' AND COUNT(DISTINCT v) = 1") == [(2,), (None,)]
    assert rows(engine, "SELECT SUM(k) / COUNT(k) + 1 FROM l HAVING COUNT(*) > 3") == [(4 / 3 + 1,)]
    with pytest.raises(PlanError, match="must be grouped"):
        engine.sql("SELECT v FROM l GROUP BY k")
    with pytest.raises(PlanError):
        engine.sql("SELECT SUM(v) FROM l")


def test_order_puts_nulls_low_and_pages(engine):
    ordered = lambda tail: [tuple(r) for r in engine.sql(f"SELECT k, v FROM l ORDER BY {tail}").collect()]
    assert [k for k, _ in ordered("k, v")] == [None, 1, 1, 2]
    assert ordered("k DESC, v DESC") == [(2, "c"), (1, "b"), (1, "a"), (None, "d")]
    assert ordered("2 DESC LIMIT 2 OFFSET 1") == [(2, "c"), (1, "b")]
    assert ordered("v LIMIT 0") == [] and ordered("v LIMIT -1") == []
    assert [r.v for r in engine.sql("SELECT v FROM l ORDER BY -k, v DESC").collect()] == ["d", "c", "b", "a"]
    assert [r.k for r in engine.sql("SELECT DISTINCT k FROM l ORDER BY k DESC OFFSET 1").collect()] == [1, None]
    with pytest.raises(PlanError):
        engine.sql("SELECT DISTINCT k FROM l ORDER BY v")


def test_sort_of_many_rows_with_ties_and_nulls(spark):
    e = Engine(spark)
    e.register("big", spark.range(25_000).selectExpr("id", "if(id % 7 = 0, null, id % 100) AS x"))
    got = [tuple(r) for r in e.sql("SELECT x, id FROM big ORDER BY x DESC, id").collect()]
    want = sorted(((None if i % 7 == 0 else i % 100, i) for i in range(25_000)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == want


def test_plans(engine, spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 10 AS g", "cast(id AS double) AS unused").write.parquet(str(tmp_path / "p"))
    engine.register("p", str(tmp_path / "p"))
    plan = lambda sql: engine.sql(sql)._jdf.queryExecution().executedPlan().toString()
    top = plan("SELECT g FROM p ORDER BY id DESC LIMIT 3")
    assert "TakeOrderedAndProject" in top and "unused" not in top
    grouped = plan("SELECT g, SUM(id) FROM p WHERE id > 5 GROUP BY g")
    assert "partial_sum" in grouped and "GreaterThan(id,5)" in grouped and "unused" not in grouped


def test_explain(engine):
    text = engine.sql("EXPLAIN SELECT l.v, COUNT(*) FROM l JOIN r ON l.k = r.k WHERE l.v > 'a' GROUP BY l.v ORDER BY l.v LIMIT 3").first().plan
    assert text.split("\n\n")[0].split("\n") == [
        "Limit(3 offset=0)", "  Sort", "    Projection", "      Aggregate", "        Filter((l.v > 'a'))", "          Join(INNER)", "            SeqScan(l) [est_rows=0, cost=1]", "            SeqScan(r) [est_rows=0, cost=1]",
    ]
    assert "Spark plan" in text


def test_streams(spark, tmp_path):
    from loomq.streaming import start

    spark.range(20).selectExpr("id % 3 AS k").write.parquet(str(tmp_path / "in"))
    e = Engine(spark)
    e.register("s", spark.readStream.schema("k bigint").parquet(str(tmp_path / "in")))
    start(e, "SELECT k, COUNT(*) AS n FROM s WHERE k > 0 GROUP BY k", "counts", str(tmp_path / "c")).awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == [(1, 7), (2, 6)]


def test_inner_chains_begin_with_the_smallest_filtered_table(spark, tmp_path):
    e = Engine(spark)
    spark.range(20_000).selectExpr("id AS f", "id % 50 AS d", "repeat('x', 20) AS pad").write.parquet(str(tmp_path / "fact"))
    spark.range(50).selectExpr("id AS d", "id % 5 AS r").write.parquet(str(tmp_path / "dim"))
    spark.range(5).selectExpr("id AS r", "concat('r', id) AS name").write.parquet(str(tmp_path / "region"))
    for t in ("fact", "dim", "region"):
        e.register(t, str(tmp_path / t))
    df = e.sql("SELECT * FROM fact JOIN dim ON fact.d = dim.d JOIN region ON dim.r = region.r AND fact.f < 100 WHERE region.name = 'r3'")
    assert df.columns == ["f", "d", "pad", "d", "r", "r", "name"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Relation [r#") < plan.index("Relation [f#")
    assert sorted(r[0] for r in df.collect()) == [i for i in range(100) if i % 50 % 5 == 3]
    assert e.sql("SELECT a.r FROM region a JOIN region b JOIN region c ON a.r < b.r AND b.r < c.r").count() == 10
    assert e.sql("SELECT a.r FROM region a CROSS JOIN region b JOIN region c ON c.r = a.r + b.r AND 1 = 1").count() == 15


def test_distinct_average_shares_the_argument(engine):
    df = engine.sql("SELECT COUNT(DISTINCT k) AS n, AVG(DISTINCT k) AS a, SUM(DISTINCT k) AS s FROM l")
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString() and rows(engine, "SELECT COUNT(DISTINCT k) AS n, AVG(DISTINCT k) AS a, SUM(DISTINCT k) AS s FROM l") == [(2, 1.5, 3)]
