import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loomq.llm import source_mix as m


def test_thresholds_are_poisson():
    for mean in (0.01, 1.0, 7.5, 32.0):
        t = m.thresholds(mean)
        assert t == sorted(t) and t[-1] == pytest.approx(1.0, abs=1e-14)
        assert t[3] - t[2] == pytest.approx(math.exp(-mean) * mean**3 / 6)


def test_counts_are_drawn_by_inversion(spark):
    df = spark.range(4000)
    got = {r.id: r.n for r in df.select("id", m.poisson(2.5, "s", F.col("id")).alias("n")).collect()}
    t = m.thresholds(2.5)
    for i, n in list(got.items())[:500]:
        u = int(hashlib.md5(f"s|0|{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert n == sum(x <= u for x in t)
    assert sum(got.values()) / 4000 == pytest.approx(2.5, abs=0.1)
    big = [r.n for r in df.select(m.poisson(500.0, "s", F.col("id")).alias("n")).collect()]
    assert sum(big) / 4000 == pytest.approx(500, abs=2)
    var = sum((n - 500) ** 2 for n in big) / 4000
    assert var == pytest.approx(500, rel=0.1)


def test_shares(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 9 < 6 THEN 'big' WHEN id % 9 < 8 THEN 'mid' ELSE 'small' END AS source", "'x' AS text")
    got = m.mixed(df, {"big": 1, "mid": 1, "small": 2, "absent": 5}, partitions=4)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    total = sum(n.values())
    assert total == pytest.approx(9000, rel=0.05) and n["small"] / total == pytest.approx(0.5, abs=0.03) and n["big"] / total == pytest.approx(0.25, abs=0.03)
    again = m.mixed(df.repartition(7), {"big": 1, "mid": 1, "small": 2, "absent": 5}, partitions=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    order = [r.doc_id for r in got.collect()]
    assert order != sorted(order)


def test_odd_rows(odd, none):
    got = m.mixed(odd, {"a": 1.0, "b": 3.0, "zz": 1.0}, others=1.0, total=200)
    assert got.columns == [*odd.columns, "copy_"]
    rows = got.collect()
    assert {r.source for r in rows} <= {"a", "b", "c", "", None}
    same = [r.copy_ for r in rows if r.doc_id == 5 and r.text == "one"]
    assert same and same.count(1) == 2  # rows of one id and source get one count
    assert m.mixed(none, {"a": 1.0}).count() == 0 and m.mixed(odd, {}).count() == 0
    with pytest.raises(ValueError, match="weights"):
        m.mixed(odd, {"a": -1.0})


def test_production_rate_of_unlisted_sources(spark, tmp_path):
    import corpus_pipeline
    from loomq.llm import queries

    df = spark.range(9000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "CASE id % 3 WHEN 0 THEN 'src1' WHEN 1 THEN 'books' END AS source", "1 AS n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op6_source_mix(spark, str(tmp_path)), corpus_pipeline.mix(spark, df, str(tmp_path))):
        n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
        assert n.keys() == {"src1", "books", None} and all(x == pytest.approx(3000, rel=0.08) for x in n.values())


def test_thresholds_of_any_mean():
    for mean in (0.0, 300.5, 8_000.0, 1e5):
        first, steps = m.bounded_thresholds(mean)
        assert steps == sorted(steps) and steps[-1] == pytest.approx(1.0, abs=1e-11) and steps[0] < 1e-15 or not mean
        assert len(steps) < 20 * math.sqrt(mean) + 40
    first, steps = m.bounded_thresholds(1e5)
    assert steps[100_000 - first] == pytest.approx(0.5 + 2 / (3 * math.sqrt(2 * math.pi * 1e5)), abs=1e-6)  # Poisson's median


def test_very_large_rates_and_the_sql_at_such_means(spark):
    import duckdb

    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (3, "z", "b"), (None, "w", "b")], "doc_id bigint, text string, source string")
    got = m.mixed(df, {"a": 100_000.0, "b": 300.0}, total=100_300)
    n = {(r.doc_id, r.source): r["count"] for r in got.groupBy("doc_id", "source").count().collect()}
    assert abs(n[1, "a"] - 100_000) < 6 * math.sqrt(1e5) and all(abs(x - 100) < 60 for (i, s), x in n.items() if s == "b")
    docs = df.toPandas().convert_dtypes()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", docs)
    for weights in ({"a": 3.0, "b": 1.0}, {"a": 1.0, "b": 999.0}):
        sql = con.execute(m.oracle(weights, columns="doc_id, text, source")).fetchall()
        assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in m.mixed(df, weights).select("doc_id", "text", "source", "copy").collect())


def test_rows_without_doc_id_are_dealt_like_others(spark):
    df = spark.range(20_000).selectExpr("cast(null AS bigint) AS doc_id", "concat('text ', id) AS text", "'a' AS source")
    got = m.mixed(df, {"a": 1.0}, partitions=8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)
    counts = {r["count"] for r in got.groupBy("text").count().collect()}
    assert len(counts) > 3  # texts draw for themselves
    same = spark.range(8000).selectExpr("7 AS doc_id", "concat('t', id) AS text", "'a' AS source")
    sizes = [r["count"] for r in m.mixed(same, {"a": 1.0}, total=24_000, partitions=8).groupBy(F.spark_partition_id()).count().collect()]
    assert not sizes or len(sizes) == 8
