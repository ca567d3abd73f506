"""The dialect's operators as queries over the star schema: name -> SQL, and the DuckDB SQL of the same result.

Where the dialect's text means the same to DuckDB, it is the oracle too. Sums of doubles are compared by the driver with
a tolerance or rounded; whole numbers that DuckDB widens are cast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import Engine
from .sources.scratch import shared_folder

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: name -> (dialect, DuckDB or None if it is the same)
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT c_custkey, c_name, c_acctbal FROM customer", None),
    "scan_star": ("SELECT * FROM nation", None),
    "star_and_more": ("SELECT *, r_regionkey * 2 AS twice FROM region", "SELECT *, CAST(r_regionkey AS BIGINT) * 2 AS twice FROM region"),
    "qualified_star": ("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", None),
    "filter_and_or_not": ("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE (c_acctbal > 5000 OR c_nationkey = 3) AND NOT (c_mktsegment = 'HOUSEHOLD')", None),
    "filter_between": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", None),
    "filter_not_between": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 50000", None),
    "filter_in": ("SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')", None),
    "filter_not_in": ("SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 2, 3)", None),
    "filter_like": ("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name LIKE '%ring' OR p_brand LIKE 'Brand#_'", None),
    "filter_not_like": ("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%'", None),
    "filter_is_null": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NOT NULL AND NOT (c_name IS NULL)", None),
    "filter_truthy_number": ("SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount AND l_tax", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0"),
    "filter_text_number": ("SELECT c_custkey FROM customer WHERE c_custkey <> '1'", "SELECT c_custkey FROM customer"),
    "filter_date_text": ("SELECT o_orderkey FROM orders WHERE o_orderdate < '1995-06-17'", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-17'"),
    "point_lookup": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42", None),
    "prefix_composite_lookup": ("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 42 AND l_quantity > 0", None),
    "range_scan": ("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 300 ORDER BY o_orderkey", None),
    "arith": ("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS minus, l_quantity / 4 AS quarter, l_linenumber + 1 AS following FROM lineitem", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS minus, l_quantity / 4 AS quarter, CAST(l_linenumber AS BIGINT) + 1 AS following FROM lineitem"),
    "div_zero": ("SELECT l_orderkey, l_quantity / l_discount AS q FROM lineitem", "SELECT l_orderkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS q FROM lineitem"),
    "text_operators": ("SELECT c_custkey, c_name + '/' + c_mktsegment AS joined, c_mktsegment * 2 AS twice FROM customer", "SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, repeat(c_mktsegment, 2) AS twice FROM customer"),
    "const_select": ("SELECT 1 + 1 AS a, 7 / 2 AS b, 'x' AS c, TRUE AND FALSE AS d", "SELECT CAST(1 + 1 AS BIGINT) AS a, 7 / 2 AS b, 'x' AS c, TRUE AND FALSE AS d"),
    "null_logic": ("SELECT NULL = NULL AS a, NULL AND FALSE AS b, NULL OR TRUE AS c, 3 NOT IN (1, NULL) AS d, 5 BETWEEN 10 AND NULL AS e, 1 / 0 AS f", "SELECT CAST(NULL AS BOOLEAN) AS a, FALSE AS b, TRUE AS c, CAST(NULL AS BOOLEAN) AS d, CAST(NULL AS BOOLEAN) AS e, CAST(NULL AS DOUBLE) AS f"),
    "join_inner": ("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", None),
    "join_right": ("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000", None),
    "join_full": ("SELECT s_suppkey, n_nationkey FROM supplier FULL OUTER JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_without_on": ("SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    "join_self_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "join_range_left": ("SELECT s_suppkey, p_partkey FROM supplier LEFT JOIN part ON s_acctbal < p_retailprice AND p_size < 3", None),
    "join_chain_filter": ("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0", None),
    "left_join_where_null": ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL", None),
    "agg_global": ("SELECT COUNT(*) AS n, COUNT(o_totalprice) AS m, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderdate) AS lo, MAX(o_totalprice) AS hi FROM orders", None),
    "agg_empty_global": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderpriority) AS lo FROM orders WHERE o_orderkey < 0", None),
    "agg_empty_group": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", None),
    "agg_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, SUM(DISTINCT o_custkey) AS s, AVG(DISTINCT o_custkey) AS a, MIN(DISTINCT o_custkey) AS lo FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s, AVG(DISTINCT o_custkey) AS a, MIN(o_custkey) AS lo FROM orders GROUP BY o_orderstatus"),
    "agg_bool": ("SELECT SUM(c_acctbal > 0) AS positive, COUNT(*) AS n FROM customer", "SELECT CAST(SUM(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, COUNT(*) AS n FROM customer"),
    "agg_group_only": ("SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size", None),
    "agg_group_expression": ("SELECT p_size / 10 AS tenth, COUNT(*) AS n FROM part GROUP BY p_size / 10", None),
    "agg_nested": ("SELECT l_returnflag, SUM(l_quantity) / COUNT(*) + 1 AS x FROM lineitem GROUP BY l_returnflag", None),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", None),
    "agg_having_hidden": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) BETWEEN 500000 AND 900000", None),
    "agg_join_having_topk": ("SELECT c_name, COUNT(*) AS n, SUM(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name HAVING COUNT(*) > 5 ORDER BY total DESC, c_name LIMIT 10", None),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, AVG(l_quantity) AS avg_qty, AVG(l_extendedprice) AS avg_price, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, AVG(l_quantity) AS avg_qty, AVG(l_extendedprice) AS avg_price, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "revenue_by_nation": ("SELECT n_name, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY n_name ORDER BY revenue DESC", "SELECT n_name, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY n_name"),
    "sort_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", None),
    "sort_hidden_column": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15", None),
    "sort_ordinal_alias": ("SELECT p_partkey, p_retailprice * 2 AS doubled FROM part ORDER BY doubled DESC, 1 LIMIT 7", None),
    "offset_only": ("SELECT r_regionkey FROM region ORDER BY r_regionkey OFFSET 2", None),
    "limit_zero": ("SELECT c_custkey FROM customer LIMIT 0", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_ordered": ("SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5", None),
}


_engines: dict[tuple[str, str], Engine] = {}


def star_schema(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the tables of sf_dir, one an application and folder: it has read the files' footers once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _engines:
        _engines.clear()
        _engines[key] = Engine(spark)
        _engines[key].register_parquet(sf_dir, TABLES)
    return _engines[key]


def _select(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: star_schema(spark, sf_dir).sql(sql)


def _stored(spark: SparkSession, sf_dir: str, table: str, primary: tuple[str, ...], columns: list[str], *statements: str) -> DataFrame:
    """The columns of a star-schema table after statements on a stored copy of it."""
    engine = Engine(spark, shared_folder(spark))
    df = star_schema(spark, sf_dir).view(table).select(*columns)
    engine.create_table_as(table, df, primary, files=4)
    for s in statements:
        engine.mine.sql(s)
    return engine.sql(f"SELECT {', '.join(columns)} FROM {table}")


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "customer", ("c_custkey",), CUSTOMER, "UPDATE customer SET c_acctbal = c_acctbal * 2, c_nationkey = c_nationkey + 1 WHERE c_acctbal < 0 OR c_custkey BETWEEN 10 AND 20")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "customer", ("c_custkey",), CUSTOMER, "DELETE FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_acctbal > 0")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "customer", ("c_custkey",), CUSTOMER, "INSERT INTO customer (c_name, c_nationkey) VALUES ('new ' + 'one', 1 + 2), ('new two', NULL)")


def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "customer", ("c_custkey",), CUSTOMER, "BEGIN", "DELETE FROM customer WHERE c_custkey > 100", "UPDATE customer SET c_name = 'x' WHERE c_custkey = 7", "COMMIT", "BEGIN", "DELETE FROM customer", "ROLLBACK")


def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ANALYZE works out for orders, as one row."""
    from .operators.define import measure

    rows, distinct = measure(star_schema(spark, sf_dir).view("orders"))
    return spark.createDataFrame([(rows, *(distinct[c] for c in sorted(distinct)))], ["row_count", *sorted(distinct)])


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_schema(spark, sf_dir).sql("EXPLAIN SELECT c_name, COUNT(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name ORDER BY c_name LIMIT 3")


STORED = {f.__name__: f for f in (dml_update, dml_delete, dml_insert, transaction_commit, analyze_stats, explain_plan)}

STORED_ORACLES = {
    "dml_update": "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 OR c_custkey BETWEEN 10 AND 20 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_acctbal < 0 OR c_custkey BETWEEN 10 AND 20 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer",
    "dml_delete": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE NOT coalesce(c_nationkey IN (1, 2, 3) AND c_acctbal > 0, FALSE)",
    "dml_insert": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT max(c_custkey) + 1, 'new one', 3, NULL FROM customer UNION ALL SELECT max(c_custkey) + 2, 'new two', NULL, NULL FROM customer",
    "transaction_commit": "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'x' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey <= 100",
    "analyze_stats": "SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_custkey) AS o_custkey, COUNT(DISTINCT o_orderdate) AS o_orderdate, COUNT(DISTINCT o_orderkey) AS o_orderkey, COUNT(DISTINCT o_orderpriority) AS o_orderpriority, COUNT(DISTINCT o_orderstatus) AS o_orderstatus, COUNT(DISTINCT o_totalprice) AS o_totalprice FROM orders",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _select(sql) for name, (sql, _) in SELECTS.items()} | STORED


def oracle_sql() -> dict[str, str]:
    return {name: oracle or sql for name, (sql, oracle) in SELECTS.items()} | STORED_ORACLES
