"""The queries over inline tables, against DuckDB."""

import math

import pytest

from loomq import inline_queries as q


def same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_equals_duckdb(spark, name):
    import duckdb

    df = q.queries()[name](spark, "unused")
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[df.columns.index(c)]) for c in columns) for r in df.collect()), key=repr)
    found = duckdb.connect().execute(q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(same(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
