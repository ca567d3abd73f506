import pytest
from llm_cases import ODD, SCHEMA


@pytest.fixture
def odd(spark):
    """The odd rows, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("row", "n", "c", "t", "w", "copy", "block", "ranges", "label", "m", "n_words", "spans", "_row", "_nth", "_gone", "token", "ids")})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
