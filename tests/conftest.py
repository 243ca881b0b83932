import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__default__parallelism="4", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of named strings."""
    from pyspark.sql import functions as F

    def value(expression, **columns):
        base = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
        return base.select(expression.alias("out")).first()["out"]

    return value
