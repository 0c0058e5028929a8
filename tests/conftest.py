from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from triage.settings import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    builder = configure(SparkSession.builder.master("local[8]")).config("spark.ui.enabled", "false")
    session = (
        builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def frame(spark):
    """``frame("a bigint, b string", (1, "x"), ...)``"""

    def make(columns: str, *rows: tuple) -> DataFrame:
        return spark.createDataFrame(list(rows), columns)

    return make


@pytest.fixture
def no_broadcast(spark):
    """Small test frames would all be broadcast; here joins must shuffle as on large data."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def plan_of(rows: DataFrame) -> str:
    """The physical plan; of a plan that ran, only what ran."""
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def values(rows: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in rows.collect()), key=repr)
