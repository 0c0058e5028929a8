"""Scans with fixed schemas, and the plain parquet writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.operators.edits import require
from triage.schemas import TABLES


def scan(spark: SparkSession, root: str, name: str, tenant: str | None = None) -> DataFrame:
    """A stored table; the tenant condition is pushed into the parquet scan."""
    rows = spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    return rows if tenant is None else rows.filter(F.col("client_id") == tenant)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Write an empty table unless something is there already."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Add rows to an append-only table after checking its required columns."""
    require(rows, schema).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only table: rows added by jobs and the folders of stream batches."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def by_created_date(rows: DataFrame) -> DataFrame:
    """Rows with the partition column of date-partitioned tables."""
    return rows.withColumn("created_date", F.to_date("created_at"))
