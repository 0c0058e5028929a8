"""What a run is about: the tenant, the clock, the size bounds."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from triage import vocabulary as v


@dataclass(frozen=True)
class Settings:
    tenant: str
    # UTC text such as "2024-01-31 00:00:00"; None means the query's own start.
    as_of: str | None = None
    daily_goal: int = v.DAILY_GOAL
    # A set of ids is broadcast only after a count shows it is no larger than this.
    broadcast_rows: int = 1_000_000

    @property
    def now(self) -> Column:
        if self.as_of is None:
            return F.current_timestamp().cast("timestamp_ntz")
        return F.lit(self.as_of).cast("timestamp_ntz")

    @property
    def today(self) -> Column:
        return F.to_date(self.now)


# Session settings the jobs are written for; sizes and parallelism stay with the cluster.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Once the true partition sizes are known, narrow sides are hashed and bodies are not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Rows laid out by content_id need no second exchange for a join on it and more columns.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SESSION.items():
        builder = builder.config(name, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """The same for a session that exists already; all of these may change while it runs."""
    for name, value in SESSION.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a session on one machine may go without a name, as in tests; it gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="triage-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")
