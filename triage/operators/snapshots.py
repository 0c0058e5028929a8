"""What changed between two whole snapshots of a source table: late, edited and deleted rows.

Rows are known by 128 bits of hash over all their columns. The hashes of a creation day add up to a digest
in any order, so days without a change are told by one narrow row each, and only the rows of other days
are compared. Two different rows, or days, are taken for equal with a chance of about 2^-128 a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.schemas import schema_of

PRINTS = schema_of("key string not null, created_at timestamp_ntz, first_hash bigint, second_hash bigint")
DIGESTS = schema_of("day string not null, rows bigint, first_sum bigint, second_sum string")
UNDATED = "undated"
INSERTED, UPDATED, DELETED = "inserted", "updated", "deleted"


def day_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.coalesce(F.to_date("created_at").cast("string"), F.lit(UNDATED)))


def prints(rows: DataFrame, key: str) -> DataFrame:
    """PRINTS of a snapshot with one row per key. NULL differs from every value, also from a neighbour's."""
    columns = [F.col(c) for c in sorted(rows.columns)]
    empty = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return rows.select(F.col(key).cast("string").alias("key"), "created_at",
                       F.xxhash64(empty, *columns).alias("first_hash"), F.xxhash64(F.lit("second"), empty, *columns).alias("second_hash"))


def digests(of: DataFrame) -> DataFrame:
    """DIGESTS of PRINTS; adds up on the map side, one row per day leaves it."""
    total = F.sum(F.col("second_hash").cast("decimal(38, 0)"))
    return day_of(of).groupBy("day").agg(F.count("*").alias("rows"), F.bit_xor("first_hash").alias("first_sum"),
                                         total.cast("string").alias("second_sum"))


def differing_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Days whose digests differ or that only one snapshot has."""
    fields = [c for c in DIGESTS.names if c != "day"]
    both = old.select("day", F.struct(*fields).alias("_old")).join(new.select("day", F.struct(*fields).alias("_new")), "day", "full")
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("day")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change, old_day: how each key of the old and new PRINTS differs; equal rows are left out.

    A row that moved to another day is an update, as long as both days are among those compared.
    """
    hashes = F.struct("created_at", "first_hash", "second_hash")
    before = day_of(old).select("key", hashes.alias("_old"), F.col("day").alias("old_day"))
    both = before.join(new.select("key", hashes.alias("_new")), "key", "full")
    change = F.when(F.col("_old").isNull(), INSERTED).when(F.col("_new").isNull(), DELETED).otherwise(UPDATED)
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("key", change.alias("change"), "old_day")
