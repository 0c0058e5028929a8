"""Changes to stored tables, as plans over the old rows and the changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.status import is_open
from triage.operators.joins import latest_per_key


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """Update the columns ``changes`` carries where the key matches, insert the rest: one row per key.

    Stored and changed rows meet in one aggregation, which keeps the newest of each kind per key, on the map
    side already, and then chooses per column. Of several changes to one key the one with the largest
    values of the ``order`` columns counts, equal ones settled by the other columns, NULL being the smallest.
    Where the stored rows have the order columns too, a change that is older than the stored row does
    nothing, so the result does not depend on how changes are split into batches or on the order in which
    these arrive. Stored columns that ``changes`` lacks keep their value (NULL for new rows). Several stored
    rows of a key become one, by the same rule. Building the plan runs nothing.
    """
    ranks = list(order or [])
    ranked = order is not None and set(order) <= set(stored.columns)
    old, new = _aged(stored, key, ranks if ranked else [], "_old"), _aged(changes, key, ranks, "_new")
    both = old.unionByName(new, allowMissingColumns=True)
    newest = both.groupBy(key).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    counts = F.col("_new").isNotNull()
    if ranked:
        counts = counts & (F.col("_old").isNull() | (F.col("_new.rank") >= F.col("_old.rank")))

    def value(side: str, column: str, ranks: Sequence[str]) -> Column:
        return F.col(f"{side}.{'rank' if column in ranks else 'rest'}.`{column}`")

    def chosen(column: str) -> Column:
        kept = value("_old", column, ranks if ranked else [])
        return F.when(counts, value("_new", column, ranks)).otherwise(kept) if column in changes.columns else kept

    return newest.select(*(F.col(c) if c == key else chosen(c).alias(c) for c in stored.columns))


def _aged(rows: DataFrame, key: str, ranks: Sequence[str], name: str) -> DataFrame:
    """The rows as one value each, ordered by ``ranks`` and then by all other columns."""
    rest = [F.col(c) for c in rows.columns if c != key and c not in ranks] or [F.lit(True).alias("_any")]
    whole = F.struct(*([F.struct(*ranks).alias("rank")] if ranks else []), F.struct(*rest).alias("rest"))
    return rows.select(key, whole.alias(name))


def upsert_bodies(stored: DataFrame, changes: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """``upsert`` for tables with one row per key whose rows are long: these are joined, not sorted, and stay
    where they are if adaptive execution finds the changes small. Of equal changes any one counts."""
    # Repeated keys do no harm in semi and anti joins, and finding the newest may be costly.
    keys = changes.select(key)
    ranks = list(order) if order is not None else [c for c in changes.columns if c != key]
    changes = latest_per_key(changes, [key], [F.col(c).desc_nulls_last() for c in ranks])
    ranked = order is not None and set(order) <= set(stored.columns)
    if not ranked and set(stored.columns) <= set(changes.columns):
        untouched = stored.join(keys, key, "left_anti")
        return untouched.unionByName(changes.select(*stored.columns))

    new = {c: f"_new_{c}" for c in changes.columns if c != key}
    renamed = changes.withColumnsRenamed(new).withColumn("_hit", F.lit(True))
    counts = F.col("_hit")
    if ranked:
        counts = counts & (F.struct(*[F.col(new[c]) for c in ranks]) >= F.struct(*ranks))
    updated = (
        stored.join(renamed, key, "left").withColumn("_hit", counts)
        .withColumns({c: F.when(F.col("_hit"), F.col(n)).otherwise(F.col(c)) for c, n in new.items()})
        .select(*stored.columns)
    )
    known = stored.select(key).join(keys, key, "left_semi")
    inserted = changes.join(known, key, "left_anti")
    return updated.unionByName(inserted.select(*[c for c in stored.columns if c in changes.columns]), allowMissingColumns=True)


def delete(stored: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return stored.join(doomed.select(key), key, "left_anti")


def bulk_status_changes(live: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Changes that give every open ticket of a (thread, member) the requested values.

    Unset values are stored blank, the reason among them.
    """
    blank = F.lit("")
    wanted = requests.select(
        "thread_id", "member_id", F.col("status").alias("_status"),
        F.coalesce("assigned_to", blank).alias("_assigned"), F.coalesce("domain", blank).alias("_domain"),
    )
    open_ = live.filter(is_open(F.col("ticket_status"))).select("content_id", "thread_id", "member_id")
    return open_.join(wanted, ["thread_id", "member_id"]).select(
        "content_id", F.col("_status").alias("status"), F.col("_assigned").alias("assigned_to"),
        F.col("_domain").alias("domain"), blank.alias("feedback_reason"), now.alias("updated_at"),
    )


def with_columns_of(table: DataFrame, schema: T.StructType) -> DataFrame:
    """Add what an older table lacks as typed NULLs, in the order of the schema; extras stay."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in table.columns}
    named = [f.name for f in schema]
    return table.withColumns(missing).select(*named, *(c for c in table.columns if c not in named))


def without_columns(table: DataFrame, *names: str) -> DataFrame:
    return table.drop(*(n for n in names if n in table.columns))


def require(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail the job when a required column is NULL; parquet itself would let it pass."""
    needed = [f.name for f in schema if not f.nullable]
    checked = {
        n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"{n} must not be NULL")).cast(schema[n].dataType))
        .otherwise(F.col(n))
        for n in needed
    }
    return rows.withColumns(checked).select(*(f.name for f in schema))
