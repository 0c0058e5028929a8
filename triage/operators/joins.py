"""Join forms that need more thought than ``join``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids of eight bytes: some tens of megabytes once hashed.
DEFAULT_BROADCAST_ROWS = 1_000_000
SALTS = 32


@dataclass(frozen=True)
class IdSet:
    """A one-column set of ids, counted once however often it is used."""

    ids: DataFrame
    rows: int
    nulls: int
    max_rows: int = DEFAULT_BROADCAST_ROWS

    @classmethod
    def of(cls, ids: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> IdSet:
        rows, filled = ids.agg(F.count("*"), F.count(F.col(ids.columns[0]))).first()
        return cls(ids, rows, rows - filled, max_rows)

    @property
    def small(self) -> bool:
        return self.rows <= self.max_rows

    @property
    def side(self) -> DataFrame:
        """The right side of a semi, anti or left join: broadcast only if counted small.

        Beyond the bound the join shuffles. The large rows are then on the left, the side that
        adaptive execution splits when one key is hot.
        """
        return F.broadcast(self.ids) if self.small else self.ids


def is_small(ids: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """Count a narrow frame (ids, bounds) against the bound; the count itself is distributed."""
    return ids.count() <= max_rows


def broadcast_if_small(ids: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(ids) if is_small(ids, max_rows) else ids


def not_in(rows: DataFrame, key: str, values: IdSet) -> DataFrame:
    """SQL ``key NOT IN (values)`` with its NULL rules.

    Spark always broadcasts the right side of a null-aware anti join, so the built-in form is
    used only behind the size check. Beyond it the counts settle the NULL rules (one NULL value
    lets no row pass) and the rest is a plain anti join, which shuffles.
    """
    ids = values.ids.toDF("_value")
    if values.small:
        return rows.filter(~F.col(key).isin(ids))
    if values.nulls:
        return rows.filter(F.lit(False))
    return rows.filter(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_value"), "left_anti")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``.

    The ``= 1`` filter over ``row_number`` plans a group limit below the exchange: each map task
    sends at most one row per key, so a hot key never gathers its rows in one task.
    """
    numbered = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return numbered.filter(F.col("_rank") == 1).drop("_rank")


def match_intervals(facts: DataFrame, at: str, intervals: DataFrame, start: str, end: str, small: bool,
                    salts: int = SALTS) -> DataFrame:
    """Inner join facts to half-open intervals ``[start, end)``; a NULL end never closes.

    Intervals are cut into the days they touch and joined on the day, so the work is linear in
    facts and days instead of facts times intervals. Consecutive intervals share few days, which
    keeps the cut table near (days + intervals) rows. It is broadcast when ``small`` (see
    ``touched_days``); otherwise facts are salted by a hash of themselves, as one day may be hot.
    """
    last_day = facts.agg(F.to_date(F.max(at))).scalar()
    cut = (
        _nonempty(intervals, start, end)
        .withColumns({"_from": F.to_date(start), "_to": F.least(F.to_date(end), last_day)})
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn("_day", F.explode(F.sequence("_from", "_to")))
        .drop("_from", "_to")
    )
    facts = facts.filter(F.col(at).isNotNull()).withColumn("_day", F.to_date(at))
    keys = ["_day"]
    if small:
        cut = F.broadcast(cut)
    else:
        cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        facts = facts.withColumn(
            "_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
        )
        keys.append("_salt")
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return facts.join(cut, keys).filter(inside).drop(*keys)


def touched_days(intervals: DataFrame, start: str, end: str) -> int:
    """Rows of the table ``match_intervals`` cuts, from the intervals alone; open ones count up to today."""
    now = F.current_timestamp().cast("timestamp_ntz")
    until = F.greatest(F.to_date(F.coalesce(F.col(end), now)), F.to_date(start))
    days = F.sum(F.date_diff(until, F.to_date(start)) + 1)
    return _nonempty(intervals, start, end).agg(F.coalesce(days, F.lit(0))).first()[0]


def _nonempty(intervals: DataFrame, start: str, end: str) -> DataFrame:
    return intervals.filter(
        F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
