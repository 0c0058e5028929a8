"""Ages, day bounds and week starts, all against a given clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from triage import vocabulary as v


def whole_hours(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def whole_minutes(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", start, end)


def urgency(created_at: Column, now: Column) -> Column:
    """An unknown creation time is critical: it fails both younger tests."""
    age = whole_hours(created_at, now)
    return (
        F.when(age < v.URGENT_FROM_HOURS, "normal")
        .when(age < v.CRITICAL_FROM_HOURS, "urgent")
        .otherwise("critical")
    )


def urgency_is(level: str, created_at: Column, now: Column) -> Column:
    """Filter form of ``urgency``: an unknown creation time matches no level."""
    age = whole_hours(created_at, now)
    return {
        "normal": age < v.URGENT_FROM_HOURS,
        "urgent": (age >= v.URGENT_FROM_HOURS) & (age < v.CRITICAL_FROM_HOURS),
        "critical": age >= v.CRITICAL_FROM_HOURS,
    }[level]


def urgency_rank(level: Column) -> Column:
    return F.when(level == "critical", 2).when(level == "urgent", 1).otherwise(0)


def urgency_name(rank: Column) -> Column:
    return F.when(rank == 2, "critical").when(rank == 1, "urgent").otherwise("normal")


def sunday_of(moment: Column) -> Column:
    """Midnight of the Sunday that opens the week of ``moment``."""
    day = F.to_date(moment)
    return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")


def period_bounds(period: str, today: Column,
                  custom: tuple[dt.date, dt.date] | None = None) -> tuple[Column, Column] | None:
    """First and last day of a named period: all, today, this week (from Monday), this month, custom."""
    if period == "all":
        return None
    if period == "today":
        return today, today
    if period == "this week":
        return F.date_sub(today, F.weekday(today)), today
    if period == "this month":
        return F.trunc(today, "month"), today
    if period == "custom" and custom is not None:
        return F.lit(custom[0]), F.lit(custom[1])
    raise ValueError(f"unknown period: {period!r}")
