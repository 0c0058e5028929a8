"""The two status rules. Reports use the stored one, lists and KPIs the live one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triage import vocabulary as v


def staff_engaged(commented: Column, replied: Column, reacted: Column) -> Column:
    false = F.lit(False)
    return F.coalesce(commented, false) | F.coalesce(replied, false) | F.coalesce(reacted, false)


def stored_status(engaged: Column, manual: Column, is_question: Column) -> Column:
    """Staff engagement wins, then any manual status (a blank one too), then the score."""
    return (
        F.when(engaged, "answered")
        .when(manual.isNotNull(), manual)
        .when(~is_question, "not_a_question")
        .otherwise("open")
    )


def live_status(engaged: Column, manual: Column, stored: Column) -> Column:
    """As above over the latest edit; blank edits do not count, rejection is as last stored."""
    return (
        F.when(engaged, "answered")
        .when(manual != "", manual)
        .when(stored == "not_a_question", "not_a_question")
        .otherwise("open")
    )


def is_open(status: Column) -> Column:
    return status.isin(*v.OPEN_SET)


def renamed_status(status: Column) -> Column:
    renamed = status
    for old, new in v.STATUS_RENAMES.items():
        renamed = F.when(status == old, new).otherwise(renamed)
    return renamed
