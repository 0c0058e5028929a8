"""Indicators and reports from additive totals.

Live indicators change with every edit. Each ticket is a state of a few columns; an edit batch takes the old
states of its tickets out of the totals (-1) and puts the new ones in (+1), so no other ticket is read.
Totals are by the hour. Where a bound such as "24 hours ago" lies inside an hour, the tickets of that
hour alone are looked at; the condition on their time reaches the scan.

Reports are about tickets as they were rebuilt: their totals are made with the rebuild, by the day, and
answer any range of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions import clock
from triage.functions.status import is_open, live_status, staff_engaged
from triage.operators.engagement import SIGNALS
from triage.operators.reports import progress, response_figures
from triage.schemas import schema_of

STATES = schema_of("content_id string not null, created_at timestamp_ntz, first_engagement_at timestamp_ntz, engaged boolean, "
                   "stored_status string, stored_updated_at timestamp_ntz, status string, updated_at timestamp_ntz")
LIVE_TOTALS = schema_of("kind string not null, at timestamp_ntz, n bigint")
REPORT_TOTALS = schema_of("kind string not null, day string, name string, minutes bigint, n bigint")
# What decides between two edits of a ticket, as far as a state shows it.
STATE_ORDER = ("updated_at", "status")


def states(stored: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """STATES of stored tickets (one row each), under the newest edits if these are given."""
    engaged = staff_engaged(*(F.col(s) if s in stored.columns else F.lit(False) for s in SIGNALS))
    rows = stored.select("content_id", "created_at", "first_engagement_at", engaged.alias("engaged"),
                         F.col("ticket_status").alias("stored_status"), F.col("ticket_updated_at").alias("stored_updated_at"))
    if edits is None:
        return rows.withColumns({"status": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    return rows.join(edits.select("content_id", *STATE_ORDER), "content_id", "left").select(*STATES.names)


def edited(old: DataFrame, edits: DataFrame) -> DataFrame:
    """Each state with the one its edits leave it in (``new_status``, ``new_updated_at``); states that no edit
    changes are left out, as are edits of unknown tickets and such that are older than the state's own."""
    newest = edits.groupBy("content_id").agg(F.max(F.struct(*STATE_ORDER)).alias("_new"))
    later = F.col("_new") > F.struct(*STATE_ORDER)
    return old.join(newest, "content_id").filter(later).select(
        *STATES.names, F.col("_new.status").alias("new_status"), F.col("_new.updated_at").alias("new_updated_at"))


def after(changed: DataFrame) -> DataFrame:
    return changed.withColumns({"status": F.col("new_status"), "updated_at": F.col("new_updated_at")}).select(*STATES.names)


def live_totals(rows: DataFrame, sign: int = 1) -> DataFrame:
    """LIVE_TOTALS of states: all tickets, open and resolved ones by the hour they were made in, resolved ones
    by the day they were answered."""
    status = live_status(F.col("engaged"), F.col("status"), F.col("stored_status"))
    made = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    answered = F.to_date(F.coalesce("first_engagement_at", "updated_at", "stored_updated_at")).cast("timestamp_ntz")
    resolved = status.isin(*v.RESOLVED_SET)
    kinds = (("made", F.lit(True), made), ("open", is_open(status), made), ("resolved", resolved, made), ("answered", resolved, answered))
    shown = F.array_compact(F.array(*(F.when(is_it, F.struct(F.lit(k).alias("kind"), at.alias("at"))) for k, is_it, at in kinds)))
    return added(rows.select(F.explode(shown).alias("t")).select("t.kind", "t.at", F.lit(sign).cast("bigint").alias("n")))


def added(*totals: DataFrame) -> DataFrame:
    """Totals of one shape as one; what adds up to nothing is left out."""
    rows = totals[0]
    for more in totals[1:]:
        rows = rows.unionByName(more)
    keys = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def _made(totals: DataFrame, rows: DataFrame, kind: str, is_it: Column, bounds: Sequence[Column]) -> DataFrame:
    """(created_at, n): whole hours from the totals, the hours with a bound inside ticket by ticket."""
    hours = [F.date_trunc("hour", b).cast("timestamp_ntz") for b in bounds]
    apart, within = F.lit(False), F.lit(False)
    for hour in hours:
        apart = apart | F.coalesce(F.col("at") == hour, F.lit(False))
        within = within | ((F.col("created_at") >= hour) & (F.col("created_at") < hour + F.expr("INTERVAL 1 HOUR")))
    whole = totals.filter((F.col("kind") == kind) & ~apart).select(F.col("at").alias("created_at"), "n")
    return whole.unionByName(rows.filter(within).filter(is_it).select("created_at", F.lit(1).cast("bigint").alias("n")))


def _count(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def open_stats(totals: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """``reports.open_stats`` from LIVE_TOTALS and the STATES they are of."""
    status = live_status(F.col("engaged"), F.col("status"), F.col("stored_status"))
    bounds = [now - F.expr(f"INTERVAL {h} HOURS") for h in (v.URGENT_FROM_HOURS, v.CRITICAL_FROM_HOURS)]
    counted = _made(totals, rows, "open", is_open(status), bounds)
    return counted.agg(_count().alias("open"), *(
        _count(clock.urgency_is(level, F.col("created_at"), now)).alias(level) for level in v.URGENCY_RANK))


def daily_stats(totals: DataFrame, rows: DataFrame, now: Column, goal: int = v.DAILY_GOAL) -> DataFrame:
    """``reports.daily_stats`` from LIVE_TOTALS and the STATES they are of."""
    today, since = F.to_date(now), now - F.expr("INTERVAL 30 DAYS")
    status = live_status(F.col("engaged"), F.col("status"), F.col("stored_status"))
    days = totals.filter((F.to_date("at") == today) & F.col("kind").isin("made", "answered")).select("kind", "n")
    recent = _made(totals, rows, "resolved", status.isin(*v.RESOLVED_SET), [since]).filter(F.col("created_at") >= since)
    counts = days.unionByName(recent.select(F.lit("recent").alias("kind"), "n")).agg(
        _count(F.col("kind") == "made").alias("in_today"), _count(F.col("kind") == "answered").alias("answered_today"),
        F.round(_count(F.col("kind") == "recent") / F.lit(30.0), 1).alias("daily_avg"))
    return progress(counts, goal)


def report_totals(tickets: DataFrame) -> DataFrame:
    """REPORT_TOTALS of stored tickets, in one pass over their narrow columns."""
    made, none = F.to_date("created_at").cast("string"), F.lit(None)
    minutes = clock.whole_minutes(F.col("created_at"), F.col("first_engagement_at"))

    def row(kind: str, day: Column, name: Column, spent: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), day.alias("day"), name.cast("string").alias("name"), spent.cast("bigint").alias("minutes"))

    closed = F.col("ticket_status") == "closed"
    shown = F.array_compact(F.array(
        row("volume", made, F.when(closed, "closed"), none),
        row("topic", made, F.coalesce("domain", F.lit("unset")), none),
        F.when(F.col("first_engagement_at").isNotNull(), row("response", made, none, minutes)),
        F.when(closed & (F.col("assigned_to") != ""), row("closed", F.to_date("ticket_updated_at").cast("string"), F.col("assigned_to"), none))))
    return added(tickets.select(F.explode(shown).alias("t")).select("t.*", F.lit(1).cast("bigint").alias("n")))


def _between(totals: DataFrame, kind: str, first: Column, last: Column) -> DataFrame:
    return totals.filter((F.col("kind") == kind) & F.col("day").between(first.cast("string"), last.cast("string")))


def volume(totals: DataFrame, first: Column, last: Column) -> DataFrame:
    return _between(totals, "volume", first, last).groupBy(F.col("day").cast("date").alias("date")).agg(
        _count().alias("tickets_in"), _count(F.col("name") == "closed").alias("tickets_closed")).orderBy("date")


def response_summary(totals: DataFrame, first: Column, last: Column) -> DataFrame:
    """Exact mean, median and share within the promise: histograms of days add up to that of the range."""
    merged = _between(totals, "response", first, last).groupBy(F.col("minutes").alias("minutes_to_response")).agg(F.sum("n").alias("n"))
    return response_figures(merged)


def productivity(totals: DataFrame, first: Column, last: Column) -> DataFrame:
    return _named(_between(totals, "closed", first, last), "assigned_to", "tickets_closed")


def topic_breakdown(totals: DataFrame, first: Column, last: Column) -> DataFrame:
    return _named(_between(totals, "topic", first, last), "domain", "tickets")


def _named(rows: DataFrame, name: str, count: str) -> DataFrame:
    return rows.groupBy(F.col("name").alias(name)).agg(_count().alias(count)).orderBy(F.col(count).desc(), name)
