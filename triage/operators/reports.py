"""Indicators over live tickets, reports over stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions import clock
from triage.functions.status import is_open, live_status, renamed_status, staff_engaged
from triage.operators.engagement import SIGNALS
from triage.operators.tickets import EDIT_ORDER

# Statuses that end an item.
CLOSING = ("closed", "cancelled")


def open_stats(live: DataFrame, now: Column) -> DataFrame:
    """Open tickets, and how many are normal, urgent, critical."""
    open_, made = is_open(F.col("ticket_status")), F.col("created_at")
    return live.agg(
        F.count_if(open_).alias("open"),
        *(F.count_if(open_ & clock.urgency_is(level, made, now)).alias(level) for level in v.URGENCY_RANK),
    )


def daily_stats(live: DataFrame, now: Column, goal: int = v.DAILY_GOAL) -> DataFrame:
    """In today, answered today, 30-day daily average of resolved items, progress to the goal."""
    today = F.to_date(now)
    resolved = F.col("ticket_status").isin(*v.RESOLVED_SET)
    answered_on = F.to_date(F.coalesce("first_engagement_at", "live_updated_at"))
    recent = F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")
    counts = live.agg(
        F.count_if(F.to_date("created_at") == today).alias("in_today"),
        F.count_if(resolved & (answered_on == today)).alias("answered_today"),
        F.round(F.count_if(resolved & recent) / F.lit(30.0), 1).alias("daily_avg"),
    )
    return progress(counts, goal)


def progress(counts: DataFrame, goal: int) -> DataFrame:
    reached = F.bround(F.col("answered_today") / F.lit(float(goal)) * 100, 0).cast("bigint") if goal > 0 else F.lit(0)
    return counts.withColumns({
        "goal": F.lit(goal).cast("bigint"),
        "goal_percent": F.least(F.lit(100), reached).cast("bigint"),
    })


def _created_between(tickets: DataFrame, first: Column, last: Column) -> DataFrame:
    return tickets.filter(F.to_date("created_at").between(first, last))


def volume(tickets: DataFrame, first: Column, last: Column) -> DataFrame:
    return (
        _created_between(tickets, first, last)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count("*").alias("tickets_in"),
             F.count_if(F.col("ticket_status") == "closed").alias("tickets_closed"))
        .orderBy("date")
    )


def response_minutes(tickets: DataFrame, first: Column, last: Column) -> DataFrame:
    """Whole minutes from creation to first engagement, negative if staff was there before."""
    answered = _created_between(tickets, first, last).filter(F.col("first_engagement_at").isNotNull())
    return answered.select(
        clock.whole_minutes(F.col("created_at"), F.col("first_engagement_at")).alias("minutes_to_response")
    )


def response_summary(minutes: DataFrame) -> DataFrame:
    """Mean, exact median and share within the promise, from a histogram of whole minutes.

    Tickets are first counted per minute, in parallel; the median then works on distinct
    minutes, a number set by the calendar and not by the ticket count.
    """
    return response_figures(minutes.groupBy("minutes_to_response").agg(F.count("*").alias("n")))


def response_figures(histogram: DataFrame) -> DataFrame:
    spent = F.col("minutes_to_response")
    within = F.sum(F.when(spent < v.RESPONSE_TARGET_MINUTES, F.col("n")).otherwise(0))
    return histogram.agg(
        F.bround(F.sum(spent * F.col("n")) / F.sum("n"), 1).alias("avg_minutes"),
        F.bround(F.percentile(spent, F.lit(0.5), F.col("n")), 1).alias("median_minutes"),
        F.bround(within / F.sum("n") * 100, 1).alias("within_target_percent"),
    )


def productivity(tickets: DataFrame, first: Column, last: Column) -> DataFrame:
    """Closed tickets per coach, by the day of the edit."""
    closed = tickets.filter(
        (F.col("ticket_status") == "closed")
        & F.to_date("ticket_updated_at").between(first, last)
        & (F.col("assigned_to") != "")
    )
    return (
        closed.groupBy("assigned_to").agg(F.count("*").alias("tickets_closed"))
        .orderBy(F.col("tickets_closed").desc(), "assigned_to")
    )


def topic_breakdown(tickets: DataFrame, first: Column, last: Column) -> DataFrame:
    return (
        _created_between(tickets, first, last)
        .groupBy(F.coalesce("domain", F.lit("unset")).alias("domain"))
        .agg(F.count("*").alias("tickets"))
        .orderBy(F.col("tickets").desc(), "domain")
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status")


def status_remap(metadata: DataFrame) -> DataFrame:
    """Old status names become current ones; a projection, so nothing moves."""
    return metadata.withColumn("status", renamed_status(F.col("status")))


def column_audit(table: DataFrame) -> DataFrame:
    """Per column: filled rows, and whether every row lacks it. One pass over the table."""
    counts = table.agg(F.count("*").alias("_rows"), *(F.count(F.col(c)).alias(c) for c in table.columns))
    named = F.array(*(
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled_rows")) for c in table.columns
    ))
    return counts.select("_rows", F.explode(named).alias("c")).select(
        "c.column_name", "c.filled_rows",
        ((F.col("c.filled_rows") == 0) & (F.col("_rows") > 0)).alias("always_null"),
    )


def closed_without_comment(tickets: DataFrame, edits: DataFrame, scores: DataFrame) -> DataFrame:
    """Log rows for edits that close an item on which no staff member commented.

    The state an edit met follows from the edit before it in the log, else from the score; so every
    edit that closed something open, assigned or rejected is found, also where it is the latest one
    and the stored ticket already shows its result. An edit that changes nothing gives no row. The row
    id comes from the edit itself, so a retried task writes the same id again.
    """
    log = edits.select("content_id", *EDIT_ORDER)
    in_time = Window.partitionBy("content_id").orderBy(*[F.col(c).asc_nulls_first() for c in EDIT_ORDER])
    steps = log.withColumn("_met", F.lag("status").over(in_time)).filter(F.col("status").isin(*CLOSING)).select(
        "content_id", "_met", F.col("status").alias("_new"), F.col("updated_at").alias("_at"))
    items = tickets.select("content_id", *SIGNALS, "member_id", "domain").filter(~F.col("team_commented"))
    met = steps.join(items, "content_id").join(scores.select("content_id", "is_question"), "content_id", "left")
    by_score = F.when(~F.col("is_question"), "not_a_question").otherwise("open")
    state = live_status(staff_engaged(*(F.col(s) for s in SIGNALS)), F.col("_met"), by_score)
    missed = met.filter(F.col("_new") != state)
    moment = F.date_format("_at", "yyyy-MM-dd HH:mm:ss")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return missed.select(
        F.md5(F.concat_ws("|", "content_id", "_new", moment)).alias("log_id"),
        F.col("_at").alias("created_at"),
        F.lit("INFO").alias("level"),
        F.lit("closed_without_comment").alias("source"),
        F.concat("content_id", F.lit(": set to "), "_new", F.lit(" before any staff comment; was it a question at all?")
                 ).alias("message"),
        F.concat(F.lit("author "), shown("member_id"), F.lit(", topic "), shown("domain")).alias("detail"),
    )
