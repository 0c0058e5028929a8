"""One ticket per scored item, and the live view of it under later edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions import status as rules
from triage.functions.text import is_blank
from triage.operators.engagement import SIGNALS
from triage.operators.joins import latest_per_key

# Edits of one moment are settled by their values, so that every run picks the same one.
EDIT_ORDER = ("updated_at", "status", "assigned_to", "domain", "feedback_reason")


TICKET_COLUMNS = (
    "content_id", "thread_id", "content_type", "space_id", "title", "body", "permalink",
    "created_at", "updated_at", "last_activity_at",
    "member_id", "member_name", "first_name", "last_name", "email_address", "member_state",
    "member_city", "avatar_url", "join_date", "last_visited_network", "member_permalink",
    *SIGNALS, "first_engagement_at",
    "ticket_status", "manual_status", "assigned_to", "ticket_updated_at", "domain",
)


def newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("content_id").desc()]


def oldest_first() -> list[Column]:
    return [F.col("created_at").asc_nulls_first(), F.col("content_id").asc()]


def latest_metadata(edits: DataFrame) -> DataFrame:
    return latest_per_key(edits, ["content_id"], [F.col(c).desc_nulls_last() for c in EDIT_ORDER])


def member_assignments(content: DataFrame, metadata: DataFrame, overrides: DataFrame) -> DataFrame:
    """A member's coach: the one of their first assigned item, unless overridden."""
    assigned = metadata.filter(~is_blank(F.col("assigned_to"))).select("content_id", "assigned_to")
    items = content.select("content_id", "member_id", "created_at").join(assigned, "content_id")
    first = latest_per_key(items, ["member_id"], oldest_first())
    override = overrides.select(
        "member_id", F.col("assigned_to").alias("override"),
        F.col("updated_at").alias("override_updated_at"), F.col("updated_by").alias("override_updated_by"),
    )
    return first.join(override, "member_id", "left").select(
        "member_id",
        F.coalesce("override", "assigned_to").alias("assigned_to"),
        F.col("created_at").alias("first_assigned_at"),
        F.col("content_id").alias("first_content_id"),
        F.col("override").isNotNull().alias("is_overridden"),
        "override_updated_at", "override_updated_by",
    )


def tickets(content: DataFrame, members: DataFrame, engagement: DataFrame, metadata: DataFrame,
            labels: DataFrame, assignments: DataFrame, few_people: bool = False) -> DataFrame:
    """Star of left joins around the content.

    Everything is joined by ``content_id``, so one exchange of the content at most serves all. What
    is keyed by member is put together beforehand. ``few_people`` says that members and coached authors
    were counted and may be broadcast: they then meet the items where these are. Else they are joined to
    the two ids of each item: ids and profiles travel to the bodies, and a prolific author's bodies never
    gather under one key. An author outside the member table keeps NULL profile fields but still gets
    the coach.
    """
    profile = members.select(
        "member_id", F.col("full_name").alias("member_name"), "first_name", "last_name",
        "email_address", F.col("state").alias("member_state"), F.col("city").alias("member_city"),
        "avatar_url", "join_date", "last_visited_network", "member_permalink",
        F.lit(True).alias("_known"),
    )
    coach = assignments.select("member_id", F.col("assigned_to").alias("_coach"))
    people = profile.join(coach, "member_id", "full").withColumnRenamed("member_id", "_author")

    edits = metadata.select(
        "content_id", F.col("status").alias("manual_status"), F.col("assigned_to").alias("_assigned"),
        F.col("updated_at").alias("ticket_updated_at"), F.col("domain").alias("_domain"),
    )
    topics = labels.select("content_id", F.col("domain").alias("_topic"))

    joined = (
        content.withColumnRenamed("member_id", "_author")
        .join(engagement, "content_id", "left")
        .join(edits, "content_id", "left")
        .join(topics, "content_id", "left")
    )
    if few_people:
        joined = joined.join(F.broadcast(people), "_author", "left")
    else:
        authors = content.select("content_id", F.col("member_id").alias("_author"))
        by_item = authors.filter(F.col("_author").isNotNull()).distinct().join(people, "_author")
        joined = joined.join(by_item, ["content_id", "_author"], "left")
    engaged = rules.staff_engaged(*(F.col(s) for s in SIGNALS))
    return (
        joined.withColumn("ticket_status",
                          rules.stored_status(engaged, F.col("manual_status"), F.col("is_question")))
        .withColumns({s: F.coalesce(F.col(s), F.lit(False)) for s in SIGNALS})
        .withColumn("member_id", F.when(F.col("_known"), F.col("_author")))
        .withColumn("assigned_to", F.coalesce("_assigned", "_coach"))
        .withColumn("domain", F.coalesce("_domain", "_topic"))
        .select(*TICKET_COLUMNS)
    )


def newest_copy(stored: DataFrame) -> DataFrame:
    """One row of each item: the newest, equal times settled by all other columns."""
    rest = sorted(set(stored.columns) - {"content_id", "created_at"}, key=lambda c: (c.startswith("_"), c))
    return latest_per_key(stored, ["content_id"], [F.col("created_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest]])


def live_tickets(stored: DataFrame, edits: DataFrame, keyed: bool = False, settled: bool = False) -> DataFrame:
    """Stored tickets under the newest edit of each; columns a stored version lacks are tolerated.

    ``keyed`` says that the stored table has one row for each item, as jobs and upserts write it;
    then no row is compared with others. ``settled`` says the same of the edits, as ``jobs.save_edits``
    keeps them; else the newest are found among all edits ever made.
    """
    return overlay(stored if keyed else newest_copy(stored), edits, settled)


def overlay(stored: DataFrame, edits: DataFrame, settled: bool = False) -> DataFrame:
    """The live columns without the de-duplication of ``live_tickets``."""
    newest = (edits if settled else latest_metadata(edits)).select(
        "content_id", F.col("status").alias("_status"), F.col("assigned_to").alias("_assigned"),
        F.col("domain").alias("_domain"), F.col("updated_at").alias("_edited_at"),
    )
    present = [F.col(s) if s in stored.columns else F.lit(False) for s in SIGNALS]
    old = {c: F.col(c) if c in stored.columns else F.lit(None) for c in ("assigned_to", "domain")}
    return (
        stored.join(newest, "content_id", "left")
        .withColumns({
            "assigned_to": F.coalesce(F.col("_assigned"), old["assigned_to"]),
            "manual_status": F.col("_status"),
            "domain": F.coalesce(F.col("_domain"), old["domain"]),
            "live_updated_at": F.coalesce("_edited_at", "ticket_updated_at"),
            "ticket_status": rules.live_status(
                rules.staff_engaged(*present), F.col("_status"), F.col("ticket_status")),
        })
        .drop("_status", "_assigned", "_domain", "_edited_at", "difficulty", "team_comment_replied")
    )
