"""What the team looks at: filtered lists, details, histories, grouped lists, searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions import clock
from triage.functions.status import is_open
from triage.functions.text import (
    found_in, full_name, is_blank, prefixed, preview, strip_html, trim_all,
)
from triage.operators.joins import DEFAULT_BROADCAST_ROWS, IdSet, is_small, latest_per_key, not_in
from triage.operators.staging import of_tenant
from triage.operators.tickets import live_tickets, newest_first, oldest_first, overlay

# A list up to this long fetches its bodies by id: some megabytes of ids.
LIST_ROWS = 100_000


@dataclass(frozen=True)
class QueueFilter:
    """Optional conditions of a ticket list; what is unset or "All" does not filter."""

    status: str | None = None
    assignee: str | None = None
    member_id: str | int | None = None
    urgency: str | None = None
    domain: str | None = None
    date_from: Column | str | None = None
    date_to: Column | str | None = None

    def stored_conditions(self, keyed: bool) -> list[Column]:
        """What can be asked of the stored rows themselves, below overlay and de-duplication.

        A lower bound in time commutes with "the newest copy counts". An upper bound and the author
        do not, as an older copy might meet them: they need a table with one row for each item.
        """
        out = []
        if self.date_from is not None:
            out.append(F.to_date("created_at") >= _day(self.date_from))
        if keyed and self.date_to is not None:
            out.append(F.to_date("created_at") <= _day(self.date_to))
        if keyed and _asked(self.member_id):
            out.append(F.col("member_id").cast("string") == str(self.member_id))
        return out

    def conditions(self, now: Column) -> list[Column]:
        out = []
        if _asked(self.status):
            out.append(F.col("ticket_status") == self.status)
        else:
            out.append(~F.col("ticket_status").isin(*v.FEEDBACK_STATUSES))
        if _asked(self.assignee):
            out.append(F.col("assigned_to") == self.assignee)
        if _asked(self.member_id):
            out.append(F.col("member_id").cast("string") == str(self.member_id))
        if _asked(self.domain):
            out.append(F.col("domain") == self.domain)
        if self.date_from is not None:
            out.append(F.to_date("created_at") >= _day(self.date_from))
        if self.date_to is not None:
            out.append(F.to_date("created_at") <= _day(self.date_to))
        if _asked(self.urgency) and str(self.urgency).lower() in v.URGENCY_RANK:
            out.append(clock.urgency_is(str(self.urgency).lower(), F.col("created_at"), now))
        return out


def _asked(value: object) -> bool:
    return value is not None and value != "" and value != "All"


def _day(bound: Column | str) -> Column:
    return bound if isinstance(bound, Column) else F.lit(bound).cast("date")


def with_list_columns(tickets: DataFrame, now: Column, length: int = v.LIST_PREVIEW) -> DataFrame:
    return tickets.withColumns({
        "body_preview": preview(F.col("body"), length),
        "urgency": clock.urgency(F.col("created_at"), now),
    })


def ticket_queue(stored: DataFrame, edits: DataFrame, now: Column, wanted: QueueFilter = QueueFilter(),
                 keyed: bool = False, max_rows: int = LIST_ROWS, settled: bool = False) -> DataFrame:
    """Live tickets that meet every condition, newest first.

    Conditions on the stored rows reach the scan, and what they leave is counted. Where that is little
    already (a fifth of ``max_rows``, one row for each item), the narrow list itself meets the bodies, which
    stay where they are, and is put in order in one place: it is made once. Else the other conditions run
    without the bodies, and the rows that are left are counted: a short list (``max_rows``) sends its ids
    to the bodies; a long one carries the bodies along, once. A row is known by its item and a hash of its
    narrow columns, so title and body are always of one stored row.
    """
    rows = stored
    for condition in wanted.stored_conditions(keyed):
        rows = rows.filter(condition)
    narrow = [c for c in stored.columns if c != "body"]
    marked = rows.withColumn("_row", F.xxhash64(*narrow))
    kept = _meeting(live_tickets(marked.drop("body"), edits, keyed, settled), wanted, now)
    if keyed and is_small(rows.select("content_id"), max_rows // 5):
        listed = marked.select("content_id", "_row", "body").join(F.broadcast(kept), ["content_id", "_row"])
        whole = listed.select(*(c for c in stored.columns if c in listed.columns), *(c for c in kept.columns if c not in stored.columns))
        return with_list_columns(whole.drop("_row", "live_updated_at"), now).repartition(1).orderBy(*newest_first())
    ids = kept.select("content_id", "_row")
    carried = _meeting(live_tickets(rows, edits, keyed, settled), wanted, now).drop("live_updated_at")
    if not is_small(ids, max_rows):
        return with_list_columns(carried, now).orderBy(*newest_first())
    bodies = marked.select("content_id", "_row", "body").join(F.broadcast(ids), ["content_id", "_row"], "left_semi")
    if not keyed:  # copies that differ in nothing but the body
        bodies = latest_per_key(bodies, ["content_id", "_row"], [F.col("body").desc_nulls_last()])
    fetched = kept.join(bodies, ["content_id", "_row"]).select(*carried.columns)
    return with_list_columns(fetched, now).orderBy(*newest_first())


def _meeting(live: DataFrame, wanted: QueueFilter, now: Column) -> DataFrame:
    for condition in wanted.conditions(now):
        live = live.filter(condition)
    return live


def ticket_detail(stored: DataFrame, edits: DataFrame, now: Column, ids: DataFrame, settled: bool = False) -> DataFrame:
    """Tickets of a set of ids, whole; both sides are narrowed before they meet."""
    asked = ids.select("content_id")
    wanted = overlay(stored.join(asked, "content_id", "left_semi"), edits.join(asked, "content_id", "left_semi"), settled)
    return wanted.withColumn("urgency", clock.urgency(F.col("created_at"), now)).drop("live_updated_at")


def member_thread_tickets(stored: DataFrame, edits: DataFrame, now: Column, pairs: DataFrame, keyed: bool = False,
                          settled: bool = False) -> DataFrame:
    """Every ticket of the given (thread, member) pairs, whatever its status, oldest first."""
    asked = pairs.select("thread_id", "member_id")
    wanted = live_tickets(stored.join(asked, ["thread_id", "member_id"], "left_semi"), edits, keyed, settled)
    return (
        with_list_columns(wanted, now, v.GROUP_PREVIEW)
        .drop("live_updated_at")
        .orderBy("thread_id", "member_id", *oldest_first())
    )


def split_open(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("is_open", is_open(F.col("ticket_status")))


def member_history(tickets: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Every member's tickets under their stored status, newest first; ``exclude`` leaves ids out."""
    rows = tickets.filter(F.col("member_id").isNotNull())
    if exclude is not None:
        rows = rows.join(exclude.select("content_id"), "content_id", "left_anti")
    return rows.select(
        "member_id", "content_id", "content_type",
        preview(F.col("body"), v.LIST_PREVIEW).alias("body_preview"), "created_at", "ticket_status",
    ).orderBy("member_id", *newest_first())


def ticket_comments(comments: DataFrame) -> DataFrame:
    """Internal notes of every ticket, oldest first."""
    return comments.select("comment_id", "content_id", "author", "body", "created_at").orderBy(
        "content_id", F.col("created_at").asc_nulls_first(), "comment_id"
    )


def review_queue(tickets: DataFrame) -> DataFrame:
    """Items the score rejected and nobody has looked at, newest first."""
    waiting = (F.col("ticket_status") == "not_a_question") & F.col("manual_status").isNull()
    return tickets.filter(waiting).orderBy(*newest_first())


def review_progress(tickets: DataFrame) -> DataFrame:
    """How many rejected items were reviewed, how many remain, and the reviewed share."""
    waiting = (F.col("ticket_status") == "not_a_question") & F.col("manual_status").isNull()
    reviewed = F.col("manual_status").isin(*v.FEEDBACK_STATUSES)
    counts = tickets.agg(F.count_if(reviewed).alias("reviewed"), F.count_if(waiting).alias("remaining"))
    total = F.col("reviewed") + F.col("remaining")
    return counts.withColumns({
        "total": total,
        "progress": F.when(total == 0, 1.0).otherwise(F.col("reviewed") / total),
    })


def queue_grouped(stored: DataFrame, edits: DataFrame, now: Column, wanted: QueueFilter = QueueFilter(),
                  keyed: bool = False, settled: bool = False) -> DataFrame:
    """The queue with one row per member and thread; one scan, bodies are cut to previews in it."""
    short = stored.withColumn("body", preview(F.col("body"), v.LIST_PREVIEW))
    for condition in wanted.stored_conditions(keyed):
        short = short.filter(condition)
    return group_queue(with_list_columns(_meeting(live_tickets(short, edits, keyed, settled), wanted, now), now))


def group_queue(queue: DataFrame) -> DataFrame:
    """One row per member and thread, with what its newest ticket shows.

    A ticket without a thread stands alone. Every aggregate combines on the map side, and only
    the short preview travels, so a busy member or thread costs no more than a quiet one.
    """
    alone = is_blank(F.col("thread_id"))
    newest = F.struct(
        "created_at", "content_id", "member_name", "body_preview", "domain", "ticket_status",
        "permalink", "assigned_to",
    )
    grouped = (
        queue.withColumns({
            "_lone": F.when(alone, F.col("content_id")),
            "_thread": F.when(~alone, F.col("thread_id")),
        })
        .groupBy("member_id", F.col("_thread").alias("thread_id"), "_lone")
        .agg(
            F.count("*").alias("tickets"),
            F.count_if(is_open(F.col("ticket_status"))).alias("open_tickets"),
            F.max(clock.urgency_rank(F.col("urgency"))).alias("_rank"),
            F.max(newest).alias("_newest"),
        )
    )
    return grouped.select(
        "member_id", "thread_id", "tickets", "open_tickets",
        clock.urgency_name(F.col("_rank")).alias("worst_urgency"),
        F.col("_newest.content_id").alias("newest_content_id"),
        F.col("_newest.created_at").alias("newest_created_at"),
        "_newest.member_name", "_newest.body_preview", "_newest.domain", "_newest.ticket_status",
        "_newest.permalink", "_newest.assigned_to",
    )


def coach_roster(coaches: DataFrame, core_members: DataFrame, tenant: str) -> DataFrame:
    """Every coach with the profile they have in the tenant, if any."""
    profiles = of_tenant(core_members, tenant).select(
        F.col("member_id").alias("_id"), "member_id", "first_name", "last_name", "network_role",
        "member_type", "avatar_url", F.col("permalink").alias("member_permalink"),
    )
    coach = coaches.select(F.col("member_id").alias("_coach"), "full_name",
                           F.col("email").alias("email_address"))
    return coach.join(profiles, F.col("_coach") == F.col("_id"), "left").select(
        "member_id", "first_name", "last_name", "full_name", "email_address", "network_role",
        "member_type", "avatar_url", "member_permalink",
    )


def coach_list(coaches: DataFrame) -> DataFrame:
    return coaches.select("member_id", "full_name", "email", "added_at", "added_by").orderBy(
        F.col("added_at").desc_nulls_last(), "member_id"
    )


def coach_names(coaches: DataFrame) -> DataFrame:
    return coaches.select("full_name").orderBy("full_name")


def member_search(core_members: DataFrame, coaches: IdSet, tenant: str, term: str,
                  limit: int = 20, wildcards: bool = True) -> DataFrame:
    """First ``limit`` active members whose name or address holds ``term``; coaches are left out."""
    name = full_name(F.col("first_name"), F.col("last_name"))
    hits = of_tenant(core_members, tenant).filter(
        (F.lower("member_status") == "active")
        & (found_in(name, term, wildcards) | found_in(F.col("email_address"), term, wildcards))
    )
    others = not_in(hits, "member_id", coaches)
    ordered = others.orderBy(
        F.col("last_name").asc_nulls_first(), F.col("first_name").asc_nulls_first(), "member_id"
    )
    return ordered.limit(limit).select(
        "member_id", trim_all(name).alias("full_name"), "email_address", "network_role", "join_date"
    )


def thread_items(core_posts: DataFrame, core_comments: DataFrame, tenant: str,
                 core_articles: DataFrame | None = None) -> DataFrame:
    """Everything that conversations show, but for names: roots (depth 0) and their active comments.

    Roots keep whatever status they have; a comment counts for the post its target id names. Texts are
    as they are stored, in ``_text``.
    """

    def item(rows: DataFrame, kind: str, key: str, thread: Column, author: str, text: str,
             depth: Column, reply_to: Column) -> DataFrame:
        return rows.select(
            thread.alias("thread_id"),
            prefixed(kind, F.col(key)).alias("content_id"),
            F.lit(kind).alias("content_type"),
            depth.cast("bigint").alias("depth"),
            reply_to.cast("bigint").alias("reply_to_id"),
            F.col(author).alias("author_id"),
            F.col(text).alias("_text"),
            "permalink", "created_at",
        )

    none = F.lit(None)
    posts = of_tenant(core_posts, tenant)
    comments = of_tenant(core_comments, tenant).filter(F.col("comment_status") == "active")
    items = item(posts, v.POST, "post_id", prefixed(v.POST, F.col("post_id")), "creator_id",
                 "description", F.lit(0), none)
    items = items.unionByName(
        item(comments, v.COMMENT, "comment_id", prefixed(v.POST, F.col("targetable_id")), "author_id",
             "comment_text", F.col("depth"), F.col("reply_to_id")))
    if core_articles is not None:
        items = items.unionByName(
            item(of_tenant(core_articles, tenant), v.ARTICLE, "article_id",
                 prefixed(v.ARTICLE, F.col("article_id")), "creator_id", "description", F.lit(0), none))
    return items


def thread_order() -> list[Column]:
    return [F.col("thread_id").asc(), F.col("created_at").asc_nulls_first(), F.col("depth").asc_nulls_first(), F.col("content_id").asc()]


def shown_text() -> Column:
    return strip_html(F.coalesce("_text", F.lit("")))


def _named(items: DataFrame, core_members: DataFrame, tenant: str, max_rows: int) -> DataFrame:
    """Items with ``_name`` and ``_staff`` of their authors; names are broadcast if counted few."""
    people = of_tenant(core_members, tenant).select(
        F.col("member_id").alias("author_id"),
        trim_all(full_name(F.col("first_name"), F.col("last_name"))).alias("_name"),
        F.col("network_role").isin(*v.STAFF_ROLES).alias("_staff"),
    )
    if is_small(people, max_rows):
        return items.join(F.broadcast(people), "author_id", "left")
    authors = items.select("content_id", "author_id").filter(F.col("author_id").isNotNull()).distinct()
    return items.join(authors.join(people, "author_id"), ["content_id", "author_id"], "left")


def _timeline_columns(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select(
        "thread_id", "content_id", "content_type", "depth", "reply_to_id", "author_id",
        F.coalesce("_name", F.lit("")).alias("author_name"),
        F.when(F.col("_staff"), "team").otherwise("member").alias("author_type"),
        text.alias("body"), "permalink", "created_at",
    )


def thread_timeline(core_posts: DataFrame, core_comments: DataFrame, core_members: DataFrame,
                    tenant: str, core_articles: DataFrame | None = None,
                    threads: IdSet | None = None, max_rows: int = DEFAULT_BROADCAST_ROWS // 10) -> DataFrame:
    """All conversations at once: root (depth 0), then its active comments by time and depth.

    The final order is by the whole key, so a range exchange may cut one long thread in many
    places; no thread has to fit one task. Names are broadcast if counted few (``max_rows``), else they
    are joined to the ids of items and come to the texts by item, so that no author's texts gather in
    one place. ``threads`` narrows the output to given thread ids.
    """
    items = thread_items(core_posts, core_comments, tenant, core_articles)
    if threads is not None:
        items = items.join(threads.side, "thread_id", "left_semi")
    ordered = _named(items, core_members, tenant, max_rows).orderBy(*thread_order())
    # Texts are cleaned above the sort: its sampling pass reads the rows once more.
    return _timeline_columns(ordered, shown_text())


def stored_threads(stored: DataFrame, core_members: DataFrame, tenant: str, threads: list[str] | None = None,
                   max_rows: int = DEFAULT_BROADCAST_ROWS // 10) -> DataFrame:
    """Conversations out of the table that ``jobs.store_threads`` lays out by thread and time.

    The condition on ``threads`` reaches the scan, which skips files and row groups of other threads by their
    statistics; texts stay in the tasks that read them, in the order they are stored in. A reader of several
    tasks' rows sorts by ``thread_order``.
    """
    rows = stored if threads is None else stored.filter(F.col("thread_id").isin(threads))
    return _timeline_columns(_named(rows, core_members, tenant, max_rows), F.col("body"))


def thread_ids_of(references: DataFrame, core_comments: DataFrame, tenant: str) -> DataFrame:
    """Thread ids for references that may still be comment ids; unknown comments give no row."""

    parents = of_tenant(core_comments, tenant).select(
        prefixed(v.COMMENT, F.col("comment_id")).alias("thread_id"),
        prefixed(v.POST, F.col("targetable_id")).alias("_post"),
    )
    looked_up = references.select("thread_id").join(parents, "thread_id", "left")
    is_comment = F.col("thread_id").startswith(v.COMMENT + "_")
    return looked_up.select(
        F.when(is_comment, F.col("_post")).otherwise(F.col("thread_id")).alias("thread_id")
    ).filter(F.col("thread_id").isNotNull()).distinct()
