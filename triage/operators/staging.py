"""Cleaning: community tables of one tenant become one pool of member items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions.text import full_name, prefixed, strip_html
from triage.operators.joins import IdSet, not_in
from triage.schemas import CONTENT_COLUMNS


def of_tenant(table: DataFrame, tenant: str) -> DataFrame:
    return table.filter(F.col("client_id") == tenant)


def staff_ids(core_members: DataFrame, tenant: str) -> DataFrame:
    return (
        of_tenant(core_members, tenant)
        .filter(F.col("network_role").isin(*v.STAFF_ROLES))
        .select("member_id")
    )


def bot_ids(info_avatars: DataFrame, tenant: str) -> DataFrame:
    return of_tenant(info_avatars, tenant).select("member_id")


def clean_posts(core_posts: DataFrame, excluded: IdSet, tenant: str) -> DataFrame:
    active = of_tenant(core_posts, tenant).filter(F.col("post_status") == "active")
    key = prefixed(v.POST, F.col("post_id"))
    return _as_content(
        not_in(active, "creator_id", excluded),
        v.POST, key, thread=key, member="creator_id", text="description",
    )


def clean_articles(core_articles: DataFrame, excluded: IdSet, tenant: str) -> DataFrame:
    active = of_tenant(core_articles, tenant).filter(F.col("article_status") == "active")
    key = prefixed(v.ARTICLE, F.col("article_id"))
    return _as_content(
        not_in(active, "creator_id", excluded),
        v.ARTICLE, key, thread=key, member="creator_id", text="description", title=F.col("title"),
    )


def clean_comments(core_comments: DataFrame, excluded: IdSet, tenant: str) -> DataFrame:
    """Only comments under posts; they have no activity time of their own."""
    active = of_tenant(core_comments, tenant).filter(
        (F.col("comment_status") == "active") & (F.col("targetable_type") == "Post")
    )
    return _as_content(
        not_in(active, "author_id", excluded),
        v.COMMENT, prefixed(v.COMMENT, F.col("comment_id")),
        thread=prefixed(v.POST, F.col("targetable_id")),
        member="author_id", text="comment_text", last_activity=F.col("created_at"),
    )


def _as_content(rows: DataFrame, kind: str, key: Column, *, thread: Column, member: str, text: str,
                title: Column | None = None, last_activity: Column | None = None) -> DataFrame:
    return rows.select(
        key.alias("content_id"),
        thread.alias("thread_id"),
        F.lit(kind).alias("content_type"),
        F.col(member).alias("member_id"),
        "space_id",
        (F.lit(None).cast("string") if title is None else title).alias("title"),
        strip_html(F.col(text)).alias("body"),
        "permalink",
        "created_at",
        "updated_at",
        (F.col("last_activity_at") if last_activity is None else last_activity).alias("last_activity_at"),
    ).select(*CONTENT_COLUMNS)


def candidates(*cleaned: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, cleaned)


def newer_than(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows created after the newest stored one; all of them when nothing is stored.

    The mark is a scalar subquery: one value reaches the scan, no rows do. Rows without a
    creation time and late rows are left behind, as a high-water mark does.
    """
    mark = stored.agg(F.max("created_at")).scalar()
    empty = stored.agg(F.count("*") == 0).scalar()
    return rows.filter(empty | (F.col("created_at") > mark))


def members(core_members: DataFrame, bots: IdSet, tenant: str) -> DataFrame:
    """Profiles of everyone who is neither staff nor bot; the full name keeps its outer blanks."""
    role = F.col("network_role")
    regular = of_tenant(core_members, tenant).filter(role.isNull() | ~role.isin(*v.STAFF_ROLES))
    return not_in(regular, "member_id", bots).select(
        "member_id", "first_name", "last_name",
        full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "email_address", "state", "city", "country", "member_status", "avatar_url",
        "join_date", "last_visited_network", F.col("permalink").alias("member_permalink"),
    )


def thread_backfill(items: DataFrame, core_comments: DataFrame, tenant: str) -> DataFrame:
    """Fill missing thread ids: a comment's thread is its post, anything else is its own.

    Only the two ids of the comments are read; the items stay on the left of the join.
    """
    parents = of_tenant(core_comments, tenant).select(
        prefixed(v.COMMENT, F.col("comment_id")).alias("content_id"),
        prefixed(v.POST, F.col("targetable_id")).alias("_post"),
    )
    filled = F.coalesce("thread_id", "_post", "content_id")
    return items.join(parents, "content_id", "left").withColumn("thread_id", filled).drop("_post")


def thread_audit(core_comments: DataFrame, tenant: str) -> DataFrame:
    """Per depth: rows, replies set and unset, targets that are not posts."""
    return of_tenant(core_comments, tenant).groupBy("depth").agg(
        F.count("*").alias("comments"),
        F.count_if(F.col("reply_to_id").isNull()).alias("without_reply_to"),
        F.count("reply_to_id").alias("with_reply_to"),
        F.count_if(F.col("targetable_type") != "Post").alias("not_under_post"),
    )
