"""Has staff touched an item, how, and when first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions.text import prefixed
from triage.operators.joins import IdSet
from triage.operators.staging import of_tenant

SIGNALS = ("team_commented", "team_comment_replied", "team_reacted")


def team_engagement(core_comments: DataFrame, core_reactions: DataFrame, staff: IdSet,
                    tenant: str) -> DataFrame:
    """One row per touched item.

    The three signals are tagged, stacked and grouped once. ``bool_or`` and ``min`` combine on
    the map side, so an item with a third of all reactions still sends one row per task, and the
    output stays partitioned by ``content_id`` for the ticket join.
    """
    comments = of_tenant(core_comments, tenant).filter(F.col("comment_status") == "active")
    by_staff = comments.join(staff.side, comments.author_id == staff.ids.member_id, "left_semi")
    answers_post = (F.col("depth") == 1) & (F.col("targetable_type") == "Post")
    answers_comment = (F.col("depth") == 2) & F.col("reply_to_id").isNotNull()
    commented = by_staff.filter(answers_post | answers_comment).select(
        F.when(answers_post, prefixed(v.POST, F.col("targetable_id")))
        .otherwise(prefixed(v.COMMENT, F.col("reply_to_id"))).alias("content_id"),
        "created_at",
        answers_post.alias("team_commented"),
        (~answers_post).alias("team_comment_replied"),
        F.lit(False).alias("team_reacted"),
    )

    reactions = of_tenant(core_reactions, tenant).filter(
        (F.col("reaction_status") == "active") & F.col("targetable_type").isin("Post", "Comment")
    )
    reacted = reactions.join(staff.side, "member_id", "left_semi").select(
        F.when(F.col("targetable_type") == "Post", prefixed(v.POST, F.col("targetable_id")))
        .otherwise(prefixed(v.COMMENT, F.col("targetable_id"))).alias("content_id"),
        "created_at",
        F.lit(False).alias("team_commented"),
        F.lit(False).alias("team_comment_replied"),
        F.lit(True).alias("team_reacted"),
    )

    return (
        commented.unionByName(reacted)
        .groupBy("content_id")
        .agg(*(F.bool_or(s).alias(s) for s in SIGNALS),
             F.min("created_at").alias("first_engagement_at"))
    )
