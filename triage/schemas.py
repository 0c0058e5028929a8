"""Column types of every stored table. ``_ntz`` columns hold UTC wall time."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def schema_of(columns: str) -> T.StructType:
    """``"name type [not null], ..."`` as a schema; unlike ``fromDDL`` this needs no session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *constraint = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=constraint != ["not", "null"]))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    # Community tables, written upstream.
    "core_posts": schema_of(
        "client_id string, post_id bigint, creator_id bigint, space_id bigint, description string, "
        "permalink string, post_status string, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "last_activity_at timestamp_ntz"
    ),
    "core_articles": schema_of(
        "client_id string, article_id bigint, creator_id bigint, space_id bigint, title string, "
        "description string, permalink string, article_status string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, last_activity_at timestamp_ntz"
    ),
    "core_comments": schema_of(
        "client_id string, comment_id bigint, targetable_type string, targetable_id bigint, "
        "author_id bigint, space_id bigint, comment_text string, permalink string, comment_status string, "
        "depth bigint, reply_to_id bigint, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "core_reactions": schema_of(
        "client_id string, member_id bigint, targetable_type string, targetable_id bigint, "
        "reaction_status string, created_at timestamp_ntz"
    ),
    "core_members": schema_of(
        "client_id string, member_id bigint, first_name string, last_name string, email_address string, "
        "network_role string, member_type string, member_status string, state string, city string, "
        "country string, avatar_url string, join_date timestamp_ntz, last_visited_network timestamp_ntz, "
        "permalink string"
    ),
    "info_avatars": schema_of("client_id string, member_id bigint"),
    # Tables the team writes.
    "ticket_metadata": schema_of(
        "content_id string not null, status string, assigned_to string, updated_at timestamp_ntz, "
        "difficulty string, domain string, feedback_reason string"
    ),
    "ticket_comments": schema_of(
        "comment_id string not null, content_id string not null, author string, body string, "
        "created_at timestamp_ntz"
    ),
    "member_assignment_overrides": schema_of(
        "member_id bigint not null, assigned_to string not null, updated_at timestamp_ntz not null, "
        "updated_by string"
    ),
    "app_logs": schema_of(
        "log_id string not null, created_at timestamp_ntz not null, level string not null, "
        "source string not null, message string not null, detail string"
    ),
    "coaches": schema_of(
        "member_id bigint, full_name string, email string, added_at timestamp_ntz, added_by string"
    ),
    "prompt_config": schema_of(
        "prompt_id string, prompt_text string, version bigint, change_reason string, "
        "created_at timestamp_ntz, created_by string"
    ),
    # Tables the jobs write.
    "question_scores": schema_of(
        "content_id string, content_type string, is_question boolean, classified_at timestamp_ntz"
    ),
    "topic_labels": schema_of("content_id string not null, domain string, labeled_at timestamp_ntz"),
}

# Columns every cleaned item has, whatever it was made from.
CONTENT_COLUMNS = (
    "content_id", "thread_id", "content_type", "member_id", "space_id", "title", "body",
    "permalink", "created_at", "updated_at", "last_activity_at",
)
