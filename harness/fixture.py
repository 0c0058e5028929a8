"""Community tables made from the given parquet tables, in Spark SQL and in DuckDB SQL.

One text per table serves both engines; only the four spellings in ``Dialect`` differ. Every
table is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from triage import vocabulary

TENANT = "tenant_a"
AS_OF = "2024-01-31 00:00:00"
STORED_UNTIL = "2024-01-20 00:00:00"
MONTH = 2592000
# Conversations opened one after the other.
OPENED = 8
# Searched besides parts of names: all, wildcards, too short to be rare, across both names, unknown.
SEARCH_TERMS = ("", "%", "7", "#0", "0_0%9@ex", "E #0", "nobody here", "@EXAMPLE.com")

# The given prose is invented, so a few words that do occur in it stand for some topics.
TOPIC_WORDS = {
    **vocabulary.TOPIC_WORDS,
    "Home & Housing Help": ("home", "der", "die", "und"),
    "Cars & Car Repairs": ("car", "les", "des", "que"),
    "Start A Business": ("business", "the", "that"),
    "Find Legal Help": ("legal", "license", "is", "was"),
    "Family & Children": ("family", "for", "with", "this"),
}


@dataclass(frozen=True)
class Dialect:
    spark_dir: str | None = None  # None: DuckDB
    # Row counts the texts need; DuckDB asks for them in place, Spark is given them.
    counts: dict[str, int] | None = None

    def t(self, name: str) -> str:
        return name if self.spark_dir is None else f"parquet.`{self.spark_dir}/{name}.parquet`"

    def rows(self, name: str) -> str:
        return f"(SELECT count(*) FROM {name})" if self.counts is None else str(self.counts[name])

    @property
    def conversations(self) -> str:
        if self.counts is None:
            return "(SELECT count(DISTINCT conv_id) FROM conversations)"
        return str(self.counts["conversations"])

    @property
    def text(self) -> str:
        return "VARCHAR" if self.spark_dir is None else "STRING"

    @property
    def newline(self) -> str:
        """The two characters of a JSON line break inside a SQL string."""
        return "\\n" if self.spark_dir is None else "\\\\n"

    def at(self, moment: str) -> str:
        return f"TIMESTAMP '{moment}'" if self.spark_dir is None else f"TIMESTAMP_NTZ '{moment}'"

    def after(self, seconds: str, start: str = "2024-01-01") -> str:
        if self.spark_dir is None:
            return f"{self.at(start)} + to_seconds({seconds})"
        return f"timestampadd(SECOND, {seconds}, {self.at(start)})"


def tables(d: Dialect) -> dict[str, str]:
    """SELECT text per table."""
    third = lambda whole: f"CAST(floor({whole} / 3) AS BIGINT)"
    # Seven neighbouring orders edit one item of each kind; a third of all items is edited.
    step = "CAST(floor(o_orderkey / 7) AS BIGINT)"
    item = lambda whole: f"3 * ({step} % {third(whole)})"
    return {
        "core_members": f"""
            SELECT CASE WHEN c_custkey % 20 = 19 THEN 'tenant_b' ELSE 'tenant_a' END AS client_id,
              c_custkey AS member_id,
              CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS first_name,
              CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE replace(c_name, 'Customer', '') END AS last_name,
              lower(c_name) || '@example.com' AS email_address,
              CASE WHEN c_custkey % 25 = 0 THEN 'host' WHEN c_custkey % 25 = 1 THEN 'moderator'
                   WHEN c_custkey % 25 IN (2, 3) THEN NULL ELSE 'member' END AS network_role,
              'standard' AS member_type,
              CASE WHEN c_custkey % 17 = 0 THEN 'inactive' ELSE 'Active' END AS member_status,
              'State-' || CAST(c_nationkey AS {d.text}) AS state,
              'City-' || CAST(c_nationkey AS {d.text}) || '-' || CAST(c_custkey % 7 AS {d.text}) AS city,
              'Country-' || CAST(c_nationkey % 5 AS {d.text}) AS country,
              CAST(NULL AS {d.text}) AS avatar_url,
              {d.after(f'c_custkey * 7919 % {MONTH}', '2023-01-01')} AS join_date,
              {d.after(f'c_custkey * 6271 % {MONTH}')} AS last_visited_network,
              'https://m.example.org/' || CAST(c_custkey AS {d.text}) AS permalink
            FROM {d.t('customer')}""",
        "info_avatars": f"""
            SELECT 'tenant_a' AS client_id, c_custkey AS member_id FROM {d.t('customer')} WHERE c_acctbal < -700""",
        "core_posts": f"""
            SELECT CASE WHEN page_id % 40 = 39 THEN 'tenant_b' ELSE 'tenant_a' END AS client_id,
              page_id AS post_id, (page_id * 31 + 4) % {d.rows('customer')} AS creator_id,
              page_id % 5 AS space_id, html AS description, url AS permalink,
              CASE WHEN page_id % 23 = 0 THEN 'deleted' ELSE 'active' END AS post_status,
              {d.after(f'page_id * 7919 % {MONTH}')} AS created_at,
              {d.after(f'page_id * 7919 % {MONTH} + 3600')} AS updated_at,
              {d.after(f'page_id * 7919 % {MONTH} + 86400')} AS last_activity_at
            FROM {d.t('pages')}""",
        "core_articles": f"""
            SELECT CASE WHEN doc_id % 40 = 39 THEN 'tenant_b' ELSE 'tenant_a' END AS client_id,
              doc_id AS article_id, (doc_id * 17 + 5) % {d.rows('customer')} AS creator_id,
              doc_id % 5 AS space_id, source || ' / ' || lang AS title,
              '<p>' || text || '</p>' AS description,
              'https://a.example.org/' || CAST(doc_id AS {d.text}) AS permalink,
              CASE WHEN doc_id % 19 = 0 THEN 'archived' ELSE 'active' END AS article_status,
              {d.after(f'doc_id * 5003 % {MONTH}')} AS created_at,
              {d.after(f'doc_id * 5003 % {MONTH} + 3600')} AS updated_at,
              {d.after(f'doc_id * 5003 % {MONTH} + 86400')} AS last_activity_at
            FROM {d.t('documents')}""",
        "core_comments": f"""
            SELECT 'tenant_a' AS client_id, conv_id * 100 + turn AS comment_id,
              CASE WHEN conv_id % 15 = 14 THEN 'Article' ELSE 'Post' END AS targetable_type,
              conv_id AS targetable_id,
              CASE role WHEN 'assistant' THEN (conv_id * 25) % {d.rows('customer')}
                        WHEN 'system' THEN (conv_id * 25 + 1) % {d.rows('customer')}
                        ELSE (conv_id * 7 + 5) % {d.rows('customer')} END AS author_id,
              conv_id % 5 AS space_id, '<div>' || text || '</div>' AS comment_text,
              'https://c.example.org/' || CAST(conv_id * 100 + turn AS {d.text}) AS permalink,
              CASE WHEN (conv_id + turn) % 31 = 0 THEN 'hidden' ELSE 'active' END AS comment_status,
              CASE WHEN turn >= 2 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS depth,
              CASE WHEN turn >= 2 THEN conv_id * 100 + turn - 1 ELSE NULL END AS reply_to_id,
              {d.after(f'conv_id * 7919 % {MONTH} + (turn + 1) * 780')} AS created_at,
              {d.after(f'conv_id * 7919 % {MONTH} + (turn + 1) * 780 + 60')} AS updated_at
            FROM {d.t('conversations')}""",
        "core_reactions": f"""
            SELECT 'tenant_a' AS client_id, user_id AS member_id,
              CASE event_type WHEN 'click' THEN 'Post' WHEN 'purchase' THEN 'Comment' ELSE 'Article' END
                AS targetable_type,
              CASE event_type WHEN 'purchase' THEN (event_id % {d.conversations}) * 100 + event_id % 8
                   ELSE event_id * 13 % {d.rows('pages')} END AS targetable_id,
              CASE WHEN event_id % 3 = 0 THEN 'active' ELSE 'removed' END AS reaction_status, ts AS created_at
            FROM {d.t('events')}""",
        "ticket_metadata_log": f"""
            SELECT CASE o_orderkey % 3
                WHEN 0 THEN 'post_' || CAST({item(d.rows('pages'))} AS {d.text})
                WHEN 1 THEN 'article_' || CAST({item(d.rows('documents'))} AS {d.text})
                ELSE 'comment_' || CAST({item(d.conversations)} * 100 + o_custkey % 8 AS {d.text}) END AS content_id,
              CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'closed'
                ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'cancelled' WHEN '2-HIGH' THEN 'not_a_question'
                  WHEN '3-MEDIUM' THEN 'confirmed_question' WHEN '4-NOT SPECIFIED' THEN 'assigned' ELSE '' END
                END AS status,
              CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
                ELSE 'Coach#' || CAST(o_custkey % 7 AS {d.text}) END AS assigned_to,
              {d.after(f'o_orderkey * 6271 % {MONTH}')} AS updated_at,
              CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 5 = 1 THEN 'Other' ELSE NULL END AS domain,
              CASE WHEN o_orderkey % 2 = 0 THEN 'note ' || CAST(o_orderkey AS {d.text})
                   WHEN o_orderkey % 5 = 0 THEN '' ELSE NULL END AS feedback_reason
            FROM {d.t('orders')}""",
        "ticket_comments": f"""
            SELECT CAST(conv_id AS {d.text}) || '-' || CAST(turn AS {d.text}) AS comment_id,
              'post_' || CAST(conv_id AS {d.text}) AS content_id,
              'Coach#' || CAST(conv_id % 7 AS {d.text}) AS author, text AS body,
              {d.after(f'(conv_id * 100 + turn) * 6271 % {MONTH}')} AS created_at
            FROM {d.t('conversations')} WHERE role <> 'user'""",
        # The last versions begin after all data, so nothing falls to them.
        "prompt_config": f"""
            SELECT 'question_classifier_v' || CAST(s_suppkey + 1 AS {d.text}) AS prompt_id,
              'Prompt of ' || s_name AS prompt_text, s_suppkey + 1 AS version,
              'reason ' || s_name AS change_reason,
              {d.after(f"s_suppkey * CAST(floor(2800000 / {d.rows('supplier')}) AS BIGINT)")} AS created_at,
              'fixture' AS created_by
            FROM {d.t('supplier')}""",
        "member_assignment_overrides": f"""
            SELECT s_suppkey * 3 AS member_id, s_name AS assigned_to,
              {d.at('2024-01-20')} AS updated_at, 'admin' AS updated_by FROM {d.t('supplier')}""",
        "coaches": f"""
            SELECT c_custkey AS member_id, c_name AS full_name, lower(c_name) || '@example.com' AS email,
              {d.after('c_custkey * 60')} AS added_at, 'admin' AS added_by
            FROM {d.t('customer')} WHERE c_acctbal > 9600
            UNION ALL SELECT CAST(-1 AS BIGINT), 'Unmatched Coach', 'none@example.com', {d.at('2024-01-01')}, 'admin'""",
        "topic_labels": f"""
            SELECT 'article_' || CAST(doc_id AS {d.text}) AS content_id,
              CASE WHEN quality = 1 AND toxic = 0 THEN 'Other' WHEN toxic = 1 THEN 'Community Support' END AS domain,
              {d.at('2024-01-15')} AS labeled_at
            FROM {d.t('labels')}""",
        # Model answers as they come back: reason line and prompt inside a JSON envelope.
        "prompt_responses": f"""
            SELECT conv_id * 100 + turn AS response_id,
              {d.after(f'(conv_id * 100 + turn) * 6271 % {MONTH}')} AS responded_at,
              '{{"candidates":[{{"content":{{"parts":[{{"text":"'
                || CASE WHEN turn % 4 = 1 THEN 'CHANGE_REASON: No change' WHEN turn % 4 = 3 THEN ''
                        ELSE 'change_reason:  pattern ' || CAST(conv_id AS {d.text}) || ' ' END || '{d.newline}'
                || trim(regexp_replace(text, '[^A-Za-z0-9 .,]', ' '{", 'g'" if d.spark_dir is None else ""}))
                || '"}}]}}}}]}}' AS result
            FROM {d.t('conversations')} WHERE role <> 'system'""",
    }


def spark_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy tables; only five row counts are taken beforehand, so that the plans need no subqueries."""
    sf_dir = sf_dir.rstrip("/")
    given = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    counts = {name: given(name).count() for name in ("customer", "pages", "documents", "supplier")}
    counts["conversations"] = given("conversations").select("conv_id").distinct().count()
    return {name: spark.sql(text) for name, text in tables(Dialect(sf_dir, counts)).items()}
