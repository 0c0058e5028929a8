"""Jobs that write: rebuild, ingest, label, roll the prompt forward, refresh after edits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.operators import edits, feedback, queues, scoring, staging, tickets, totals
from triage.operators.reports import status_remap
from triage.plans.workspace import Workspace
from triage.schemas import TABLES
from triage.settings import Settings
from triage.sources.store import VersionedTable


def rebuild(ws: Workspace, spark: SparkSession, root: str) -> None:
    """Replace every derived table. Each is read back, so later plans start from stored rows."""
    content = _replaced(spark, f"{root}/content", ws.content, by_day=True)
    engaged = _replaced(spark, f"{root}/team_engagement", ws.engagement)
    people = _replaced(spark, f"{root}/members", ws.members)
    refresh_tickets(ws, spark, root, content=content, engaged=engaged, people=people)


def refresh_tickets(ws: Workspace, spark: SparkSession, root: str, *, content: DataFrame,
                    engaged: DataFrame, people: DataFrame) -> DataFrame:
    """Only what an edit of an assignee changes: assignments, tickets and their totals."""
    assigned = _replaced(spark, f"{root}/member_assignments", tickets.member_assignments(
        content, ws.metadata, ws.inputs.member_assignment_overrides))
    rows = tickets.tickets(content, people, engaged, ws.metadata, ws.labels, assigned, ws.few_people)
    stored = _replaced(spark, f"{root}/tickets", rows, by_day=True)
    report_totals_table(spark, root).replace(totals.report_totals(stored))
    return stored


def report_totals_table(spark: SparkSession, root: str) -> VersionedTable:
    """Daily totals of the stored tickets, made with them; reports of any range read nothing else."""
    return VersionedTable(spark, f"{root}/report_totals", totals.REPORT_TOTALS)


# Of the stored texts that one range of conversations holds.
RANGE_CHARACTERS = 64_000_000


def store_threads(items: DataFrame, spark: SparkSession, root: str, files: int,
                  characters: int = RANGE_CHARACTERS) -> VersionedTable:
    """Conversations laid out for reading one at a time: ranges of the whole order of threads, each sorted;
    ``files`` of them, or more where texts are longer than ``characters`` each. Ranges follow the rows, so a
    long thread takes several files and short ones share one."""
    held = items.agg(F.coalesce(F.sum(F.length("_text").cast("bigint")), F.lit(0))).first()[0]
    ranges = max(files, -(-held // characters))
    # Texts are cleaned above the exchange, which samples the rows first.
    laid = items.repartitionByRange(ranges, *queues.thread_order()).sortWithinPartitions(*queues.thread_order())
    rows = laid.withColumn("body", queues.shown_text()).drop("_text")
    table = VersionedTable(spark, f"{root}/threads", T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
    table.replace(rows)
    return table


def _replaced(spark: SparkSession, path: str, rows: DataFrame, by_day: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    table = VersionedTable(spark, path, schema, by_day=by_day)
    table.replace(rows)
    return table.read()


def ingest(cleaned: DataFrame, table: VersionedTable, commit_key: str | None = None) -> bool:
    """Upsert what is newer than the newest stored row.

    Late and undated rows stay behind; the next ``rebuild``, or the stream, picks them up. The source
    fixes the creation time of an item, so an item never moves to another day.
    """
    fresh = staging.newer_than(cleaned, table.read())
    return table.upsert(fresh, "content_id", ["updated_at"], commit_key, key_moves=False)


def score_new(ws: Workspace, table: VersionedTable, commit_key: str | None = None,
              scorer: scoring.Scorer | None = None) -> bool:
    return table.upsert(ws.incremental_scores(table.read(), scorer), "content_id", commit_key=commit_key)


def label_new(ws: Workspace, table: VersionedTable, settings: Settings,
              commit_key: str | None = None, topic: Column | PipelineModel | None = None) -> bool:
    pending = scoring.unlabelled_questions(ws.content, table.read())
    return table.upsert(scoring.label_topics(pending, settings.now, topic), "content_id", commit_key=commit_key)


def roll_prompt_forward(ws: Workspace, responses: DataFrame, table: VersionedTable,
                        commit_key: str | None = None) -> bool:
    row = feedback.prompt_rollforward(table.read(), responses, ws.feedback, ws.settings.now)
    return table.upsert(row, "version", commit_key=commit_key)


def edits_table(spark: SparkSession, path: str, buckets: int, schema: T.StructType = TABLES["ticket_metadata"]) -> VersionedTable:
    """Where edits are kept, one row for each item. ``buckets`` stays as it is for good: a few hundred
    thousand items in each are rewritten at once, so choose it for the size the table may reach."""
    return VersionedTable(spark, path, schema, buckets=buckets, key="content_id")


def save_edits(changes: DataFrame, table: VersionedTable, commit_key: str | None = None) -> bool:
    """Edits of status, assignee, domain or reason; the newest per item is kept, by ``tickets.EDIT_ORDER``.

    The table is what ``tickets.latest_metadata`` finds among all edits ever made, brought up to date by
    each batch: however edits are split into batches and in whichever order these come.
    """
    order = [c for c in tickets.EDIT_ORDER if c in changes.columns]
    return table.upsert(changes, "content_id", order, commit_key)


def migrate_metadata(table: VersionedTable) -> bool:
    """Bring an older table to the current columns and status names."""
    widened = edits.with_columns_of(table.read(), TABLES["ticket_metadata"])
    return table.replace(status_remap(widened))
