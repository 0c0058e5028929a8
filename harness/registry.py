"""Every registered query: an operator over the tables of ``fixture``.

Views that a team reads all day come from stored content and tickets. Both are written once per
session and data folder to the session's shared folder and read back, as a cluster would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harness.fixture import AS_OF, OPENED, SEARCH_TERMS, STORED_UNTIL, TENANT, TOPIC_WORDS, spark_tables
from triage import vocabulary
from triage.functions import clock
from triage.functions.text import prefixed
from triage.operators import edits, feedback, joins, queues, reports, scoring, staging, tickets, totals, training
from triage.operators.queues import QueueFilter
from triage.plans.indicators import LiveIndicators
from triage.plans.jobs import edits_table, ingest, rebuild, report_totals_table, save_edits, store_threads
from triage.plans.mirror import SourceMirror
from triage.plans.search import MemberIndex
from triage.plans.workspace import Inputs, Rule, Workspace
from triage.schemas import CONTENT_COLUMNS, TABLES
from triage.settings import Settings, shared_dir, tune
from triage.sources import reader
from triage.sources.store import VersionedTable
from triage.streaming.streams import append_stream, read_files, upsert_stream

SETTINGS = Settings(tenant=TENANT, as_of=AS_OF)
# Of a table of edits; some hundred thousand rows each at the size they are meant for.
EDIT_BUCKETS = 16
THREAD_FILES = 8


def rule() -> Rule:
    """The scoring rule of the tests: the same answer in every engine."""
    return Rule(
        is_question=F.expr("length(body) % 4 <> 0"),
        classified_at=F.expr("created_at + INTERVAL 10 MINUTES"),
    )


_workspaces: dict[tuple[str, str], Workspace] = {}
_responses: dict[tuple[str, str], DataFrame] = {}
_served: dict[tuple[str, str], Workspace] = {}
_roots: dict[tuple[str, str], str] = {}
_indicators: dict[tuple[str, str], LiveIndicators] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The whole pipeline from raw tables, nothing stored."""
    key = _key(spark, sf_dir)
    if key not in _workspaces:
        made = spark_tables(tune(spark), sf_dir)
        made["ticket_metadata"] = made.pop("ticket_metadata_log")
        _responses[key] = made.pop("prompt_responses")
        _workspaces[key] = Workspace(Inputs(**made), SETTINGS, rule())
    return _workspaces[key]


def served(spark: SparkSession, sf_dir: str) -> Workspace:
    """The pipeline over stored content and tickets, as the rebuild job writes them, and over the newest
    edits, kept by three batches of which the latest came first."""
    key, raw = _key(spark, sf_dir), workspace(spark, sf_dir)
    if key not in _served:
        root = _roots[key] = scratch(spark, "stored")
        rebuild(raw, spark, root)
        content, stored = (VersionedTable(spark, f"{root}/{name}", _content_schema(rows), by_day=True).read()
                           for name, rows in (("content", raw.content), ("tickets", raw.rebuilt_tickets)))
        newest = edits_table(spark, f"{root}/edits", EDIT_BUCKETS, _content_schema(_log(raw)))
        for batch in _newest_come_first(_log(raw), "updated_at"):
            save_edits(batch, newest)
        _served[key] = Workspace(raw.inputs, SETTINGS, rule(), stored_content=content, stored_tickets=stored, keyed=True,
                                 newest_edits=newest.read())
    return _served[key]


def indicators(spark: SparkSession, sf_dir: str) -> LiveIndicators:
    """Totals that begin with the stored tickets and count three batches of edits, the latest first and one
    of them twice."""
    key, ws = _key(spark, sf_dir), served(spark, sf_dir)
    if key not in _indicators:
        made = LiveIndicators(spark, f"{_roots[key]}/indicators", EDIT_BUCKETS)
        made.rebuild(ws.tickets)
        batches = _newest_come_first(_log(ws), "updated_at")
        for number, batch in enumerate([*batches, batches[0]]):
            made.apply(batch, f"batch-{number % len(batches)}")
        _indicators[key] = made
    return _indicators[key]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/triage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _log(ws: Workspace) -> DataFrame:
    return ws.inputs.ticket_metadata


def _raw(fn: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(workspace(spark, sf_dir))


def _view(fn: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(served(spark, sf_dir))


def _queue(**wanted) -> Callable[[SparkSession, str], DataFrame]:
    return _view(lambda ws: queues.ticket_queue(
        ws.tickets, ws.edits, SETTINGS.now, QueueFilter(**wanted), ws.keyed, settled=ws.settled))


def _period(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        first, last = clock.period_bounds(name, SETTINGS.today)
        return _queue(date_from=first, date_to=last)(spark, sf_dir)

    return query


def _date(text: str):
    return F.lit(text).cast("date")


REPORT_DAYS = ("2024-01-01", "2024-01-31")


def _report(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return _view(lambda ws: fn(ws.tickets, _date(REPORT_DAYS[0]), _date(REPORT_DAYS[1])))


def _totalled(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        served(spark, sf_dir)
        kept = report_totals_table(spark, _roots[_key(spark, sf_dir)]).read()
        return fn(kept, _date(REPORT_DAYS[0]), _date(REPORT_DAYS[1]))

    return query


def _null_aware_anti(ws: Workspace) -> DataFrame:
    keyed = ws.inputs.core_members.withColumn(
        "_key", F.when(F.col("network_role").isNotNull(), F.col("member_id")))
    return joins.not_in(keyed, "_key", joins.IdSet.of(ws.inputs.coaches.select("member_id"))).select(
        "member_id", "email_address")


def _score_increment(ws: Workspace) -> DataFrame:
    stored = ws.scores.filter(F.col("classified_at") < F.lit(STORED_UNTIL).cast("timestamp_ntz"))
    return ws.incremental_scores(stored)


def _score_batches(ws: Workspace) -> DataFrame:
    """The rule once more, as a function of batches in the place of a hosted model."""
    scored = scoring.score_batches(ws.candidates, lambda rows: rows["body"].str.len() % 4 != 0, F.lit(AS_OF).cast("timestamp_ntz"))
    return scored.drop("classified_at")


def _scorer_ranking(ws: Workspace) -> DataFrame:
    """Scores of an invented model: a probability with many ties."""
    likely = ws.content.select("content_id", (F.pmod(F.length("body"), F.lit(23)) / 22).alias("probability"),
                               F.expr("created_at + INTERVAL 10 MINUTES").alias("classified_at"))
    return training.stored_ranking(ws.inputs.prompt_config, likely, ws.feedback)


def _pairs(ws: Workspace) -> DataFrame:
    return ws.posts.select("thread_id", "member_id").distinct()


def _ticket_urgency(ws: Workspace) -> DataFrame:
    made = F.col("created_at")
    return ws.tickets.select(
        "content_id", "created_at", clock.whole_hours(made, SETTINGS.now).alias("age_hours"),
        clock.urgency(made, SETTINGS.now).alias("urgency"))


def _member_threads(ws: Workspace) -> DataFrame:
    return queues.member_thread_tickets(ws.tickets, ws.edits, SETTINGS.now, _pairs(ws), ws.keyed, ws.settled)


def _thread_timeline(ws: Workspace) -> DataFrame:
    i = ws.inputs
    return queues.thread_timeline(i.core_posts, i.core_comments, i.core_members, TENANT, i.core_articles)


def _stored_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    i = ws.inputs
    items = queues.thread_items(i.core_posts, i.core_comments, TENANT, i.core_articles)
    return store_threads(items, spark, scratch(spark, "threads"), THREAD_FILES).read()


def _thread_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.stored_threads(_stored_threads(spark, sf_dir), workspace(spark, sf_dir).inputs.core_members, TENANT)


def _thread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of the latest edited posts, as a team member opens them."""
    ws = workspace(spark, sf_dir)
    posts = _log(ws).filter(F.col("content_id").startswith("post_")).groupBy("content_id").agg(F.max("updated_at").alias("at"))
    opened = [r.content_id for r in posts.orderBy(F.desc("at"), "content_id").limit(OPENED).collect()]
    return queues.stored_threads(_stored_threads(spark, sf_dir), ws.inputs.core_members, TENANT, opened)


def _thread_backfill(ws: Workspace) -> DataFrame:
    early = F.col("created_at") < F.lit(STORED_UNTIL).cast("timestamp_ntz")
    history = ws.candidates.select(
        "content_id", "content_type", F.when(~early, F.col("thread_id")).alias("thread_id"))
    return staging.thread_backfill(history, ws.inputs.core_comments, TENANT)


def _thread_lookup(ws: Workspace) -> DataFrame:
    asked = ws.candidates.select(F.col("content_id").alias("thread_id"))
    return queues.thread_ids_of(asked, ws.inputs.core_comments, TENANT)


def _status_remap(ws: Workspace) -> DataFrame:
    status = F.col("status")
    old = F.when(status == "assigned", "in_progress").when(status.isNull(), "open").when(status == "", "answered")
    return reports.status_remap(ws.metadata.withColumn("status", old.otherwise(status)))


def _column_audit(ws: Workspace) -> DataFrame:
    return reports.column_audit(ws.tickets.select(
        "content_type", "first_engagement_at", "ticket_status", "ticket_updated_at", "avatar_url"))


def _closed_without_comment(ws: Workspace) -> DataFrame:
    return reports.closed_without_comment(ws.tickets, _log(ws), ws.content)


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace(spark, sf_dir)
    return _responses[_key(spark, sf_dir)]


def _rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = served(spark, sf_dir)
    return feedback.prompt_rollforward(
        ws.inputs.prompt_config, _proposals(spark, sf_dir), ws.feedback, SETTINGS.now)


def _version_stats(ws: Workspace) -> DataFrame:
    return feedback.version_stats(ws.inputs.prompt_config, ws.scores, ws.feedback)


def _new_labels(ws: Workspace) -> DataFrame:
    return ws.new_labels(scoring.topic_by_words(F.col("body"), TOPIC_WORDS))


def _topic_labels(ws: Workspace) -> DataFrame:
    return edits.upsert(ws.labels, _new_labels(ws), "content_id")


def _topic_responses(ws: Workspace) -> DataFrame:
    """Half of the answers lack the label and must be left for the next run."""
    usable = F.length("content_id") % 2 == 0
    result = F.when(usable, F.to_json(F.struct("domain"))).otherwise('{"domain": null}')
    answered = _new_labels(ws).select("content_id", result.alias("result"))
    return scoring.labels_from_responses(answered, SETTINGS.now).drop("labeled_at")


def _upsert_metadata(ws: Workspace) -> DataFrame:
    late = F.col("updated_at") >= F.lit(STORED_UNTIL).cast("timestamp_ntz")
    return edits.upsert(_log(ws).filter(~late), _log(ws).filter(late), "content_id", tickets.EDIT_ORDER)


def _upsert_assignee(ws: Workspace) -> DataFrame:
    notes = ws.inputs.ticket_comments
    newest = joins.latest_per_key(
        notes, ["content_id"], [F.col("created_at").desc_nulls_last(), F.col("comment_id").desc()])
    changes = newest.select("content_id", F.col("author").alias("assigned_to"), F.col("created_at").alias("updated_at"))
    return edits.upsert(ws.metadata, changes, "content_id")


def _upsert_override(ws: Workspace) -> DataFrame:
    changes = ws.inputs.coaches.select(
        "member_id", F.col("full_name").alias("assigned_to"), F.col("added_at").alias("updated_at"),
        F.col("added_by").alias("updated_by"))
    return edits.upsert(ws.inputs.member_assignment_overrides, changes, "member_id")


def _bulk_status_update(ws: Workspace) -> DataFrame:
    requests = _pairs(ws).select(
        "thread_id", "member_id", F.lit("closed").alias("status"), F.lit("Coach#1").alias("assigned_to"),
        F.lit(None).cast("string").alias("domain"))
    return edits.upsert(ws.metadata, edits.bulk_status_changes(ws.live, requests, SETTINGS.now), "content_id")


def _delete_coach(ws: Workspace) -> DataFrame:
    gone = ws.inputs.core_members.filter(F.col("member_status") == "inactive")
    return edits.delete(ws.inputs.coaches, gone, "member_id")


def _append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "events")
    reader.create_if_absent(spark, path, TABLES["app_logs"])
    reader.append(_closed_without_comment(served(spark, sf_dir)), path, TABLES["app_logs"])
    return spark.read.schema(TABLES["app_logs"]).parquet(path)


def _content_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])


def _incremental_posts(ws: Workspace) -> DataFrame:
    stored = ws.posts.filter(F.col("created_at") < F.lit(STORED_UNTIL).cast("timestamp_ntz"))
    return staging.newer_than(ws.posts, stored)


def _incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the old items, then all newer ones, into a table with one folder per day."""
    ws = workspace(spark, sf_dir)
    table = VersionedTable(spark, scratch(spark, "content"), _content_schema(ws.candidates), by_day=True)
    table.replace(ws.candidates.filter(F.col("created_at") < F.lit(STORED_UNTIL).cast("timestamp_ntz")))
    ingest(ws.candidates, table)
    return table.read().select(*CONTENT_COLUMNS)


def _stream_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts land as files; the stream cleans and upserts them."""
    ws = workspace(spark, sf_dir)
    landing, out = scratch(spark, "landing"), scratch(spark, "posts")
    ws.inputs.core_posts.write.parquet(landing)
    stream = read_files(spark, landing, ws.inputs.core_posts.schema)
    table = VersionedTable(spark, out, _content_schema(ws.posts), by_day=True)
    query = upsert_stream(
        stream, table, "content_id", f"{out}-checkpoint", f"posts_{uuid.uuid4().hex}",
        transform=lambda rows: staging.clean_posts(rows, ws.excluded, TENANT),
        order=["updated_at"], key_moves=False)
    query.awaitTermination()
    return table.read()


def _last_snapshot(posts: DataFrame) -> DataFrame:
    """The posts as they may have been: some not yet there, some with another text, status, owner or time,
    some that are gone now."""
    key = F.col("post_id")
    there = posts.filter(key % 11 != 3).withColumns({
        "description": F.when(key % 7 == 1, F.concat("description", F.lit(" (before)"))).otherwise(F.col("description")),
        "post_status": F.when(key % 13 == 2, F.lit("draft")).otherwise(F.col("post_status")),
        "space_id": F.when(key % 17 == 4, F.lit(None)).otherwise(F.col("space_id")),
        "created_at": F.when(key % 19 == 5, F.expr("created_at - INTERVAL 3 DAYS")).otherwise(F.col("created_at"))})
    gone = posts.filter(key % 5 == 0).withColumns({"post_id": -key - 1, "post_status": F.lit("active")})
    return there.unionByName(gone)


def _mirror(spark: SparkSession, sf_dir: str) -> tuple[SourceMirror, Callable[[DataFrame], int], VersionedTable]:
    """A mirror that took over the last snapshot, how it takes the next one, and its content."""
    ws, root = workspace(spark, sf_dir), scratch(spark, "mirror")
    made = SourceMirror(spark, root, "post_id")
    content = VersionedTable(spark, f"{root}/posts", _content_schema(ws.posts), by_day=True)

    def take(snapshot: DataFrame) -> int:
        return made.sync(snapshot, lambda rows: staging.clean_posts(rows, ws.excluded, TENANT), content,
                         lambda key: prefixed(vocabulary.POST, key))

    take(_last_snapshot(ws.inputs.core_posts))
    return made, take, content


def _snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _, _ = _mirror(spark, sf_dir)
    return made.changes(workspace(spark, sf_dir).inputs.core_posts).select("key", "change")


def _snapshot_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, take, content = _mirror(spark, sf_dir)
    take(workspace(spark, sf_dir).inputs.core_posts)
    return content.read()


def _member_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms out of the tables, and some with wildcards, too short, or unknown."""
    ws = workspace(spark, sf_dir)
    index = MemberIndex(spark, scratch(spark, "member-index"), EDIT_BUCKETS)
    index.build(ws.inputs.core_members, TENANT)
    prompts, members = ws.inputs.prompt_config, ws.inputs.core_members
    terms = prompts.select(F.expr("right(prompt_text, 3)").alias("term")).unionByName(
        members.select(F.substring("first_name", 2, 5).alias("term"))).unionByName(
        spark.createDataFrame([(t,) for t in SEARCH_TERMS], "term string")).distinct()
    return index.search(terms, joins.IdSet.of(ws.inputs.coaches.select("member_id")))


def _newest_come_first(rows: DataFrame, at: str) -> list[DataFrame]:
    """Three deliveries: the latest days, the days before them, then the earliest and undated rows."""
    day = F.to_date(at)
    late, middle = day >= F.lit("2024-01-21").cast("date"), day >= F.lit("2024-01-11").cast("date")
    return [rows.filter(late), rows.filter(middle & ~late), rows.filter(~middle | day.isNull())]


def _stream_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits arrive in three deliveries, the newest first; a run takes each."""
    ws = workspace(spark, sf_dir)
    landing, out = scratch(spark, "landing"), scratch(spark, "metadata")
    schema = _content_schema(_log(ws))
    table = edits_table(spark, out, EDIT_BUCKETS, schema)
    for part in _newest_come_first(_log(ws), "updated_at"):
        part.write.mode("append").parquet(landing)
        upsert_stream(read_files(spark, landing, schema), table, "content_id", f"{out}-checkpoint", "edits",
                      order=tickets.EDIT_ORDER).awaitTermination()
    return table.read()


def _stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes arrive in three deliveries, the newest first; then all of them once more, with other times and
    with none."""
    notes = workspace(spark, sf_dir).inputs.ticket_comments
    landing, out = scratch(spark, "landing"), scratch(spark, "notes")
    undated = notes.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    shifted = notes.withColumn("created_at", F.expr("created_at + INTERVAL 40 DAYS"))
    for part in [*_newest_come_first(notes, "created_at"), notes, shifted, undated]:
        part.write.mode("append").parquet(landing)
        stream = read_files(spark, landing, notes.schema)
        append_stream(stream, "comment_id", out, f"{out}-checkpoint").awaitTermination()
    return reader.read_log(spark, out, notes.schema)


def _metadata_migration(ws: Workspace) -> DataFrame:
    """A table from before topics and difficulties gets both columns; notes of reviews are dropped."""
    old = edits.without_columns(ws.metadata, "domain")
    return edits.without_columns(edits.with_columns_of(old, TABLES["ticket_metadata"]), "feedback_reason")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # Cleaning
        "clean_posts": _raw(lambda ws: ws.posts),
        "clean_articles": _raw(lambda ws: ws.articles),
        "clean_comments": _raw(lambda ws: ws.comments),
        "members": _raw(lambda ws: ws.members),
        "candidates": _raw(lambda ws: ws.candidates),
        "null_aware_anti": _raw(_null_aware_anti),
        "coach_roster": _raw(lambda ws: queues.coach_roster(ws.inputs.coaches, ws.inputs.core_members, TENANT)),
        "incremental_posts": _raw(_incremental_posts),
        "incremental_upsert": _incremental_upsert,
        "snapshot_changes": _snapshot_changes,
        "snapshot_content": _snapshot_content,
        # Scores, engagement, tickets
        "team_engagement": _raw(lambda ws: ws.engagement),
        "scored_content": _raw(lambda ws: scoring.scored_content(ws.candidates, ws.scores)),
        "score_increment": _raw(_score_increment),
        "score_batches": _raw(_score_batches),
        "score_inputs": _raw(lambda ws: scoring.score_inputs(ws.candidates, ws.inputs.prompt_config)),
        "latest_metadata": _raw(lambda ws: ws.metadata),
        "member_assignments": _raw(lambda ws: ws.assignments),
        "tickets": _raw(lambda ws: ws.rebuilt_tickets),
        "topic_labels": _view(_topic_labels),
        "topic_responses": _view(_topic_responses),
        "label_inputs": _view(lambda ws: scoring.label_inputs(scoring.unlabelled_questions(ws.content, ws.labels))),
        # Views over live tickets
        "newest_edits": _view(lambda ws: ws.edits),
        "live_tickets": _view(lambda ws: ws.live),
        "ticket_queue": _queue(),
        "ticket_queue_open": _queue(status="open"),
        "ticket_queue_urgent": _queue(urgency="Urgent"),
        "ticket_queue_domain": _queue(domain="Other"),
        "ticket_queue_member": _queue(member_id=12),
        "ticket_queue_assignee": _queue(assignee="Coach#3"),
        "ticket_queue_date": _queue(date_from="2024-01-10", date_to="2024-01-20"),
        "tickets_this_week": _period("this week"),
        "tickets_this_month": _period("this month"),
        "ticket_urgency": _view(_ticket_urgency),
        "ticket_detail": _view(lambda ws: queues.ticket_detail(
            ws.tickets, ws.edits, SETTINGS.now, ws.inputs.ticket_comments, ws.settled)),
        "member_history": _view(lambda ws: queues.member_history(ws.tickets)),
        "member_thread_tickets": _view(_member_threads),
        "member_thread_split": _view(lambda ws: queues.split_open(_member_threads(ws))),
        "ticket_comments": _raw(lambda ws: queues.ticket_comments(ws.inputs.ticket_comments)),
        "review_queue": _view(lambda ws: queues.review_queue(ws.tickets)),
        "review_progress": _view(lambda ws: queues.review_progress(ws.tickets)),
        "queue_grouped": _view(lambda ws: queues.queue_grouped(
            ws.tickets, ws.edits, SETTINGS.now, keyed=ws.keyed, settled=ws.settled)),
        "coach_list": _raw(lambda ws: queues.coach_list(ws.inputs.coaches)),
        "coach_names": _raw(lambda ws: queues.coach_names(ws.inputs.coaches)),
        "member_search": _raw(lambda ws: queues.member_search(
            ws.inputs.core_members, joins.IdSet.of(ws.inputs.coaches.select("member_id")), TENANT, "Build")),
        "member_search_batch": _member_search_batch,
        # Threads
        "thread_timeline": _raw(_thread_timeline),
        "thread_layout": _thread_layout,
        "thread_pages": _thread_pages,
        "thread_backfill": _raw(_thread_backfill),
        "thread_lookup": _raw(_thread_lookup),
        "thread_audit": _raw(lambda ws: staging.thread_audit(ws.inputs.core_comments, TENANT)),
        # Indicators and reports
        "open_stats": _view(lambda ws: reports.open_stats(ws.live, SETTINGS.now)),
        "daily_stats": _view(lambda ws: reports.daily_stats(ws.live, SETTINGS.now)),
        "report_volume": _report(reports.volume),
        "response_minutes": _report(reports.response_minutes),
        "response_summary": _report(lambda *a: reports.response_summary(reports.response_minutes(*a))),
        "report_productivity": _report(reports.productivity),
        "report_domain": _report(reports.topic_breakdown),
        # The same from totals that are kept
        "open_stats_kept": lambda spark, sf_dir: indicators(spark, sf_dir).open_stats(SETTINGS.now),
        "daily_stats_kept": lambda spark, sf_dir: indicators(spark, sf_dir).daily_stats(SETTINGS.now),
        "report_volume_kept": _totalled(totals.volume),
        "response_summary_kept": _totalled(totals.response_summary),
        "report_productivity_kept": _totalled(totals.productivity),
        "report_domain_kept": _totalled(totals.topic_breakdown),
        "status_counts": _raw(lambda ws: reports.status_counts(_log(ws))),
        "status_remap": _raw(_status_remap),
        "column_audit": _view(_column_audit),
        "closed_without_comment": _view(_closed_without_comment),
        # Feedback loop
        "classification_feedback": _view(lambda ws: ws.feedback),
        "feedback_range": _view(lambda ws: feedback.feedback_between(
            ws.feedback, _date("2024-01-15"), _date("2024-01-28"))),
        "top_false_positives": _view(lambda ws: feedback.top_feedback(
            ws.feedback, SETTINGS.today, "not_a_question", 20)),
        "feedback_digest": _view(lambda ws: feedback.feedback_digest(ws.feedback, SETTINGS.today)),
        "proposal_request": _view(lambda ws: feedback.proposal_request(
            ws.inputs.prompt_config, ws.feedback, SETTINGS.today)),
        "prompt_latest": _raw(lambda ws: feedback.latest_prompt(ws.inputs.prompt_config)),
        "version_intervals": _raw(lambda ws: feedback.version_intervals(ws.inputs.prompt_config)),
        "version_stats": _view(_version_stats),
        "prompt_proposals": lambda spark, sf_dir: feedback.parse_proposals(_proposals(spark, sf_dir)),
        "prompt_rollforward": _rollforward,
        "scorer_quality": _view(lambda ws: training.stored_quality(ws.inputs.prompt_config, ws.scores, ws.feedback)),
        "scorer_ranking": _view(_scorer_ranking),
        # Changes to stored tables
        "upsert_metadata": _raw(_upsert_metadata),
        "upsert_assignee_partial": _raw(_upsert_assignee),
        "upsert_override": _raw(_upsert_override),
        "bulk_status_update": _view(_bulk_status_update),
        "delete_coach": _raw(_delete_coach),
        "metadata_migration": _raw(_metadata_migration),
        "append_events": _append_events,
        # Streams
        "stream_posts": _stream_posts,
        "stream_edits": _stream_edits,
        "stream_events": _stream_events,
    }
