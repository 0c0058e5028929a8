"""Jobs and streams on stored tables, and what the plans of whole runs look like."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from harness import registry
from tests.conftest import at, plan_of, values
from triage.operators import staging, training
from triage.operators.joins import IdSet
from triage.plans import jobs
from triage.plans.workspace import Inputs, Workspace
from triage.schemas import TABLES
from triage.sources.reader import read_log
from triage.sources.store import VersionedTable
from triage.streaming import streams

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ws(spark):
    return registry.workspace(spark, SF_DIR)


def test_rebuild_writes_what_the_plan_gives(spark, ws, tmp_path):
    jobs.rebuild(ws, spark, str(tmp_path))
    schema = registry._content_schema(ws.rebuilt_tickets)
    stored = VersionedTable(spark, str(tmp_path / "tickets"), schema, by_day=True).read()
    assert values(stored) == values(ws.rebuilt_tickets)


def test_inputs_from_stored_tables(spark, ws, tmp_path):
    root = str(tmp_path)
    for name in Inputs.__dataclass_fields__:
        rows = getattr(ws.inputs, name)
        if rows is not None:
            have = set(rows.columns)
            rows.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                          for f in TABLES[name])).write.parquet(f"{root}/{name}")
    ws.scores.write.parquet(f"{root}/question_scores")
    loaded = Workspace(Inputs.from_root(spark, root), registry.SETTINGS)
    assert values(loaded.rebuilt_tickets) == values(ws.rebuilt_tickets)


def test_scores_labels_and_prompt_move_on(spark, ws, tmp_path):
    scores = VersionedTable(spark, str(tmp_path / "scores"), TABLES["question_scores"])
    scores.replace(ws.scores.filter(F.col("classified_at") < F.lit(registry.STORED_UNTIL)))
    jobs.score_new(ws, scores)
    assert values(scores.read()) == values(ws.scores)

    labels = VersionedTable(spark, str(tmp_path / "labels"), TABLES["topic_labels"])
    labels.replace(ws.labels)
    jobs.label_new(ws, labels, registry.SETTINGS)
    questions = ws.content.filter("is_question").count()
    assert labels.read().filter("domain IS NOT NULL").join(ws.content.filter("is_question"), "content_id").count() == questions

    config = VersionedTable(spark, str(tmp_path / "config"), TABLES["prompt_config"])
    config.replace(ws.inputs.prompt_config)
    served = registry.served(spark, SF_DIR)
    jobs.roll_prompt_forward(served, registry._proposals(spark, SF_DIR), config)
    enough = served.feedback.filter(F.to_date("flagged_at") >= "2024-01-24").count() >= 5
    assert config.read().count() == ws.inputs.prompt_config.count() + enough


def test_new_items_are_scored_by_any_kind_of_scorer(spark, ws):
    stored = ws.scores.filter("crc32(content_id) % 2 = 0")
    only = Workspace(replace(ws.inputs, question_scores=stored), registry.SETTINGS)
    with pytest.raises(ValueError, match="give a scorer"):
        only.incremental_scores(stored)
    fresh = ws.scores.count() - stored.count()
    by_column = only.incremental_scores(stored, F.length("body") % 4 != 0)
    by_batch = only.incremental_scores(stored, lambda rows: rows["body"].str.len() % 4 != 0)
    assert fresh > 0 and values(by_batch) == values(by_column) and by_column.count() == fresh
    examples = ws.candidates.select("body", (F.length("body") % 2).cast("double").alias("label")).limit(60)
    by_model = only.incremental_scores(stored, training.train(examples))
    assert by_model.columns == by_column.columns and by_model.count() == fresh


def test_edits_and_migration(spark, frame, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "meta"), TABLES["ticket_metadata"])
    day = lambda n: at(f"2024-01-{n:02d}")
    edit = lambda *rows: frame("content_id string, status string, assigned_to string, updated_at timestamp_ntz, domain string, "
                               "feedback_reason string", *rows)
    jobs.save_edits(edit(("a", "open", "", day(1), "", ""), ("a", "in_progress", "", day(2), "", ""), ("b", "x", "", day(1), "", "")), table)
    jobs.save_edits(edit(("b", "answered", "c", day(3), "", "")), table)
    jobs.migrate_metadata(table)
    assert values(table.read().select("content_id", "status", "difficulty")) == [("a", "assigned", None), ("b", "closed", None)]


def test_stream_equals_batch_and_takes_late_files(spark, ws, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    schema = ws.inputs.core_posts.schema
    table = VersionedTable(spark, str(tmp_path / "posts"), registry._content_schema(ws.posts), by_day=True)

    def run():
        stream = streams.read_files(spark, landing, schema, files_per_batch=1)
        streams.upsert_stream(stream, table, "content_id", checkpoint, "posts",
                              lambda rows: staging.clean_posts(rows, ws.excluded, "tenant_a")).awaitTermination()

    late = F.col("created_at") < F.lit("2024-01-10").cast("timestamp_ntz")
    ws.inputs.core_posts.filter(~late).write.parquet(landing)
    run()
    assert values(table.read()) == values(ws.posts.filter(~late))
    ws.inputs.core_posts.filter(late).write.mode("append").parquet(landing)
    run()
    assert values(table.read()) == values(ws.posts)


def test_batch_ingest_equals_rebuild_for_rows_in_order(spark, ws, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "posts"), registry._content_schema(ws.posts), by_day=True)
    for until in ("2024-01-10", "2024-01-20", "2024-03-01"):
        jobs.ingest(ws.posts.filter(F.col("created_at") < F.lit(until).cast("timestamp_ntz")), table)
    assert values(table.read()) == values(ws.posts)


def test_repeated_events_are_appended_once(spark, frame, tmp_path):
    rows = frame("log_id string, created_at timestamp_ntz", ("a", at("2024-01-01 00:00:00")), ("a", at("2024-01-01 00:10:00")),
                 ("b", at("2024-01-01 00:00:00")))
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(landing)
    stream = streams.read_files(spark, landing, rows.schema)
    streams.append_stream(stream, "log_id", out, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.log_id for r in read_log(spark, out, rows.schema).collect()) == ["a", "b"]


LAZY = [n for n in registry.queries() if not n.startswith("stream") and n not in ("incremental_upsert", "append_events", "score_batches")]


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_pairs_everything_with_everything(spark, name):
    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan


def exchanges_above(plan: str, column: str) -> int:
    """Exchanges on the way of a column from its scan; it is scanned once."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    wide = [i for i, line in enumerate(lines) if "FileScan" in line and f"{column}#" in line.split("Batched")[0]]
    assert len(wide) == 1
    above, level = 0, depth(lines[wide[0]])
    for line in reversed(lines[: wide[0]]):
        if depth(line) < level:
            level = depth(line)
            above += "Exchange" in line
    return above


def stored_tickets_plan(spark) -> str:
    served = registry.served(spark, SF_DIR)
    large = Workspace(served.inputs, replace(registry.SETTINGS, broadcast_rows=0), registry.rule(), stored_content=served.content)
    return large.rebuilt_tickets._jdf.queryExecution().executedPlan().toString()


def test_bodies_move_once_when_nothing_is_small(spark, no_broadcast):
    plan = stored_tickets_plan(spark)
    assert "BroadcastHashJoin" not in plan and exchanges_above(plan, "body") == 1


def test_bodies_move_once_at_default_thresholds(spark):
    assert exchanges_above(stored_tickets_plan(spark), "body") <= 1


def test_texts_of_threads_do_not_move_by_author(spark, ws):
    i = ws.inputs
    timeline = registry.queues.thread_timeline(i.core_posts, i.core_comments, i.core_members, "tenant_a", i.core_articles)
    assert "hashpartitioning(author_id" not in timeline._jdf.queryExecution().executedPlan().toString()
    many = registry.queues.thread_timeline(i.core_posts, i.core_comments, i.core_members, "tenant_a", i.core_articles, max_rows=0)
    assert values(many) == values(timeline)


def test_one_thread_is_read_where_it_lies(spark, frame, tmp_path):
    import pyarrow.parquet as pq

    made = at("2024-01-01")
    rows = [(f"post_{t:03d}", f"c_{t}_{k}", "comment", k, None, 1, f"<p>text {k}</p>", None, made) for t in range(40) for k in range(400 if t == 7 else 5)]
    items = frame("thread_id string, content_id string, content_type string, depth bigint, reply_to_id bigint, author_id bigint, _text string, "
                  "permalink string, created_at timestamp_ntz", *rows).repartition(7)
    stored = jobs.store_threads(items, spark, str(tmp_path), 8).read()
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in stored.inputFiles()]
    spans = sorted((s.min, s.max) for f in files for g in range(f.num_row_groups)
                   for s in [f.metadata.row_group(g).column(f.schema.names.index("thread_id")).statistics])
    assert len(spans) >= 6 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # ranges touch, they do not overlap
    assert sum(a <= "post_007" <= b for a, b in spans) >= 3  # the hot thread takes several files
    members = frame("client_id string, member_id bigint, first_name string, last_name string, network_role string", ("t", 1, "A", "B", "host"))
    page = registry.queues.stored_threads(stored, members, "t", ["post_007"])
    plan = page._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line and "thread_id#" in line]
    assert len(scan) == 1 and "PushedFilters: [" in scan[0] and "thread_id" in scan[0].split("PushedFilters")[1]
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    got = page.orderBy(*registry.queues.thread_order()).collect()
    assert [r.body for r in got] == [f"text {k}" for k in range(400)] and got[0].author_name == "A B" and got[0].author_type == "team"


def test_ranges_of_threads_grow_with_their_texts(spark, frame, tmp_path):
    made = at("2024-01-01")
    rows = [(f"post_{t:03d}", f"post_{t:03d}", "post", 0, None, 1, "x" * 100, None, made) for t in range(200)]
    items = frame("thread_id string, content_id string, content_type string, depth bigint, reply_to_id bigint, author_id bigint, _text string, "
                  "permalink string, created_at timestamp_ntz", *rows).repartition(4)
    many = jobs.store_threads(items, spark, str(tmp_path / "many"), 2, characters=1_000).read()
    few = jobs.store_threads(items, spark, str(tmp_path / "few"), 2).read()
    assert len(many.inputFiles()) >= 15 and len(few.inputFiles()) == 2
    assert values(many) == values(few) and many.count() == 200
    none = jobs.store_threads(items.limit(0), spark, str(tmp_path / "none"), 2).read()
    assert none.count() == 0


@pytest.fixture
def whole_plans(spark):
    """Plans that show every column and filter."""
    wide = {"spark.sql.maxMetadataStringLength": "10000", "spark.sql.debug.maxToStringFields": "1000"}
    for name, value in wide.items():
        spark.conf.set(name, value)
    yield
    for name in wide:
        spark.conf.unset(name)


def test_conditions_on_stored_rows_reach_the_scan(spark, whole_plans):
    served = registry.served(spark, SF_DIR)
    wanted = registry.QueueFilter(date_from="2024-01-10", date_to="2024-01-20", member_id=12)
    plan = registry.queues.queue_grouped(served.tickets, registry._log(served), registry.SETTINGS.now, wanted, keyed=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text
    scans = [line for line in text.split("\n") if "FileScan" in line and "ticket_status#" in line.split("Batched")[0]]
    assert len(scans) == 1


def test_a_short_list_leaves_other_bodies_where_they_are(spark, whole_plans):
    served = registry.served(spark, SF_DIR)
    short = registry.queues.ticket_queue(served.tickets, registry._log(served), registry.SETTINGS.now, registry.QueueFilter(member_id=12), keyed=True)
    plan = short._jdf.queryExecution().executedPlan().toString()
    # The scan of bodies meets a broadcast of ids before any exchange.
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "body#" in line.split("Batched")[0])
    above = [line for line in lines[max(0, scan - 6):scan] if "Exchange" in line or "Join" in line]
    assert above and "BroadcastHashJoin" in above[-1]
    some = registry.queues.ticket_queue(served.tickets, registry._log(served), registry.SETTINGS.now, registry.QueueFilter(member_id=12), keyed=True, max_rows=3)
    plan = some._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "body#" in line.split("Batched")[0])
    above = [line for line in plan[max(0, scan - 6):scan] if "Exchange" in line or "Join" in line]
    assert above and "BroadcastHashJoin" in above[-1] and "LeftSemi" in above[-1]
    assert values(some) == values(short) and some.columns == short.columns
    long = registry.queues.ticket_queue(served.tickets, registry._log(served), registry.SETTINGS.now, registry.QueueFilter(member_id=12), keyed=True, max_rows=-1)
    assert values(long) == values(short) and long.columns == short.columns


def test_lists_read_the_newest_edits_and_compare_none(spark):
    served = registry.served(spark, SF_DIR)
    for name in ("ticket_queue", "ticket_queue_open", "queue_grouped", "ticket_detail", "member_thread_tickets", "live_tickets", "open_stats"):
        plan = registry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan, name
    assert served.settled and values(served.metadata) == values(registry.workspace(spark, SF_DIR).metadata)


def test_an_upsert_of_all_edits_has_one_exchange(spark):
    plan = registry.queries()["upsert_metadata"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan


def test_newest_edits_do_not_depend_on_batches(spark, frame, tmp_path):
    import random

    rnd = random.Random(2)
    schema = "content_id string, status string, assigned_to string, updated_at timestamp_ntz, difficulty string, domain string, feedback_reason string"
    rows = [(f"i{rnd.randint(0, 20)}", rnd.choice([None, "", "open", "closed"]), rnd.choice([None, "c"]),
             rnd.choice([None, at("2024-01-01"), at("2024-01-02")]), None, rnd.choice([None, "d"]), None) for _ in range(120)]
    want = values(registry.tickets.latest_metadata(frame(schema, *rows)))
    for number, step in enumerate((120, 37)):
        rnd.shuffle(rows)
        table = jobs.edits_table(spark, str(tmp_path / str(number)), 4)
        for k in range(0, len(rows), step):
            jobs.save_edits(frame(schema, *rows[k:k + step]), table, commit_key=str(k))
            jobs.save_edits(frame(schema, *rows[k:k + step]), table, commit_key=str(k))
        assert values(table.read()) == want


@pytest.mark.parametrize("few", [False, True])
def test_tickets_are_the_same_however_many_people_there_are(spark, ws, few):
    made = Workspace(ws.inputs, replace(registry.SETTINGS, broadcast_rows=1_000_000 if few else 0), registry.rule())
    assert made.few_people == few and values(made.rebuilt_tickets) == values(ws.rebuilt_tickets)


@pytest.mark.parametrize("max_rows", [-1, 100])
def test_copies_of_one_time_are_not_mixed(spark, frame, max_rows):
    made = at("2024-01-05")
    columns = ("content_id string, created_at timestamp_ntz, title string, body string, ticket_status string, ticket_updated_at timestamp_ntz, "
               "member_id bigint, team_commented boolean, team_comment_replied boolean, team_reacted boolean")
    rows = [("a", made, f"title{k}", f"body{k}", "open", None, 1, False, False, False) for k in (0, 1)]
    rows += [("b", made, "same", f"body{k}", "open", None, 1, False, False, False) for k in (0, 1)]
    edits = frame("content_id string, status string, assigned_to string, domain string, feedback_reason string, updated_at timestamp_ntz")
    for order in (rows, rows[::-1]):
        got = registry.queues.ticket_queue(frame(columns, *order), edits, registry.SETTINGS.now, max_rows=max_rows)
        assert values(got.select("content_id", "title", "body")) == [("a", "title1", "body1"), ("b", "same", "body1")]


def test_hot_keys_give_whole_results(spark, frame, no_broadcast):
    """A third of all rows share an author, an item and a day."""
    n = 6000
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    posts = spark.range(n).select(
        F.lit("t").alias("client_id"), F.col("id").alias("post_id"), hot.alias("creator_id"), F.lit(1).cast("bigint").alias("space_id"),
        F.lit("x").alias("description"), F.lit(None).cast("string").alias("permalink"), F.lit("active").alias("post_status"),
        *(F.lit("2024-01-01").cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at", "last_activity_at")))
    excluded = IdSet.of(spark.range(n).filter("id % 2 = 1").toDF("member_id"), 0)
    kept = staging.clean_posts(posts, excluded, "t")
    assert kept.count() == sum(1 for i in range(n) if (0 if i % 3 == 0 else i) % 2 == 0)
