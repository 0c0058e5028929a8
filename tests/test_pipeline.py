"""Staging, engagement, tickets, threads, on hand-made rows."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, values
from triage.operators import engagement, queues, scoring, staging, tickets
from triage.operators.joins import IdSet
from triage.schemas import TABLES

T0 = at("2024-01-10 00:00:00")
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NOW = "2024-01-31 00:00:00"


def table(spark, name, *rows):
    """Rows as dicts; what is not given is NULL."""
    schema = TABLES[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def ids(frame, *numbers, bound=1_000_000):
    return IdSet.of(frame("member_id bigint", *[(n,) for n in numbers]), bound)


def comment(number, author, target=1, depth=1, reply_to=None, minutes=0, **more):
    return dict(client_id="t", comment_id=number, author_id=author, targetable_type="Post", targetable_id=target,
                comment_status="active", depth=depth, reply_to_id=reply_to,
                created_at=T0 + dt.timedelta(minutes=minutes)) | more


def reaction(member, kind, target, minutes=0, status="active"):
    return dict(client_id="t", member_id=member, targetable_type=kind, targetable_id=target,
                reaction_status=status, created_at=T0 + dt.timedelta(minutes=minutes))


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_posts_of_others_are_left_out(spark, frame, bound):
    post = lambda n, author, **more: dict(client_id="t", post_id=n, creator_id=author, post_status="active",
                                          description="<b>x</b>", created_at=T0) | more
    posts = table(spark, "core_posts", post(1, 5), post(2, 9), post(3, 5, client_id="u"),
                  post(4, 5, post_status="deleted"), post(5, None))
    got = staging.clean_posts(posts, ids(frame, 9, bound=bound), "t")
    assert values(got.select("content_id", "thread_id", "body", "title")) == [("post_1", "post_1", "x", None)]


def test_only_comments_under_posts_count(spark, frame):
    comments = table(spark, "core_comments", comment(1, 5, comment_text=" hi "),
                     comment(2, 5, targetable_type="Article"), comment(3, 5, comment_status="hidden"))
    got = staging.clean_comments(comments, ids(frame), "t")
    assert values(got.select("content_id", "thread_id", "body", "last_activity_at")) == [
        ("comment_1", "post_1", "hi", T0)]


def test_newer_than_misses_late_and_undated_rows(frame):
    rows = frame("k string, created_at timestamp_ntz", ("late", T0), ("new", T0 + dt.timedelta(days=2)), ("none", None))
    stored = frame("created_at timestamp_ntz", (T0 + dt.timedelta(days=1),))
    assert values(staging.newer_than(rows, stored).select("k")) == [("new",)]
    assert len(values(staging.newer_than(rows, stored.limit(0)))) == 3


minute = st.integers(0, 50)
comments_ = st.lists(st.tuples(st.integers(1, 4), st.integers(1, 3), st.sampled_from([1, 2]),
                               st.one_of(st.none(), st.integers(1, 3)), minute), max_size=10)
reactions_ = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["Post", "Comment", "Article"]),
                                st.integers(1, 3), minute, st.sampled_from(["active", "removed"])), max_size=10)


@QUICK
@given(comments=comments_, reactions=reactions_, bound=st.sampled_from([0, 100]))
def test_engagement_equals_full_outer_join(spark, frame, comments, reactions, bound):
    c = table(spark, "core_comments", *[comment(i, a, t, d, r, m) for i, (a, t, d, r, m) in enumerate(comments)])
    r = table(spark, "core_reactions", *[reaction(*x) for x in reactions])
    staff = {1, 2}
    got = engagement.team_engagement(c, r, ids(frame, *staff, bound=bound), "t")
    want: dict[str, list] = {}

    def touch(key, signal, minutes):
        row = want.setdefault(key, [False, False, False, minutes])
        row[signal], row[3] = True, min(row[3], minutes)

    for a, t, d, reply, m in comments:
        if a in staff and d == 1:
            touch(f"post_{t}", 0, m)
        if a in staff and d == 2 and reply is not None:
            touch(f"comment_{reply}", 1, m)
    for a, kind, t, m, s in reactions:
        if a in staff and s == "active" and kind != "Article":
            touch(f"{kind.lower()}_{t}", 2, m)
    assert values(got) == sorted(
        [(k, a, b, c_, T0 + dt.timedelta(minutes=m)) for k, (a, b, c_, m) in want.items()], key=repr)


def test_engagement_groups_once(spark, frame):
    c, r = table(spark, "core_comments"), table(spark, "core_reactions")
    schema_c, schema_r = c.schema, r.schema
    c = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema_c))
    got = engagement.team_engagement(c, spark.range(1).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema_r)), ids(frame, 1), "t")
    assert plan_of(got).count("Exchange hashpartitioning") <= 1


def content(frame, *rows):
    made = frame("content_id string, member_id bigint, created_at timestamp_ntz, is_question boolean", *rows)
    return made.withColumns({c: F.lit(None).cast("string") for c in ("thread_id", "content_type", "title", "body", "permalink")} | {
        "space_id": F.lit(1).cast("bigint"), "updated_at": F.col("created_at"), "last_activity_at": F.col("created_at")})


def test_first_assignment_and_override(frame):
    items = content(frame, ("post_1", 1, T0, True), ("post_2", 1, T0, True), ("post_3", 1, T0 - dt.timedelta(1), True),
                    ("post_4", 2, T0, True), ("post_5", 3, T0, True))
    edits = frame("content_id string, assigned_to string", ("post_1", "a"), ("post_2", "b"), ("post_3", ""),
                  ("post_4", "c"), ("post_5", None))
    overrides = frame("member_id bigint, assigned_to string, updated_at timestamp_ntz, updated_by string",
                      (2, "", T0, "x"), (3, "z", T0, "x"))
    got = tickets.member_assignments(items, edits, overrides)
    # Equal times go to the smaller id; a blank override counts; member 3 has no assigned item.
    assert values(got.select("member_id", "assigned_to", "first_content_id", "is_overridden")) == [
        (1, "a", "post_1", False), (2, "", "post_4", True)]


def test_tickets_star(spark, frame):
    items = content(frame, ("post_1", 1, T0, True), ("post_2", 7, T0, False), ("post_3", None, T0, None))
    people = table(spark, "core_members", dict(client_id="t", member_id=1, first_name="A"))
    members = staging.members(people, ids(frame), "t")
    touched = frame("content_id string, team_commented boolean, team_comment_replied boolean, team_reacted boolean, "
                    "first_engagement_at timestamp_ntz", ("post_9", True, False, False, T0))
    edits = frame("content_id string, status string, assigned_to string, updated_at timestamp_ntz, domain string",
                  ("post_1", "", "", T0, None))
    labels = frame("content_id string, domain string", ("post_1", "Other"))
    coaches = frame("member_id bigint, assigned_to string", (7, "coach"))
    got = tickets.tickets(items, members, touched, edits, labels, coaches)
    assert got.columns == list(tickets.TICKET_COLUMNS)
    assert values(got.select("content_id", "member_id", "member_name", "ticket_status", "assigned_to", "domain",
                             "team_reacted")) == [
        ("post_1", 1, "A ", "", "", "Other", False),
        ("post_2", None, None, "not_a_question", "coach", None, False),
        ("post_3", None, None, "open", None, None, False)]


def stored(frame, *rows):
    return frame("content_id string, created_at timestamp_ntz, ticket_status string, assigned_to string, domain string, "
                 "team_commented boolean, team_comment_replied boolean, team_reacted boolean, ticket_updated_at timestamp_ntz",
                 *rows)


def edit_log(frame, *rows):
    return frame("content_id string, status string, assigned_to string, domain string, feedback_reason string, "
                 "updated_at timestamp_ntz", *rows)


def test_live_overlay(frame):
    day = dt.timedelta(days=1)
    rows = stored(frame, ("a", T0, "open", "x", "d", False, False, False, T0),
                  ("a", T0 - day, "closed", "old", None, False, False, False, T0),
                  ("b", T0, "not_a_question", "x", None, False, False, False, T0),
                  ("c", T0, "open", "x", None, False, True, False, T0))
    log = edit_log(frame, ("a", "closed", None, None, None, T0), ("a", "", "", "", None, T0 + day),
                   ("b", None, None, None, None, T0 + day), ("c", "cancelled", "y", "e", None, T0))
    live = tickets.live_tickets(rows, log)
    assert "team_comment_replied" not in live.columns
    # A blank edit neither closes nor keeps; a cleared rejection lingers until the rebuild.
    assert values(live.select("content_id", "ticket_status", "assigned_to", "domain", "manual_status")) == [
        ("a", "open", "", "", ""), ("b", "not_a_question", "x", None, None), ("c", "answered", "y", "e", "cancelled")]


def test_live_overlay_of_older_columns(frame):
    rows = stored(frame, ("a", T0, "open", "x", "d", False, True, False, T0)).drop("team_comment_replied", "domain")
    live = tickets.live_tickets(rows, edit_log(frame))
    assert values(live.select("ticket_status", "domain")) == [("open", None)]


def full_tickets(frame, *rows):
    """(content_id, created_at, ticket_status, body) with the other columns filled in."""
    made = frame("content_id string, created_at timestamp_ntz, ticket_status string, body string", *rows)
    flags = {c: F.lit(False) for c in ("team_commented", "team_comment_replied", "team_reacted")}
    texts = {c: F.lit(None).cast("string") for c in ("assigned_to", "domain", "thread_id", "member_name", "permalink")}
    return made.withColumns(flags | texts | {"member_id": F.lit(1).cast("bigint"), "ticket_updated_at": F.col("created_at")})


def test_queue_fetches_the_body_of_the_newest_copy(frame):
    day = dt.timedelta(days=1)
    rows = full_tickets(frame, ("a", T0, "open", "new" * 100), ("a", T0 - day, "open", "old"), ("b", None, "open", "undated"),
                        ("b", None, "open", "undated"), ("c", T0, "not_a_question", "no"))
    now = F.lit(NOW).cast("timestamp_ntz")
    got = queues.ticket_queue(rows, edit_log(frame), now)
    assert [(r.content_id, r.body, len(r.body_preview), r.urgency) for r in got.collect()] == [
        ("a", "new" * 100, 120, "critical"), ("b", "undated", 7, "critical")]
    assert queues.queue_grouped(rows, edit_log(frame), now).count() == 2


def test_queue_conditions(frame):
    rows = full_tickets(frame, ("a", T0, "open", "x"), ("b", T0, "confirmed_question", "x"), ("c", T0, "not_a_question", "x"))
    now = F.lit(NOW).cast("timestamp_ntz")
    log = edit_log(frame, ("a", "closed", "Ann", "Other", None, T0), ("b", "confirmed_question", None, None, None, T0))

    def found(**wanted):
        return sorted(r.content_id for r in queues.ticket_queue(rows, log, now, queues.QueueFilter(**wanted)).collect())

    assert found() == found(status="All", assignee="All", urgency="All", domain="All", member_id="") == ["a"]
    assert found(status="not_a_question") == ["c"]
    assert found(assignee="Ann") == found(domain="Other") == found(member_id="1") == found(urgency="Critical") == ["a"]
    assert found(urgency="Normal") == found(assignee="O'Hara") == found(date_from="2024-01-11") == found(date_to="2024-01-09") == []


def test_grouping_of_threads(frame):
    queue = frame("member_id bigint, thread_id string, content_id string, created_at timestamp_ntz, ticket_status string, "
                  "urgency string, member_name string, body_preview string, domain string, permalink string, assigned_to string",
                  (1, "t", "a", T0, "open", "critical", "m", "old", None, None, None),
                  (1, "t", "b", T0 + dt.timedelta(1), "closed", "normal", "m", "new", None, None, None),
                  (2, "t", "c", T0, "new", "urgent", "n", "x", None, None, None),
                  (1, None, "d", T0, "open", "normal", "m", "x", None, None, None),
                  (1, "", "e", T0, "open", "normal", "m", "x", None, None, None))
    got = queues.group_queue(queue).select("newest_content_id", "tickets", "open_tickets", "worst_urgency")
    assert values(got) == [("b", 2, 1, "critical"), ("c", 1, 1, "urgent"), ("d", 1, 1, "normal"), ("e", 1, 1, "normal")]


def test_timeline_of_missing_roots_and_articles(spark, frame):
    posts = table(spark, "core_posts", dict(client_id="t", post_id=1, creator_id=1, description=None, created_at=T0, post_status="deleted"))
    comments = table(spark, "core_comments", comment(5, 2, 1, minutes=0), comment(6, 9, 77, minutes=1, targetable_type="Article"))
    articles = table(spark, "core_articles", dict(client_id="t", article_id=3, creator_id=1, description="<i>q", created_at=T0))
    people = table(spark, "core_members", dict(client_id="t", member_id=2, first_name=" B ", network_role="host"),
                   dict(client_id="u", member_id=1, first_name="other"))
    got = queues.thread_timeline(posts, comments, people, "t", articles)
    assert [tuple(r) for r in got.select("thread_id", "content_id", "depth", "author_name", "author_type", "body").collect()] == [
        ("article_3", "article_3", 0, "", "member", "q"), ("post_1", "post_1", 0, "", "member", ""),
        ("post_1", "comment_5", 1, "B", "team", ""), ("post_77", "comment_6", 1, "", "member", "")]
    wanted = IdSet.of(frame("thread_id string", ("post_77",)))
    assert queues.thread_timeline(posts, comments, people, "t", articles, wanted).count() == 1


def test_references_to_comments_become_threads(spark, frame):
    comments = table(spark, "core_comments", comment(5, 2, 8))
    asked = frame("thread_id string", ("comment_5",), ("comment_6",), ("post_1",), ("post_1",))
    assert values(queues.thread_ids_of(asked, comments, "t")) == [("post_1",), ("post_8",)]


def test_labels_are_retried_and_parsed(frame):
    items = frame("content_id string, content_type string, body string, is_question boolean",
                  ("a", "post", "My car, my CAR and a bill", True), ("b", "post", "nothing", True),
                  ("c", "post", "tax", True), ("d", "post", "tax", False), ("e", "post", "bill car", True))
    before = frame("content_id string, domain string", ("b", None), ("c", "Other"))
    now = F.lit(NOW).cast("timestamp_ntz")
    got = scoring.label_topics(scoring.unlabelled_questions(items, before), now).drop("labeled_at")
    assert values(got) == [("a", "Cars & Car Repairs"), ("b", "Other"), ("e", "Pay Debt & Bills")]
    answers = frame("content_id string, result string", ("a", '{"domain": "Other"}'), ("b", "sorry"),
                    ("c", '{"domain": {}}'), ("d", None))
    assert values(scoring.labels_from_responses(answers, now).drop("labeled_at")) == [("a", "Other")]


def test_python_model_sees_whole_bodies(frame):
    long = "x" * 5000 + "?"
    items = frame("content_id string, content_type string, body string", ("a", "post", long), ("b", "post", "no"))
    got = scoring.score_batches(items, lambda batch: batch["body"].str.endswith("?"), F.lit(NOW).cast("timestamp_ntz"))
    assert values(got.select("content_id", "is_question")) == [("a", True), ("b", False)]
    prompts = frame("prompt_text string, version bigint", ("old", 1), ("new", 2))
    assert scoring.score_inputs(items, prompts).filter("content_id = 'a'").first().prompt == f"new Content type: post. Text: {long}"


def test_member_search(spark, frame):
    people = table(spark, "core_members", *[
        dict(client_id="t", member_id=n, first_name=f, last_name=l, email_address=e, member_status=s)
        for n, f, l, e, s in [(1, "Ann", "Lee", "a@x", "Active"), (2, "Bo", None, "ann@x", "ACTIVE"),
                              (3, "Ann", "Abe", "q@x", "active"), (4, "Ann", "Coach", "c@x", "active"),
                              (5, "Ann", "Gone", "g@x", "inactive")]])
    found = queues.member_search(people, ids(frame, 4), "t", "ANN", 2)
    assert [(r.member_id, r.full_name) for r in found.collect()] == [(2, "Bo"), (3, "Ann Abe")]
    assert queues.member_search(people, ids(frame, 4, None), "t", "ann").isEmpty()
