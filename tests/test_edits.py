import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import at, values
from triage.operators import edits
from triage.schemas import TABLES

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows_ = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.integers(0, 3)), max_size=8)


@QUICK
@given(stored=st.dictionaries(st.integers(0, 5), st.integers(0, 9), max_size=5), changes=rows_, cut=st.integers(0, 8))
def test_upsert_newest_wins_however_changes_are_split(frame, stored, changes, cut):
    old = frame("k bigint, t bigint, v bigint", *[(k, 4, v) for k, v in stored.items()])
    new = lambda rows: frame("k bigint, t bigint, v bigint", *rows)
    once = edits.upsert(old, new(changes), "k", ["t", "v"])
    everything = [(k, 4, v) for k, v in stored.items()] + changes
    want = {k: max((t, v) for c, t, v in everything if c == k) for k, _, _ in everything}
    assert values(once) == sorted([(k, *tv) for k, tv in want.items()], key=repr)
    split = edits.upsert(edits.upsert(old, new(changes[cut:]), "k", ["t", "v"]), new(changes[:cut]), "k", ["t", "v"])
    assert values(split) == values(once)


def test_without_order_a_change_replaces(frame):
    old = frame("k string, t bigint", ("a", 9), ("b", 1))
    assert values(edits.upsert(old, frame("k string, t bigint", ("a", 3), ("a", 5)), "k")) == [("a", 5), ("b", 1)]


def test_partial_upsert_keeps_other_columns(frame):
    old = frame("k string, status string, who string", ("a", "open", "x"), ("b", None, "y"))
    new = frame("k string, who string", ("a", None), ("c", "z"))
    got = edits.upsert(old, new, "k")
    assert values(got) == sorted([("a", "open", None), ("b", None, "y"), ("c", None, "z")], key=repr)


def test_bulk_changes_touch_open_items_of_the_pair_only(frame):
    live = frame("content_id string, thread_id string, member_id bigint, ticket_status string",
                 ("a", "t", 1, "open"), ("b", "t", 1, "assigned"), ("c", "t", 1, "closed"),
                 ("d", "t", 2, "open"), ("e", "u", 1, "new"))
    asked = frame("thread_id string, member_id bigint, status string, assigned_to string, domain string",
                  ("t", 1, "closed", None, None))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    got = edits.bulk_status_changes(live, asked, now).drop("updated_at")
    assert values(got) == [("a", "closed", "", "", ""), ("b", "closed", "", "", "")]


def test_columns_are_added_and_dropped_only_where_needed(frame):
    old = frame("content_id string, status string, extra string", ("a", "open", "x"))
    wide = edits.with_columns_of(old, TABLES["ticket_metadata"])
    assert wide.columns == [f.name for f in TABLES["ticket_metadata"]] + ["extra"]
    assert edits.with_columns_of(wide, TABLES["ticket_metadata"]).columns == wide.columns
    assert edits.without_columns(old, "extra", "missing").columns == ["content_id", "status"]


def test_required_columns_are_checked(frame):
    rows = frame("log_id string, created_at timestamp_ntz, level string, source string, message string, detail string",
                 ("1", at("2024-01-01"), "INFO", "s", None, None))
    with pytest.raises(Exception, match="message must not be NULL"):
        edits.require(rows, TABLES["app_logs"]).collect()
