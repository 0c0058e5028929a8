import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import plan_of, values
from triage.operators.joins import IdSet, latest_per_key, match_intervals, not_in

START = dt.datetime(2024, 1, 1)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("bound", [1_000_000, 0])
@pytest.mark.parametrize("listed, want", [
    ([(2,)], [(1,), (3,)]),
    ([(2,), (None,)], []),
    ([], [(1,), (2,), (3,), (None,)]),
    ([(9,), (9,)], [(1,), (2,), (3,)]),
])
def test_not_in_follows_sql(frame, listed, want, bound):
    rows = frame("k bigint", (1,), (2,), (3,), (None,))
    got = not_in(rows, "k", IdSet.of(frame("x bigint", *listed), bound))
    assert values(got) == sorted(want, key=repr)


def test_not_in_shuffles_beyond_the_bound(frame, no_broadcast):
    rows, listed = frame("k bigint", (1,), (2,)), frame("x bigint", (2,))
    assert "BroadcastHashJoin" in plan_of(not_in(rows, "k", IdSet.of(listed)))
    assert "Broadcast" not in plan_of(not_in(rows, "k", IdSet.of(listed, 0)))


def test_latest_per_key_limits_before_the_exchange(frame):
    rows = frame("k bigint, v bigint", (1, 1), (1, 3), (2, 2))
    got = latest_per_key(rows, ["k"], [F.col("v").desc()])
    assert values(got) == [(1, 3), (2, 2)]
    plan = plan_of(got)
    assert plan.count("WindowGroupLimit") == 2


seconds = st.integers(0, 6 * 86400)


@QUICK
@given(facts=st.lists(seconds, min_size=1, max_size=25),
       spans=st.lists(st.tuples(seconds, st.one_of(st.none(), seconds)), max_size=8),
       small=st.booleans())
def test_match_intervals_equals_brute_force(frame, facts, spans, small):
    moment = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    f = frame("id bigint, at timestamp_ntz", *[(i, moment(s)) for i, s in enumerate(facts)], (99, None))
    s = frame("v bigint, a timestamp_ntz, b timestamp_ntz", *[(i, moment(a), moment(b)) for i, (a, b) in enumerate(spans)])
    got = match_intervals(f, "at", s, "a", "b", small, salts=3).select("id", "v")
    want = [(i, v) for i, t in enumerate(facts) for v, (a, b) in enumerate(spans)
            if t >= a and (b is None or t < b)]
    assert values(got) == sorted(want, key=repr)


def test_match_intervals_never_loops(frame, no_broadcast):
    f = frame("id bigint, at timestamp_ntz", (1, START))
    s = frame("v bigint, a timestamp_ntz, b timestamp_ntz", (1, START, None))
    for small in (True, False):
        plan = plan_of(match_intervals(f, "at", s, "a", "b", small))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "_salt" in plan and "Broadcast" not in plan.split("Subquery")[0]
