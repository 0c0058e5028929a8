"""Indicators and reports from kept totals equal those from the tickets."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, values
from triage.operators import reports, tickets, totals
from triage.plans.indicators import LiveIndicators

TICKETS = ("content_id string, created_at timestamp_ntz, first_engagement_at timestamp_ntz, team_commented boolean, team_comment_replied boolean, "
           "team_reacted boolean, ticket_status string, ticket_updated_at timestamp_ntz, assigned_to string, domain string")
EDITS = "content_id string, status string, assigned_to string, updated_at timestamp_ntz, domain string, feedback_reason string"
STATUSES = [None, "", "open", "new", "assigned", "closed", "answered", "cancelled", "not_a_question"]


def moments(rnd, n):
    return [rnd.choice([None, at(f"2024-01-{rnd.randint(1, 31):02d} {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00"),
                        at(f"2024-01-{rnd.choice([29, 30])} {rnd.choice(['16:59:59', '17:00:00', '17:29:59', '17:30:00', '17:30:01', '18:00:00'])}"),
                        at("2024-01-01 17:30:00"), at("2024-01-01 17:29:59"), at("2024-02-02 00:00:00")]) for _ in range(n)]


def stored(rnd, n=150):
    flag = lambda: rnd.random() < .1
    return [(f"t{i}", m, e if flag() else None, flag(), flag(), flag(), rnd.choice(STATUSES[2:]), u, rnd.choice([None, "", "a", "b"]), rnd.choice([None, "x"]))
            for i, (m, e, u) in enumerate(zip(moments(rnd, n), moments(rnd, n), moments(rnd, n)))]


def edit_batches(rnd, batches=3, n=60):
    return [[(f"t{rnd.randint(0, 170)}", rnd.choice(STATUSES), None, m, None, None) for m in moments(rnd, n)] for _ in range(batches)]


@pytest.fixture(scope="module")
def now():
    return F.lit("2024-01-31 17:30:00").cast("timestamp_ntz")


@pytest.mark.parametrize("seed", [1, 2])
def test_live_indicators_after_batches(spark, frame, tmp_path, now, seed):
    rnd = random.Random(seed)
    rows, batches = frame(TICKETS, *stored(rnd)), edit_batches(rnd)
    kept = LiveIndicators(spark, str(tmp_path), 4)
    kept.rebuild(rows)
    for upto in range(len(batches) + 1):
        log = frame(EDITS, *[e for b in batches[:upto] for e in b])
        live = tickets.live_tickets(rows, log, keyed=True)
        assert values(kept.open_stats(now)) == values(reports.open_stats(live, now))
        assert values(kept.daily_stats(now)) == values(reports.daily_stats(live, now))
        if upto < len(batches):
            assert kept.apply(frame(EDITS, *batches[upto]), f"b{upto}")
            assert not kept.apply(frame(EDITS, *batches[upto]), f"b{upto}")
    again = LiveIndicators(spark, str(tmp_path / "again"), 4)
    again.rebuild(rows, tickets.latest_metadata(log))
    assert values(again.totals.read()) == values(kept.totals.read()) and values(again.states.read()) == values(kept.states.read())


def test_a_batch_lost_half_way_is_counted_once(spark, frame, tmp_path, now, monkeypatch):
    rnd = random.Random(3)
    rows, (first, second) = frame(TICKETS, *stored(rnd)), edit_batches(rnd, 2)
    kept = LiveIndicators(spark, str(tmp_path), 4)
    kept.rebuild(rows)

    def die(*_, **__):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(kept.states, "upsert", die)
        with pytest.raises(RuntimeError, match="driver lost"):
            kept.apply(frame(EDITS, *first), "first")
    with pytest.raises(RuntimeError, match="half way"):
        kept.apply(frame(EDITS, *second), "second")
    assert kept.apply(frame(EDITS, *first), "first") and kept.apply(frame(EDITS, *second), "second")
    live = tickets.live_tickets(rows, frame(EDITS, *first, *second), keyed=True)
    assert values(kept.open_stats(now)) == values(reports.open_stats(live, now))


def test_only_the_hours_of_the_bounds_are_looked_at(spark, frame, tmp_path, now):
    kept = LiveIndicators(spark, str(tmp_path), 4)
    kept.rebuild(frame(TICKETS, *stored(random.Random(4))))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        for stats in (kept.open_stats(now), kept.daily_stats(now)):
            plan = stats._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in plan.split("\n") if "FileScan" in line and "engaged#" in line.split("Batched")[0]]
            assert scans and all("GreaterThanOrEqual(created_at" in s and "LessThan(created_at" in s for s in scans)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_no_tickets(spark, frame, tmp_path, now):
    kept = LiveIndicators(spark, str(tmp_path), 4)
    kept.rebuild(frame(TICKETS))
    kept.apply(frame(EDITS, ("t1", "closed", None, at("2024-01-01"), None, None)), "b")
    none = tickets.live_tickets(frame(TICKETS), frame(EDITS), keyed=True)
    assert values(kept.open_stats(now)) == values(reports.open_stats(none, now))
    assert values(kept.daily_stats(now)) == values(reports.daily_stats(none, now))


@pytest.mark.parametrize("days", [("2024-01-01", "2024-01-31"), ("2024-01-29", "2024-01-30"), ("2023-01-01", "2023-01-02")])
def test_reports_of_any_range(frame, days):
    rows = frame(TICKETS, *stored(random.Random(5), 300))
    kept = totals.report_totals(rows)
    first, last = (F.lit(d).cast("date") for d in days)
    assert values(totals.volume(kept, first, last)) == values(reports.volume(rows, first, last))
    assert values(totals.productivity(kept, first, last)) == values(reports.productivity(rows, first, last))
    assert values(totals.topic_breakdown(kept, first, last)) == values(reports.topic_breakdown(rows, first, last))
    direct = reports.response_summary(reports.response_minutes(rows, first, last))
    assert values(totals.response_summary(kept, first, last)) == values(direct)
