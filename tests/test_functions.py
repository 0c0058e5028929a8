import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from triage.functions import clock, status, text

MANUAL = (None, "", "closed", "not_a_question", "confirmed_question")


def test_stored_status_truth_table(frame):
    rows = list(itertools.product((True, False, None), MANUAL, (True, False, None)))
    got = frame("e boolean, m string, q boolean", *rows).select(
        "e", "m", "q", status.stored_status(F.coalesce("e", F.lit(False)), F.col("m"), F.col("q")).alias("s"))
    for e, m, q, s in got.collect():
        if e:
            assert s == "answered"
        elif m is not None:
            assert s == m  # a blank one too
        else:
            assert s == ("not_a_question" if q is False else "open")


def test_live_status_truth_table(frame):
    rows = list(itertools.product((True, False), MANUAL, ("open", "not_a_question", "", "closed")))
    got = frame("e boolean, m string, o string", *rows).select(
        "e", "m", "o", status.live_status(F.col("e"), F.col("m"), F.col("o")).alias("s"))
    for e, m, o, s in got.collect():
        want = "answered" if e else m if m else "not_a_question" if o == "not_a_question" else "open"
        assert s == want


def test_staff_engaged_needs_one_signal(frame):
    rows = list(itertools.product((True, False, None), repeat=3))
    got = frame("a boolean, b boolean, c boolean", *rows).select(
        "a", "b", "c", status.staff_engaged(F.col("a"), F.col("b"), F.col("c")).alias("e"))
    assert all(r.e == any((r.a, r.b, r.c)) for r in got.collect())


def test_renamed_status(frame):
    got = frame("s string", ("open",), ("in_progress",), ("answered",), ("closed",), ("x",), (None,)).select(
        status.renamed_status(F.col("s")))
    assert [r[0] for r in got.collect()] == ["new", "assigned", "closed", "closed", "x", None]


@pytest.mark.parametrize("raw, want", [
    ("<p>a</p><br/>b", "a b"),
    ("  a \t\n b ", "a b"),
    ("\u00a0a\u00a0b\u00a0", "a\u00a0b"),
    ("\u3000a\u2003", "a"),
    ("a\x0bb", "a\x0bb"),
    ("a < b", "a < b"),
    ("a <\nb> c", "a c"),
    ("", ""),
    (None, None),
])
def test_strip_html(frame, raw, want):
    assert frame("t string", (raw,)).select(text.strip_html(F.col("t"))).first()[0] == want


def test_preview_counts_characters(frame):
    assert frame("t string", ("🙂é" * 100,)).select(text.preview(F.col("t"), 3)).first()[0] == "🙂é🙂"


@pytest.mark.parametrize("document, want", [
    ('{"domain": "Other"}', "Other"), ('{"domain": 3}', "3"), ('{"domain": {"a": 1}}', None),
    ('{"domain": ["a"]}', None), ('{"domain": null}', None), ('{"other": 1}', None), ("no json", None),
    ('{"domain": "{x"}', "{x"), (None, None),
])
def test_json_scalar(frame, document, want):
    got = frame("d string", (document,)).select(text.json_scalar(F.col("d"), "$.domain")).first()[0]
    assert got == want


def test_search_wildcards(frame):
    rows = frame("t string", ("50% off",), ("500 off",), ("A_b",), ("axb",))
    found = lambda term, wild: [r[0] for r in rows.filter(text.found_in(F.col("t"), term, wild)).collect()]
    assert found("50%", False) == ["50% off"]
    assert found("50%", True) == ["50% off", "500 off"]
    assert found("a_B", False) == ["A_b"]
    assert found("a_B", True) == ["A_b", "axb"]
    slashed = frame("t string", ("a\\b",), ("ab",), ("50%",))
    hits = lambda term: [r[0] for r in slashed.filter(text.found_in(F.col("t"), term, True)).collect()]
    assert hits("\\") == ["a\\b"] and hits("\\%") == ["a\\b"] and hits("A\\B") == ["a\\b"]


def test_ages_truncate_toward_zero(frame):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = frame("t timestamp_ntz", (at("2024-01-30 00:00:01"),), (at("2024-01-30 00:00:00"),),
                 (at("2024-01-29 00:00:00"),), (at("2024-01-31 00:30:00"),), (None,))
    got = rows.select(clock.whole_hours(F.col("t"), now), clock.urgency(F.col("t"), now)).collect()
    assert [tuple(r) for r in got] == [
        (23, "normal"), (24, "urgent"), (48, "critical"), (0, "normal"), (None, "critical")]


def test_unknown_age_matches_no_urgency_filter(frame):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = frame("t timestamp_ntz", (None,))
    for level in ("normal", "urgent", "critical"):
        assert rows.filter(clock.urgency_is(level, F.col("t"), now)).isEmpty()


def test_weeks_open_on_sunday(frame):
    rows = frame("t timestamp_ntz", (at("2024-01-27 23:59:59"),), (at("2024-01-28 00:00:00"),))
    got = [r[0] for r in rows.select(clock.sunday_of(F.col("t"))).collect()]
    assert got == [at("2024-01-21 00:00:00"), at("2024-01-28 00:00:00")]


@pytest.mark.parametrize("today, period, want", [
    ("2024-01-31", "today", ("2024-01-31", "2024-01-31")),
    ("2024-01-31", "this week", ("2024-01-29", "2024-01-31")),
    ("2024-01-28", "this week", ("2024-01-22", "2024-01-28")),
    ("2024-01-29", "this week", ("2024-01-29", "2024-01-29")),
    ("2024-02-29", "this month", ("2024-02-01", "2024-02-29")),
])
def test_periods(spark, today, period, want):
    bounds = clock.period_bounds(period, F.lit(today).cast("date"))
    got = spark.range(1).select(*bounds).first()
    assert tuple(str(d) for d in got) == want


def test_custom_period_and_all(spark):
    first, last = dt.date(2024, 1, 2), dt.date(2024, 1, 5)
    bounds = clock.period_bounds("custom", F.lit("2024-01-31").cast("date"), (first, last))
    assert tuple(spark.range(1).select(*bounds).first()) == (first, last)
    assert clock.period_bounds("all", F.lit("2024-01-31").cast("date")) is None
    with pytest.raises(ValueError):
        clock.period_bounds("next year", F.lit("2024-01-31").cast("date"))
