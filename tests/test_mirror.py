"""Late, edited and deleted source rows reach the content."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, values
from triage.operators import snapshots
from triage.plans.mirror import SourceMirror
from triage.schemas import schema_of
from triage.sources.store import VersionedTable

SOURCE = "id bigint, a string, b string, shown boolean, created_at timestamp_ntz"
CONTENT = schema_of("content_id string not null, a string, b string, created_at timestamp_ntz")
DAY1, DAY2, DAY3 = at("2024-01-01"), at("2024-01-02 23:59:59"), at("2024-01-03")
FIRST = [(1, "x", None, True, DAY1), (2, "x", "y", True, DAY1), (3, "x", "y", True, DAY2), (4, "x", "y", False, DAY3), (5, "x", "y", True, None),
         (6, "x", "y", True, DAY2)]


def clean(rows):
    return rows.filter("shown").select(F.concat(F.lit("p_"), F.col("id").cast("string")).alias("content_id"), "a", "b", "created_at")


def key(column):
    return F.concat(F.lit("p_"), column)


@pytest.fixture
def mirror(spark, frame, tmp_path):
    made, content = SourceMirror(spark, str(tmp_path), "id"), VersionedTable(spark, str(tmp_path / "content"), CONTENT, by_day=True)
    made.sync(frame(SOURCE, *FIRST), clean, content, key)
    return made, content


@pytest.mark.parametrize(("rows", "found"), [
    (FIRST, []),
    ([*FIRST, (7, "late", "y", True, DAY1)], [("7", "inserted")]),
    ([*FIRST, (7, "late", "y", True, None)], [("7", "inserted")]),
    ([(1, None, "x", True, DAY1), *FIRST[1:]], [("1", "updated")]),  # a value moves to its neighbour
    ([(1, "x", "", True, DAY1), *FIRST[1:]], [("1", "updated")]),
    ([*FIRST[:2], (3, "x", "y", True, DAY3), *FIRST[3:]], [("3", "updated")]),  # another day
    ([*FIRST[:2], (3, "x", "y", True, None), *FIRST[3:]], [("3", "updated")]),
    ([*FIRST[:2], (3, "x", "y", False, DAY2), *FIRST[3:]], [("3", "updated")]),  # cleaning leaves it out now
    (FIRST[1:], [("1", "deleted")]),
    ([], [(str(k), "deleted") for k in range(1, 7)]),
    ([(2, "x", "y", True, DAY2), (3, "x", "y", True, DAY1), *FIRST[3:], (9, "n", "n", True, DAY3)],
     [("1", "deleted"), ("2", "updated"), ("3", "updated"), ("9", "inserted")]),
])
def test_each_kind_of_change(frame, mirror, rows, found):
    made, content = mirror
    snapshot = frame(SOURCE, *rows)
    assert values(made.changes(snapshot).select("key", "change")) == found
    assert made.sync(snapshot, clean, content, key) == len(found)
    assert values(content.read()) == values(clean(snapshot))
    assert made.sync(snapshot, clean, content, key) == 0


def test_days_without_a_change_are_left_alone(frame, mirror):
    made, content = mirror
    before = content._live()
    made.sync(frame(SOURCE, *FIRST[1:]), clean, content, key)
    assert {d for d, f in content._live().items() if f != before.get(d)} == {"2024-01-01"}


@pytest.mark.parametrize("lost", ["prints", "digests"])
def test_a_job_lost_half_way_is_run_again(frame, mirror, monkeypatch, lost):
    made, content = mirror
    snapshot = frame(SOURCE, *FIRST[2:], (1, "new", None, True, DAY3), (8, "late", None, True, DAY1))

    def die(*_, **__):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(getattr(made, lost), "exchange" if lost == "prints" else "replace", die)
        with pytest.raises(RuntimeError):
            made.sync(snapshot, clean, content, key)
    made.sync(snapshot, clean, content, key)
    assert values(content.read()) == values(clean(snapshot))
    assert values(made.changes(snapshot)) == []


def test_digests_do_not_depend_on_order(frame):
    rows = snapshots.prints(frame(SOURCE, *FIRST), "id")
    again = snapshots.prints(frame(SOURCE, *FIRST[::-1]).repartition(3), "id")
    assert values(snapshots.digests(rows)) == values(snapshots.digests(again)) and snapshots.differing_days(
        snapshots.digests(rows), snapshots.digests(again)).isEmpty()
