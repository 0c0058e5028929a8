import pytest
from pyspark.sql import functions as F

from tests.conftest import at, values
from triage.schemas import schema_of
from triage.sources import reader
from triage.sources.store import VersionedTable

SCHEMA = schema_of("k string not null, v string, created_at timestamp_ntz")


@pytest.fixture(params=[{}, {"by_day": True}, {"buckets": 4, "key": "k"}], ids=["whole", "by_day", "buckets"])
def table(spark, tmp_path, request):
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA, **request.param)


def rows(spark, *items):
    return spark.createDataFrame([(k, v, None if d is None else at(f"2024-01-{d:02d}")) for k, v, d in items], SCHEMA)


def held(table):
    return values(table.read().select("k", "v"))


def test_empty_then_replace_upsert_delete(spark, table):
    assert held(table) == []
    table.replace(rows(spark, ("a", "1", 1), ("b", "1", 2), ("n", "1", None)))
    table.upsert(rows(spark, ("b", "2", 2), ("c", "2", 3)), "k")
    assert held(table) == [("a", "1"), ("b", "2"), ("c", "2"), ("n", "1")]
    table.delete(rows(spark, ("a", "", 1)), "k")
    assert held(table) == [("b", "2"), ("c", "2"), ("n", "1")]
    table.replace(rows(spark, ("z", "9", 9)))
    assert held(table) == [("z", "9")]


def test_row_that_changes_its_day_is_moved(spark, table):
    table.replace(rows(spark, ("a", "1", 1), ("b", "1", 2)))
    table.upsert(rows(spark, ("a", "2", 5)), "k")
    assert held(table) == [("a", "2"), ("b", "1")]


def test_only_touched_days_are_rewritten(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, by_day=True)
    table.replace(rows(spark, ("a", "1", 1), ("b", "1", 2)))
    table.upsert(rows(spark, ("c", "1", 2)), "k")
    assert sorted(p.name for p in (tmp_path / "t/data").glob("folder=*/part=*")) == ["part=2024-01-01", "part=2024-01-02", "part=2024-01-02"]
    assert held(table) == [("a", "1"), ("b", "1"), ("c", "1")]


def folders(tmp_path):
    return {p.name: p.parent.name for p in (tmp_path / "t/data").glob("folder=*/part=*")}


def test_a_change_leaves_the_buckets_of_other_keys_alone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=64, key="k")
    table.replace(rows(spark, *((f"k{i}", "1", 1 + i % 20) for i in range(300))))
    before = table._live()
    assert len(before) > 50
    change = rows(spark, ("k7", "2", 25), ("new", "2", None))
    table.upsert(change, "k")
    after, touched = table._live(), table._parts_of(change)
    assert len(touched) == 2 and {p for p in after if after[p] != before.get(p)} == touched
    assert len(table.read_keys(change).inputFiles()) == 2
    assert values(table.read_keys(change).select("k", "v")) == [("k7", "2"), ("new", "2")]
    table.delete(rows(spark, ("k8", "", 1)), "k")
    assert {p for p in after if after[p] != table._live().get(p)} == table._parts_of(rows(spark, ("k8", "", 1)))
    assert len(held(table)) == 300 and ("k8", "1") not in held(table)


def test_buckets_cannot_be_taken_for_others(spark, tmp_path):
    VersionedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4, key="k").replace(rows(spark, ("a", "1", 1)))
    with pytest.raises(ValueError, match="8 buckets"):
        VersionedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=8, key="k").read()
    with pytest.raises(ValueError, match="need a key"):
        VersionedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=8)


def test_commit_counts_once(spark, table):
    assert table.upsert(rows(spark, ("a", "1", 1)), "k", commit_key="s:0")
    assert not table.upsert(rows(spark, ("a", "2", 1)), "k", commit_key="s:0")
    assert held(table) == [("a", "1")]


def test_dead_batch_is_invisible_and_written_again(spark, table, monkeypatch):
    table.replace(rows(spark, ("a", "1", 1)))

    def die(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "_commit", die)
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, ("b", "lost", 1)), "k")
    assert held(table) == [("a", "1")]
    table.upsert(rows(spark, ("c", "1", 1)), "k")
    assert held(table) == [("a", "1"), ("c", "1")]


def test_bounds_open_only_their_days(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, by_day=True)
    table.replace(rows(spark, ("a", "1", 1), ("b", "1", 2), ("c", "1", 3)))
    part = table.read("2024-01-02", "2024-01-02")
    assert values(part.select("k")) == [("b",)]
    assert len(part.inputFiles()) == 1


def test_reader_keeps_its_snapshot(spark, table):
    table.replace(rows(spark, ("a", "1", 1)))
    before = table.read()
    table.replace(rows(spark, ("b", "1", 1)))
    assert [r.k for r in before.collect()] == ["a"]
    assert [r.k for r in table.read().collect()] == ["b"]


def test_null_keys_are_refused(spark, table):
    bad = spark.createDataFrame([(None, "1", at("2024-01-01"))], "k string, v string, created_at timestamp_ntz")
    with pytest.raises(Exception, match="must not be NULL"):
        table.replace(bad)


def test_create_if_absent_and_append(spark, tmp_path):
    path = str(tmp_path / "log")
    reader.create_if_absent(spark, path, SCHEMA)
    reader.append(rows(spark, ("a", "1", 1)), path, SCHEMA)
    reader.create_if_absent(spark, path, SCHEMA)
    reader.append(rows(spark, ("b", "1", 1)), path, SCHEMA)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_scan_pushes_the_tenant_down(spark, tmp_path):
    spark.createDataFrame([("t", 1), ("u", 2)], "client_id string, member_id bigint").write.parquet(str(tmp_path / "info_avatars"))
    rows_ = reader.scan(spark, str(tmp_path), "info_avatars", "t")
    assert values(rows_) == [("t", 1)]
    assert "EqualTo(client_id,t)" in rows_._jdf.queryExecution().executedPlan().toString()
    assert reader.by_created_date(rows(spark, ("a", "1", 3))).first().created_date.day == 3
