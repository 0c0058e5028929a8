"""What arrives late, out of order or twice."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, values
from triage.operators import edits
from triage.schemas import schema_of
from triage.sources.reader import read_log
from triage.sources.store import VersionedTable
from triage.streaming import streams

NOTES = "log_id string, created_at timestamp_ntz, message string"
LOG = schema_of("log_id string, created_at timestamp_ntz, message string")
EDITS = schema_of("content_id string, status string, updated_at timestamp_ntz")


def land(frame, path, schema, *rows):
    frame(schema, *rows).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, None])
def test_late_and_undated_events_are_kept(spark, frame, tmp_path, files):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    days = [("a", at("2024-01-10")), ("b", at("2024-01-09")), ("c", at("2024-01-01")), ("n", None)]
    for k, (key, day) in enumerate(days):
        land(frame, landing, NOTES, (key, day, "x"), *[(i, d, "x") for i, d in days[:k]])
        stream = streams.read_files(spark, landing, spark.read.parquet(landing).schema, files)
        streams.append_stream(stream, "log_id", out, mark).awaitTermination()
    assert sorted(r.log_id for r in read_log(spark, out, LOG).collect()) == ["a", "b", "c", "n"]


@pytest.mark.parametrize("files", [1, None])
def test_a_repeat_of_another_time_is_stored_once(spark, frame, tmp_path, files):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for days in ([("a", at("2024-01-10"))], [("a", at("2024-01-02")), ("b", None)], [("a", None), ("b", at("2024-03-01")), (None, None)],
                 [("c", at("2023-01-01")), (None, at("2024-01-01"))]):
        land(frame, landing, NOTES, *[(k, d, "x") for k, d in days])
        if files == 1:
            stream = streams.read_files(spark, landing, spark.read.parquet(landing).schema, files)
            streams.append_stream(stream, "log_id", out, mark).awaitTermination()
    stream = streams.read_files(spark, landing, spark.read.parquet(landing).schema, files)
    streams.append_stream(stream, "log_id", out, mark).awaitTermination()
    assert values(read_log(spark, out, LOG).select("log_id")) == sorted([("a",), ("b",), ("c",), (None,)], key=repr)


def test_a_batch_run_again_replaces_its_rows(spark, frame, tmp_path, monkeypatch):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(frame, landing, NOTES, ("a", at("2024-01-10"), "x"), ("b", None, "x"))
    stream = streams.read_files(spark, landing, spark.read.parquet(landing).schema)
    written, run = streams.require, streams._run

    def dies_after_writing(writer, apply, checkpoint):
        def broken(rows, batch_id):
            apply(rows, batch_id)
            raise RuntimeError("driver lost")

        return run(writer, broken, checkpoint)

    with monkeypatch.context() as patch:
        patch.setattr(streams, "_run", dies_after_writing)
        with pytest.raises(Exception, match="driver lost"):
            streams.append_stream(stream, "log_id", out, mark).awaitTermination()
    assert written is streams.require and read_log(spark, out, LOG).count() == 2
    land(frame, landing, NOTES, ("b", at("2024-01-11"), "y"), ("c", None, "y"))
    streams.append_stream(stream, "log_id", out, mark).awaitTermination()
    assert values(read_log(spark, out, LOG).select("log_id", "message")) == [("a", "x"), ("b", "x"), ("c", "y")]


def edit_stream(spark, landing, table, mark, files=None, name="edits"):
    stream = streams.read_files(spark, landing, EDITS, files)
    streams.upsert_stream(stream, table, "content_id", mark, name, order=["updated_at", "status"]).awaitTermination()


@pytest.mark.parametrize("layout", [{}, {"buckets": 8, "key": "content_id"}], ids=["whole", "buckets"])
@pytest.mark.parametrize("files", [1, None])
def test_an_older_edit_never_wins(spark, frame, tmp_path, files, layout):
    landing = str(tmp_path / "in")
    table = VersionedTable(spark, str(tmp_path / "t"), EDITS, **layout)
    for rows in ([("a", "late", at("2024-01-10"))], [("a", "early", at("2024-01-02")), ("b", "one", at("2024-01-03"))],
                 [("b", "none", None), ("a", "mid", at("2024-01-05"))]):
        land(frame, landing, "content_id string, status string, updated_at timestamp_ntz", *rows)
        if files == 1:
            edit_stream(spark, landing, table, str(tmp_path / "mark"), files)
    edit_stream(spark, landing, table, str(tmp_path / "mark"), files)
    assert values(table.read().select("content_id", "status")) == [("a", "late"), ("b", "one")]


def test_a_new_checkpoint_is_a_new_stream(spark, frame, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), EDITS)
    for k in ("a", "b"):
        land(frame, str(tmp_path / k), "content_id string, status string, updated_at timestamp_ntz", (k, "x", at("2024-01-01")))
        edit_stream(spark, str(tmp_path / k), table, str(tmp_path / f"mark-{k}"), name="same")
    assert values(table.read().select("content_id")) == [("a",), ("b",)]


def test_building_an_upsert_runs_nothing(spark, frame):
    stored = frame("k string, v bigint, t bigint", ("a", 1, 1))
    stop = F.udf(lambda v: 1 / 0, "bigint")
    changes = stored.withColumn("v", stop("v"))
    edits.upsert(stored, changes, "k", ["t"])
    edits.upsert(stored, changes, "k")
    edits.delete(stored, changes, "k")
