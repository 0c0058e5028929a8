"""File streams into versioned tables and append-only logs.

A micro-batch is an ordinary DataFrame, so cleaning and upserts are the batch operators. Every
commit carries the identity of the checkpoint and the batch number: a batch replayed after a failure
is skipped, and a stream with a new checkpoint is never taken for an older one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from triage.operators.edits import require
from triage.sources.reader import create_if_absent
from triage.sources.store import VersionedTable

# State on local disk with a change log in the checkpoint, so that it may outgrow memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: T.StructType,
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def upsert_stream(stream: DataFrame, table: VersionedTable, key: str, checkpoint: str, name: str,
                  transform: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                  order: Sequence[str] | None = None, key_moves: bool = True) -> StreamingQuery:
    """Run each micro-batch through ``transform`` and upsert it; stops when the input is used up.

    Rows count by the arrival of their file, so late rows are not missed as a high-water mark would
    miss them. With ``order`` an older change never replaces a newer stored row, so neither the size
    of batches nor the order of files shows in the table. A table with buckets rewrites only those of the
    keys of a batch; of a table by days ``key_moves=False`` promises that the source never changes the day
    of a key.
    """

    def apply(rows: DataFrame, batch_id: int) -> None:
        table.on(rows.sparkSession).upsert(transform(rows), key, order, commit_key=f"{_identity(rows)}:{batch_id}", key_moves=key_moves)

    return _run(stream.writeStream.queryName(name), apply, checkpoint)


def append_stream(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each key once, however late or changed its repeats come; only they are discarded.

    The keys seen are the state of the stream, kept for good: there is no watermark, so a row may be late
    by any time or have none. They lie on the executors' disks in the state store, dealt by key, and a
    batch looks up its own keys only, never the stored rows. The first row of a key to arrive is the one
    stored; of repeats within one batch any one. Rows without a key are one. Each batch is a folder of its
    own that a batch run again after a failure replaces, so rows are neither lost nor doubled. Keys that
    other jobs append to the same path are not known to the stream.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def apply(rows: DataFrame, batch_id: int) -> None:
        create_if_absent(rows.sparkSession, path, schema)
        require(rows, schema).write.mode("overwrite").parquet(f"{path}/batch-{_identity(rows)}-{batch_id}")

    schema = stream.schema
    return _run(stream.dropDuplicates([key]).writeStream, apply, checkpoint)


def _identity(rows: DataFrame) -> str:
    """The id that the checkpoint of the running stream keeps."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _run(writer: DataStreamWriter, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return writer.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
