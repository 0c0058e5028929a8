"""What the operators share: Arrow tasks, text rules, cut lineage, choosing rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.settings import shared_dir

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words between the ASCII white space characters.
WORDS = r"[^\x20\x09-\x0D]+"
# Rows handed to one call of a task function; texts can be long.
SLICE_ROWS = 256


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


# What the tasks of a run have in common in this Python process, by the run's name: of one run at most.
_held: dict[str, Any] = {}


def hold(run: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once for the tasks of a run in this Python process. Spark uses its Python processes for
    stage after stage, so a task of any other run that begins here lets it go."""
    let_go(run)
    if run not in _held:
        _held[run] = make()
    return _held[run]


def let_go(run: str | None = None) -> None:
    """Drop what tasks of other runs hold in this Python process. Tasks of ``per_batch`` begin with it, and so does every
    other Python task of the pipeline's stages."""
    for other in _held.keys() - {run}:
        del _held[other]


def per_batch(rows: DataFrame, start: Callable[[], Callable], schema: str, run: str | None = None) -> DataFrame:
    """Arrow batches through ``start()(columns) -> columns``; ``start`` runs once in each task.

    ``columns`` are Python lists in the order of the frame. Batches are cut to ``SLICE_ROWS`` rows,
    so a task holds the values of a few hundred texts at a time, whatever the batch size of the
    session. Only what tasks hold for ``run`` is left from the tasks before.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(run)
        call = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = call(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)
        rest = getattr(call, "rest", None)
        if rest is not None:
            for out in rest():
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    fields = _fields(schema)
    names, types = [n for n, _ in fields], [t for _, t in fields]
    return rows.mapInArrow(task, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
         "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string())}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(n, ARROW[t]) for n, t in (part.strip().split(" ", 1) for part in schema.split(","))]


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; off one machine it must name one."""
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(rows: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name below the shared one."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_prefix(*frames: DataFrame) -> str:
    """Underscores that no column of the frames begins with, for columns of our own."""
    prefix = "_"
    while any(c.startswith(prefix) for rows in frames for c in rows.columns):
        prefix += "_"
    return prefix


def choose_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` names, each once, with all their columns.

    ``chosen`` has ``id``, ``text_hash`` (xxhash64 of the text) and ``copies``, one row per pair of
    the first two; ``copies`` is how many rows of ``docs`` have that pair. Rows equal in both are
    the same document repeated: one of them stays. ``chosen`` is hashed, so texts are not sorted.
    """
    own = free_prefix(docs)
    row_hash, chosen_id, chosen_hash, copies = (own + n for n in ("row_hash", "id", "hash", "copies"))
    chosen = chosen.select("id", "text_hash", "copies").toDF(chosen_id, chosen_hash, copies)
    keyed = docs.withColumn(row_hash, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(chosen_id)) & (F.col(row_hash) == F.col(chosen_hash))
    if chosen.filter(F.col(copies) > 1).isEmpty():
        return keyed.join(chosen.hint("shuffle_hash"), same, "left_semi").drop(row_hash)
    hit = keyed.join(chosen.hint("shuffle_hash"), same)
    once, repeated = hit.filter(F.col(copies) == 1), hit.filter(F.col(copies) > 1)
    return once.unionByName(repeated.dropDuplicates([row_hash, id_col])).select(*docs.columns)
