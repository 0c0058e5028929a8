"""Parquet tables that can be replaced and upserted without touching what readers read.

Every change writes a new folder and then one manifest file that says which folder holds which
part; the change counts from the moment that file is there. A job that dies before it leaves the
table as it was, and its folder is never read. One writer per table at a time.

With ``by_day`` the parts are creation days, which suits long rows that are read by their time. With
``buckets`` they are a fixed number of hash buckets of the key, which suits rows that are changed and
looked up by key: a key never leaves its bucket, so a change reads and rewrites only the buckets of its
own keys, whatever else is stored. With neither, each change writes the whole table. The manifest is the
only thing the driver reads: one row per part, however many rows a part has.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.operators import edits
from triage.operators.joins import broadcast_if_small
from triage.schemas import schema_of

_MANIFEST = schema_of("version bigint, folder string, part string, filled boolean, commit_key string")
_UNDATED = "undated"
_WHOLE = "all"


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, by_day: bool = False,
                 buckets: int = 0, key: str | None = None):
        if buckets and (by_day or key is None):
            raise ValueError("buckets need a key and exclude by_day")
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.by_day = by_day
        self.buckets, self.key = buckets, key

    def on(self, spark: SparkSession) -> VersionedTable:
        """The same table for another session."""
        return VersionedTable(spark, self.root, self.schema, self.by_day, self.buckets, self.key)

    # -- reading -------------------------------------------------------------------------------

    def read(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """Current rows; with bounds, only the folders of days within them are opened."""
        parts = [p for p in self._live() if (first_day is None or p >= first_day) and (last_day is None or p <= last_day)]
        return self._rows(parts).drop("part")

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """Rows with one of the keys; of a table with buckets only theirs are opened."""
        asked = keys.select(self.key)
        return self._rows(self._parts_of(asked)).drop("part").join(broadcast_if_small(asked), self.key, "left_semi")

    def read_parts(self, parts: Collection[str]) -> DataFrame:
        """Rows of some days (``undated`` for rows without a time) or buckets; only their folders are opened."""
        return self._rows(parts).drop("part")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def _live(self) -> dict[str, str]:
        """Part -> the folder that holds it now."""
        newest = self._manifest().groupBy("part").agg(F.max_by(F.struct("folder", "filled"), "version").alias("now"))
        live = {r.part: r.now.folder for r in newest.filter("now.filled").collect()}
        if self.buckets and not all(p.endswith(f"of{self.buckets}") for p in live):
            raise ValueError(f"{self.root} is not laid out in {self.buckets} buckets")
        return live

    def _rows(self, parts: Collection[str]) -> DataFrame:
        live = self._live()
        layout = T.StructType([*self.schema.fields, T.StructField("folder", T.StringType()),
                               T.StructField("part", T.StringType())])
        paths = [f"{self.root}/data/folder={live[p]}/part={p}" for p in sorted(set(parts) & live.keys())]
        if not paths:
            return self.spark.createDataFrame([], layout).drop("folder")
        reader = self.spark.read.schema(layout).option("basePath", f"{self.root}/data")
        return reader.parquet(*paths).drop("folder")

    # -- writing -------------------------------------------------------------------------------

    def replace(self, rows: DataFrame, commit_key: str | None = None) -> bool:
        """The table becomes ``rows``."""
        if self._committed(commit_key):
            return False
        before = set(self._live())
        self._publish(rows, before, commit_key)
        return True

    def upsert(self, changes: DataFrame, key: str, order: Sequence[str] | None = None,
               commit_key: str | None = None, key_moves: bool = True) -> bool:
        """Apply changes by key; ``key_moves=False`` promises that a key never changes its day,
        which spares a table by days the look for the old day of each changed key."""
        if self._committed(commit_key):
            return False
        # The changes are read for their keys, their parts and themselves.
        changes = changes.persist()
        try:
            touched = self._touched(changes, key, key_moves)
            merge = edits.upsert_bodies if self.by_day else edits.upsert
            self._publish(merge(self._rows(touched).drop("part"), changes, key, order), touched, commit_key)
        finally:
            changes.unpersist()
        return True

    def delete(self, doomed: DataFrame, key: str, commit_key: str | None = None) -> bool:
        if self._committed(commit_key):
            return False
        touched = self._parts_of(doomed) if self.buckets else set(self._live())
        self._publish(edits.delete(self._rows(touched).drop("part"), doomed, key), touched, commit_key)
        return True

    def exchange(self, gone: DataFrame, rows: DataFrame, key: str, parts: Collection[str],
                 commit_key: str | None = None) -> bool:
        """Take the keys of ``gone``, which lie in ``parts``, out of the table and put ``rows`` in."""
        if self._committed(commit_key):
            return False
        rows = rows.persist()
        try:
            touched = set(parts) | self._parts_of(rows)
            kept = edits.delete(self._rows(touched).drop("part"), gone, key)
            self._publish(kept.unionByName(rows.select(*kept.columns)), touched, commit_key)
        finally:
            rows.unpersist()
        return True

    # -- parts ---------------------------------------------------------------------------------

    def _touched(self, changes: DataFrame, key: str, key_moves: bool) -> set[str]:
        """Parts an upsert rewrites: those of the changes and, of days, those their keys lie in now."""
        if not self.by_day:
            return self._parts_of(changes)
        days = self._with_part(changes).select("part")
        if key_moves:
            keys = broadcast_if_small(changes.select(key))
            days = days.union(self._rows(self._live()).join(keys, key, "left_semi").select("part"))
        return {r.part for r in days.distinct().collect()}

    def _parts_of(self, rows: DataFrame) -> set[str]:
        """Parts that the rows belong to; no stored row is looked at."""
        if not (self.by_day or self.buckets):
            return {_WHOLE}
        return {r.part for r in self._with_part(rows).select("part").distinct().collect()}

    def _with_part(self, rows: DataFrame) -> DataFrame:
        if self.buckets:
            bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets))
            return rows.withColumn("part", F.format_string(f"%05dof{self.buckets}", bucket))
        if self.by_day:
            return rows.withColumn("part", F.coalesce(F.to_date("created_at").cast("string"), F.lit(_UNDATED)))
        return rows.withColumn("part", F.lit(_WHOLE))

    def _publish(self, rows: DataFrame, parts: set[str], commit_key: str | None) -> None:
        """Write the rows, then the one manifest file; ``parts`` without rows become empty."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/folder={folder}"
        placed = self._with_part(edits.require(rows, self.schema))
        if self.by_day or self.buckets:
            # Few files per part, while adaptive execution splits a part that is too large for one task.
            placed = placed.hint("rebalance", "part")
        placed.write.partitionBy("part").parquet(path)
        layout = T.StructType([*self.schema.fields, T.StructField("part", T.StringType())])
        filled = {r.part for r in self.spark.read.schema(layout).parquet(path).select("part").distinct().collect()}
        version = self._manifest().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        entries = [(version, folder, part, part in filled, commit_key) for part in sorted(parts | filled)]
        # A commit that changes no part still records its key; the blank part is never filled.
        self._commit(entries or [(version, folder, "", False, commit_key)])

    def _commit(self, entries: list[tuple]) -> None:
        rows = self.spark.createDataFrame(entries, _MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def commits(self) -> DataFrame:
        """Keys of the changes made so far, one column."""
        return self._manifest().filter("commit_key is not null").select("commit_key").distinct()

    def _committed(self, commit_key: str | None) -> bool:
        if commit_key is None:
            return False
        return not self._manifest().filter(F.col("commit_key") == commit_key).isEmpty()
