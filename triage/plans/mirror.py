"""Content that follows whole snapshots of its source: late, edited and deleted rows reach it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.operators import snapshots
from triage.operators.joins import broadcast_if_small
from triage.sources.store import VersionedTable


class SourceMirror:
    """Hashes of the source rows that a content table was made from, and their daily digests.

    A snapshot is read once for its digests and, for the days that differ, once more for the rows that
    changed; only these are cleaned. Content is brought up to date first, the hashes next and the digests
    last, each with one commit, so a job that is lost in between is run again and finds what is left to do.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.key = key
        self.prints = VersionedTable(spark, f"{root}/prints", snapshots.PRINTS, by_day=True)
        self.digests = VersionedTable(spark, f"{root}/digests", snapshots.DIGESTS)

    def changes(self, snapshot: DataFrame) -> DataFrame:
        """key, change, old_day of every source row that differs from the last snapshot taken over."""
        return self._changes(snapshot, self._days(snapshots.digests(snapshots.prints(snapshot, self.key))))

    def sync(self, snapshot: DataFrame, clean: Callable[[DataFrame], DataFrame], content: VersionedTable,
             content_key: Callable[[Column], Column]) -> int:
        """Bring ``content`` (one folder per day) to what ``clean`` makes of the snapshot; number of changes.

        ``content_key`` gives the content id of a source key. A row that is changed so that cleaning leaves
        it out goes from the content, as a deleted one does. An item keeps its source row's creation time.
        """
        digests = snapshots.digests(snapshots.prints(snapshot, self.key)).persist()
        days = self._days(digests)
        changed = self._changes(snapshot, days).persist()
        try:
            count = changed.count()
            if count:
                keys = broadcast_if_small(changed.filter(F.col("change") != snapshots.DELETED).select(F.col("key").alias("_key")))
                fresh = self._of_days(snapshot, days).withColumn("_key", F.col(self.key).cast("string")).join(keys, "_key", "left_semi").drop("_key")
                old_days = {r.old_day for r in changed.select("old_day").distinct().collect() if r.old_day is not None}
                gone = changed.select(content_key(F.col("key")).alias("content_id"))
                content.exchange(gone, clean(fresh), "content_id", old_days)
                self.prints.exchange(changed.select("key"), snapshots.prints(fresh, self.key), "key", old_days)
            if days:
                self.digests.replace(digests)
            return count
        finally:
            changed.unpersist()
            digests.unpersist()

    def _days(self, digests: DataFrame) -> set[str]:
        """Days that differ: as many as the calendar has, at most."""
        return {r.day for r in snapshots.differing_days(self.digests.read(), digests).collect()}

    def _changes(self, snapshot: DataFrame, days: set[str]) -> DataFrame:
        return snapshots.changes(self.prints.read_parts(days), snapshots.prints(self._of_days(snapshot, days), self.key))

    @staticmethod
    def _of_days(rows: DataFrame, days: set[str]) -> DataFrame:
        """Rows of the days; the range they span reaches the scan."""
        made, dated = F.col("created_at"), sorted(days - {snapshots.UNDATED})
        wanted = F.lit(False)
        if dated:
            within = (made >= F.lit(dated[0]).cast("timestamp_ntz")) & (made < F.lit(dated[-1]).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
            wanted = within & F.to_date(made).cast("string").isin(dated)
        return rows.filter(wanted | made.isNull() if snapshots.UNDATED in days else wanted)
