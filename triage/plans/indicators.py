"""Stored totals for indicators, brought up to date by each batch of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from triage.operators import totals
from triage.sources.store import VersionedTable


class LiveIndicators:
    """States of tickets by key bucket, and the totals of them.

    A batch is applied in two commits under one key: first the totals, then the states. A job lost between
    them is run again with the same batch: it computes the same changes, as the states are still the old
    ones, finds the totals done and goes on with the states. Another batch is refused until then. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.states = VersionedTable(spark, f"{root}/states", totals.STATES, buckets=buckets, key="content_id")
        self.totals = VersionedTable(spark, f"{root}/totals", totals.LIVE_TOTALS)

    def rebuild(self, stored: DataFrame, edits: DataFrame | None = None) -> None:
        """Start from stored tickets (one row each) and the newest edits that are known."""
        self.states.replace(totals.states(stored, edits))
        self.totals.replace(totals.live_totals(self.states.read()))

    def apply(self, edits: DataFrame, batch: str) -> bool:
        """Count a batch of edits once; False if it was counted before."""
        waiting = self.totals.commits().join(self.states.commits(), "commit_key", "left_anti").filter(f"commit_key <> '{batch}'")
        if not waiting.isEmpty():
            raise RuntimeError("a batch was lost half way; run it again before the next one")
        narrow = edits.select("content_id", *totals.STATE_ORDER).persist()
        changed = totals.edited(self.states.read_keys(narrow), narrow).persist()
        try:
            moved = totals.live_totals(changed, -1).unionByName(totals.live_totals(totals.after(changed)))
            counted = self.totals.replace(totals.added(self.totals.read(), moved), batch)
            kept = self.states.upsert(totals.after(changed), "content_id", commit_key=batch)
            return counted or kept
        finally:
            changed.unpersist()
            narrow.unpersist()

    def open_stats(self, now: Column) -> DataFrame:
        return totals.open_stats(self.totals.read(), self.states.read(), now)

    def daily_stats(self, now: Column) -> DataFrame:
        return totals.daily_stats(self.totals.read(), self.states.read(), now)
