"""Support-queue analytics on Spark DataFrames."""

from triage.settings import Settings

__all__ = ["Settings"]
