"""Token counts kept as additive totals, brought up to date by signed batches.

A batch is a table of signed changes. It is summed by source, language and tokenizer version and
written as one small delta; the delta's folder is named by the batch, so writing a batch again replaces
the same folder, and a batch whose delta is there is skipped. Totals are sums of deltas. Nothing is
ever updated in place: a lost job leaves no folder marked as done, and is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens")
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def inserted(docs: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    """Each row adds one document and its tokens."""
    return _signed(docs, F.lit(1), tokens, tokenizer)


def deleted(docs: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    """Each row takes away one document and the tokens it was counted with."""
    return _signed(docs, F.lit(-1), -tokens, tokenizer)


def revised(docs: DataFrame, old: Column, new: Column, tokenizer: str) -> DataFrame:
    """Each row corrects the count of a document that stays."""
    return _signed(docs, F.lit(0), F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)), tokenizer)


def _signed(docs: DataFrame, sign: Column, tokens: Column, tokenizer: str) -> DataFrame:
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"), sign.cast("long").alias("documents"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


class TokenTotals:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Apply a batch of signed changes once; False if it was committed before.

        Changes of one batch count together, in any order. Null sources and languages are groups of
        their own. A batch without rows is committed and changes nothing. ``batch_id`` may hold
        letters, digits, dots, dashes and underscores, and starts with a letter or digit.
        """
        if not batch_id[:1].isalnum() or not all(c.isalnum() or c in "._-" for c in batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._done(batch_id):
            return False
        rows = changes[0] if changes else self.spark.createDataFrame([], DELTA)
        for more in changes[1:]:
            rows = rows.unionByName(more)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums = sums.filter((F.col("documents") != 0) | (F.col("tokens") != 0))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        return True

    def batches(self) -> list[str]:
        """Committed batches: a folder counts once its job has marked it as done."""
        fs, path = self._path(self.folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        found = [n.removeprefix("batch=") for n in names if n.startswith("batch=")]
        return sorted(b for b in found if self._done(b))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens: groups that sum up to nothing are left out."""
        folders = [f"{self.folder}/batch={b}" for b in self.batches()]
        deltas = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.filter((F.col("documents") != 0) | (F.col("tokens") != 0))

    def _done(self, batch_id: str) -> bool:
        fs, path = self._path(f"{self.folder}/batch={batch_id}/_SUCCESS")
        return fs.exists(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
