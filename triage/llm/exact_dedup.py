"""Exact duplicates, with frequent texts split off before any shuffle.

Misra-Gries summaries find the digests that may be frequent; an exact count settles their winners,
which are broadcast and resolve their rows where they lie. All other digests go through one ordinary
shuffle of (id, digest), so no task receives the rows of a frequent text.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import choose_rows, cut, per_batch

# Counters of a summary: any text in more than one of SLOTS rows is found; at most SLOTS are broadcast.
SLOTS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, digest): SHA-256 of the text, A-Z lower-cased, in UTF-8; null text is empty."""

    def start():
        def call(ids, hashes, texts):
            sums = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").lower()).digest() for t in texts]
            return ids, hashes, sums

        return call

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return per_batch(rows, start, "id long, text_hash long, digest binary")


def _shrink(counters: Counter, slots: int) -> Counter:
    """Misra-Gries for whole batches: keep what exceeds the count of rank slots + 1, less that count."""
    if len(counters) <= slots:
        return counters
    floor = sorted(counters.values(), reverse=True)[slots]
    return Counter({k: n - floor for k, n in counters.items() if n > floor})


def frequent_candidates(keyed: DataFrame, column: str = "digest", slots: int = SLOTS) -> list[bytes]:
    """At most ``slots`` values; every value in more than 1 of slots + 1 rows is among them."""

    def start():
        seen = Counter()

        def call(values):
            seen.update(values)
            if len(seen) > 8 * slots:
                small = _shrink(seen, slots)
                seen.clear()
                seen.update(small)

        def rest():
            small = _shrink(seen, slots)
            yield list(small), list(small.values())

        call.rest = rest
        return call

    summaries = per_batch(keyed.select(column), start, "digest binary, n long")
    merged = summaries.groupBy("digest").agg(F.sum("n").alias("n"))
    top = merged.orderBy(F.desc("n"), "digest").limit(slots + 1).collect()  # bounded by slots
    floor = top[slots]["n"] if len(top) > slots else 0
    return [bytes(r["digest"]) for r in top if r["n"] > floor]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """A row for each row of ``docs``: id, text_hash, digest, keep_id, group_size, kept, copies.

    Of rows with equal texts the one with the largest id is kept. Null text counts as empty. Null ids
    rank below all others and are kept only where a text has no other. Rows that repeat id and text
    are one document repeated: exactly one of them is marked kept, and ``copies`` tells how many
    there are with the winner's id. Other columns are neither read nor returned. No rows in, no
    rows out.
    """
    keyed = cut(digests(docs, id_col, text_col))
    candidates = frequent_candidates(keyed, "digest", slots)
    by_digest = Window.partitionBy("digest")
    order = by_digest.orderBy(F.desc_nulls_last("id"), "text_hash")
    columns = ["id", "text_hash", "digest", "keep_id", "group_size", "kept", "copies"]

    def shuffled(rows: DataFrame) -> DataFrame:
        sized = rows.withColumns({
            "keep_id": F.max("id").over(by_digest), "group_size": F.count("*").over(by_digest),
            "_rank": F.row_number().over(order), "_best": F.first("text_hash").over(order)})
        top = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("_best"))
        sized = sized.withColumn("kept", F.col("_rank") == 1)
        return sized.withColumn("copies", F.sum(top.cast("long")).over(by_digest)).select(*columns)

    if not candidates:
        return shuffled(keyed)
    spark = docs.sparkSession
    # At most ``slots`` digests of 32 bytes, and later as many winners.
    names = F.broadcast(spark.createDataFrame([(d,) for d in candidates], "digest binary"))
    frequent = keyed.join(names, "digest", "left_semi")
    best = frequent.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # Of the rows that have the winning id, one text (they may differ in case) and its copies.
    tops = frequent.join(F.broadcast(best), "digest").filter(F.col("id").eqNullSafe(F.col("keep_id")))
    counted = tops.groupBy("digest", "keep_id", "group_size", "text_hash").agg(F.count("*").alias("copies"))
    winners = cut(counted.groupBy("digest", "keep_id", "group_size").agg(
        F.min(F.struct("text_hash", "copies")).alias("_top")).select(
            "digest", "keep_id", "group_size", F.col("_top.text_hash").alias("_hash"),
            F.col("_top.copies").alias("copies")).coalesce(1))
    found = keyed.join(F.broadcast(winners), "digest")
    lost = found.filter(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("_hash"))))
    lost = lost.withColumn("kept", F.lit(False)).select(*columns)
    won = winners.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("keep_id").alias("id"), F.col("_hash").alias("text_hash"), "digest", "keep_id", "group_size",
        (F.col("_i") == 1).alias("kept"), "copies")
    rare = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return lost.unionByName(won).unionByName(shuffled(rare))


def keep_one_per_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col, slots).filter("kept")
    return choose_rows(docs, cut(decided.select("id", "text_hash", "copies")), id_col, text_col)
