"""Near duplicates by SimHash: pigeonhole blocks, a join on them, and the Hamming distance.

A fingerprint is cut into blocks; two of them within ``bits`` differing bits agree on all but
``bits`` blocks, so they meet in the bucket of some choice of agreeing blocks. Buckets of ordinary
size are joined pair by pair. A fingerprint that is in a crowded bucket is handled without pairs and
without loss (for up to two bits): two fingerprints differ in at most two bits exactly when some
value differs from each in at most one, so crowded ones meet at their 65 nearest values, where at
most 65 can meet, and a star of links replaces the pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import choose_rows, cut, per_batch
from .components import connected_components

SEED = 42
# Buckets up to this size are joined pair by pair.
CROWDED = 24
BLOCKS = 4
# Shingle hashes whose bits are counted at a time.
CHUNK = 8192


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp): the 64-bit fingerprint as a signed long.

    Words lie between ASCII white space after lower-casing A-Z; shingles of ``shingle`` words, repeats
    included, or the whole sequence where there are fewer. A bit is set if it is set in over half of
    the shingles' XXH64. A text without words (null, empty, blank) has fingerprint zero.
    """

    def start():
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def fingerprint(text):
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            if not words:
                return 0
            ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
            line, width = b" ".join(words), min(shingle, len(words))
            first = [0, *(ends[: len(words) - width] + 1).tolist()]
            last = ends[width - 1:].tolist()
            ones = np.zeros(64, "i8")
            for at in range(0, len(first), CHUNK):
                part = [digest(line[a:b], SEED) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])]
                bits = np.unpackbits(np.array(part, "<u8").view("u1"), bitorder="little").reshape(-1, 64)
                ones += bits.sum(axis=0, dtype="i8")
            packed = np.packbits(2 * ones > len(first), bitorder="little")
            return int(packed.view("<i8")[0])

        def call(ids, hashes, texts):
            return ids, hashes, [fingerprint(t) for t in texts]

        return call

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return per_batch(rows, start, "id long, text_hash long, fp long")


def _masks(bits: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - bits blocks of a 64-bit word, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _first_bucket(a: Column, b: Column, masks: list[int]) -> Column:
    """The first bucket in which both are; a pair is taken there only."""
    apart = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])


def links(fps: DataFrame, bits: int = 2, blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """(src, dst) between distinct fingerprints (column fp): their components are those of all pairs
    within ``bits`` differing bits (0 to 2)."""
    if not 0 <= bits <= 2 or blocks <= bits:
        raise ValueError("bits must be 0, 1 or 2, and fewer than the blocks")
    masks = _masks(bits, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    members = fps.select("fp", F.explode(keys).alias("_key")).select("fp", "_key.b", "_key.k")
    sizes = cut(members.groupBy("b", "k").agg(F.count("*").alias("n")).filter("n > 1"))
    met = cut(members.join(sizes, ["b", "k"]))
    plain = met.filter(F.col("n") <= crowded)
    a, c = plain.select("b", "k", F.col("fp").alias("src")), plain.select("b", "k", F.col("fp").alias("dst"))
    pairs = a.join(c, ["b", "k"]).filter(
        (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits)
        & (_first_bucket(F.col("src"), F.col("dst"), masks) == F.col("b"))).select("src", "dst")
    if bits == 0:
        return pairs
    dense = met.filter(F.col("n") > crowded).select("fp").distinct()
    flips = [0, *((1 << i) - (1 << 64) * (i == 63) for i in range(64))]
    near = dense.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("_flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("at"))
    if bits == 2:  # at most 65 fingerprints are within one bit of a value
        stars = near.groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("_near")).filter(F.size("_near") > 1)
    else:  # within one bit: the fingerprint that has the value, and those beside it
        stars = near.groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("_near")).filter(
            (F.size("_near") > 1) & F.array_contains("_near", F.col("at")))
        stars = stars.select(F.concat(F.array("at"), F.array_remove("_near", F.col("at"))).alias("_near"))
    star = stars.select(F.col("_near")[0].alias("src"), F.explode(F.slice("_near", 2, 65)).alias("dst"))
    return pairs.unionByName(star.distinct())


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id",
                       text_col: str = "text", blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """A row for each row of ``docs``: id, text_hash, fp, component, component_id.

    ``component_id`` is the smallest id reachable over fingerprints within ``bits`` differing bits,
    the row's own included; null where no reachable row has an id. ``component`` is a fingerprint that
    stands for the component. Texts without words share
    fingerprint zero and link like any others. Repeated rows are linked to each other. Other columns are
    neither read nor returned.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    parts = cut(connected_components(links(fps, bits, blocks, crowded)))
    placed = fps.join(parts, fps.fp == parts.node, "left")
    placed = placed.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(least, "component").select("fp", "component", "component_id"))
    return rows.join(named, "fp").select("id", "text_hash", "fp", "component", "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one row each, with all columns.

    Where rows of different texts share that id, the one with the smallest text hash stays.
    """
    found = simhash_components(docs, shingle, bits, id_col, text_col)
    first = found.filter(F.col("id").eqNullSafe(F.col("component_id")))
    counted = first.groupBy("component", "id", "text_hash").agg(F.count("*").alias("copies"))
    best = counted.groupBy("component").agg(F.min(F.struct("id", "text_hash", "copies")).alias("_best"))
    chosen = best.select("_best.*").groupBy("id", "text_hash").agg(F.max("copies").alias("copies"))
    return choose_rows(docs, cut(chosen), id_col, text_col)
