"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers and shifted to be non-negative; bit b of component d over the rows
of a block is a bitmap, a slice. The score slices of a query are the sum of its multiples of the slices,
by full adders on bitmaps. The best rows are then taken from the most significant slice downward; where
more rows tie than places are left, the smallest ids win.

Candidate rows are dealt into blocks by hash of the id, every block also receives the queries, and a
task streams them: it holds one block's slices and a batch of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
# Rows of a block, on average.
BLOCK_ROWS = 16_384
BATCH = 512


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * component) as longs. Rows with a null id, a null vector, or a component
    that is null or not finite are left out: they take no part. A component that does not fit a long once
    it is scaled fails the job, by name."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)

    def whole(x):
        scaled = x * F.lit(float(scale))
        wide = F.raise_error(F.concat(F.lit("component does not fit a long: "), x.cast("string"))).cast("long")
        return F.when((scaled >= -(2.0 ** 63)) & (scaled < 2.0 ** 63), F.floor(scaled)).otherwise(wide)

    return rows.select("id", F.transform("v", whole).alias("v"))


class SlicedBlock:
    """Slices of a block of rows; ids ascend, so earlier rows win ties."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.width = len(ids), values.shape[1]
        self.low = values.min(axis=0) if self.rows and self.width else np.zeros(self.width, "i8")
        shifted = values.view("u8") - self.low.view("u8")  # exact, as no difference passes 2^64
        self.top = shifted.max(axis=0) if self.rows and self.width else np.zeros(self.width, "u8")
        self.bits = [int(t).bit_length() for t in self.top]
        self.slices = [[_bitmap(shifted[:, d] >> np.uint64(b) & np.uint64(1)) for b in range(self.bits[d])] for d in range(self.width)]
        self.all = _bitmap(np.ones(self.rows, "i8"))

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices, base): the score of a row is base plus its number in the slices.

        A negative weight multiplies the complement of a component within its bits, so that all is
        addition: q * s = -q * (top - s) + q * top, top all ones.
        """
        planes: list[list[np.ndarray]] = []
        base = 0
        for d in range(self.width):
            weight = int(query[d]) if d < len(query) else 0
            base += weight * int(self.low[d])
            if not weight or not self.slices[d]:
                continue
            number = self.slices[d]
            if weight < 0:
                base += weight * ((1 << self.bits[d]) - 1)
                number = [self.all & ~s for s in number]
                weight = -weight
            for p in range(weight.bit_length()):
                if weight >> p & 1:
                    while len(planes) <= p:
                        planes.append([])
                    planes[p] = _add(planes[p], number)
        total: list[np.ndarray] = []
        for number in reversed(planes):  # Horner: twice the higher planes, plus this one
            total = _add([np.zeros_like(self.all), *total] if total else [], number)
        return total, base

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows whose id is not ``own``, best first, ties to the smaller id."""
        slices, base = self.score_slices(query)
        able = self.all.copy()
        first, last = np.searchsorted(self.ids, (own, own + 1)) if own < (1 << 63) - 1 else (self.rows, self.rows)
        for row in range(first, last):
            able[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure, tied = np.zeros_like(able), able
        for s in reversed(slices):
            with_bit = tied & s
            count = _count(sure) + _count(with_bit)
            if count > k:
                tied = with_bit
            else:
                sure |= with_bit
                tied = tied & ~s
                if count == k:
                    break
        rows = _rows(sure)
        boundary = _rows(tied)[: k - len(rows)] if len(rows) < k else []
        scored = []
        for row in [*rows, *boundary]:
            at, bit = row >> 6, np.uint64(row & 63)
            score = base + sum(int(s[at] >> bit & np.uint64(1)) << b for b, s in enumerate(slices))
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError(f"score {score} of query {own} and row {self.ids[row]} does not fit a long")
            scored.append((int(self.ids[row]), score))
        return sorted(scored, key=lambda r: (-r[1], r[0]))


def _bitmap(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits.astype("u1"), bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, "u1")]).view("<u8")


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray) -> list[int]:
    return np.flatnonzero(np.unpackbits(bitmap.view("u1"), bitorder="little")).tolist()


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two sliced numbers, least significant slice first."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            y = b[i]
            half = x ^ y
            if carry is None:
                out.append(half)
                carry = x & y
            else:
                out.append(half ^ carry)
                carry = (x & y) | (carry & half)
        elif carry is None:
            out.extend(a[i:])
            break
        else:
            out.append(x ^ carry)
            carry = x & carry
            if not carry.any():
                carry = None
    if carry is not None and carry.any():
        out.append(carry)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank from 1, id, score) of the k best rows of ``vectors`` for each row of ``queries``.

    Rows with the query's id are not its candidates. Vectors of unequal length are filled up with
    zeros. Queries that repeat id and vector are one query; candidates that repeat are each a row. Null vectors and such with
    null or non-finite components take no part; a component or one of the best scores that does not fit a
    long fails the job. With fewer candidates all are returned, with none no row.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).dropDuplicates(["id", "v"])
    blocks = max(1, -(-vectors.count() // block_rows))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asked"), "id", "v")
    both = held.unionByName(asked.select(everywhere.alias("block"), F.lit(1).alias("asked"), "id", "v"))
    # Blocks are few and all alike, so each is a partition of its own; a hash would put some together.
    dealt = both.repartitionById(blocks, "block").sortWithinPartitions("block", "asked", "id")
    local = dealt.mapInArrow(lambda batches: _blocks(batches, k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each block's rows come first, then the queries, batch by batch."""
    block, ids, values, index = None, [], [], None
    for batch in batches:
        numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if a == b:
                continue
            if numbers[a] != block:
                block, ids, values, index = numbers[a], [], [], None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                ids.append(part.column(2).to_numpy())
                values += part.column(3).to_pylist()
                continue
            if index is None:
                if not ids:
                    continue
                index = SlicedBlock(np.concatenate(ids), _matrix(values))
                ids, values = [], []
            for at in range(0, part.num_rows, BATCH):
                out = ([], [], [])
                some = part.slice(at, BATCH)
                for own, query in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                    for row, score in index.best(query, own, k):
                        for column, value in zip(out, (own, row, score)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "id", "score"])


def _matrix(values: list[list[int]]) -> np.ndarray:
    width = max(map(len, values), default=0)
    out = np.zeros((len(values), width), "i8")
    for row, v in zip(out, values):
        row[: len(v)] = v
    return out
