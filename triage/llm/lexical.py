"""Ranked lexical search with MaxScore and joint bounds of term pairs.

Every document becomes a narrow row of the asked terms it holds, written once. Tasks read these rows into
blocks. A block has a posting list for each term, its largest impact, and for pairs of frequent terms that
some query joins the intersection list with the largest joint impact. A query's terms stand in a fixed
order, weakest first, paired with their neighbours; the bound of its first j terms is the sum of pair
bounds where a pair lies in them, else of single maxima. Terms whose bound stays below the tenth best
score so far are not read as candidates, and candidates are dropped as soon as what is left cannot lift
them. Scores equal to the tenth best are followed up, so ties are settled as documents, not as they come.

All documents are asked every query, in blocks; nothing is cut off but by bounds that hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, per_batch

TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Documents of a block; the terms of queries that go to executors at once; texts whose words are not listed.
BLOCK_DOCS, QUERY_TERMS, LONG_TEXT = 4096, 200_000, 1 << 20
# A term in at least this part of a block's documents may have intersection lists.
PAIR_SHARE = 1 / 64

VECTORS = "doc_id long, n long, terms array<long>, tf array<long>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> Iterator[bytes]:
    """Terms of a text; only A to Z are lower-cased. UTF-8 of other letters has no byte below 128."""
    low = (text or "").encode().lower()
    if len(low) < LONG_TEXT:
        return re.findall(TERM, low)
    return (m.group() for m in re.finditer(TERM, low))


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: the distinct terms of each item; rows of one id are one item."""

    def start():
        def call(ids, texts):
            found = [(i, t.decode()) for i, text in zip(ids, texts) for t in set(terms_of(text))]
            return list(zip(*found)) if found else None

        return call

    return per_batch(items.select(F.col(id_col).cast("long"), F.col(text_col)), start, "item long, term string").distinct()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """VECTORS of the documents with at least one term: its terms' count and the asked ones with theirs."""

    def start():
        def call(ids, texts):
            out = ([], [], [], [])
            for doc_id, text in zip(ids, texts):
                counts = Counter(terms_of(text))
                if counts:
                    held = [(vocabulary[t], n) for t, n in counts.items() if t in vocabulary]
                    for column, value in zip(out, (doc_id, counts.total(), [t for t, _ in held], [n for _, n in held])):
                        column.append(value)
            return out

        return call

    return per_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col)), start, VECTORS)


class Block:
    """Postings of some documents: for each term the documents in ascending order, and their impacts."""

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weight: np.ndarray, docs: int, length: int):
        self.doc_ids, self.size = doc_ids, len(doc_ids)
        if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
            m = np.array([10 + 90 * int(x) * docs // length for x in n], "i8")
        else:
            m = 10 + (90 * n * docs) // length
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        order = np.argsort(term, kind="stable")
        self.row, self.impact = row[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.largest = np.zeros(len(weight), "i8")
        np.maximum.at(self.largest, term, impact)
        self.pair_largest: dict[tuple[int, int], int] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[term], self.bounds[term + 1]
        return self.row[a:b], self.impact[a:b]

    def intersect(self, pairs: list[tuple[int, int]], share: float) -> None:
        """Intersection lists of the pairs of frequent terms; what stays of each is its joint maximum."""
        often = np.diff(self.bounds) >= max(1, share * self.size)
        scratch, first = np.zeros(self.size, "i8"), None
        for a, b in pairs:
            if not (often[a] and often[b]):
                continue
            if a != first:
                scratch[:] = 0
                rows, impacts = self.postings(a)
                scratch[rows] = impacts
                first = a
            rows, impacts = self.postings(b)
            other = scratch[rows]
            both = impacts[other > 0] + other[other > 0]
            joint = int(both.max()) if len(both) else 0
            self.pair_largest[a, b] = max(joint, int(self.largest[a]), int(self.largest[b]))

    def prefix_bounds(self, terms: np.ndarray) -> np.ndarray:
        """For j = 0, 1, ...: the most that the first j terms can give one document."""
        out = np.zeros(len(terms) + 1, "i8")
        for j in range(1, len(terms) + 1):
            out[j] = out[j - 1] + self.largest[terms[j - 1]]
            if j % 2 == 0:
                joint = self.pair_largest.get((int(terms[j - 2]), int(terms[j - 1])))
                if joint is not None:
                    out[j] = min(out[j], out[j - 2] + joint)
        return out

    def search(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score at least ``least`` (all positive scores, if that is 0), with their scores."""
        least = max(least, 1)
        bound = self.prefix_bounds(terms)
        if bound[-1] < least:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        essential = int(np.searchsorted(bound, least, "left")) - 1  # the bound of the terms before stays below
        score = np.zeros(self.size, "i8")
        for t in terms[essential:]:
            rows, impacts = self.postings(t)
            score[rows] += impacts
        rows = np.flatnonzero(score)
        for j in range(essential - 1, -1, -1):
            rows = rows[score[rows] + bound[j + 1] >= least]
            if not len(rows):
                break
            held, impacts = self.postings(terms[j])
            if len(held):
                at = np.minimum(np.searchsorted(held, rows), len(held) - 1)
                hit = held[at] == rows
                score[rows[hit]] += impacts[at[hit]]
        rows = rows[score[rows] >= least]
        return rows, score[rows]


def _best(doc_ids: np.ndarray, scores: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The k best places: highest score, then smallest known id, rows without id last."""
    return np.lexsort((doc_ids, ~known, -scores))[:k]


def _rank_within(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_vectors(rows: DataFrame, queries: list[tuple[int | None, list[int]]], weight: list[int], docs: int, length: int,
                   k: int, block_docs: int = BLOCK_DOCS, pair_share: float = PAIR_SHARE) -> DataFrame:
    """FOUND: the k best documents of each query in each task; these hold the k best of all."""
    asked = [np.array(sorted(t, key=lambda t: (weight[t], t)), "i8") for _, t in queries]
    pairs = sorted({(int(t[j]), int(t[j + 1])) for t in asked for j in range(0, len(t) - 1, 2)})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                held.append(batch.slice(at, block_docs))
                while sum(b.num_rows for b in held) >= block_docs:
                    whole = pa.Table.from_batches(held)
                    yield block(whole.slice(0, block_docs))
                    held = whole.slice(block_docs).to_batches()
        if any(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    def block(table: pa.Table) -> Block:
        table = table.combine_chunks()
        terms = table["terms"].combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy())
        ids = table["doc_id"]
        made = Block(ids.fill_null(0).to_numpy().astype("i8"), table["n"].to_numpy().astype("i8"), np.repeat(np.arange(len(sizes)), sizes),
                     terms.flatten().to_numpy().astype("i8"), table["tf"].combine_chunks().flatten().to_numpy().astype("i8"),
                     np.array(weight, "i8"), docs, length)
        made.known = ids.is_valid().to_numpy()
        made.intersect(pairs, pair_share)
        return made

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, "i8")
        best = [(empty, empty, np.zeros(0, bool))] * len(asked)
        for made in blocks(batches):
            for i, terms in enumerate(asked):
                doc_ids, scores, known = best[i]
                found, new = made.search(terms, int(scores[-1]) if len(scores) == k else 0)
                if len(found):
                    doc_ids, scores = np.append(doc_ids, made.doc_ids[found]), np.append(scores, new)
                    known = np.append(known, made.known[found])
                    at = _best(doc_ids, scores, known, k)
                    best[i] = doc_ids[at], scores[at], known[at]
        for (item, _), (doc_ids, scores, known) in zip(queries, best):
            if len(scores):
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(scores), pa.int64()),
                                                  "doc_id": pa.array(doc_ids, mask=~known), "score": pa.array(scores)})

    return rows.mapInArrow(task, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, query_limit: int = QUERY_TERMS, block_docs: int = BLOCK_DOCS,
           pair_share: float = PAIR_SHARE) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item, scores above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Null and
    wordless texts have no terms: such documents are not counted and never found, such items find nothing.
    Repeated document rows are documents of their own; item rows of one id (null is one) are one item.
    Equal scores are ranked by doc_id, null last. Items are sent to executors in portions of about
    ``query_limit`` terms, each with a pass over the documents; a portion's terms are all the driver holds.
    """
    asked = cut(query_terms(items))
    portions = max(1, math.ceil(asked.count() / query_limit))
    found = None
    for number in range(portions):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(portions)) == number)
        hits = _search_portion(docs, part, k, block_docs, pair_share)
        found = hits if found is None else found.unionByName(hits)
    return _rank_within(found, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_portion(docs: DataFrame, asked: DataFrame, k: int, block_docs: int, pair_share: float) -> DataFrame:
    queries: dict[int | None, list[int]] = {}
    vocabulary: dict[bytes, int] = {}
    for item, term in asked.collect():
        queries.setdefault(item, []).append(vocabulary.setdefault(term.encode(), len(vocabulary)))
    rows = cut(vectors(docs, vocabulary))
    count, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = [math.floor(1000 * math.log((2 * count + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))]
    return search_vectors(rows, sorted(queries.items(), key=repr), weight, count, max(length, 1), k, block_docs, pair_share)
