"""Toxicity from two Kneser-Ney models of letters within words, one of each class.

For a letter x after the letters h of its word, class c has

    p_c(x | h) = max(n_c(hx) - D, 0) / n_c(h) + D * types_c(h) / n_c(h) * p_shared(x | h'),

where h' is h without its first letter and p_shared is the interpolated Kneser-Ney model of both
classes together: its counts are numbers of different letters seen before h'x. A rare expression thus
falls back on counts that both classes share and weighs nothing, while variants of one stem count
together. A text is judged by the difference of the two log-likelihoods, per letter over the whole
text, and by that of its most telling word; a logistic curve fitted on a fold of its own that gave no
counts turns the two into a score.

All counts are of all training rows, gathered by Spark. The letter groups are hashed to ``SLOTS``
slots, so the model that is sent to the executors has at most SLOTS rows, whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, per_batch

ORDER = 5
DISCOUNT = 0.75
SLOTS = 1 << 22
# Probability of a letter of which nothing is known.
UNIFORM = 1 / 256
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 1
# The logistic curve is fitted on at most so many labelled rows.
CALIBRATION_ROWS = 20_000
# Distinct words whose log-likelihoods a task remembers, and counts before it hands them on.
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")
# Where no rows are there to fit it on: intercept, weight per letter, weight of the word.
DEFAULT_CURVE = (-7.0, 1.0, 0.7)
# Columns of the model: counts of letter groups by class and the same for their contexts; types of
# each context by class; shared counts of the group, of the context, and its types.
PARTS = ("n0", "n1", "h0", "h1", "t0", "t1", "s", "hs", "ts")


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def letter_groups(words: list[str]):
    """Letters of all words, each word with an end mark: (word index, place, hashes by order).

    ``hashes[n]`` has for each letter the hash of the n letters that end with it, ``hashes[0]`` zero;
    a group of n is within its word where ``place + 1 >= n - 1`` (one start mark may be used).
    """
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    marks = codes == 0
    spot = np.arange(len(codes))
    start = np.maximum.accumulate(np.where(marks, spot, 0))
    start[1:][marks[1:]] = start[:-1][marks[1:]]  # an end mark belongs to the word before it
    age = spot - start
    hashes = [np.zeros(len(codes), "u8")]
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            before = np.concatenate([np.zeros(1, "u8"), hashes[-1][:-1]])
            h = (before * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(h ^ (h >> np.uint64(29)))
    word = np.cumsum(marks) - 1
    word[marks] -= 1
    return word, age, hashes


def _slot(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype("i8")


def _group_counts(words: Counter, label: int) -> tuple[np.ndarray, ...]:
    """Rows (hash of group, of its context, of its suffix, of the suffix's context, class counts, inner)."""
    names = list(words)
    times = np.fromiter((words[w] for w in names), "i8", len(names))
    word, age, h = letter_groups(names)
    rows = []
    for n in range(2, ORDER + 1):
        at = np.flatnonzero(age >= n - 1)
        # Only the longest group that a place has is counted by class; all serve the shared counts.
        longest = (age[at] == n - 1) | (n == ORDER)
        count = np.where(longest, times[word[at]], 0)
        group, first, back = np.unique(h[n][at], return_index=True, return_inverse=True)
        sums = np.bincount(back, count, len(group)).astype("i8")
        lone = at[first]
        rows.append((group, h[n - 1][lone - 1], h[n - 1][lone], h[n - 2][lone - 1], sums))
    group, context, suffix, under, sums = (np.concatenate(x) for x in zip(*rows))
    zeros = np.zeros(len(sums), "i8")
    return (group.astype("i8"), _slot(group), _slot(context), _slot(suffix), _slot(under),
            sums if label == 0 else zeros, sums if label == 1 else zeros)


COUNTS = "g long, slot long, context long, suffix long, under long, n0 long, n1 long"


def count_groups(texts: DataFrame) -> DataFrame:
    """One row per letter group of all rows of ``texts`` (text, label 0 or 1)."""

    def start():
        seen = (Counter(), Counter())

        def flush():
            for label in (0, 1):
                if seen[label]:
                    yield _group_counts(seen[label], label)
                    seen[label].clear()

        def call(text, label):
            for t, y in zip(text, label):
                seen[y].update(words_of(t))
            if len(seen[0]) + len(seen[1]) > REMEMBERED:
                return tuple(np.concatenate(x) for x in zip(*flush()))
            return None

        call.rest = flush
        return call

    rows = per_batch(texts, start, COUNTS)
    return rows.groupBy("g", "slot", "context", "suffix", "under").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def model_rows(groups: DataFrame) -> DataFrame:
    """(slot, PARTS): at most SLOTS rows, from the counts of all letter groups."""
    zero = {p: F.lit(0).cast("long") for p in PARTS}

    def part(at: str, **sums: Column) -> list[Column]:
        return [F.col(at).alias("slot"), *[sums.get(p, zero[p]).alias(p) for p in PARTS]]

    one = F.lit(1).cast("long")
    seen = [(F.col(n) > 0).cast("long") for n in ("n0", "n1")]
    pieces = [F.struct(*part("slot", n0=F.col("n0"), n1=F.col("n1"))),
              F.struct(*part("context", h0=F.col("n0"), h1=F.col("n1"), t0=seen[0], t1=seen[1])),
              F.struct(*part("suffix", s=one)), F.struct(*part("under", hs=one))]
    sums = groups.select(F.explode(F.array(*pieces)).alias("_p")).select("_p.*")
    sums = sums.groupBy("slot").agg(*[F.sum(p).alias(p) for p in PARTS if p != "ts"])
    # Types of a shared context: different groups of one letter less that follow it. The condition holds
    # for every group, as counts are never negative, and so does that under is never null: asking for the one and not
    # for the other keeps both readers of the groups alike, so that these are counted once.
    types = groups.filter(F.col("n0") + F.col("n1") >= 0).select("suffix", "under").distinct().groupBy("under").agg(F.count("*").alias("ts"))
    return sums.join(types, sums.slot.eqNullSafe(types.under), "left").select(
        "slot", *[F.coalesce(F.col(p), F.lit(0)).cast("float").alias(p) for p in PARTS])


class Model(NamedTuple):
    """The two models and the curve; small enough to be sent to every task."""

    slots: np.ndarray
    table: np.ndarray  # a row of zeros, then one of PARTS for each slot: sent as tasks use it, not copied there
    curve: tuple[float, float, float] = DEFAULT_CURVE

    @property
    def parts(self) -> np.ndarray:
        return self.table[1:]


def reader(slots: np.ndarray, table: np.ndarray):
    """A function from texts to (difference per letter, difference of the most telling word)."""
    index = np.zeros(SLOTS, "i4")
    index[slots] = np.arange(1, len(slots) + 1, dtype="i4")
    known: dict[str, float] = {}

    def learn(words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            known.update(zip(some, _differences(some, index, table).tolist()))

    def read(texts: list[str | None]) -> list[tuple[float, float]]:
        split = [words_of(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        learn(list({w for words in split for w in words} - known.keys()))
        out = []
        for words in split:
            if not words:
                out.append((0.0, 0.0))
                continue
            each = np.fromiter(map(known.__getitem__, words), "f8", len(words))
            letters = sum(map(len, words)) + len(words)
            out.append((float(each.sum() / letters), float(each.max())))
        return out

    return read


def _differences(words: list[str], index: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the log-likelihood under class 1 less that under class 0."""
    word, age, h = letter_groups(words)
    at = np.flatnonzero(age >= 1)
    age = age[at]
    rows = [index[_slot(h[n][at])] for n in range(ORDER + 1)]
    over = [index[_slot(h[n][at - 1])] if n else np.zeros(len(at), "i4") for n in range(ORDER)]
    shared = np.full(len(at), UNIFORM)
    total = np.zeros(len(at))
    column = {p: i for i, p in enumerate(PARTS)}
    for n in range(1, ORDER + 1):
        context = table[over[n - 1]] if n > 1 else None
        if n > 1:  # the class models, where this is the longest group of the place
            longest = (age == n - 1) | ((n == ORDER) & (age >= n - 1))
            logs = []
            for c in "01":
                whole, types = context[:, column["h" + c]], context[:, column["t" + c]]
                count = np.minimum(table[rows[n], column["n" + c]], whole)
                mixed = np.maximum(count - DISCOUNT, 0) + np.minimum(DISCOUNT * types, whole) * shared
                logs.append(np.log(np.where(whole > 0, mixed / np.maximum(whole, 1), shared)))
            total = np.where(longest, logs[1] - logs[0], total)
        if n < ORDER:  # the shared model of n letters
            inner = age >= n
            if n > 1:
                whole, types = context[:, column["hs"]], context[:, column["ts"]]
            else:
                root = index[0]
                whole = np.full(len(at), table[root, column["hs"]])
                types = np.full(len(at), table[root, column["ts"]])
            count = np.minimum(table[rows[n], column["s"]], whole)
            mixed = np.maximum(count - DISCOUNT, 0) + np.minimum(DISCOUNT * types, whole) * shared
            shared = np.where(inner & (whole > 0), mixed / np.maximum(whole, 1), shared)
    return np.bincount(word[at], total, len(words))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve over the two differences, weights not negative, ridge 1e-3."""
    if len(set(y.tolist())) < 2:
        return DEFAULT_CURVE
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + 1e-3 * w * (0, 1, 1)
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag((1e-9, 1e-3, 1e-3))
        w -= np.linalg.solve(curve, slope)
    w[1:] /= scale
    return tuple(float(v) for v in w) if np.isfinite(w).all() and (w[1:] >= 0).all() else _one_weight(x, y)


def _one_weight(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Where a weight turned negative: the word alone, halfway between the classes."""
    middle = (np.quantile(x[y == 1, 1], 0.1) + np.quantile(x[y == 0, 1], 0.99)) / 2
    return (-0.7 * float(middle), 0.0, 0.7)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", held_out: int = HELD_OUT) -> Model:
    """Count the training folds, collect the model (at most SLOTS rows), fit the curve.

    Rows with null id, null label or a label other than 0 and 1 teach nothing; null text is empty.
    An id with several labels teaches each; repeated rows count as often as they come. Fold
    ``held_out`` is never read; fold ``CALIBRATION`` only by the curve, of it at most
    CALIBRATION_ROWS rows, the smallest by hash of the id. Without labels the default curve scores
    every text alike. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), fold(id_col).alias("fold"))
    texts = texts.filter(F.col("id").isNotNull() & (F.col("fold") != held_out))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1))
    rows = texts.join(known.hint("shuffle_hash"), "id")
    counted = count_groups(rows.filter(F.col("fold") != CALIBRATION).select("text", "label"))
    found = model_rows(counted).toArrow()
    table = np.zeros((found.num_rows + 1, len(PARTS)), "f4")
    for i, p in enumerate(PARTS):
        table[1:, i] = found[p].to_numpy()
    model = Model(found["slot"].to_numpy().astype("i4"), table)
    del found
    ids = known.filter(fold("id") == CALIBRATION).dropDuplicates(["id"])
    few = ids.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS)  # ids and labels only
    sample = texts.filter(F.col("fold") == CALIBRATION).select("id", "text").join(F.broadcast(few), "id")
    seen = _read(sample.select("id", "label", "text"), model).toArrow()
    features = np.column_stack([seen[c].to_numpy() for c in ("per_letter", "peak")])
    return model._replace(curve=_fit_curve(features, seen["label"].to_numpy().astype("f8")))


def _read(rows: DataFrame, model: Model) -> DataFrame:
    """(id, label, text) to (id, label, per_letter, peak)."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def start():
        read = reader(*sent.value[:2])

        def call(ids, labels, texts):
            found = read(texts)
            return ids, labels, [a for a, _ in found], [b for _, b in found]

        return call

    return per_batch(rows, start, "id long, label int, per_letter double, peak double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, text_hash, per_letter, peak, score.

    Only the text is looked at. Texts without letters (null, empty) have differences of zero and the
    score the curve gives there. Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def start():
        slots, table, (base, per_letter, peak) = sent.value
        read = reader(slots, table)

        def call(ids, hashes, texts):
            found = read(texts)
            lines = [base + per_letter * a + peak * b for a, b in found]
            return (ids, hashes, [a for a, _ in found], [b for _, b in found],
                    [float(1 / (1 + np.exp(-np.clip(v, -60, 60)))) for v in lines])

        return call

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return per_batch(rows, start, "id long, text_hash long, per_letter double, peak double, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, whole; nothing is shuffled for it."""
    model = fit(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def task(batches):
        import pyarrow as pa

        let_go()
        slots, table, (base, per_letter, peak) = sent.value
        read = reader(slots, table)
        limit = float(np.log(threshold / (1 - threshold)))
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = read(part.column(at).to_pylist())
                keep = [base + per_letter * a + peak * b < limit for a, b in found]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
