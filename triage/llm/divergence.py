"""How far the sources of a language differ in their words.

Words are found, packed and counted in numpy, straight from the Arrow bytes. A word of up to eight bytes
is one uint64, of up to sixteen two; these are sorted by radix (sixteen bits a pass) and counted as
runs. Longer words go to buckets of their length class, sorted by their bytes. What leaves a task is one row
for each word, language and source of a slice of texts; Spark adds them up.

All later arithmetic is on integers: parts per billion, rounded down, and their differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat import bytes_of, scatter, slices
from .common import cut

MIN_DOCS = 30
TOP_TERMS = 50
SCALE, SMOOTHING = 1_000_000_000, 5
# Text counted at a time; a longer text is counted in pieces of about this size.
SLICE_BYTES = 8 << 20
# Values of one dense block of words and sources, and sources compared with all others in one task.
BLOCK_CELLS, MOST_CELLS, TILE = 1 << 15, 1 << 22, 512

COUNTS = "lang string, source string, term string, n long, docs long"

# For each byte: the letter it counts as, 0 where it ends a word.
_LETTER = np.zeros(256, "u1")
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def words_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of the texts, and start, length and text number of each word in them."""
    # A zero byte after each text keeps words of neighbours apart.
    width = lengths + 1
    begin = np.cumsum(width) - width
    low = np.zeros(int(width.sum()) + 16, "u1")
    for at, a, n in zip(begin, starts, lengths):
        low[at:at + n] = _LETTER[data[a:a + n]]
    inside = (low != 0).view("i1")
    edges = np.flatnonzero(np.diff(inside, prepend=0))
    first, last = edges[::2], edges[1::2]
    return low, first, last - first, np.searchsorted(begin, first, "right") - 1


def packed(low: np.ndarray, first: np.ndarray, length: np.ndarray, skip: int) -> np.ndarray:
    """Bytes ``skip`` to ``skip + 8`` of each word as a big-endian uint64, zeros behind its end."""
    eight = np.ndarray(len(low) - 7, ">u8", low, strides=(1,))  # the eight bytes from each place on
    unused = np.uint64(64) - np.minimum(length - skip, 8).astype("u8") * np.uint64(8)
    return eight[first + skip].astype("u8") >> unused << unused


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows by uint64 columns, the first column counting most.

    Sixteen bits a pass from the last: numpy sorts such digits by counting. Digits equal in all rows
    are passed over.
    """
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype("u2")
            if len(digit) and (digit == digit[0]).all():
                continue
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(changed: np.ndarray) -> np.ndarray:
    """Starts of runs, given where a row differs from the one before."""
    changed[:1] = True
    return np.flatnonzero(changed)


def _differs(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def count_runs(keys: list[np.ndarray], order: np.ndarray, doc: np.ndarray, group: np.ndarray,
               weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in an order by key, then document: a row of each key and group, its weight and documents.

    Documents are numbered so that those of a group follow each other, thus a stable order by key alone
    is one by key, group and document.
    """
    keys, doc, weight = [k[order] for k in keys], doc[order], weight[order]
    group = group[doc]
    new_group = _differs([*keys, group])
    starts = _runs(new_group.copy())
    new_doc = _differs([*keys, doc]) | new_group
    new_doc[:1] = True
    if not len(starts):
        return order[:0], group[:0], weight[:0], weight[:0]
    return order[starts], group[starts], np.add.reduceat(weight, starts), np.add.reduceat(new_doc.astype("i8"), starts)


def _bucket(length: np.ndarray) -> np.ndarray:
    """Length class of a long word: 32, 64, 128, ... bytes."""
    return 1 << np.ceil(np.log2(np.maximum(length, 17))).astype("i8")


def count_words(low: np.ndarray, first: np.ndarray, length: np.ndarray, doc: np.ndarray, group: np.ndarray,
                weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket of lengths: word numbers, groups, occurrences and documents of the distinct words.

    ``doc`` must not fall along the words.
    """
    for lowest, highest, columns in ((1, 8, 1), (9, 16, 2)):
        some = np.flatnonzero((length >= lowest) & (length <= highest))
        if len(some):
            keys = [packed(low, first[some], length[some], 8 * c) for c in range(columns)]
            order = radix_order(keys)
            at, *rest = count_runs(keys, order, doc[some], group, weight[some])
            yield some[at], *rest
    long = np.flatnonzero(length > 16)
    sizes = _bucket(length[long])
    for size in np.unique(sizes):
        some = long[sizes == size]
        text = np.array([low[a:a + n].tobytes() for a, n in zip(first[some], length[some])], f"S{size}")
        code = np.unique(text, return_inverse=True)[1].astype("u8")
        order = radix_order([code])
        at, *rest = count_runs([code], order, doc[some], group, weight[some])
        yield some[at], *rest


def _count_slice(rows: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    lang, source = (rows.column(n).dictionary_encode() for n in ("lang", "source"))
    pair = lang.indices.to_numpy().astype("i8") * len(source.dictionary) + source.indices.to_numpy()
    by_group = np.argsort(pair, kind="stable")
    rows, pair = rows.take(pa.array(by_group)), pair[by_group]
    data, at, size = bytes_of(rows.column("text"))
    if rows.num_rows == 1 and size[0] > slice_bytes:
        parts = [_long_text(data[at[0]:at[0] + size[0]], slice_bytes)]
    else:
        low, first, length, doc = words_of(data, at, size)
        parts = [(low, first, length, doc, np.ones(len(first), "i8"))]
    for low, first, length, doc, weight in parts:
        for some, group, n, docs in count_words(low, first, length, doc, pair, weight):
            ends = np.cumsum(length[some])
            chars = np.empty(int(ends[-1]), "u1")
            scatter(chars, ends - length[some], low, first[some], length[some])
            bounds = pa.py_buffer(np.append(0, ends).astype("i4"))
            terms = pa.StringArray.from_buffers(len(some), bounds, pa.py_buffer(chars))
            langs, sources = np.divmod(group, len(source.dictionary))
            yield pa.RecordBatch.from_pydict({
                "lang": lang.dictionary.take(pa.array(langs)), "source": source.dictionary.take(pa.array(sources)),
                "term": terms, "n": pa.array(n), "docs": pa.array(docs)})


def _long_text(data: np.ndarray, slice_bytes: int) -> tuple:
    """The distinct words of one long text with their counts, found piece by piece between words."""
    zero, found, weights = np.zeros(1, "i8"), [], []
    at = 0
    while at < len(data):
        end = min(at + slice_bytes, len(data))
        while end < len(data) and _LETTER[data[end]]:  # a word is not cut
            end += 1
        low, first, length, doc = words_of(data, np.array([at]), np.array([end - at]))
        for some, _, n, _ in count_words(low, first, length, doc, zero, np.ones(len(first), "i8")):
            found += [low[a:a + w].tobytes() for a, w in zip(first[some], length[some])]
            weights.append(n)
        at = end
    length = np.array([len(w) for w in found], "i8")
    low = np.frombuffer(b"".join(found) + bytes(16), "u1")
    weight = np.concatenate(weights) if weights else zero[:0]
    return low, np.cumsum(length) - length, length, np.zeros(len(found), "i8"), weight


def word_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """COUNTS: occurrences of each word in each language and source, and the rows it is in."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield from _count_slice(part, slice_bytes)

    return rows.mapInArrow(task, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str):
    """Smoothed share in parts of SCALE, rounded down, plus one; in decimals, as the product may pass 2^63.
    NULL where no word is kept."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (cast({SCALE} as decimal(18, 0)) * cast({n} + {SMOOTHING} as decimal(18, 0))) "
                  f"div cast({total} + {SMOOTHING} * {kept} as decimal(20, 0)) END")


def kept_words(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of words in at least ``min_docs`` rows of their language."""
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("docs", in_lang).filter(F.col("docs") >= min_docs).drop("docs")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, slice_bytes: int = SLICE_BYTES,
               block_cells: int = BLOCK_CELLS) -> DataFrame:
    """For each source of each language: its distance to every other one, and the words it has too often.

    Returns lang, source, part ("pair" or "term"), item, value, rank. Null text, lang and source are empty
    strings; repeated rows count as often as they come; other columns are not read; no rows give none.
    Shares are those of ``share``. A pair's value is the sum over the language's kept words of the
    difference of both shares; a term's that of the source's share and the language's, for words of the
    source above it, the ``top`` largest. Equal values are ranked by the item's bytes.
    """
    words = cut(kept_words(word_counts(docs, slice_bytes), min_docs))
    lang_words = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = lang_words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sums = words.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    nothing = F.lit(0).cast("long")
    groups = cut(groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, nothing).alias(c) for c in ("total", "kept", "lang_total"))))

    shares = words.join(lang_words, ["lang", "term"]).join(groups, ["lang", "source"])
    more = share("n", "total", "kept") - share("lang_n", "lang_total", "kept")
    terms = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value"))
    terms = _ranked(terms.filter(F.col("value") > 0)).filter(F.col("rank") <= top)
    return _ranked(pairs(words, groups, block_cells)).unionByName(terms)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def pairs(words: DataFrame, groups: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Sums over kept words of the differences of shares, for every two sources of a language.

    Words are dealt by hash into blocks, each a dense table of its words and all sources of the language of
    about ``block_cells`` values; a block gives one sum for each pair, and these are added up. Blocks grow
    with the square of many sources, so that sums are fewer than values, up to MOST_CELLS; beyond TILE
    sources a block is compared in several tasks.
    """
    # A group's share of words it lacks is what it has in every block.
    groups = groups.withColumn("base", share("0", "total", "kept"))
    sized = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.count("*").alias("sources")).filter("kept > 0")
    cells = F.least(F.greatest(F.col("sources") * F.col("sources"), F.lit(block_cells)), F.lit(max(MOST_CELLS, block_cells)))
    sized = sized.select("lang", F.ceil(F.col("kept") * F.col("sources") / cells).cast("int").alias("blocks"),
                         F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"))
    every = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(groups, "lang")
    known = words.join(groups, ["lang", "source"]).join(sized, "lang").withColumn("share", share("n", "total", "kept"))
    rows = every.select("lang", "block", "tiles", "source", F.lit(None).cast("string").alias("term"),
                        F.col("base").alias("share"))
    rows = rows.unionByName(known.withColumn("block", F.pmod(F.hash("term"), "blocks")).select(*rows.columns))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sums = rows.groupBy("lang", "block", "tile").applyInPandas(_block_sums, "lang string, source string, item string, value long")
    found = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Sources of a language without kept words differ by nothing.
    bare = groups.filter("kept = 0").select("lang", "source")
    other = bare.select("lang", F.col("source").alias("item"))
    equal = bare.join(other, "lang").filter(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("long"))
    half = found.unionByName(equal)
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return both.withColumn("part", F.lit("pair"))


def _block_sums(rows):
    import pandas as pd

    base = rows[rows["term"].isna()].sort_values("source")
    known = rows[rows["term"].notna()]
    sources = base["source"].to_numpy(object)
    codes, terms = pd.factorize(known["term"])
    table = np.tile(base["share"].to_numpy("i8"), (len(terms), 1))
    table[codes, np.searchsorted(sources, known["source"].to_numpy(object))] = known["share"].to_numpy("i8")
    table = table.T.copy()
    out = []
    for a in range(int(rows["tile"].iloc[0]), len(sources) - 1, int(rows["tiles"].iloc[0])):
        value = np.abs(table[a + 1:] - table[a]).sum(axis=1)
        out.append(pd.DataFrame({"source": sources[a], "item": sources[a + 1:], "value": value}))
    if not out:
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})
    return pd.concat(out).assign(lang=rows["lang"].iloc[0])[["lang", "source", "item", "value"]]
