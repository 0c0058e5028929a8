"""Chat formatting by columnar byte assembly.

A turn is five segments: opening mark, role, middle mark, content, closing mark. For a whole batch of
turns the segment lengths are one matrix, their running sum gives every offset, and each column of
segments is copied into one preallocated buffer by scatter indices; the buffer becomes the Arrow
column as it is. No text is put together in Python.

Marks inside texts are escaped: a backslash goes behind the first character of each, and what looks
like an escaped mark gets one more, so removing one backslash from each gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.operators.joins import broadcast_if_small

# Opening, middle and closing mark of a role; what has no entry is written with its name.
MARKS = {"system": ("[SYS] ", "", " [/SYS]\n"), "user": ("[INST] ", "", " [/INST]\n"),
         "assistant": ("<s> ", "", " </s>\n")}
NAMED = ("[TURN] ", " [AS] ", " [/TURN]\n")
LEARNT = "assistant"
CONTROL = r"(?:/?s>|/?SYS\]|/?INST\]|/?TURN\]|AS\])"
TO_ESCAPE, TO_RESTORE = rf"([<\[])(\\*{CONTROL})", rf"([<\[])\\(\\*{CONTROL})"
# Turns of one block of a conversation. A block is formatted as a whole, so a conversation of any length
# is spread over many tasks.
BLOCK_TURNS = 64
# Content bytes put together at a time, and the length from which a segment is copied by itself.
SLICE_BYTES, LONG = 1 << 22, 1 << 14

PARTS = "conv_id long, block long, piece int, n_turns long, text string, loss_start array<long>, loss_end array<long>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, TO_ESCAPE, r"\1\\\2")


def restored(text: str) -> str:
    return re.sub(TO_RESTORE, r"\1\2", text)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a string array without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "i4")[texts.offset:texts.offset + len(texts) + 1].astype("i8")
    return np.frombuffer(data or b"", "u1"), at[:-1], np.diff(at)


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``to[i]``: short ones by one index vector, long ones as they are."""
    short = np.flatnonzero((lengths > 0) & (lengths < LONG))
    lens = lengths[short]
    if len(short):
        inside = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(to[short], lens) + inside] = data[np.repeat(starts[short], lens) + inside]
    for i in np.flatnonzero(lengths >= LONG):
        out[to[i]:to[i] + lengths[i]] = data[starts[i]:starts[i] + lengths[i]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns and their bounds in it; then, in code points of each turn, where its
    content begins and ends and how long the turn is."""
    kinds = [*MARKS.values(), NAMED]
    literals = "".join(mark for marks in kinds for mark in marks).encode()
    sizes = np.array([[len(mark) for mark in marks] for marks in kinds], "i8")
    places = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    kind = pc.fill_null(pc.index_in(roles, pa.array(list(MARKS))), len(MARKS)).to_numpy(zero_copy_only=False)

    shown = escaped(pc.if_else(pa.array(kind == len(MARKS)), roles, ""))
    content = escaped(texts)
    name_data, name_at, name_len = bytes_of(shown)
    text_data, text_at, text_len = bytes_of(content)
    lengths = np.stack([sizes[kind, 0], name_len, sizes[kind, 1], text_len, sizes[kind, 2]], axis=1)
    ends = np.cumsum(lengths)
    starts = (ends - lengths.ravel()).reshape(lengths.shape)

    buffer = pa.allocate_buffer(int(ends[-1]) if len(ends) else 0)
    out = np.frombuffer(buffer, "u1")
    marks = np.frombuffer(literals, "u1")
    for column, which in ((0, 0), (2, 1), (4, 2)):
        scatter(out, starts[:, column], marks, places[kind, which], lengths[:, column])
    scatter(out, starts[:, 1], name_data, name_at, name_len)
    scatter(out, starts[:, 3], text_data, text_at, text_len)

    before = sizes[kind, 0] + pc.utf8_length(shown).to_numpy(zero_copy_only=False) + sizes[kind, 1]
    after = before + pc.utf8_length(content).to_numpy(zero_copy_only=False)
    return buffer, np.append(starts[:, 0], ends[-1] if len(ends) else 0), before, after, after + sizes[kind, 2]


def slices(batch: pa.RecordBatch, column: str, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch cut by the bytes of a column; a value that is longer is a slice of its own."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        full = (size[at - 1] if at else 0) + slice_bytes
        upto = max(at + 1, int(np.searchsorted(size, full, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _pieces(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns as parts; a part ends with its block or when its slice is full."""
    last, piece = None, -1
    for batch in batches:
        for rows in slices(batch, "text", slice_bytes):
            buffer, bounds, before, after, width = assemble(rows.column("role"), rows.column("text"))
            keys = list(zip(rows.column("conv_id").to_pylist(), rows.column("block").to_pylist()))
            first = np.array([0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)])
            numbers = []
            for i in first[:-1]:
                piece = piece + 1 if keys[i] == last else 0
                last = keys[i]
                numbers.append(piece)
            # Turns lie side by side in the buffer, so a part is a pair of offsets into it.
            texts = pa.StringArray.from_buffers(len(numbers), pa.py_buffer(bounds[first].astype("i4")), buffer)
            begins = np.cumsum(width) - width
            begins -= np.repeat(begins[first[:-1]], np.diff(first))
            learnt = np.flatnonzero(pc.equal(rows.column("role"), LEARNT).to_numpy(zero_copy_only=False))
            cuts = pa.array(np.searchsorted(learnt, first), pa.int32())
            starts, ends = (pa.ListArray.from_arrays(cuts, pa.array((begins + x)[learnt], pa.int64())) for x in (before, after))
            ids, blocks = zip(*(keys[i] for i in first[:-1]))
            columns = {"conv_id": pa.array(ids, pa.int64()), "block": pa.array(blocks, pa.int64()),
                       "piece": pa.array(numbers, pa.int32()), "n_turns": pa.array(np.diff(first), pa.int64()),
                       "text": texts, "loss_start": starts, "loss_end": ends}
            yield pa.RecordBatch.from_pydict(columns)


def format_chats(turns: DataFrame, block_turns: int = BLOCK_TURNS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Conversations as formatted text: PARTS, the parts of a conversation in order of block and piece.

    Turns are taken by ``turn``, equal ones by role and text, null ones first; repeated rows are turns of
    their own. Null role or text is empty; rows without ``conv_id`` are one conversation. Other columns are
    neither read nor returned. ``loss_start`` and ``loss_end`` are the places, in code points of the
    part, of what an assistant says. No rows give none.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    laid = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return laid.mapInArrow(lambda batches: _pieces(batches, slice_bytes), PARTS)


def spread(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Ids of the conversations that lie in more than the first block."""
    outside = F.col("turn").isNull() | (F.col("turn") < 0) | (F.col("turn") >= block_turns)
    return turns.filter(outside).select(F.col("conv_id").cast("long")).distinct()


HEADS = re.compile("|".join(f"(?P<{role}>{re.escape(marks[0])})" for role, marks in MARKS.items())
                   + f"|(?P<named>{re.escape(NAMED[0])})")


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    at = 0
    while at < len(text):
        head = HEADS.match(text, at)
        if head is None:
            raise ValueError(f"no turn begins at {at}")
        role, at = head.lastgroup, head.end()
        if role == "named":
            end = text.index(NAMED[1], at)
            role, at = restored(text[at:end]), end + len(NAMED[1])
            closing = NAMED[2]
        else:
            closing = MARKS[role][2]
        end = text.index(closing, at)
        yield role, restored(text[at:end])
        at = end + len(closing)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations whose parts come one after the other; one part is held at a time."""
    names = [part.strip().split(" ")[0] for part in DIGESTS.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, started, n_turns, loss_chars, chars = None, False, 0, 0, 0
    whole, loss = hashlib.sha256(), hashlib.sha256()

    def row():
        return current, n_turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        done = []
        columns = [batch.column(n) for n in ("conv_id", "text", "loss_start", "loss_end")]
        for i in range(batch.num_rows):
            conv_id, text, starts, ends = (c[i].as_py() for c in columns)
            if not started or conv_id != current:
                if started:
                    done.append(row())
                current, started, n_turns, loss_chars, chars = conv_id, True, 0, 0, 0
                whole, loss = hashlib.sha256(), hashlib.sha256()
            for role, said in read_turns(text):
                whole.update(f"{role}\n{said}\n".encode())
                n_turns += 1
            for a, b in zip(starts, ends):
                said = restored(text[a:b])
                loss.update(said.encode())
                loss_chars += len(said)
            chars += len(text)
        if done:
            yield batch_of(done)
    if started:
        yield batch_of([row()])


def digests(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """DIGESTS of every conversation, read back from its formatted parts.

    A digest of a conversation needs its parts in order. Where all lie in one block they come so from
    the formatting; only the parts of longer ones (see ``spread``) are moved again, and are then read
    one at a time, whatever the length of the conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    long_ones = broadcast_if_small(spread(rows, block_turns).toDF("_long"))
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = format_chats(rows.join(long_ones, same, "left_anti"), block_turns)
    parts = format_chats(rows.join(long_ones, same, "left_semi"), block_turns)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")
    return short.mapInArrow(_digest, DIGESTS).unionByName(ordered.mapInArrow(_digest, DIGESTS))
