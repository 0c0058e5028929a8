"""Packing documents into token sequences by best-two-fit.

Documents are tokenised where they lie and leave as narrow rows, one for each piece. Pieces are dealt
by hash into groups of a bounded number, and each group is packed by itself; what a group wastes in
its last bins is small beside its size. Pieces that fill a sequence need no packing.
"""

from __future__ import annotations

import gc
import uuid
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hold, let_go, per_batch

CAPACITY = 2048
# Pieces of a group, on average: about as many rows of a few numbers are in one task at a time.
GROUP = 16_384
# What is white space to some Unicode version or engine, and what is near it. A byte-level BPE takes the last space
# before a visible character into that character's word, and line breaks between visible characters one by one. So a
# text may be cut at a single space between visible characters, and before one or two line breaks between them.
BLANK = r"\x00-\x20\x7F-\xA0\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u3000\uFEFF"
WORD_START = rf"(?<=[^{BLANK}])(?: (?=[^{BLANK}])|(?=\n\n?[^{BLANK}]))"
WHOLE_WORD = rf"\n?\n?[^{BLANK}](?:.*[^{BLANK}])?"
# Letters as every Unicode version has them; an ASCII character that is none begins something new.
LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
PLAIN_WORD = rf"(\n?\n?)([{LATIN}]+)((?:[\x00-@\[-`{{-\x7F].*)?)"
# Encoded words a process keeps before it sets all aside, dropping those set aside before that it has not met since;
# and the length of the longest of them.
KNOWN_WORDS, KNOWN_LENGTH = 600_000, 48
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    Texts are cut where words begin: words seen before are looked up, new plain words go through the
    tokenizer's BPE model, and whatever is not a plain word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = [chr(c) for c in (32, *range(0xC0, 0x100))]
        self.as_bytes = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.cut, self.whole = re.compile(WORD_START).split, re.compile(WHOLE_WORD, re.DOTALL).fullmatch
        self.plain = re.compile(PLAIN_WORD, re.DOTALL).fullmatch
        # Ids as bytes, so that those of a text are joined and not converted one by one. A word that begins with a
        # line break is written with it, all others without the space before them.
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}
        line_break, = self._encode(["\n"])
        self.breaks = {"": b"", "\n": line_break, "\n\n": line_break * 2}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles among them
        try:
            cut = [self._cut(text) for text in texts]
            heads = self._encode([head for head, _ in cut])
            return [np.frombuffer(head + b"".join(ids), "<u4") for head, (_, ids) in zip(heads, cut)]
        finally:
            if collecting:
                gc.enable()

    def _cut(self, text: str) -> tuple[str, list[bytes]]:
        """What comes before the first cut of a text, and the ids of each word after it."""
        if any(m in text for m in self.marks):  # a mark is cut out of a text before its words are
            return text, []
        # Most texts have nothing but words between single spaces and breaks; that needs no pattern.
        head, *words = text.replace("\n", " \n").replace("\n \n", "\n\n").split(" ")
        ids = self._look_up(words) if not words or self.whole(head) else [None]
        if None in ids:
            head, *words = self.cut(text)
            ids = self._look_up(words, whole=True)
        if len(self.known) > KNOWN_WORDS:
            self.known, self.aside, self.ends = {}, self.known, {"": b""}
        return head, ids

    def _look_up(self, words: list[str], whole: bool = False) -> list[bytes | None]:
        """Ids of words; without ``whole``, None for what no word can be cut out as."""
        ids = list(map(self.known.get, words))
        if None in ids:
            missing = [i for i, found in enumerate(ids) if found is None]
            new = {words[i] for i in missing}
            coded = self._learn(new if whole else [w for w in new if w.isalpha() or self.whole(w)])
            for i in missing:
                ids[i] = coded.get(words[i])
        return ids

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words not known. Known from now on are the words but long ones, or else the letters they begin with."""
        known, aside, ends, coded, other = self.known, self.aside, self.ends, {}, []
        for word in words:
            ids = aside.get(word)
            if ids is None:
                if len(word) > KNOWN_LENGTH:
                    other.append(word)
                    continue
                if word.isascii() and word.isalpha():
                    ids = self._encode_letters("", word)
                elif plain := self.plain(word):
                    breaks, letters, end = plain.groups()
                    start = breaks + letters
                    ids = known.get(start) or aside.get(start)
                    met = ids is not None
                    if not met:
                        known[start] = ids = self._encode_letters(breaks, letters)
                    if end:
                        if end not in ends:
                            ends[end] = self._encode([end])[0]
                        ids += ends[end]
                        if not met:  # most such words never come again
                            coded[word] = ids
                            continue
                else:
                    other.append(word)
                    continue
            known[word] = coded[word] = ids
        for word, ids in zip(other, self._encode([w if w[0] == "\n" else " " + w for w in other])):
            coded[word] = ids
            if len(word) <= KNOWN_LENGTH:
                known[word] = ids
        return coded

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, breaks: str, letters: str) -> bytes:
        """Ids of Latin letters behind line breaks, or else behind a space, from the tokenizer's BPE model: what its
        other steps do to such a word is to write its bytes as characters."""
        shown = letters if letters.isascii() else letters.translate(self.as_bytes)
        shown = shown if breaks else self.as_bytes[32] + shown
        return self.breaks[breaks] + array("I", [t.id for t in self.tokenize(shown)]).tobytes()


def encoder(path: str, run: str) -> Encoder:
    """The encoder of a run in this process: its later tasks here know the words of the earlier ones. The next task of
    anything else that begins here drops it."""
    return hold(run, lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """A row for each piece of at most ``capacity`` ids: PIECES; ``deal`` spreads equal rows.

    ``tokenizer_path`` is a tokenizers JSON file of a byte-level BPE that every executor can open; marks it
    knows as added tokens are one id in texts, too. An id END_ID ends each document; null text is empty.
    Longer documents are cut so that all pieces but the first are full.
    """

    run = uuid.uuid4().hex

    def start():
        import zlib

        encode = encoder(tokenizer_path, run)
        dealt = 0

        def call(ids, texts):
            nonlocal dealt
            out = ([], [], [], [], [], [])
            for doc_id, tokens in zip(ids, encode([t or "" for t in texts])):
                tokens = np.append(tokens, np.array([END_ID], "<u4"))
                at, k = 0, 0
                end = len(tokens) % capacity or capacity
                while at < len(tokens):
                    row = (doc_id, k, at, end - at, zlib.crc32(tokens[at:end].tobytes()), dealt % 65_536)
                    for column, value in zip(out, row):
                        column.append(value)
                    at, end, k, dealt = end, end + capacity, k + 1, dealt + 1
            return out

        return call

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return per_batch(rows, start, PIECES, run)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, no bin above ``capacity``.

    A bin starts with the longest item left and takes the longest that fits until none does. Then its
    smallest item gives way to two items that fill the widened gap more tightly, as long as such a
    pair is left; the item goes back to the others.
    """
    stock: dict[int, list[int]] = {}
    for item, length in enumerate(lengths):
        stock.setdefault(length, []).append(item)
    left = sorted(stock)

    def take(length: int) -> int:
        item = stock[length].pop()
        if not stock[length]:
            del left[bisect_right(left, length) - 1]
        return item

    def give_back(length: int, item: int) -> None:
        if not stock[length]:
            insort(left, length)
        stock[length].append(item)

    bins = []
    while left:
        gap, chosen = capacity, []  # chosen: (length, item)
        while left and left[0] <= gap:
            length = left[bisect_right(left, gap) - 1]
            chosen.append((length, take(length)))
            gap -= length
        while gap:
            small = min(chosen)
            pair = _tightest_pair(left, stock, small[0], gap + small[0])
            if pair is None:
                break
            chosen.remove(small)
            chosen += [(length, take(length)) for length in pair]
            give_back(*small)
            gap += small[0] - sum(pair)
        bins.append([item for _, item in chosen])
    return bins


def _tightest_pair(left: list[int], stock: dict[int, list[int]], above: int, most: int) -> tuple[int, int] | None:
    """Two lengths in stock with the largest sum in (above, most]."""
    best, found = above, None
    low, high = 0, bisect_right(left, most - left[0]) - 1 if left else -1
    while low <= high:
        a, b = left[low], left[high]
        if a + b > most or (low == high and len(stock[a]) < 2):
            high -= 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
            if best == most:
                break
        low += 1
    return found


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``rows`` (PIECES) with sequence_id and offset.

    Sequences of packed groups have numbers from 0 up, full pieces negative ones. No rows give none.
    """
    rows = cut(rows)
    full = rows.filter(F.col("length") >= capacity).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).drop("deal")
    part = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))

    def pack_group(key, items):
        let_go()
        items = items.sort_values(["length", "doc_id", "piece", "ids_crc32", "deal"], kind="stable", ignore_index=True)
        sequence, offset = np.zeros(len(items), "i8"), np.zeros(len(items), "i8")
        lengths = items["length"].tolist()
        for number, chosen in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for item in chosen:
                sequence[item], offset[item] = (key[0] << 32) + number, at
                at += lengths[item]
        return items.assign(sequence_id=sequence, offset=offset)[names]

    names = [*full.columns]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    keyed = part.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "deal"), F.lit(groups)))
    return full.unionByName(keyed.groupBy("group").applyInPandas(pack_group, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents; every row of ``docs`` is packed, repeated rows each.

    Null ids are kept as they are. Other columns are neither read nor returned.
    """
    return pack(pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity)
