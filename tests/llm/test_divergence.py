import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from triage.llm import divergence as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "text string, lang string, source string, term string, n bigint, docs int, value string, block int, kept int"


def brute(rows, min_docs, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        held[lang].update(set(words))
        groups.add((lang, source))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        others = [s for l, s in groups if l == lang]
        total = sum(counts[lang, s][t] for s in others for t in kept)

        def p(n, whole):
            return 1 + 10**9 * (n + 5) // (whole + 5 * len(kept))

        def of(s):
            whole = sum(counts[lang, s][t] for t in kept)
            return {t: p(counts[lang, s][t], whole) for t in kept}

        mine = of(source)
        pairs = [(-sum(abs(mine[t] - q[t]) for t in kept), s.encode(), s) for s in others if s != source for q in [of(s)]]
        terms = []
        for t in kept:
            more = mine[t] - p(sum(counts[lang, s][t] for s in others), total)
            if counts[lang, source][t] and more > 0:
                terms.append((-more, t.encode(), t))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def check(spark, rows, min_docs, top=50, **sizes):
    frame = spark.createDataFrame([(*r, "t", 1, 2, "v", 3, 4) for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in d.divergence(frame, min_docs, top, **sizes).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, min_docs, top)


WORDS = ["a", "The", "the", "straße", "Ünique", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 9, "的", "的的",
         "x" * 40, "x" * 41, "X" * 33, "z" * 300]


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 64, "block_cells": 7}])
def test_like_brute_force(spark, sizes):
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choices(WORDS, range(1, len(WORDS) + 1), k=rnd.randint(0, 30))).replace(" ", rnd.choice([" ", "1", "\n_"])),
             rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", "Ä", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "en", "b"), ("only here", "xx", "one"), ("only here", "xx", "two"), ("alone", "yy", "one"), *rows[:9]]
    rows += [(" ".join(rnd.choices(WORDS, k=2000)), "en", "a")]
    check(spark, rows, 5, top=4, **sizes)


def test_ties_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(d, "TILE", 3)
    check(spark, [(f"same w{k % 2}x", "en", f"s{k % 8}") for k in range(64)], 2)


def test_no_rows(spark):
    assert d.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_stay_exact_for_large_counts(spark):
    n, total = 10**15, 3 * 10**15
    row = spark.createDataFrame([(n, total, 7)], "n bigint, total bigint, kept bigint").select(d.share("n", "total", "kept").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 35)


def test_radix_order_is_a_stable_sort():
    rnd = np.random.default_rng(1)
    words = [rnd.integers(0, 2**63, 500).astype("u8") >> np.uint64(s) for s in (61, 40)]
    want = sorted(range(500), key=lambda i: (words[0][i], words[1][i]))
    assert d.radix_order(words).tolist() == want
