import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from triage.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n int, terms string, tf int, score double, item_id int"
ITEMS = "item_id bigint, text string, doc_id int, term int, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(c.total() for _, c in counted), Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in counted:
            m = 100 - 90 + 90 * c.total() * len(counted) // total
            score = sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[-1], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "x", 2, .5, 3) for d in docs], DOCS).repartition(3),
            spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEMS))


@pytest.mark.parametrize("options", [{}, {"block_docs": 16, "pair_share": 0.0}, {"query_limit": 20, "block_docs": 50}])
def test_like_brute_force(spark, options):
    rnd = random.Random(8)
    words = ["the", "The", "of", "and", "2024", "straße", "的", "É", "é", *(f"w{k}" for k in range(60))]
    weights = [60, 5, 40, 30, 5, 5, 5, 3, 3, *(60 / (k + 1) for k in range(60))]
    docs = [(k, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for k in range(400)]
    docs += [(900 + k, docs[7][1]) for k in range(30)]  # more equal scores than places
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (950, None), (951, "-_!"), (952, "the " * 3000), (953, "w59 " * 5)]
    items = [(k, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 25)))) for k in range(40)]
    items += [(50, None), (51, ""), (52, "unknown"), (53, docs[7][1]), (54, "w59"), (None, "the w3"), (3, "w58 w57"), (3, "w58 w57")]
    got = sorted((tuple(r) for r in lexical.search(*frames(spark, docs, items), k=10, **options).collect()), key=repr)
    assert got == brute(docs, items, 10)


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_nothing_to_search(spark, empty):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    found = lexical.search(docs.limit(0) if empty == "docs" else docs, items.limit(0) if empty == "items" else items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def block(rnd, docs=300, words=12):
    held = rnd.random((docs, words)) < rnd.random(words)
    row, term = np.nonzero(held)
    weight = np.sort(rnd.integers(1, 3000, words))
    return lexical.Block(np.arange(docs), rnd.integers(1, 90, docs), row, term, rnd.integers(1, 6, len(row)), weight, docs, docs * 40)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_pairs_tighten_them(seed):
    made = block(np.random.default_rng(seed))
    asked = np.arange(12)
    single = made.prefix_bounds(asked)
    made.intersect([(j, j + 1) for j in range(0, 12, 2)], 0)
    joint = made.prefix_bounds(asked)
    assert (joint <= single).all() and (joint < single).any() and (np.diff(joint) >= 0).all()
    score = np.zeros(made.size, "i8")
    for j, t in enumerate(asked):
        rows, impacts = made.postings(t)
        score[rows] += impacts
        assert score.max() <= joint[j + 1]
    for least in (0, int(np.median(score)), int(score.max()), int(score.max()) + 1):
        rows, scores = made.search(asked, least)
        want = np.flatnonzero(score >= max(least, 1))
        assert np.array_equal(rows, want) and np.array_equal(scores, score[want])
