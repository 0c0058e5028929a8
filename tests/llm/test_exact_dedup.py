import hashlib
import random
from collections import Counter, defaultdict

import pytest

from triage.llm.exact_dedup import SLOTS, _shrink, exact_dedup, frequent_candidates, keep_one_per_text


def lower(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = Counter()
    for i, t in rows:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        out[(i, max(known) if known else None, len(ids), hashlib.sha256(lower(t)).hexdigest())] += 1
    return out


def check(rows, frame, slots):
    got = exact_dedup(frame, slots=slots).collect()
    assert Counter((r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == brute(rows)
    kept = Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept.values()) <= {1} and len(kept) == len({lower(t) for _, t in rows})
    assert all(r.id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("slots", [1, 3, SLOTS])
def test_like_brute_force(docs, slots):
    rnd = random.Random(slots)
    rows = [(i, rnd.choice(["Hot", "hot", "HOT"]) if i % 3 == 0 else rnd.choice(["a", "A", "É", "é", None, "", f"t{i}"])) for i in range(300)]
    check(rows, docs(*rows), slots)


@pytest.mark.parametrize("slots", [1, SLOTS])
def test_ties_nulls_and_repeats(docs, slots):
    rows = [(5, "x"), (5, "x"), (5, "X"), (None, "x"), (None, "only"), (None, "only"), (7, None), (8, ""), (9, "y" * 300_000)]
    check(rows, docs(*rows), slots)


def test_no_rows(docs, spark):
    empty = docs((1, "a")).limit(0)
    assert exact_dedup(empty).count() == 0 and keep_one_per_text(empty).count() == 0


def test_kept_rows_have_all_columns(docs):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, None), (4, ""), (5, "b"), (None, "c")]
    frame = docs(*rows)
    kept = keep_one_per_text(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "c"), (2, "A"), (4, ""), (5, "b")]


def test_summaries_keep_what_is_frequent(docs, spark):
    values = [b"hot"] * 400 + [b"warm"] * 150 + [str(i).encode() for i in range(450)]
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(7)
    found = frequent_candidates(frame, "digest", 9)
    assert {b"hot", b"warm"} <= set(found) and len(found) <= 9
    assert _shrink(Counter("aabbc"), 2) == Counter(a=1, b=1)
