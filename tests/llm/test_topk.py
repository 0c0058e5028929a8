import math

import numpy as np
import pytest

from triage.llm.topk import SlicedBlock, top_k


def brute(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(x)) for x in v]

    known = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = set()
    for i, v in queries:
        q = whole(v)
        if i is None or q is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in known if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, score bigint, rank int"


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_like_brute_force(spark, block_rows):
    rnd = np.random.default_rng(block_rows)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, .3, 8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, [0.0] * 8), (301, [-1.0] * 8), (302, None), (303, [None] * 8),
             (304, [math.nan] * 8), (305, [math.inf] * 8), (306, []), (307, [0.5]), (None, [1.0] * 8), (308, [70000.0, 1.0]), (309, [-1e6] * 8), (310, [9e5, -1e6])]
    frame = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA).repartition(5)
    queries = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 299]
    asked = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in queries + queries[:4]], SCHEMA)
    got = top_k(frame, asked, 5, block_rows=block_rows).collect()
    assert {tuple(r) for r in got} == brute(rows, queries, 5) and len(got) == len({tuple(r) for r in got})


def test_few_candidates_and_none(spark):
    frame = spark.createDataFrame([(1, [0.5], 0, 1, 2, 3), (2, [0.25], 0, 1, 2, 3)], SCHEMA)
    assert [tuple(r) for r in top_k(frame, frame.limit(1), 5).collect()] == [(1, 1, 2, 128 * 64)]
    assert top_k(frame.limit(0), frame, 5).count() == 0 and top_k(frame, frame.limit(0), 5).count() == 0


def test_slices_add_up():
    rnd = np.random.default_rng(4)
    values = rnd.integers(-300, 300, (130, 6))
    block = SlicedBlock(np.arange(130), values)
    for _ in range(20):
        q = rnd.integers(-300, 300, 6)
        slices, base = block.score_slices(q)
        bits = [np.unpackbits(s.view("u1"), bitorder="little")[:130].astype("i8") for s in slices]
        assert np.array_equal(base + sum(b << i for i, b in enumerate(bits)), values @ q)


def test_what_does_not_fit_a_long_fails_by_name(spark):
    frame = spark.createDataFrame([(1, [1e17], 0, 1, 2, 3), (2, [1.0], 0, 1, 2, 3)], SCHEMA)
    with pytest.raises(Exception, match="component does not fit"):
        top_k(frame, frame, 5).collect()
    frame = spark.createDataFrame([(1, [1e10], 0, 1, 2, 3), (2, [-1e10], 0, 1, 2, 3)], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(frame, frame, 5).collect()
