import random

import pytest
import xxhash

from triage.llm.components import connected_components
from triage.llm.simhash import fingerprints, keep_one_per_component, links, simhash_components


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(values, bits):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= bits:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowded", [2, 10_000])
def test_links_join_all_that_are_close(spark, bits, crowded):
    rnd = random.Random(bits)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for seed in list(values)[:6] + [0, 1 << 63]:
        for _ in range(25):
            v = seed
            for _ in range(rnd.randint(1, 3)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
            seed = rnd.choice([seed, v])
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = connected_components(links(frame, bits, crowded=crowded)).collect()
    got = {r.node: r.component for r in found}
    want = components(values, bits)
    for a in values:
        for b in values:
            same = got.get(signed(a), signed(a)) == got.get(signed(b), signed(b))
            assert same == (want[a] == want[b])


def test_fingerprints_like_brute_force(docs):
    rows = [(1, "One two\tTHREE four five"), (2, "one TWO three four five"), (3, None), (4, " \n"), (5, "É é two"),
            (6, "a"), (7, "word " * 30_000), (8, "a b c d e")]
    got = {r.id: r.fp for r in fingerprints(docs(*rows)).collect()}
    assert got == {i: signed(fingerprint(t)) for i, t in rows}


def test_components_of_documents(docs):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(400)) for _ in range(6)]
    rows = [(i + 10, base[i % 6] if i % 4 else base[i % 6] + " zz") for i in range(40)]
    rows += [(3, None), (2, ""), (None, ""), (None, "alone here now"), (60, "alone"), (60, "alone")]
    got = simhash_components(docs(*rows)).collect()
    prints = {fingerprint(t) for _, t in rows}
    part = components(prints, 2)
    least = {}
    for i, t in rows:
        c = part[fingerprint(t)]
        least[c] = min(x for x in (least.get(c), i) if x is not None) if (least.get(c), i) != (None, None) else None
    assert sorted((str(r.id), str(r.component_id)) for r in got) == sorted((str(i), str(least[part[fingerprint(t)]])) for i, t in rows)


def test_one_of_each_component_stays(docs):
    text = "the quick brown fox jumps over the lazy dog " * 20
    frame = docs((4, text), (2, text.upper()), (2, text.upper()), (2, "quite another text stands here"), (9, None), (8, ""), (None, "x y z"), (None, "x y z"))
    kept = keep_one_per_component(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect()) == [("2", "THE Q"), ("2", "quite"), ("8", ""), ("None", "x y z")]
    assert keep_one_per_component(frame.limit(0)).count() == 0


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (900, 901), (901, 900)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert connected_components(edges.limit(0)).count() == 0
