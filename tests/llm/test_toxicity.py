import random
import zlib

import numpy as np

from triage.llm import toxicity

BAD = ["blurgface", "snotwit", "grumblehead"]


def texts(n, seed=0):
    rnd = random.Random(seed)
    parts = ["an", "the", "or", "ing", "ed", "st", "ha", "re", "on"]
    out = []
    for i in range(n):
        words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 200))]
        bad = i % 5 == 0
        for _ in range(rnd.randint(1, 3) * bad):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD).upper() + rnd.choice(["", ",", "."]))
        out.append((i, " ".join(words), int(bad)))
    return out


def fitted(spark, docs, rows):
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    return toxicity.fit(docs(*[(i, t) for i, t, _ in rows]), labels), labels


def test_held_out_accuracy_and_pipeline_stage(spark, docs):
    rows = texts(1200)
    model, labels = fitted(spark, docs, rows)
    frame = docs(*[(i, t) for i, t, _ in rows])
    scores = {r.id: r.score for r in toxicity.score(frame, model).collect()}
    held = [(scores[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 150 and np.mean(held) > 0.97
    kept = toxicity.keep_clean(frame, labels)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}


def test_held_out_labels_are_not_read(spark, docs):
    rows = texts(300)
    turned = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in rows]
    one, two = fitted(spark, docs, rows)[0], fitted(spark, docs, turned)[0]
    assert one.curve == two.curve
    assert np.array_equal(one.parts[np.argsort(one.slots)], two.parts[np.argsort(two.slots)])


def test_nulls_empty_and_no_labels(spark, docs):
    rows = [(1, None), (2, ""), (None, "some words"), (3, "12 34 !!"), (4, "words " * 20_000), (4, "words")]
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(*rows), none)
    got = toxicity.score(docs(*rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs(*rows).limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 7), (2, 1), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.keep_clean(docs(*rows), odd).count() <= 6


def brute(words_by_class):
    """Kneser-Ney with dictionaries, straight from its formula; a function from word to difference."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT

    def grams(word, size):
        s = "\0" + word + "\0"
        return [(s[:k + 1][-size:], k) for k in range(1, len(s)) if k + 1 >= size]

    top = ({}, {})
    inner = {m: set() for m in range(2, n + 1)}
    for c in (0, 1):
        for word, times in words_by_class[c].items():
            for m in range(2, n + 1):
                for g, k in grams(word, m):
                    inner[m].add(g)
                    if m == n or k == m - 1:
                        top[c][g] = top[c].get(g, 0) + times

    def shared(g):
        if not g:
            return toxicity.UNIFORM
        lower = shared(g[1:])
        seen = [x for x in inner[len(g) + 1] if x[1:-1] == g[:-1]]
        if not seen:
            return lower
        count = sum(x[1:] == g for x in seen)
        return (max(count - d, 0) + min(d * len({x[-1] for x in seen}), len(seen)) * lower) / len(seen)

    def chance(c, g, inner_place):
        base = shared_at(g, inner_place)
        total = {x: t for x, t in top[c].items() if len(x) == len(g) and x[:-1] == g[:-1]}
        whole = sum(total.values())
        if not whole:
            return base
        return (max(total.get(g, 0) - d, 0) + min(d * len(total), whole) * base) / whole

    def shared_at(g, k):
        # The shared model of fewer letters, none of it reaching before the word.
        return shared(g[1:])

    def difference(word):
        s = "\0" + word + "\0"
        out = 0.0
        for k in range(1, len(s)):
            g = s[:k + 1][-n:]
            out += np.log(chance(1, g, k)) - np.log(chance(0, g, k))
        return out

    return difference


def test_differences_follow_the_formula(spark):
    classes = ({"abba": 3, "abc": 2, "cab": 1}, {"abba": 1, "bad": 4, "badly": 2, "ab": 1})
    rows = [(w, c) for c in (0, 1) for w, n in classes[c].items() for _ in range(n)]
    table = toxicity.model_rows(toxicity.count_groups(spark.createDataFrame(rows, "text string, label int"))).toArrow()
    parts = np.column_stack([table[p].to_numpy() for p in toxicity.PARTS]).astype("f4")
    slots = table["slot"].to_numpy()
    index = np.zeros(toxicity.SLOTS, "i4")
    index[slots] = np.arange(1, len(slots) + 1)
    full = np.concatenate([np.zeros((1, len(toxicity.PARTS)), "f4"), parts])
    words = ["abba", "bad", "abc", "badly", "zebra", "b", "cabbad"]
    got = toxicity._differences(words, index, full)
    want = [brute(classes)(w) for w in words]
    assert np.allclose(got, want, atol=1e-4)


def test_held_out_labels(spark):
    """Figures of the README: on the larger table more than half of the toxic rows are found, without false alarms."""
    import __spark_entry__ as repo

    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = repo.queries()["op10_toxicity"](spark, sf_dir).filter("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    found, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert found / (found + missed) > 0.5 and found / (found + wrong) > 0.95
