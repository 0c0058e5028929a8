import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.llm import mixing
from triage.llm.mixing import OTHER, chance, mix, probabilities, rake, tempered_shares


def slow_rake(tokens, shares, rounds=3000):
    w = {c: t for c, t in tokens.items() if t}
    goals = []
    for axis, share in enumerate(shares):
        there = {c[axis] for c in w}
        total = sum(share[v] for v in there)
        goals.append({v: share[v] / total for v in there})
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            sums = {}
            for c, t in w.items():
                sums[c[axis]] = sums.get(c[axis], 0) + t
            w = {c: t * goal[c[axis]] / sums[c[axis]] for c, t in w.items()}
    return w


def test_rake_like_brute_force():
    rnd = np.random.default_rng(1)
    tokens = rnd.integers(0, 50, (4, 3, 3)).astype(float)
    tokens[3] = 0
    tokens[0, 0, 0] = 9
    shares = [np.array([.5, .3, .1, .1]), np.array([.6, .3, .1]), np.array([.2, .2, .6])]
    raked = rake(tokens, shares)
    slow = slow_rake({i: t for i, t in np.ndenumerate(tokens)}, shares)
    assert all(abs(raked[i] - slow.get(i, 0)) < 1e-6 for i in np.ndindex(raked.shape))
    assert np.allclose(raked.sum(axis=(0, 2)), shares[1]) and np.allclose(raked.sum(axis=(1, 2)), np.array([5, 3, 1, 0]) / 9)
    assert not rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)]).any()


def test_probabilities_lose_no_more_than_allowed():
    tokens, raked = np.array([100., 10., 1.]), np.array([.6, .3, .1])
    p = probabilities(tokens, raked, 0.05)
    assert (p <= 1).all() and p.max() == 1
    scale = p[0] * tokens[0] / raked[0]
    assert 0.949 <= (p * tokens).sum() / scale <= 1
    assert np.allclose(probabilities(tokens, raked, 0.0), raked / tokens / (raked / tokens).max())


@pytest.fixture
def corpus(spark):
    rows = []
    for i in range(1500):
        lang = ("en", "en", "en", "de", None)[i % 5]
        source = ("hot", "hot", f"s{i % 7}")[i % 3]
        rows.append((i, "word " * (5 + i * 37 % 150), lang, source, 1, "x", 0.5))
    rows += [(None, "one two", "en", "hot", 1, "x", 0.5), (9000, None, "en", None, 0, "x", 0.5), (9001, "", "xx", "hot", 0, "x", 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens bigint, topic string, weight double")


def test_margins_of_weights_and_of_the_sample(corpus):
    shares = {"en": .5, "de": .3}
    mixed = mix(corpus, shares, {"brief": .3, "article": .7}, {"hot": .4, "s1": .2}, other=.2)
    rows = mixed.collect()
    assert len(rows) == 1503 and mixed.columns[: len(corpus.columns)] == corpus.columns
    total = sum(r._weight * r._tokens for r in rows)
    by_lang = {k: sum(r._weight * r._tokens for r in rows if (r.lang if r.lang in shares else OTHER) == k) / total for k in (*shares, OTHER)}
    assert np.allclose([by_lang["en"], by_lang["de"], by_lang[OTHER]], [.5, .3, .2], atol=1e-6)
    drawn = [r for r in rows if r._sampled]
    expected = sum(r._probability * r._tokens for r in rows)
    assert abs(sum(r._tokens for r in drawn) - expected) < 0.1 * expected
    assert all(0 <= r._probability <= 1 for r in rows)
    again = {r.doc_id for r in mix(corpus.repartition(5), shares, {"brief": .3, "article": .7}, {"hot": .4, "s1": .2}, other=.2).collect() if r._sampled}
    assert again == {r.doc_id for r in drawn}


def test_tempered_shares_and_empty(corpus):
    got = tempered_shares({"a": 900, "b": 100, "c": 0}, 0.5)
    assert np.allclose([got["a"], got["b"]], [.75, .25]) and set(got) == {"a", "b"}
    assert tempered_shares({"a": 900, "b": 100}, 0) == {"a": .5, "b": .5} and tempered_shares({}, 0.5) == {}
    assert mix(corpus.limit(0), {"en": 1.0}, 0.9).count() == 0


def test_more_sources_than_a_thousand_keep_their_margins(spark):
    rows = [(k, "word " * (1 + k % 7), ("en", "de")[k // 1500 % 2], f"s{k % 1500}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mix(docs, {"en": .7, "de": .3}, 1.0, 0.0).groupBy("source").agg(F.sum(F.col("_weight") * F.col("_tokens")).alias("w")).collect()
    total = sum(r.w for r in got)
    assert len(got) == 1500 and all(abs(r.w / total - 1 / 1500) < 1e-6 for r in got)


def test_margins_that_cannot_hold_are_reported(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x"), (2, "a", "de", "y")], "doc_id bigint, text string, lang string, source string")
    with pytest.warns(UserWarning, match="off their shares"):
        mix(docs, {"en": .9, "de": .1}, 1.0, {"x": .1, "y": .9}).collect()


def test_too_many_cells_are_refused(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="cells"):
        mix(corpus, {"en": 1.0}, 1.0)


def test_columns_of_the_same_names(corpus):
    names = ("_source_key", "_lang_key", "_topic", "_tokens", "_weight", "_probability", "_sampled", "_s", "_l", "_t", "_s0", "_l0", "_t0",
             "_chosen_id", "_row_hash", "__x")
    clashing = corpus.withColumns({n: F.lit(n) for n in names})
    kept = mixing.keep_sampled(clashing, {"en": .5, "de": .3}, 1.0)
    plain = mixing.keep_sampled(corpus, {"en": .5, "de": .3}, 1.0)
    assert kept.columns == clashing.columns
    assert sorted(map(str, kept.drop(*names).collect())) == sorted(map(str, plain.collect()))
    assert kept.select(*names).distinct().collect() == [tuple(names)]
    rows = mix(clashing, {"en": .5}, 1.0)
    assert rows.columns == [*clashing.columns, "___topic", "___tokens", "___weight", "___probability", "___sampled"]


def test_chance_is_uniform(spark):
    values = [r[0] for r in spark.range(4000).select(chance(F.col("id"), F.lit(""), 1)).collect()]
    assert 0 <= min(values) and max(values) < 1 and abs(np.mean(values) - .5) < .02
