import math
import random
import re

import pytest

from triage.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words, places, base = find(low), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for line in low.split("\n"):
        block = set(find(line))
        for label, texts in licenses.TEMPLATES.items():
            for t in texts:
                words_t = set(licenses.plain_words(t))
                share = len(words_t & block) / len(words_t)
                if len(words_t & block) >= math.ceil(licenses.THRESHOLD * len(words_t) - 1e-9):
                    labels.add(label)
                    best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), 1.0 if places else best)


def test_like_brute_force(docs):
    rnd = random.Random(2)
    known = [t for ts in licenses.TEMPLATES.values() for t in ts] + [
        "UNDER the MIT-license under the mit license", "mit under license the", "Apache License, Version 20", "cc by-nc", "CC BY ncé",
        "Klicense İ under the MİT license", "é-É ß 1a2b_c"]
    rows = [(0, None), (1, ""), (2, "..."), (3, "cc by nc " * 500), (None, "Under the MIT License"), (3, "cc by nc")]
    for i in range(10, 140):
        words = rnd.choice(known).split()
        for _ in range(rnd.randint(0, 5)):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(["the", "\n", "foo", "License"])) if rnd.random() < .5 else words.pop() if len(words) > 1 else 0
        rows.append((i, " ".join(rnd.choices(["der", "mit", "und"], k=3) + words)))
    got = licenses.scan_licenses(docs(*rows)).collect()
    out = lambda i, v: (str(i), *map(str, v))
    assert sorted(out(r[0], (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in got) == sorted(
        out(i, (*(b := brute(t))[:6], round(b[6], 9))) for i, t in rows)


def test_native_and_without_shuffle_of_texts(docs):
    plan = licenses.scan_licenses(docs((1, "a"), (2, "under the mit license")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)


def test_no_rows_and_no_templates(docs):
    assert licenses.scan_licenses(docs((1, "a")).limit(0)).count() == 0
    got = licenses.scan_licenses(docs((1, "Under the MIT license")), templates={}).first()
    assert got.labels == ["mit"] and got.score == 1.0
    with pytest.raises(Exception):
        licenses.scan_licenses(docs((1, "a")), id_col="absent").count()
