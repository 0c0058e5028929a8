"""The index finds what a scan finds."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from triage.operators.joins import IdSet
from triage.operators.queues import member_search
from triage.plans.search import MemberIndex, asked, grams
from triage.schemas import TABLES

TERMS = ["", "%", "_", "a", "an", "ann", "ANN", "n l", "lee@", "%n_l%", "a%b", "100%", "\\", "é", "ß", "zzz", "nobody", "@example.com", "  ", "_ee", "n  "]


@pytest.fixture(scope="module")
def people(spark):
    rnd = random.Random(6)
    firsts, lasts = ["Ann", "ANNA", "Lee", None, "É", "Straße", "a_b", "100%", "back\\slash", ""], ["Lee", "Lane", None, "O'Neil", "Anders", "ß"]
    rows = [(("t", "u")[i % 9 == 8], i, rnd.choice(firsts), rnd.choice(lasts), rnd.choice([None, f"lee{i}@example.com", f"A{i}@b.org"]),
             "member", None, rnd.choice(["active", "Active", "inactive", None]), None, None, None, None, None, None, None) for i in range(150)]
    return spark.createDataFrame(rows, TABLES["core_members"]).repartition(4)


@pytest.fixture(scope="module")
def index(spark, people, tmp_path_factory):
    made = MemberIndex(spark, str(tmp_path_factory.mktemp("index")), 8)
    made.build(people, "t")
    return made


def test_a_batch_of_terms_finds_what_scans_find(spark, people, index):
    coaches = IdSet.of(spark.createDataFrame([(3,), (10,), (999,)], "member_id bigint"))
    terms = spark.createDataFrame([(t,) for t in [*TERMS, None, "ann"]], "term string")
    got = index.search(terms, coaches, limit=7).collect()
    found = {t: [tuple(r)[2:] for r in sorted((r for r in got if r.term == t), key=lambda r: r.place)] for t in TERMS}
    for term in TERMS:
        assert found[term] == [tuple(r) for r in member_search(people, coaches, "t", term, limit=7).collect()], term
    assert len(got) == sum(map(len, found.values()))


def test_only_the_buckets_of_the_probes_are_opened(spark, index):
    terms = spark.createDataFrame([("nobody lives here",)], "term string")
    nobody = index.search(terms, IdSet.of(spark.createDataFrame([], "member_id bigint")))
    opened = {name: sum(f"/{name}/" in f for f in nobody.inputFiles()) for name in ("postings", "counts", "profiles")}
    assert nobody.count() == 0 and opened["profiles"] == 0 and opened["postings"] <= 3
    one = index.postings.read_keys(spark.createDataFrame([("lee",)], "gram string"))
    assert len(one.inputFiles()) == 1 < len(index.postings.read().inputFiles())


def test_grams_and_what_is_asked(frame):
    row = frame("t string, n string", ("aBc", None)).select(grams(F.col("t")).alias("g"), grams(F.col("n")).alias("none")).first()
    assert sorted(row.g) == ["", "a", "ab", "abc", "b", "bc", "c"] and row.none == []
    got = {t: sorted(frame("t string", (t,)).select(asked(F.col("t"))).first()[0]) for t in ("", "%", "a_bcde", "AB", "abcabc")}
    assert got == {"": [""], "%": [""], "a_bcde": ["a", "bcd", "cde"], "AB": ["ab"], "abcabc": ["abc", "bca", "cab"]}


def test_no_members(spark, tmp_path):
    made = MemberIndex(spark, str(tmp_path), 4)
    made.build(spark.createDataFrame([], TABLES["core_members"]), "t")
    terms = spark.createDataFrame([("a",), ("",)], "term string")
    assert values(made.search(terms, IdSet.of(spark.createDataFrame([], "member_id bigint")))) == []


def test_members_are_dealt_and_postings_are_read_once(spark, people, tmp_path, monkeypatch):
    from triage.plans import search

    tasks = []
    replace = search.VersionedTable.replace

    def counted(self, rows, commit_key=None):
        tasks.append((self.key, rows.rdd.getNumPartitions() if self.root.endswith("/postings") else 0))
        return replace(self, rows, commit_key)

    monkeypatch.setattr(search, "MEMBERS_A_TASK", 20, raising=False)
    monkeypatch.setattr(search.VersionedTable, "replace", counted)
    made = MemberIndex(spark, str(tmp_path), 4)
    made.build(people.coalesce(1), "t")
    assert max(n for _, n in tasks) >= 3
    found = made.search(spark.createDataFrame([("lee",)], "term string"), IdSet.of(spark.createDataFrame([], "member_id bigint")))
    assert found.count() > 0 and not [f for f in found.inputFiles() if "/postings/" in f or "/counts/" in f]
