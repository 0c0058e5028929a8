import weakref

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from triage.llm.common import choose_rows, free_prefix, hold, let_go, per_batch
from triage.llm.packing import pack_documents


def test_rows_are_chosen_whatever_the_columns_are_called(spark):
    names = ("_row_hash", "_chosen_id", "_chosen_hash", "_chosen_copies", "_id", "_hash", "_copies", "copies", "text_hash", "id")
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, None), (3, "c")], "doc_id bigint, text string")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    chosen = docs.filter("doc_id is null or doc_id < 3").groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash")).agg(
        F.count("*").alias("copies"))
    for some in (chosen, chosen.filter("copies = 1")):
        kept = choose_rows(docs, some, "doc_id", "text")
        want = [(1, "a"), (2, "b"), (None, None)] if some is chosen else [(2, "b"), (None, None)]
        assert kept.columns == docs.columns
        assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(((*w, *names) for w in want), key=repr)


def test_a_free_prefix_is_no_columns_beginning(spark):
    assert free_prefix(spark.createDataFrame([(1, 2)], "_a int, __b int")) == "___"
    assert free_prefix(spark.range(1)) == "_"


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from triage import settings

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        settings.shared_dir(Session)


def encoders_left(docs):
    """How many encoders live in the Python processes that take a task, by process."""

    def start():
        import gc
        import os

        from triage.llm.packing import Encoder

        return lambda ids: ([os.getpid()], [sum(isinstance(x, Encoder) for x in gc.get_objects())])

    return {(r.process, r.n) for r in per_batch(docs.repartition(64).select("doc_id"), start, "process long, n long").collect()}


def test_later_stages_do_not_carry_the_words_that_packing_met(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('word', id, ' and word', id + 1) as text").repartition(64)
    packed = {r.doc_id for r in pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert len(packed) == 4000
    assert {n for _, n in encoders_left(docs)} == {0}


def test_what_a_run_holds_goes_when_another_begins():
    class Words:
        pass

    held = weakref.ref(hold("one", Words))
    assert held() is not None and hold("one", Words) is held()
    let_go("one")
    assert held() is not None
    other = weakref.ref(hold("another", Words))
    assert held() is None and other() is not None
    let_go()
    assert other() is None
