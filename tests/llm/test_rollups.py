import pytest
from pyspark.sql import functions as F

from triage.llm.common import shared_folder
from triage.llm.rollups import TokenTotals, deleted, inserted, revised

DOCS = "doc_id bigint, source string, lang string, tokens bigint, documents bigint, tokenizer string"


def values(totals):
    return sorted((tuple(r) for r in totals.totals().select("source", "lang", "tokenizer", "documents", "tokens").collect()), key=repr)


def test_batches_count_once_and_in_any_order(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5, 9, "x"), (2, "a", "en", 7, 9, "x"), (2, "a", "en", 7, 9, "x"), (3, None, None, 0, 9, "x"), (4, "b", "de", None, 9, "x")], DOCS)
    totals = TokenTotals(spark, shared_folder(spark, "totals"))
    assert values(totals) == [] and totals.batches() == []
    assert totals.commit("b2", deleted(docs.filter("doc_id = 1"), F.col("tokens"), "v1"))
    assert totals.commit("b1", inserted(docs, F.col("tokens"), "v1"), revised(docs.filter("doc_id = 2"), F.col("tokens"), F.lit(10), "v1"))
    want = sorted([("a", "en", "v1", 2, 20), (None, None, "v1", 1, 0), ("b", "de", "v1", 1, 0)], key=repr)
    assert values(totals) == want
    assert not totals.commit("b1", inserted(docs, F.col("tokens"), "v1")) and values(totals) == want
    assert totals.commit("none") and totals.commit("empty", inserted(docs.limit(0), F.col("tokens"), "v1")) and values(totals) == want
    assert totals.batches() == ["b1", "b2", "empty", "none"]
    with pytest.raises(ValueError):
        totals.commit("../x")


def test_a_batch_that_was_cut_short_is_written_again(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5, 9, "x")], DOCS)
    totals = TokenTotals(spark, shared_folder(spark, "totals"))
    totals.commit("b1", inserted(docs, F.col("tokens"), "v1"))
    fs, marker = totals._path(f"{totals.folder}/batch=b1/_SUCCESS")
    fs.delete(marker, False)
    assert values(totals) == []
    assert totals.commit("b1", inserted(docs, F.col("tokens"), "v1")) and values(totals) == [("a", "en", "v1", 1, 5)]


def test_deletes_undo_inserts(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", i, 9, "x") for i in range(50)], DOCS)
    totals = TokenTotals(spark, shared_folder(spark, "totals"))
    totals.commit("in", inserted(docs, F.col("tokens"), "v1"))
    totals.commit("out", deleted(docs, F.col("tokens"), "v1"))
    assert values(totals) == []
