from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as repo
from triage.llm.common import cut

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages_by_hand(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, cut(stage(spark, rows, SF_DIR))
        assert set(rows.columns) == COLUMNS
        assert rows.exceptAll(before).isEmpty()
        counts.append(rows.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    texts = [r.text.lower() for r in rows.select("text").collect()]
    assert len(texts) == len(set(texts))
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows.select("doc_id").collect()}


def test_run_gives_what_the_stages_give(spark):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = cut(stage(spark, rows, SF_DIR))
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, rows.select(columns).collect()))


def test_empty_documents_pass_all_stages(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = cut(stage(spark, rows, SF_DIR))
    assert rows.count() == 0


CLASHING = ("id", "text_hash", "copies", "fp", "digest", "label", "score", "kept", "keep_id", "component_id", "n", "g", "slot", "_row_hash",
            "_chosen_id", "_chosen_hash", "_chosen_copies", "_tokens", "_topic", "_weight", "_probability", "_sampled", "_s", "_s0", "__id")


def test_nulls_repeats_ties_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(None, "no id and quite clean", "en", "src1", 3), (9001, None, None, None, None), (9002, "", "en", "src1", 0),
                                 (9003, "Same text twice", "en", "src2", 1), (9003, "Same text twice", "en", "src2", 1),
                                 (9004, "same TEXT twice", None, "src2", 1), (9005, "long " * 30_000, "de", None, 1)], docs.schema)
    plain = docs.unionByName(odd)
    wide = plain.withColumns({n: F.lit(n) for n in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(map(repr, plain.collect()))
        plain, wide = cut(stage(spark, plain, SF_DIR)), cut(stage(spark, wide, SF_DIR))
        assert set(wide.columns) == COLUMNS | set(CLASHING), name
        assert sorted(map(repr, wide.drop(*CLASHING).collect())) == sorted(map(repr, plain.collect())), name
        assert set(map(repr, plain.collect())) <= set(before), name
        if name == "exact dedup":
            assert [r.doc_id for r in plain.filter("lower(text) = 'same text twice'").collect()] == [9004]
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, SF_DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_all_operators_are_registered():
    names = [n for n in repo.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in repo.queries()
