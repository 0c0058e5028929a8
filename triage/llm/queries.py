"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, lexical, licenses, mixing, packing, rollups, secrets, simhash, topk, toxicity, wrappers
from .common import cut, read, shared_folder, word_count

# Shares of tokens the mix aims at; a number tempers the shares the documents have.
LANGUAGES = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
TOPICS = 0.9
SOURCES = 0.7


# Passes of the token count rollup.
ESTIMATE, WORDS = "chars4-v1", "words-v2"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_secrets(read(spark, sf_dir, "documents"))

    def line(finds):
        return F.array_join(F.transform(finds, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def of_kind(kind):
        return lambda f: f["kind"] == kind

    base = F.filter("finds", lambda f: f["path"] == "")
    rows = rows.select("id", "finds", "closed", base.alias("base"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"),
                       line(F.col("finds")).alias("spans"), "closed")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), LANGUAGES, TOPICS, SOURCES)
    return mixed.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
                        F.col("_weight").alias("weight"), F.col("_probability").alias("probability"),
                        F.col("_sampled").alias("sampled"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wrappers.main_texts(read(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                       F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come with estimated counts; their words are counted under a new tokenizer version
    and the estimate is corrected; what is labelled toxic is withdrawn. One batch is sent twice."""
    docs = read(spark, sf_dir, "documents")
    counted = cut(docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"),
                              F.coalesce(F.col("n_chars"), F.lit(0)).alias("given"),
                              F.coalesce(F.length("text"), F.lit(0)).alias("chars")))
    bad = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    gone = counted.join(bad.hint("shuffle_hash"), "doc_id", "left_semi")
    old, new = F.ceil(F.col("given") / 4), F.ceil(F.col("chars") / 4)
    totals = rollups.TokenTotals(spark, shared_folder(spark, "token-totals"))
    batches = (("load", (rollups.inserted(counted, old, ESTIMATE),)),
               ("recount", (rollups.revised(counted, old, new, ESTIMATE), rollups.inserted(counted, F.col("words"), WORDS))),
               ("recount", (rollups.inserted(counted, F.col("words"), WORDS),)),
               ("withdraw", (rollups.deleted(gone, new, ESTIMATE), rollups.deleted(gone, F.col("words"), WORDS))))
    for name, changes in batches:
        totals.commit(name, *changes)
    return totals.totals()


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(read(spark, sf_dir, "documents"), shingle=3, bits=2)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("id") == toxicity.HELD_OUT, F.lit(False))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                    "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(control))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_mix_sources, op3_main_text, op4_license_scan, op5_top_k, op6_token_counts, op7_best_fit_packing,
    op8_exact_dedup, op9_simhash, op10_toxicity, op11_chat_format, op12_source_divergence,
    op13_lexical_search)}

NOT_BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words() -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(licenses.plain_words(t)))) for label, texts in licenses.TEMPLATES.items() for t in texts]


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '([<\\[])(\\\\*{chat.CONTROL})', '\\1\\\\\\2', 'g')"


SQL = {
    "op4_license_scan": f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (
  SELECT doc_id, low, regexp_extract_all(low, '{NOT_BETWEEN}') AS words FROM d),
p(phrase, label) AS (VALUES {", ".join(f"({licenses.plain_words(k)!r}, {v!r})" for k, v in licenses.PHRASES.items())}),
t(tid, label, twords) AS (VALUES {", ".join(f"({i}, {v!r}, {w!r})" for i, (v, w) in enumerate(_template_words()))}),
hits AS (
  SELECT w.doc_id, w.low, w.words, p.label, list_filter(range(0, len(w.words) - len(p.phrase) + 1),
         lambda i: list_slice(w.words, i + 1, i + len(p.phrase)) = p.phrase) AS places
  FROM w JOIN p ON list_has_all(w.words, p.phrase)),
base AS (
  SELECT doc_id, low, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
         list(DISTINCT label) FILTER (len(places) > 0) AS labels
  FROM hits GROUP BY doc_id, low),
lines AS (
  SELECT doc_id, low, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{NOT_BETWEEN}')) AS line FROM w),
met AS (
  SELECT doc_id, low, t.label, len(list_intersect(line, twords)) / len(twords) AS share
  FROM lines JOIN t ON len(list_intersect(line, twords)) >= {licenses.THRESHOLD} * len(twords)),
best AS (SELECT doc_id, low, max(share) AS share, list(DISTINCT label) AS labels FROM met GROUP BY doc_id, low)
SELECT w.doc_id, len(w.words) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, CAST([] AS VARCHAR[]))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, CAST([] AS VARCHAR[])), coalesce(best.labels, CAST([] AS VARCHAR[]))))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id AND w.low = base.low LEFT JOIN best ON w.doc_id = best.doc_id AND w.low = best.low""",
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_token_counts": f"""
WITH kept AS (SELECT * FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
n AS (
  SELECT source, lang, '{ESTIMATE}' AS tokenizer, CAST(ceil(coalesce(length(text), 0) / 4) AS BIGINT) AS tokens FROM kept
  UNION ALL
  SELECT source, lang, '{WORDS}', len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM n GROUP BY ALL""",
    "op8_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
marks(role, marks) AS (VALUES {", ".join(f"('{r}', {sum(map(len, m))})" for r, m in chat.MARKS.items())})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
       CAST(coalesce(sum(length(said)) FILTER (role = '{chat.LEARNT}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (role = '{chat.LEARNT}'), '')) AS loss_sha256,
       CAST(sum(length({_escaped("said")}) + coalesce(marks, {sum(map(len, chat.NAMED))} + length({_escaped("role")}))) AS BIGINT) AS formatted_chars
FROM t LEFT JOIN marks USING (role) GROUP BY conv_id""",
    "op12_source_divergence": """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (sum(coalesce(n.n, 0)) OVER s + 5 * count(*) OVER s) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(coalesce(n.n, 0)) OVER l + 5 * count(*) OVER s) AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
  WINDOW s AS (PARTITION BY g.lang, g.source), l AS (PARTITION BY g.lang)),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN c x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN c y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM c WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50""",
    "op13_lexical_search": """
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM low),
s AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
i AS (
  SELECT p.r, p.doc_id, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS impact
  FROM p JOIN w USING (term), s),
f AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term)
  GROUP BY item_id, r HAVING sum(impact) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
}
