"""A trainable question scorer: the team's corrections as labels, Spark ML as the model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.operators.feedback import version_intervals
from triage.operators.joins import DEFAULT_BROADCAST_ROWS, match_intervals, touched_days

FEATURES = 1 << 16
# Parts that corrections are dealt into; each is predicted by a model of the others.
FOLDS = 4
# Ranges of a score between 0 and 1 that are ranked each by itself.
RANGES = 1024


def labelled(feedback: DataFrame) -> DataFrame:
    """Items the team confirmed as questions (1) or rejected (0)."""
    return feedback.select(
        "content_id", F.coalesce("body", F.lit("")).alias("body"),
        (F.col("feedback_type") == "confirmed_question").cast("double").alias("label"),
    )


def held_out(content_id: Column, one_in: int = 4) -> Column:
    """Split by a hash of the key, the same in every run and every retried task."""
    return F.pmod(F.xxhash64(content_id), F.lit(one_in)) == 0


def train(examples: DataFrame) -> PipelineModel:
    """Fit on (body, label); both classes must be there."""
    classes = {r.label for r in examples.select("label").distinct().limit(2).collect()}
    if len(classes) < 2:
        raise ValueError("no examples to train on" if not classes else f"all examples have the label {classes.pop():g}")
    stages = [
        RegexTokenizer(inputCol="body", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(examples)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows (content_id, body, ...) with ``is_question`` and its probability."""
    scored = model.transform(rows.withColumn("body", F.coalesce("body", F.lit(""))))
    return scored.select(
        *rows.columns,
        (F.col("prediction") == 1.0).alias("is_question"),
        vector_to_array("probability")[1].alias("probability"),
    )


def evaluate(predicted: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of predictions against labels, one row for each value of ``by``, one aggregation."""
    truth, guess = F.col("label") == 1.0, F.col("is_question")
    counts = predicted.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(truth & guess).alias("true_positives"),
        F.count_if(~truth & guess).alias("false_positives"),
        F.count_if(~truth & ~guess).alias("true_negatives"),
        F.count_if(truth & ~guess).alias("false_negatives"),
    )
    hits = F.col("true_positives")
    return counts.withColumns({
        "precision": F.try_divide(hits, hits + F.col("false_positives")),
        "recall": F.try_divide(hits, hits + F.col("false_negatives")),
        "accuracy": F.try_divide(hits + F.col("true_negatives"), F.col("rows")),
    })


def stored_quality(config: DataFrame, scores: DataFrame, feedback: DataFrame,
                   max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """How the stored scores fare against the team's corrections, for each prompt version that made them."""
    judged = _judged(config, scores.select("content_id", "is_question", "classified_at"), feedback, max_rows)
    return evaluate(judged, "version")


def _judged(config: DataFrame, scores: DataFrame, feedback: DataFrame, max_rows: int) -> DataFrame:
    """Scores with the team's label and the prompt version they were made under."""
    spans = version_intervals(config).select("version", F.col("created_at").alias("_start"), F.col("superseded_at").alias("_end"))
    truth = labelled(feedback).select("content_id", "label")
    small = touched_days(spans, "_start", "_end") <= max_rows
    return match_intervals(scores.join(truth, "content_id"), "classified_at", spans, "_start", "_end", small)


def cross_predicted(examples: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Every example with the probability that a model of the other folds gives it; folds are by key hash, so
    each needs both classes among the others."""
    dealt = examples.withColumn("_fold", F.pmod(F.xxhash64("content_id"), F.lit(folds)))
    parts = [predict(train(dealt.filter(F.col("_fold") != k)), dealt.filter(F.col("_fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def calibration(predicted: DataFrame) -> IsotonicRegressionModel:
    """The rising step function from probabilities to shares of questions, learnt on ``cross_predicted`` rows."""
    return IsotonicRegression(featuresCol="probability", labelCol="label", predictionCol="calibrated").fit(predicted)


def ranking_quality(rows: DataFrame, score: str, *by: str) -> DataFrame:
    """How well a score between 0 and 1 puts questions first: ``positives``, ``negatives`` and ``auc``, the chance
    that a random question scores above a random other item, ties counting half. NULL without both kinds.

    Rows are first counted by distinct score. Negatives below are summed up range by range of the score, so
    one sort serves all and no value of ``by`` needs its rows in one task.
    """
    truth = F.col("label") == 1.0
    part = F.least(F.floor(F.col(score) * RANGES), F.lit(RANGES - 1))
    counted = rows.filter(F.col(score).isNotNull() & F.col("label").isNotNull()).withColumn("_part", part)
    counted = counted.groupBy(*by, "_part", F.col(score).alias("_score")).agg(
        F.count_if(truth).alias("_pos"), F.count_if(~truth).alias("_neg"))
    inside = Window.partitionBy(*by, "_part").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    won = counted.withColumn("_won", F.col("_pos") * (below + F.col("_neg") / 2))
    parts = won.groupBy(*by, "_part").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.sum("_won").alias("_won"))
    # At most RANGES rows for each value of ``by``.
    lower = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.withColumn("_won", F.col("_won") + F.col("_pos") * F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    sums = whole.groupBy(*by).agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.sum("_won").alias("_won"))
    return sums.withColumn("auc", F.try_divide(F.col("_won"), F.col("positives") * F.col("negatives"))).drop("_won")


def stored_ranking(config: DataFrame, scores: DataFrame, feedback: DataFrame,
                   max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``ranking_quality`` of stored probabilities against the team's corrections, for each prompt version."""
    judged = _judged(config, scores.select("content_id", "probability", "classified_at"), feedback, max_rows)
    return ranking_quality(judged, "probability", "version")


def train_topics(examples: DataFrame) -> PipelineModel:
    """Fit topics on (body, domain), a class for each topic that occurs; counts of words are summed in one
    pass whatever the number of topics."""
    indexer = StringIndexer(inputCol="domain", outputCol="label", stringOrderType="alphabetAsc").fit(examples.filter("domain IS NOT NULL"))
    stages = [
        RegexTokenizer(inputCol="body", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES),
        indexer,
        NaiveBayes(),
        IndexToString(inputCol="prediction", outputCol="topic", labels=indexer.labels),
    ]
    known = examples.filter("domain IS NOT NULL").withColumn("body", F.coalesce("body", F.lit("")))
    return Pipeline(stages=stages).fit(known)


def predict_topics(model: PipelineModel, rows: DataFrame, fallback: Column, least: float) -> DataFrame:
    """Rows with ``domain``: the learnt topic where its probability is at least ``least``, else ``fallback``, an
    expression over the rows such as ``scoring.topic_by_words``."""
    given = [c for c in rows.columns if c != "domain"]
    texts = rows.select(*given).withColumn("body", F.coalesce("body", F.lit("")))
    steps = [s for s in model.stages if s.__class__.__name__ != "StringIndexerModel"]
    guessed = PipelineModel(steps).transform(texts)
    sure = F.array_max(vector_to_array("probability")) >= least
    return guessed.select(*given, F.when(sure & (F.trim("body") != ""), F.col("topic")).otherwise(fallback).alias("domain"))


def train_and_evaluate(feedback: DataFrame) -> DataFrame:
    """Train on three quarters of the corrections, report on the rest."""
    examples = labelled(feedback)
    test = held_out(F.col("content_id"))
    model = train(examples.filter(~test))
    return evaluate(predict(model, examples.filter(test)))
