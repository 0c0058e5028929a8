"""Question scores and topic labels: batch, incremental, with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions.text import json_scalar
from triage.operators import training
from triage.operators.joins import latest_per_key

# A predictor gets whole rows (content_id, content_type, body) and says whether each is a question.
BatchPredictor = Callable[[pd.DataFrame], "pd.Series[bool]"]
# What can score: an expression over the candidates, a function of batches, a fitted model.
Scorer = Column | BatchPredictor | PipelineModel


def unscored(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates without a score yet. Keys are never NULL here, so a plain anti join is exact."""
    return candidates.join(scores.select("content_id"), "content_id", "left_anti")


def score(candidates: DataFrame, is_question: Column, scored_at: Column) -> DataFrame:
    """Score by a Column expression: no shuffle, no Python."""
    return candidates.select(
        "content_id", "content_type", is_question.alias("is_question"), scored_at.alias("classified_at")
    )


def score_batches(candidates: DataFrame, predict: BatchPredictor, scored_at: Column) -> DataFrame:
    """Score by a Python model over Arrow batches; bodies reach it whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.Series(predict(batch), index=batch.index)
            yield batch[["content_id", "content_type"]].assign(is_question=answers)

    answered = candidates.select("content_id", "content_type", "body").mapInPandas(
        run, "content_id string, content_type string, is_question boolean"
    )
    return answered.withColumn("classified_at", scored_at)


def score_with(candidates: DataFrame, scorer: Scorer, scored_at: Column) -> DataFrame:
    """Score by whatever kind of scorer is given."""
    if isinstance(scorer, Column):
        return score(candidates, scorer, scored_at)
    if isinstance(scorer, PipelineModel):
        rows = candidates.select("content_id", "content_type", "body")
        return score(training.predict(scorer, rows), F.col("is_question"), scored_at)
    return score_batches(candidates, scorer, scored_at)


def score_inputs(candidates: DataFrame, config: DataFrame) -> DataFrame:
    """Text a remote model would be sent per item: newest prompt, type, whole body."""
    prompt = config.agg(F.max_by("prompt_text", "version")).scalar()
    return candidates.select(
        "content_id", "content_type",
        F.concat(prompt, F.lit(" Content type: "), "content_type", F.lit(". Text: "), "body").alias("prompt"),
    )


def scored_content(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    return candidates.join(scores.select("content_id", "is_question"), "content_id")


def unlabelled_questions(content: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions that have no label, or only an empty one from a failed run."""
    done = labels.filter(F.col("domain").isNotNull()).select("content_id")
    questions = content.filter("is_question").select("content_id", "content_type", "body")
    return questions.join(done, "content_id", "left_anti")


def label_inputs(pending: DataFrame) -> DataFrame:
    """Text a remote model would be sent for each unlabelled question: the topics, type, whole body."""
    asked = F.lit(v.TOPIC_REQUEST + "; ".join(v.TOPICS))
    return pending.select(
        "content_id", "content_type",
        F.concat(asked, F.lit("\nType: "), "content_type", F.lit("\nText: "), F.coalesce("body", F.lit(""))).alias("prompt"),
    )


def topic_by_words(body: Column, dictionary: Mapping[str, Sequence[str]] = v.TOPIC_WORDS) -> Column:
    """Topic with most dictionary words in the whole body; ties go to the first listed.

    The body is split once and reduced to its dictionary words by a hash lookup; the counts per
    topic run over those few. Nothing is exploded, so rows never shuffle.
    """
    words = [w for topic in v.TOPICS for w in dictionary.get(topic, ())]
    tokens = F.split(F.lower(F.coalesce(body, F.lit(""))), "[^a-z]+")
    found = F.filter(tokens, lambda token: token.isin(words))

    def hits_of(hits: Column, words_of_topic: Sequence[str]) -> Column:
        return F.size(F.filter(hits, lambda word: word.isin(*words_of_topic)))

    def pick(hits: Column) -> Column:
        counts = F.array(*(
            F.struct(hits_of(hits, dictionary[topic]).alias("n"), F.lit(-rank).alias("order"),
                     F.lit(topic).alias("topic"))
            for rank, topic in enumerate(v.TOPICS) if topic in dictionary
        ))
        best = F.array_max(counts)
        return F.when(best["n"] > 0, best["topic"]).otherwise(v.FALLBACK_TOPIC)

    # A one-element transform names the hits once instead of repeating the split per topic.
    return F.transform(F.array(found), pick)[0]


# A learnt topic counts from this probability on.
SURE = 0.6


def label_topics(pending: DataFrame, labeled_at: Column, topic: Column | PipelineModel | None = None) -> DataFrame:
    """Labels by an expression, by a model of ``training.train_topics`` (the dictionary where it is not SURE),
    else by the dictionary alone."""
    if isinstance(topic, PipelineModel):
        found = training.predict_topics(topic, pending, topic_by_words(F.col("body")), SURE)
        return found.select("content_id", "domain", labeled_at.alias("labeled_at"))
    return pending.select(
        "content_id",
        (topic_by_words(F.col("body")) if topic is None else topic).alias("domain"),
        labeled_at.alias("labeled_at"),
    )


def labels_from_responses(responses: DataFrame, labeled_at: Column) -> DataFrame:
    """Labels out of model responses (content_id, result); those without a usable label are dropped."""
    parsed = responses.select(
        "content_id", json_scalar(F.col("result"), "$.domain").alias("domain"), labeled_at.alias("labeled_at")
    ).filter(F.col("domain").isNotNull())
    return latest_per_key(parsed, ["content_id"], [F.col("domain")])
