"""From community tables to tickets as one lazy plan, and the views served from stored tickets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.operators import engagement, feedback, scoring, staging, tickets, training
from triage.operators.joins import IdSet
from triage.settings import Settings
from triage.sources.reader import scan


@dataclass(frozen=True)
class Inputs:
    core_posts: DataFrame
    core_articles: DataFrame
    core_comments: DataFrame
    core_reactions: DataFrame
    core_members: DataFrame
    info_avatars: DataFrame
    ticket_metadata: DataFrame
    ticket_comments: DataFrame
    member_assignment_overrides: DataFrame
    coaches: DataFrame
    prompt_config: DataFrame
    topic_labels: DataFrame
    # Stored scores; where there are none, the rule below scores every item in the same plan.
    question_scores: DataFrame | None = None

    @classmethod
    def from_root(cls, spark: SparkSession, root: str, scored: bool = True) -> Inputs:
        names = [n for n in cls.__dataclass_fields__ if scored or n != "question_scores"]
        return cls(**{n: scan(spark, root, n) for n in names})


@dataclass(frozen=True)
class Rule:
    """A scoring rule as Column expressions over the candidates."""

    is_question: Column
    classified_at: Column


class Workspace:
    """Each table of the pipeline, built on first use. Nothing runs but the size checks."""

    def __init__(self, inputs: Inputs, settings: Settings, rule: Rule | None = None,
                 stored_content: DataFrame | None = None, stored_tickets: DataFrame | None = None,
                 keyed: bool = False, newest_edits: DataFrame | None = None):
        if inputs.question_scores is None and rule is None:
            raise ValueError("either stored scores or a rule is needed")
        self.inputs, self.settings, self.rule = inputs, settings, rule
        self._stored_content, self._stored_tickets = stored_content, stored_tickets
        # Stored tickets have one row for each item, as ``jobs.rebuild`` writes them.
        self.keyed = keyed
        # One row for each edited item, as ``jobs.save_edits`` keeps it; else all edits are compared.
        self._newest_edits = newest_edits

    @property
    def settled(self) -> bool:
        return self._newest_edits is not None

    @property
    def edits(self) -> DataFrame:
        """What lists lay over the stored tickets: the newest edits if they are kept, else all of them."""
        return self._newest_edits if self.settled else self.inputs.ticket_metadata

    @property
    def _tenant(self) -> str:
        return self.settings.tenant

    @property
    def _bound(self) -> int:
        return self.settings.broadcast_rows

    @cached_property
    def staff(self) -> IdSet:
        return IdSet.of(staging.staff_ids(self.inputs.core_members, self._tenant), self._bound)

    @cached_property
    def bots(self) -> IdSet:
        return IdSet.of(staging.bot_ids(self.inputs.info_avatars, self._tenant), self._bound)

    @cached_property
    def excluded(self) -> IdSet:
        """Authors whose items are not tickets: staff and bots, left out by one anti join."""
        return IdSet.of(self.staff.ids.unionByName(self.bots.ids), self._bound)

    @cached_property
    def posts(self) -> DataFrame:
        return staging.clean_posts(self.inputs.core_posts, self.excluded, self._tenant)

    @cached_property
    def articles(self) -> DataFrame:
        return staging.clean_articles(self.inputs.core_articles, self.excluded, self._tenant)

    @cached_property
    def comments(self) -> DataFrame:
        return staging.clean_comments(self.inputs.core_comments, self.excluded, self._tenant)

    @cached_property
    def members(self) -> DataFrame:
        return staging.members(self.inputs.core_members, self.bots, self._tenant)

    @cached_property
    def candidates(self) -> DataFrame:
        return staging.candidates(self.posts, self.articles, self.comments)

    @cached_property
    def scores(self) -> DataFrame:
        if self.inputs.question_scores is not None:
            return self.inputs.question_scores
        if self._stored_content is not None:
            return scoring.score(self._stored_content, F.col("is_question"), self.rule.classified_at)
        return scoring.score(self.candidates, self.rule.is_question, self.rule.classified_at)

    @cached_property
    def content(self) -> DataFrame:
        """Scored items. With a rule the score is one more column: no second scan, no join."""
        if self._stored_content is not None:
            return self._stored_content
        if self.inputs.question_scores is not None:
            return scoring.scored_content(self.candidates, self.inputs.question_scores)
        return self.candidates.withColumn("is_question", self.rule.is_question)

    @cached_property
    def engagement(self) -> DataFrame:
        i = self.inputs
        return engagement.team_engagement(i.core_comments, i.core_reactions, self.staff, self._tenant)

    @cached_property
    def metadata(self) -> DataFrame:
        return self.edits if self.settled else tickets.latest_metadata(self.edits)

    @cached_property
    def labels(self) -> DataFrame:
        return self.inputs.topic_labels

    @cached_property
    def assignments(self) -> DataFrame:
        return tickets.member_assignments(
            self.content, self.metadata, self.inputs.member_assignment_overrides)

    @cached_property
    def rebuilt_tickets(self) -> DataFrame:
        return tickets.tickets(self.content, self.members, self.engagement, self.metadata,
                               self.labels, self.assignments, self.few_people)

    @cached_property
    def few_people(self) -> bool:
        """Whether members and coached authors may be broadcast; edited items are no fewer than the latter.
        Profiles are some hundred bytes, hence the share of the bound for ids."""
        return self.members.count() + self.edits.count() <= self._bound // 5

    @property
    def tickets(self) -> DataFrame:
        """Stored tickets if given, else the rebuild itself."""
        return self.rebuilt_tickets if self._stored_tickets is None else self._stored_tickets

    @cached_property
    def live(self) -> DataFrame:
        return tickets.live_tickets(self.tickets, self.edits, self.keyed, self.settled)

    @cached_property
    def feedback(self) -> DataFrame:
        return feedback.classification_feedback(self.metadata, self.tickets, self._bound)

    def new_labels(self, topic: Column | PipelineModel | None = None) -> DataFrame:
        """Labels for the questions that have none; by the built-in dictionary unless told otherwise."""
        pending = scoring.unlabelled_questions(self.content, self.labels)
        return scoring.label_topics(pending, self.settings.now, topic)

    def topic_model(self) -> PipelineModel:
        """Topics as they are labelled so far."""
        return training.train_topics(self.content.select("content_id", "body").join(self.labels.select("content_id", "domain"), "content_id"))

    def incremental_scores(self, stored: DataFrame, scorer: scoring.Scorer | None = None) -> DataFrame:
        """Scores for the items ``stored`` lacks: by a column expression, a function of batches or a
        fitted model, else by the workspace's rule."""
        fresh = scoring.unscored(self.candidates, stored)
        if scorer is not None:
            return scoring.score_with(fresh, scorer, self.settings.now)
        if self.rule is None:
            raise ValueError("this workspace has stored scores and no rule: give a scorer for new items")
        return scoring.score(fresh, self.rule.is_question, self.rule.classified_at)
