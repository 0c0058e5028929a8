"""The feedback loop: what the team corrected, per prompt version, and the next version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage import vocabulary as v
from triage.functions import clock
from triage.functions.text import is_blank, json_scalar, preview, trim_all
from triage.operators.joins import DEFAULT_BROADCAST_ROWS, is_small, match_intervals, touched_days

_VERSION_BLOCK = 1024


def classification_feedback(metadata: DataFrame, tickets: DataFrame,
                            max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Reviewed items with a reason (a blank one counts), week opening on Sunday.

    People write the flags, so they are few beside the tickets; counted small they are
    broadcast and the bodies of all other tickets stay where they are.
    """
    flagged = metadata.filter(
        F.col("status").isin(*v.FEEDBACK_STATUSES) & F.col("feedback_reason").isNotNull()
    ).select(
        "content_id", F.col("status").alias("feedback_type"), "feedback_reason",
        F.col("updated_at").alias("flagged_at"), F.col("assigned_to").alias("flagged_by"),
    )
    # A flag takes the room of some ten ids.
    if is_small(flagged, max_rows // 10):
        flagged = F.broadcast(flagged)
    items = tickets.select("content_id", "content_type", "body", "member_name",
                           F.col("created_at").alias("content_created_at"))
    return items.join(flagged, "content_id").select(
        "content_id", "feedback_type", "feedback_reason", "flagged_at", "flagged_by",
        "content_type", "body", "member_name", "content_created_at",
        clock.sunday_of(F.col("flagged_at")).alias("feedback_week"),
    )


def feedback_between(feedback: DataFrame, first: Column, last: Column) -> DataFrame:
    return feedback.filter(F.to_date("flagged_at").between(first, last)).orderBy(*_newest_flag())


def _newest_flag() -> list[Column]:
    return [F.col("flagged_at").desc_nulls_last(), F.col("content_id").desc()]


def recent_feedback(feedback: DataFrame, today: Column) -> DataFrame:
    return feedback.filter(F.to_date("flagged_at") >= F.date_sub(today, v.FEEDBACK_DAYS))


def top_feedback(feedback: DataFrame, today: Column, kind: str, rows: int) -> DataFrame:
    """The newest ``rows`` of one kind; a top-k, so each task keeps at most that many."""
    return (
        recent_feedback(feedback, today)
        .filter(F.col("feedback_type") == kind)
        .select("content_id", "flagged_at", "content_type", "feedback_reason",
                preview(F.col("body"), v.DIGEST_PREVIEW).alias("body_preview"))
        .orderBy(*_newest_flag())
        .limit(rows)
    )


def feedback_digest(feedback: DataFrame, today: Column) -> DataFrame:
    """One row: both sections as text, the number of recent rows, and whether it passes the gate.

    The rows of the sections are chosen, and all rows counted, without the bodies; then one pass over these
    fetches the few that are shown.
    """
    sections = {"not_a_question": (v.DIGEST_REJECTS, "FP"), "confirmed_question": (v.DIGEST_CONFIRMED, "CQ")}
    kind = F.col("feedback_type")
    recent = recent_feedback(feedback, today).filter(kind.isin(*sections))
    narrow = recent.select("content_id", "feedback_type", "flagged_at")
    place = F.row_number().over(Window.partitionBy("feedback_type").orderBy(*_newest_flag()))
    most = reduce(lambda rest, k: F.when(kind == k, sections[k][0]).otherwise(rest), sections, F.lit(0))
    placed = narrow.withColumn("_place", place).filter(F.col("_place") <= max(n for n, _ in sections.values()))
    chosen = placed.filter(F.col("_place") <= most).select("content_id", "feedback_type", "_place")

    tag = reduce(lambda rest, k: F.when(kind == k, sections[k][1]).otherwise(rest), sections, F.lit(""))
    note = F.when(~is_blank(F.col("feedback_reason")), F.concat(F.lit(v.DIGEST_NOTE), "feedback_reason")).otherwise("")
    line = F.concat(F.lit("  ["), tag, F.lit(f"] {v.DIGEST_TYPE}"), "content_type", F.lit(v.DIGEST_TEXT),
                    preview(F.col("body"), v.DIGEST_PREVIEW), note)
    # At most the lines of both sections: they fit a broadcast, and the aggregate that joins them.
    lines = recent.join(F.broadcast(chosen), ["content_id", "feedback_type"]).select("feedback_type", "_place", line.alias("line"))

    def section(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(kind == name, F.struct("_place", "line"))))
        text = F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")
        return F.when(F.count_if((kind == name) & F.col("line").isNotNull()) == 0, v.DIGEST_EMPTY).otherwise(text)

    examples = F.concat(F.lit(v.DIGEST_REJECT_HEADER), section("not_a_question"), F.lit(v.DIGEST_CONFIRMED_HEADER),
                        section("confirmed_question"))
    rows = recent_feedback(feedback, today).agg(F.count("*")).scalar()
    counted = lines.agg(examples.alias("examples")).withColumn("feedback_rows", rows)
    return counted.withColumn("passes_gate", F.col("feedback_rows") >= v.FEEDBACK_GATE)


def latest_prompt(config: DataFrame) -> DataFrame:
    """The current prompt and the number the next one gets; one row even for an empty table."""
    return config.agg(
        F.max("version").alias("version"),
        F.max_by("prompt_text", "version").alias("prompt_text"),
        (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"),
    )


def proposal_request(config: DataFrame, feedback: DataFrame, today: Column) -> DataFrame:
    """What a remote model needs to propose a prompt: old prompt, examples. No row below the gate."""
    current = latest_prompt(config)
    digest = feedback_digest(feedback, today).filter("passes_gate")
    return digest.select(
        "examples",
        current.select("prompt_text").scalar().alias("old_prompt"),
        current.select("version").scalar().alias("old_version"),
    )


def version_intervals(config: DataFrame) -> DataFrame:
    """Each version with the time the next one took over.

    ``lead`` over blocks of version numbers, then over the first rows of the blocks: the same
    answer as one global window, without sending the whole table through one task.
    """
    blocked = config.withColumn("_block", F.floor(F.col("version") / _VERSION_BLOCK))
    heads = blocked.groupBy("_block").agg(F.min_by("created_at", "version").alias("_head"))
    following = heads.select(
        "_block", F.lead("_head").over(Window.orderBy("_block")).alias("_next_block")
    )
    inside = Window.partitionBy("_block").orderBy("version")
    is_last = F.lead("version").over(inside).isNull()
    return (
        blocked.withColumns({"_next": F.lead("created_at").over(inside), "_last": is_last})
        .join(following, "_block", "left")
        .withColumn("superseded_at", F.when(F.col("_last"), F.col("_next_block")).otherwise(F.col("_next")))
        .select("version", "prompt_text", "change_reason", "created_by", "created_at", "superseded_at")
    )


def version_stats(config: DataFrame, scores: DataFrame, feedback: DataFrame,
                  max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Per version: scored rows, questions among them, corrections, question rate.

    ``total_classified`` counts an unused version as 1, as a count over a left join does;
    ``classified_rows`` is the true number.
    """
    versions = version_intervals(config)
    spans = versions.select("version", F.col("created_at").alias("_start"), F.col("superseded_at").alias("_end"))
    small = touched_days(spans, "_start", "_end") <= max_rows

    scored = match_intervals(
        scores.select("classified_at", "is_question"), "classified_at", spans, "_start", "_end", small
    ).groupBy("version").agg(
        F.count("*").alias("classified_rows"),
        F.count_if(F.col("is_question")).alias("classified_as_question"),
    )
    flags = match_intervals(
        feedback.select("flagged_at", "feedback_type"), "flagged_at", spans, "_start", "_end", small
    ).groupBy("version").agg(
        F.count_if(F.col("feedback_type") == "not_a_question").alias("false_positives"),
        F.count_if(F.col("feedback_type") == "confirmed_question").alias("confirmed_questions"),
    )
    zero = F.lit(0).cast("bigint")
    counts = ("classified_rows", "classified_as_question", "false_positives", "confirmed_questions")
    total = F.greatest(F.col("classified_rows"), F.lit(1))
    return (
        versions.join(scored, "version", "left").join(flags, "version", "left")
        .withColumns({c: F.coalesce(F.col(c), zero) for c in counts})
        .select(
            "version", "prompt_text", "change_reason", "created_at", "superseded_at",
            F.col("superseded_at").isNull().alias("is_current"),
            total.alias("total_classified"), *counts,
            F.bround(F.col("classified_as_question") / total * 100, 1).alias("question_rate"),
        )
        .orderBy(F.col("version").desc())
    )


# Fixed patterns: the reason is the rest of its line, and that first line is not part of the prompt.
REASON = r"(?di)CHANGE_REASON:\s*(.*?)(?:\n|$)"
REASON_LINE = r"(?di)^CHANGE_REASON:.*\n?"


def parse_proposals(responses: DataFrame) -> DataFrame:
    """Reason and prompt text out of model responses (response_id, result, responded_at)."""
    text = json_scalar(F.col("result"), "$.candidates[0].content.parts[0].text")
    parsed = responses.withColumn("_text", text)
    reason = F.when(F.col("_text").rlike(REASON), F.regexp_extract("_text", REASON, 1))
    return parsed.select(
        "response_id", "responded_at",
        trim_all(reason).alias("change_reason"),
        trim_all(F.regexp_replace("_text", REASON_LINE, "")).alias("new_prompt"),
    )


def accepted(proposals: DataFrame, old_prompt: Column) -> DataFrame:
    """A proposal counts if it names a change, changes the text, and is long enough to be a prompt."""
    return proposals.filter(
        (F.lower(trim_all(F.col("change_reason"))) != v.NO_CHANGE)
        & (F.col("new_prompt") != trim_all(old_prompt))
        & (F.length("new_prompt") > v.MIN_PROMPT_LENGTH)
    )


def prompt_rollforward(config: DataFrame, responses: DataFrame, feedback: DataFrame, now: Column,
                       created_by: str = "prompt_updater") -> DataFrame:
    """The row to append to the config: the newest acceptable proposal, or nothing.

    One version per run, as each is a proposal to change the version before it.
    """
    current = latest_prompt(config)
    enough = recent_feedback(feedback, F.to_date(now)).agg(F.count("*") >= v.FEEDBACK_GATE).scalar()
    chosen = (
        accepted(parse_proposals(responses), current.select("prompt_text").scalar())
        .filter(enough)
        .orderBy(F.col("responded_at").desc_nulls_last(), F.col("response_id").desc())
        .limit(1)
    )
    version = current.select("next_version").scalar()
    return chosen.withColumn("version", version).select(
        F.concat(F.lit("question_classifier_v"), F.col("version").cast("string")).alias("prompt_id"),
        F.col("new_prompt").alias("prompt_text"), "version", "change_reason",
        now.alias("created_at"), F.lit(created_by).alias("created_by"),
    )
