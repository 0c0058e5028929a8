import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, values
from triage.operators import feedback, reports, training

T0 = at("2024-01-30 00:00:00")
COLUMNS = ("content_id string, feedback_type string, feedback_reason string, flagged_at timestamp_ntz, "
           "content_type string, body string")
LONG = "Say TRUE when a member asks for help with something that staff can answer."


def today():
    return F.lit("2024-01-31").cast("date")


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def flagged(frame, rejects=0, confirmed=0, note="why", days=0):
    rows = [(f"{kind}_{i}", kind, note, T0 - dt.timedelta(days=days, minutes=i), "post", "b" * 400)
            for kind, n in (("not_a_question", rejects), ("confirmed_question", confirmed)) for i in range(n)]
    return frame(COLUMNS, *rows)


def response(text: str) -> str:
    import json

    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def config(frame, *rows):
    return frame("version bigint, prompt_text string, change_reason string, created_by string, created_at timestamp_ntz", *rows)


def test_digest_limits_notes_and_empty_sections(frame):
    got = feedback.feedback_digest(flagged(frame, rejects=25), today()).first()
    head, lines = got.examples.split("\n\n## CONFIRMED QUESTIONS\n")
    assert lines == "  (none this week)"
    assert head.startswith("## FALSE POSITIVES\n  [FP] Type: post | Text: ")
    assert head.count("[FP]") == 20 and "b" * 351 not in head and head.endswith("b | Team note: why")
    assert got.feedback_rows == 25 and got.passes_gate
    blank = feedback.feedback_digest(flagged(frame, confirmed=2, note=""), today()).first()
    assert "Team note" not in blank.examples and not blank.passes_gate


def test_digest_of_nothing(frame):
    got = feedback.feedback_digest(flagged(frame), today()).first()
    assert got.examples == "## FALSE POSITIVES\n  (none this week)\n\n## CONFIRMED QUESTIONS\n  (none this week)"


def test_old_feedback_does_not_count(frame):
    assert feedback.recent_feedback(flagged(frame, rejects=3, days=5), today()).count() == 3
    assert feedback.recent_feedback(flagged(frame, rejects=3, days=9), today()).count() == 0


def test_latest_prompt_of_an_empty_table(frame):
    assert tuple(feedback.latest_prompt(config(frame)).first()) == (None, None, 1)


def test_proposals_are_parsed(frame):
    answers = frame("response_id bigint, responded_at timestamp_ntz, result string",
                    (1, T0, response(f"CHANGE_REASON: too strict \n{LONG}\nsecond line")),
                    (2, T0, response(f"change_reason:No change\n{LONG}")),
                    (3, T0, response(LONG)), (4, T0, "broken"), (5, T0, response("CHANGE_REASON: a\rb\nrest")))
    got = {r.response_id: (r.change_reason, r.new_prompt) for r in feedback.parse_proposals(answers).collect()}
    assert got == {1: ("too strict", f"{LONG}\nsecond line"), 2: ("No change", LONG), 3: (None, LONG),
                   4: (None, None), 5: ("a\rb", "rest")}


def test_roll_forward_gates(frame):
    versions = config(frame, (1, "old", None, None, T0), (4, "prompt", None, None, T0))
    enough = flagged(frame, rejects=5)

    def roll(text, feedback_rows=enough, versions=versions):
        answer = frame("response_id bigint, responded_at timestamp_ntz, result string", (1, T0, response(text)))
        return feedback.prompt_rollforward(versions, answer, feedback_rows, now()).collect()

    new, = roll(f"CHANGE_REASON: wider\n{LONG}")
    assert (new.prompt_id, new.version, new.prompt_text, new.change_reason) == ("question_classifier_v5", 5, LONG, "wider")
    assert not roll(f"CHANGE_REASON: wider\n{LONG}", flagged(frame, rejects=4))
    assert not roll(f"CHANGE_REASON: No Change \n{LONG}")
    assert not roll(LONG)
    assert not roll("CHANGE_REASON: wider\ntoo short")
    assert not roll(f"CHANGE_REASON: wider\n{LONG}", versions=config(frame, (1, f" {LONG}\n", None, None, T0)))


def test_newest_acceptable_proposal_wins(frame):
    versions = config(frame, (1, "old", None, None, T0))
    answers = frame("response_id bigint, responded_at timestamp_ntz, result string",
                    (1, T0, response(f"CHANGE_REASON: one\n{LONG}")),
                    (2, T0 + dt.timedelta(hours=1), response(f"CHANGE_REASON: two\n{LONG}")),
                    (3, T0 + dt.timedelta(hours=2), response(f"CHANGE_REASON: no change\n{LONG}")))
    new, = feedback.prompt_rollforward(versions, answers, flagged(frame, rejects=5), now()).collect()
    assert new.change_reason == "two" and new.version == 2


def test_request_is_made_only_past_the_gate(frame):
    versions = config(frame, (3, "current", None, None, T0))
    assert feedback.proposal_request(versions, flagged(frame, rejects=4), today()).isEmpty()
    row = feedback.proposal_request(versions, flagged(frame, rejects=5), today()).first()
    assert (row.old_prompt, row.old_version) == ("current", 3)


def test_intervals_cross_blocks_of_versions(frame):
    numbers = [1, 2, 1023, 1024, 5000]
    versions = config(frame, *[(n, "p", None, None, T0 + dt.timedelta(days=i)) for i, n in enumerate(numbers)])
    got = {r.version: r.superseded_at for r in feedback.version_intervals(versions).collect()}
    assert got == {n: (T0 + dt.timedelta(days=i + 1) if i < 4 else None) for i, n in enumerate(numbers)}


def test_unused_version_counts_one_and_none(frame):
    versions = config(frame, (1, "p", None, None, T0), (2, "q", None, None, T0 + dt.timedelta(days=5)))
    scores = frame("content_id string, is_question boolean, classified_at timestamp_ntz",
                   ("a", True, T0), ("b", None, T0), ("c", False, T0 - dt.timedelta(1)), ("d", True, None))
    got = {r.version: r for r in feedback.version_stats(versions, scores, flagged(frame, rejects=1)).collect()}
    assert (got[2].total_classified, got[2].classified_rows, got[2].is_current, got[2].question_rate) == (1, 0, True, 0.0)
    assert (got[1].total_classified, got[1].classified_as_question, got[1].question_rate) == (2, 1, 50.0)


def test_stats_do_not_depend_on_the_join(frame, no_broadcast):
    versions = config(frame, *[(n, "p", None, None, T0 - dt.timedelta(hours=9 * (20 - n))) for n in range(20)])
    scores = frame("content_id string, is_question boolean, classified_at timestamp_ntz",
                   *[(str(i), i % 3 == 0, T0 - dt.timedelta(minutes=i * 17)) for i in range(300)])
    rows = flagged(frame, rejects=7, confirmed=2)
    assert values(feedback.version_stats(versions, scores, rows)) == values(
        feedback.version_stats(versions, scores, rows, max_rows=0))


def test_literal_unset_joins_the_missing(frame):
    rows = frame("created_at timestamp_ntz, domain string", (T0, "unset"), (T0, None), (T0, ""))
    day = F.lit("2024-01-30").cast("date")
    assert values(reports.topic_breakdown(rows, day, day)) == [("", 1), ("unset", 2)]


def test_response_summary_of_nothing_and_of_ties(frame):
    empty = reports.response_summary(frame("minutes_to_response bigint")).first()
    assert tuple(empty) == (None, None, None)
    got = reports.response_summary(frame("minutes_to_response bigint", (-5,), (10,), (1439,), (1440,))).first()
    assert tuple(got) == (721.0, 724.5, 75.0)


def test_closing_without_a_comment_is_logged_once(frame):
    items = [(k, k == "b", k == "r", False, None if k == "e" else 7, "d") for k in "abcernq"]
    tickets = frame("content_id string, team_commented boolean, team_comment_replied boolean, team_reacted boolean, "
                    "member_id bigint, domain string", *items)
    scores = frame("content_id string, is_question boolean", *[(k, k != "n") for k in "abcern"])
    log = "content_id string, updated_at timestamp_ntz, status string, assigned_to string, domain string, feedback_reason string"
    day = lambda n: T0 + dt.timedelta(days=n)
    edits = frame(log, *[(k, day(n), s, None, None, None) for k, n, s in (
        ("a", 1, "assigned"), ("a", 2, "closed"), ("a", 3, "closed"), ("a", 4, "open"), ("a", 5, "cancelled"),
        ("b", 1, "closed"), ("c", 1, ""), ("c", 2, "closed"), ("e", 1, "cancelled"), ("r", 1, "closed"), ("n", 1, "closed"),
        ("q", 1, "closed"), ("gone", 1, "closed"))])
    got = reports.closed_without_comment(tickets, edits, scores)
    found = sorted((r.message.split(":")[0], (r.created_at - T0).days) for r in got.collect())
    assert found == [("a", 2), ("a", 5), ("c", 2), ("e", 1), ("n", 1), ("q", 1), ("r", 1)]
    assert {r.detail for r in got.collect()} == {"author 7, topic d", "author unknown, topic d"}
    assert values(got.select("log_id")) == values(reports.closed_without_comment(tickets, edits, scores).select("log_id"))


def test_column_audit(frame):
    rows = frame("a string, b string", ("x", None), (None, None))
    assert values(reports.column_audit(rows)) == [("a", 1, False), ("b", 0, True)]


def test_scorer_learns(frame):
    rows = [(str(i), ("confirmed_question" if i % 2 else "not_a_question"), "r", T0, "post",
             "how do I get help please" if i % 2 else "thank you all great day") for i in range(120)]
    got = training.train_and_evaluate(frame(COLUMNS, *rows)).first()
    assert got.rows > 10 and got.accuracy == 1.0 and got.false_positives == 0


def test_scorer_needs_both_classes(frame):
    rows = [(str(i), "not_a_question", "r", T0, "post", "text") for i in range(3)]
    examples = training.labelled(frame(COLUMNS, *rows))
    with pytest.raises(ValueError, match="label 0"):
        training.train(examples)
    with pytest.raises(ValueError, match="no examples"):
        training.train(examples.limit(0))


def pair_counting(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_ranking_quality_is_pair_counting(frame):
    import random

    rnd = random.Random(9)
    rows = [(v, rnd.choice([0.0, 1.0, rnd.random(), .5]), float(rnd.random() < .4)) for v in ("a", "b") for _ in range(300)]
    rows += [("one kind", .3, 1.0), ("none", None, 1.0), ("none", .2, None)]
    got = {r.v: r for r in training.ranking_quality(frame("v string, s double, label double", *rows), "s", "v").collect()}
    for v in ("a", "b"):
        assert got[v].auc == pytest.approx(pair_counting([(s, y) for w, s, y in rows if w == v]), abs=1e-12)
    assert got["one kind"].auc is None and (got["one kind"].positives, got["one kind"].negatives) == (1, 0) and "none" not in got


def test_folds_and_calibration(frame):
    import random

    rnd = random.Random(4)
    words = ["help", "please", "how", "thanks", "great", "news"]
    rows = []
    for k in range(240):
        body = " ".join(rnd.choices(words, [5, 3, 4, 1, 1, 1] if k % 2 else [1, 1, 1, 5, 4, 3], k=6))
        rows.append((f"i{k}", body, float(k % 2 if rnd.random() < .85 else 1 - k % 2)))
    examples = frame("content_id string, body string, label double", *rows)
    predicted = training.cross_predicted(examples).cache()
    assert predicted.count() == len(rows) and predicted.select("content_id").distinct().count() == len(rows)
    quality = training.ranking_quality(predicted, "probability").first()
    assert quality.auc > 0.75 and (quality.positives, quality.negatives) == (sum(r[2] for r in rows), sum(1 - r[2] for r in rows))
    sure = training.calibration(predicted).transform(predicted)
    error = lambda c: sure.agg(F.avg((F.col(c) - F.col("label")) ** 2)).first()[0]
    assert error("calibrated") <= error("probability")
    ordered = [r.calibrated for r in sure.orderBy("probability").collect()]
    assert ordered == sorted(ordered)


def test_learnt_topics_beat_the_dictionary(frame):
    import random

    from triage import vocabulary
    from triage.operators import scoring

    rnd = random.Random(5)
    topics = [t for t in vocabulary.TOPICS if t in vocabulary.TOPIC_WORDS][:3]
    own = {t: [f"{'abc'[i]}word{k}" for k in range(12)] for i, t in enumerate(topics)}

    def text(topic):
        listed = [rnd.choice(vocabulary.TOPIC_WORDS[topic])] if rnd.random() < .3 else []
        return " ".join([*rnd.choices(own[topic], k=8), *rnd.choices(["and", "the", "so"], k=8), *listed])

    rows = [(f"i{k}", t, text(t)) for k in range(240) for t in [rnd.choice(topics)]]
    labelled = frame("content_id string, domain string, body string", *rows, ("none", None, "x"), ("empty", topics[0], None))
    test = training.held_out(F.col("content_id"))
    model = training.train_topics(labelled.filter(~test))
    pending = labelled.filter(test).filter("content_id <> 'none'")
    truth = {r[0]: r[1] for r in rows}
    right = {}
    for name, topic in (("model", model), ("dictionary", None)):
        found = scoring.label_topics(pending, now(), topic).collect()
        right[name] = sum(truth.get(r.content_id) == r.domain for r in found) / len(found)
    assert right["model"] > 0.95 > 0.6 > right["dictionary"]
    unsure = frame("content_id string, body string", ("a", "unheard of"), ("b", None), ("c", vocabulary.TOPIC_WORDS[topics[1]][0]))
    got = training.predict_topics(model, unsure, scoring.topic_by_words(F.col("body")), least=1.1)
    assert values(got.select("content_id", "domain")) == values(scoring.label_topics(unsure, now()).select("content_id", "domain"))
