"""Tokens, decisions, completion, lifecycle; decisions against a one-by-one replay."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.fixtures import stored, view
from sluicegate.operators import approvals

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NOW = datetime(2024, 2, 1)
TOKENS = "approval_token string, template_id int, reviewer_email string, token_used boolean, token_expires_at timestamp_ntz, round int, action string, created_at timestamp_ntz"
REQUESTS = "decision_id int, decided_at timestamp_ntz, token string, decision string"


def token(name, used=False, expires=NOW + timedelta(days=30), template=1, email="r@x.test", round_=1, action=None):
    return (name, template, email, used, expires, round_, action, NOW - timedelta(days=1))


@pytest.mark.parametrize(
    "asked, state",
    [("good", "valid"), ("missing", "not_found"), ("spent", "used"), ("old", "expired"), ("spent-old", "used"), ("edge", "valid")],
)
def test_token_state(spark, asked, state):
    rows = [
        token("good"),
        token("spent", used=True),
        token("old", expires=NOW - timedelta(seconds=1)),
        token("spent-old", used=True, expires=NOW - timedelta(days=1)),
        token("edge", expires=NOW),
    ]
    known = spark.createDataFrame(rows, TOKENS)
    requests = spark.createDataFrame([(1, NOW, asked, "approve")], REQUESTS)
    assert approvals.token_state(requests, known).first().token_state == state
    assert approvals.token_state(requests, known, as_of=str(NOW)).first().token_state == state


def replay(decisions, tokens, statuses, required, strict):
    """The workflow handled one decision at a time."""
    tokens = {t[0]: dict(zip("token template email used expires round action created".split(), t)) for t in tokens}
    statuses = dict(statuses)
    outcomes, of_template, reviewers = {}, defaultdict(list), defaultdict(set)
    for t in tokens.values():
        of_template[t["template"]].append(t)
    for template, email in required:
        reviewers[template].add(email)
    for number, at, name, decision in sorted(decisions, key=lambda d: (d[1], d[0])):
        t = tokens.get(name)
        if t is None:
            outcomes[number] = ("not_found", None)
        elif t["used"]:
            outcomes[number] = ("used", None)
        elif t["expires"] < at:
            outcomes[number] = ("expired", None)
        elif statuses.get(t["template"]) != "Pending Approval":
            outcomes[number] = ("not_pending", None)
        elif not strict and t["round"] < max(x["round"] for x in of_template[t["template"]]):
            outcomes[number] = ("old_round", None)
        else:
            t["used"], t["action"] = True, "approved" if decision == "approve" else "rejected"
            needed = reviewers[t["template"]]
            if decision == "reject" and (strict or t["email"] in needed):
                statuses[t["template"]] = "Draft"
            mine = of_template[t["template"]]
            latest = max(x["round"] for x in mine)
            given = {x["email"] for x in mine if x["action"] == "approved" and x["round"] == latest}
            rows = sum(x["action"] == "approved" and x["email"] in needed for x in mine)
            complete = rows >= len(needed) > 0 if strict else t["email"] in needed and needed <= given
            if decision == "approve" and complete:
                statuses[t["template"]] = "Pending DDL"
            outcomes[number] = ("recorded", statuses[t["template"]])
    return outcomes


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_decisions_equal_one_by_one_handling(spark, seed, strict):
    pick = random.Random(seed)
    emails = ["a@x", "b@x", "c@x", "d@x"]
    statuses = [(i, "Pending Approval" if i % 5 else "Draft") for i in range(12)]
    required = [(i, e) for i, _ in statuses for e in emails[: 1 + i % 3]]
    tokens = [
        token(f"{i}-{e}-{r}", pick.random() < 0.15, NOW + timedelta(hours=pick.choice([5, 500])), i, e, r, None)
        for i, _ in statuses
        for e in emails
        for r in range(1, 2 + i % 2)
    ]
    tokens = [t if not t[3] else t[:6] + (pick.choice(["approved", "rejected"]),) + t[7:] for t in tokens]
    decisions = [
        (
            n,
            NOW + timedelta(hours=pick.randint(0, 30)),
            pick.choice([t[0] for t in tokens] + ["unknown"]),
            pick.choice(["approve", "approve", "approve", "reject"]),
        )
        for n in range(220)
    ]
    found = approvals.apply_decisions(
        spark.createDataFrame(decisions, REQUESTS),
        spark.createDataFrame(tokens, TOKENS),
        spark.createDataFrame(statuses, "id int, status string"),
        spark.createDataFrame([(i, e, "required") for i, e in required], "template_id int, reviewer_email string, reviewer_type string"),
        strict_reference=strict,
        hot_rows=3,
    )
    expected = replay(decisions, tokens, statuses, required, strict)
    assert strict or {"recorded", "old_round", "used", "not_pending"} <= {o for o, _ in expected.values()}
    assert "Pending DDL" in {s for _, s in expected.values()}
    assert {r.decision_id: (r.outcome, r.template_status) for r in found.collect()} == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("strict", [False, True])
def test_decisions_over_the_given_tables(spark, strict):
    """The same, over all decisions and approvals that the registered query reads."""
    asked, known = stored(spark, DATA, "decisions"), stored(spark, DATA, "token_approvals")
    templates, reviewers = view(spark, DATA, "templates"), view(spark, DATA, "template_reviewers")
    found = approvals.apply_decisions(asked, known, templates, reviewers, strict_reference=strict)
    fields = ("approval_token", "template_id", "reviewer_email", "token_used", "token_expires_at", "round", "action", "created_at")
    required = reviewers.filter("reviewer_type = 'required'").select("template_id", "reviewer_email")
    expected = replay(
        [tuple(r) for r in asked.select("decision_id", "decided_at", "token", "decision").collect()],
        [tuple(r) for r in known.select(*fields).collect()],
        [tuple(r) for r in templates.select("id", "status").collect()],
        [tuple(r) for r in required.collect()],
        strict,
    )
    assert {r.decision_id: (r.outcome, r.template_status) for r in found.collect()} == expected
    assert {"Draft", "Pending Approval"} <= {s for _, s in expected.values()}


REVIEWERS = "template_id int, reviewer_email string, reviewer_type string"
APPROVALS = "template_id int, reviewer_email string, action string, round int, created_at timestamp_ntz"


def completion(spark, rows, row_counting=False):
    reviewers = spark.createDataFrame([(1, "a", "required"), (1, "b", "required"), (1, "c", "optional")], REVIEWERS)
    given = spark.createDataFrame([(1, e, action, r, NOW) for e, action, r in rows], APPROVALS)
    found = approvals.fully_approved(reviewers, given, row_counting).first()
    return (found.required, found.approved, found.fully_approved)


def test_completion(spark):
    assert completion(spark, [("a", "approved", 1), ("b", "approved", 1)]) == (2, 2, True)
    assert completion(spark, [("a", "approved", 1), ("c", "approved", 1)]) == (2, 1, False)
    assert completion(spark, [("a", "approved", 1), ("b", "rejected", 1)]) == (2, 1, False)
    # One reviewer approving in two rounds does not stand in for the other.
    twice = [("a", "approved", 1), ("b", None, 1), ("a", "approved", 2), ("b", None, 2)]
    assert completion(spark, twice) == (2, 1, False)
    assert completion(spark, twice, row_counting=True) == (2, 2, True)
    # An approval of an earlier round has lapsed.
    assert completion(spark, [("a", "approved", 1), ("b", "approved", 2)]) == (2, 1, False)


def test_registry_tables_have_rounds_and_names(spark):
    """The tables that the registry makes, without a round column, are enough."""
    columns = "template_id int, reviewer_email string, action string, created_at timestamp_ntz"
    later = NOW + timedelta(days=2)
    rows = [(1, "a", "approved", NOW), (1, "b", "rejected", NOW), (1, "a", "approved", later), (1, "b", None, later)]
    given = spark.createDataFrame(rows, columns)
    assert {(r.created_at, r.round) for r in approvals.with_rounds(given).collect()} == {(NOW, 1), (later, 2)}
    reviewers = spark.createDataFrame([(1, "a", "required"), (1, "b", "required"), (2, "c", "optional")], REVIEWERS)
    templates = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    found = approvals.fully_approved(reviewers, given, templates=templates).collect()
    assert {(r.template_id, r.required, r.approved, r.fully_approved) for r in found} == {
        (1, 2, 1, False),
        (2, 0, 0, False),
        (3, 0, 0, False),
    }


def test_messages_and_tables_after_each_decision(spark):
    reviewers = spark.createDataFrame([(1, "a", "required"), (1, "b", "required"), (1, "c", "optional")], REVIEWERS)
    tokens = [token(f"t-{e}", False, NOW + timedelta(days=9), 1, e, 1, None) for e in "abc"]
    known = spark.createDataFrame(tokens, TOKENS)
    steps = [(i, NOW + timedelta(hours=i), f"t-{e}", "approve") for i, e in enumerate("cabb")]
    templates = spark.createDataFrame([(1, "Pending Approval"), (2, "Draft")], "id int, status string")
    outcomes = approvals.apply_decisions(spark.createDataFrame(steps, REQUESTS), known, templates, reviewers)
    texts = {r.decision_id: r.message[:8] for r in approvals.messages_after(outcomes, reviewers, known).collect()}
    assert texts == {0: "0 of 2 r", 1: "1 of 2 r", 2: "All 2 re"}
    rows, after = approvals.applied_tables(outcomes, known.withColumn("actioned_at", F.lit(None).cast("timestamp_ntz")), templates)
    assert {(r.id, r.status) for r in after.collect()} == {(1, "Pending DDL"), (2, "Draft")}
    assert {(r.approval_token, r.token_used, r.action) for r in rows.collect()} == {(f"t-{e}", True, "approved") for e in "abc"}
    submitted = approvals.submitted_templates(after, spark.createDataFrame([(1,), (2,)], "template_id int"))
    assert {(r.id, r.status) for r in submitted.collect()} == {(1, "Pending DDL"), (2, "Pending Approval")}


def test_messages(spark):
    reviewers = spark.createDataFrame([(1, "a", "required"), (1, "b", "required")], REVIEWERS)
    rows = spark.createDataFrame([(1, "a", "approved", 1, NOW)], APPROVALS)
    text = approvals.progress_messages(reviewers, rows).first().message
    assert text == "1 of 2 required reviewers have approved. Awaiting 1 more."
    done = rows.unionByName(spark.createDataFrame([(1, "b", "approved", 1, NOW)], APPROVALS))
    assert approvals.progress_messages(reviewers, done).first().message.startswith("All 2 required reviewers have approved.")
    assert "back to Draft" in approvals.progress_messages(reviewers, rows, "reject").first().message


def test_readiness_reasons_in_order(spark):
    templates = spark.createDataFrame([(i, "Draft") for i in range(1, 6)] + [(6, "Approved")], "id int, status string")
    columns = spark.createDataFrame([(2, False), (3, True), (4, True), (5, True)], "template_id int, is_included boolean")
    reviewers = spark.createDataFrame([(4, "optional"), (5, "optional"), (5, "required")], "template_id int, reviewer_type string")
    found = {r.template_id: r.readiness for r in approvals.readiness(templates, columns, reviewers).collect()}
    assert found == {
        1: "no_columns", 2: "no_included_columns", 3: "no_reviewers", 4: "no_required_reviewers", 5: "ready", 6: "not_draft",
    }


@pytest.mark.parametrize("pieces", [1, 3, 16, None])
def test_previous_status_does_not_depend_on_pieces(spark, pieces):
    pick = random.Random(7)
    statuses = ["Pending Approval", "Pending DDL", "Approved", "Draft", "Deprecated"]
    events = [(n, pick.randint(1, 3), NOW + timedelta(minutes=pick.randint(0, 4000)), pick.choice(statuses)) for n in range(300)]
    df = spark.createDataFrame(events, "event_id int, template_id int, ts timestamp_ntz, to_status string")
    expected, last = {}, {}
    for n, template, _, status in sorted(events, key=lambda e: (e[2], e[0])):
        expected[n] = last.get(template, "Draft")
        last[template] = status
    found = approvals.with_previous_status(df, pieces)
    assert {r.event_id: r.from_status for r in found.collect()} == expected
    assert {r.template_id: r.status for r in approvals.replay_status(df).collect()} == last


def test_legal_path_has_no_invalid_transitions(spark):
    path = ["Pending Approval", "Draft", "Pending Approval", "Pending DDL", "Approved", "Deprecated"]
    df = spark.createDataFrame([(i, 1, NOW + timedelta(hours=i), s) for i, s in enumerate(path)], "event_id int, template_id int, ts timestamp_ntz, to_status string")
    assert approvals.invalid_transitions(df).count() == 0
    assert approvals.invalid_transitions(df.filter("to_status <> 'Pending DDL'")).count() == 1


def test_reminders_wait_for_more_than_the_given_days(spark):
    templates = spark.createDataFrame([(1, "Pending Approval"), (2, "Draft")], "id int, status string")
    reviewers = spark.createDataFrame([(t, e, "required") for t in (1, 2) for e in "abcd"] + [(1, "o", "optional")], REVIEWERS)
    rows = [
        (1, "a", None, 1, NOW - timedelta(days=4)),
        (1, "b", "approved", 1, NOW - timedelta(days=4)),
        (1, "c", None, 1, NOW - timedelta(days=3)),
        (1, "o", None, 1, NOW - timedelta(days=9)),
        (2, "a", None, 1, NOW - timedelta(days=9)),
    ]
    found = approvals.reminders(templates, reviewers, spark.createDataFrame(rows, APPROVALS), str(NOW))
    assert [tuple(r) for r in found.collect()] == [(1, "a", 4)]


def test_fan_out_expires_after_thirty_days(spark):
    reviewers = spark.createDataFrame([(1, "a", "required"), (1, "b", "optional"), (2, "a", "required")], REVIEWERS)
    submissions = spark.createDataFrame([(1, NOW)], "template_id int, submitted_at timestamp_ntz")
    found = approvals.fan_out(submissions, reviewers).orderBy("reviewer_email").collect()
    assert [(r.reviewer_email, r.action, r.token_used, r.token_expires_at) for r in found] == [
        ("a", None, False, NOW + timedelta(days=30)),
        ("b", None, False, NOW + timedelta(days=30)),
    ]


def test_stored_tables_hold_what_is_asked_for(spark, monkeypatch):
    """States of tokens store no other fields; decisions settled by their token are not joined on."""
    kept = {}

    def record(df, label, folder=None):
        kept[label] = df
        return df

    monkeypatch.setattr(approvals, "materialise", record)
    known = spark.createDataFrame([token("good"), token("spent", used=True)], TOKENS)
    requests = [(i, NOW, name, "approve") for i, name in enumerate(("good", "spent", "missing"))]
    decisions = spark.createDataFrame(requests, REQUESTS)
    approvals.token_state(decisions, known)
    assert not {"template_id", "reviewer_email", "round"} & set(kept["tokens"].columns)
    templates = spark.createDataFrame([(1, "Pending Approval"), (1, "Draft")], "id int, status string")
    reviewers = spark.createDataFrame([(1, "r@x.test", "required")], "template_id int, reviewer_email string, reviewer_type string")
    got = approvals.apply_decisions(decisions, known, templates, reviewers)
    assert sorted((r.decision_id, r.outcome) for r in got.collect()) == [
        (0, "not_pending"), (0, "recorded"), (1, "used"), (1, "used"), (2, "not_found"),
    ]
    assert {r.token for r in kept["placed"].collect()} == {"good"}
