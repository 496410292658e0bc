"""Approval workflow over the registry tables.

Times of evaluation are parameters (`as_of`), never the clock. A review round is the set
of approval rows of one submission, numbered in a `round` column; tables without that
column, like the registry's own, are numbered by their times of creation (`with_rounds`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicegate.model import LEGAL_TRANSITIONS, REMINDER_DAYS, TOKEN_EXPIRY_DAYS
from sluicegate.plans.skew import HOT_ROWS, measured_lookup
from sluicegate.sources.workspace import broadcast_if_small, materialise

# Fixed texts shown to template creators.
PARTLY_APPROVED = "%d of %d required reviewers have approved. Awaiting %d more."
ALL_APPROVED = "All %d required reviewers have approved. The Unity Catalog table will be provisioned shortly."
BACK_TO_DRAFT = "Your template has been moved back to Draft status. You can revise it and submit again."
REJECTED = "Your template was rejected"
APPROVED = "Your template has been approved"
LINK = "%s/api/v1/approvals/%s/%s"
DATE_FORMAT = "MMMM dd, yyyy"


def _moment(df: DataFrame, column: str, as_of: str) -> Column:
    """`as_of` as the type of a timestamp column."""
    return F.lit(as_of).cast(df.schema[column].dataType)


# ---------------------------------------------------------------------------
# Submission
# ---------------------------------------------------------------------------


def readiness(templates: DataFrame, columns: DataFrame, reviewers: DataFrame) -> DataFrame:
    """First reason that keeps a template from being submitted, or `ready`."""
    c = columns.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("_columns"), F.count_if(F.col("is_included")).alias("_included")
    )
    r = reviewers.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("_reviewers"), F.count_if(F.col("reviewer_type") == "required").alias("_required")
    )

    def none(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) == 0

    reason = (
        F.when(F.col("status") != "Draft", "not_draft")
        .when(none("_columns"), "no_columns")
        .when(none("_included"), "no_included_columns")
        .when(none("_reviewers"), "no_reviewers")
        .when(none("_required"), "no_required_reviewers")
        .otherwise("ready")
    )
    return (
        templates.select(F.col("id").alias("template_id"), "status")
        .join(c, "template_id", "left")
        .join(r, "template_id", "left")
        .select("template_id", reason.alias("readiness"))
    )


def with_rounds(approvals: DataFrame) -> DataFrame:
    """Approvals with `round`: as it is there, else the rank of `created_at`, which all rows
    of one submission share, among the submissions of the template. Rows without a time, or
    without a template, belong to the first round."""
    if "round" in approvals.columns:
        return approvals
    known = F.col("created_at").isNotNull() & F.col("template_id").isNotNull()
    times = approvals.filter(known).select("template_id", "created_at").distinct()
    number = F.row_number().over(Window.partitionBy("template_id").orderBy("created_at"))
    numbered = approvals.join(times.withColumn("round", number), ["template_id", "created_at"], "left")
    return numbered.select(*approvals.columns, F.coalesce("round", F.lit(1)).alias("round"))


def fan_out(submissions: DataFrame, reviewers: DataFrame) -> DataFrame:
    """One pending approval row per reviewer of each submitted template (template_id,
    submitted_at). Tokens are secrets and issued elsewhere. Names are copied if there are any."""
    return submissions.join(reviewers, "template_id").select(
        "template_id",
        "reviewer_email",
        *[c for c in ("reviewer_name",) if c in reviewers.columns],
        "reviewer_type",
        F.lit(None).cast("string").alias("action"),
        F.lit(False).alias("token_used"),
        F.col("submitted_at").alias("created_at"),
        (F.col("submitted_at") + F.expr(f"INTERVAL {TOKEN_EXPIRY_DAYS} DAYS")).alias("token_expires_at"),
    )


# ---------------------------------------------------------------------------
# Tokens and decisions
# ---------------------------------------------------------------------------


def _with_token(
    requests: DataFrame,
    approvals: DataFrame,
    request_id: str,
    as_of: str | None,
    hot_rows: int,
    fields: tuple[str, ...] = (),
) -> DataFrame:
    """Requests with `fields` of their approval row and the state of the token. Tokens are
    unique in `approvals`; one token may be used by any number of requests."""
    known = approvals.select(
        F.col("approval_token").alias("token"),
        *fields,
        F.col("token_used").alias("_used"),
        F.col("token_expires_at").alias("_expires"),
        F.lit(True).alias("_known"),
    )
    asked = F.col("decided_at") if as_of is None else _moment(approvals, "token_expires_at", as_of)
    state = (
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.col("_used"), "used")
        .when(F.col("_expires") < asked, "expired")
        .otherwise("valid")
    )
    known = materialise(known.filter(F.col("token").isNotNull()), "tokens")
    return (
        measured_lookup(requests, known, ["token"], request_id, "left", hot_rows)
        .withColumn("token_state", state)
        .drop("_known", "_used", "_expires")
    )


def token_state(
    requests: DataFrame,
    approvals: DataFrame,
    as_of: str | None = None,
    request_id: str = "decision_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """State of each request's token: not_found, used, expired or valid, in that order of
    precedence. Without `as_of` a request is judged at its own `decided_at`."""
    return _with_token(requests, approvals, request_id, as_of, hot_rows).select(*requests.columns, "token_state")


def apply_decisions(
    decisions: DataFrame,
    approvals: DataFrame,
    templates: DataFrame,
    reviewers: DataFrame,
    as_of: str | None = None,
    strict_reference: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Outcome per decision (decision_id, decided_at, token, decision), as if they were
    handled one after the other: recorded, not_found, used, expired or not_pending.

    A token is consumed by the first decision recorded with it. A token of an earlier round
    than the template's latest records nothing (`old_round`). A template stops taking
    decisions at the first rejection by a required reviewer, or once every required
    reviewer has approved in the latest round. With `strict_reference` any reviewer's
    rejection counts, tokens of all rounds are taken, and approval rows of required
    reviewers are counted over all rounds.
    The new status of the template as of the decision is returned for recorded ones.
    Starts jobs.
    """
    approvals = with_rounds(approvals)
    newest = approvals.groupBy("template_id").agg(F.max("round").alias("_newest"))
    # Both are read several times below.
    fields = ("template_id", "reviewer_email", "round")
    asked = materialise(_with_token(decisions, approvals, "decision_id", as_of, hot_rows, fields), "decisions")
    states = templates.select(F.col("id").alias("template_id"), F.col("status").alias("_status")).join(
        newest, "template_id", "left"
    )
    is_pending = F.coalesce(F.col("_status") == "Pending Approval", F.lit(False))
    of_template = Window.partitionBy("template_id")
    states = materialise(
        states.withColumns({"_open": F.max(is_pending).over(of_template), "_copies": F.count(F.lit(1)).over(of_template)}),
        "states",
    )
    at = F.struct("decided_at", "decision_id")
    # An unknown or used token says all by itself, and other decisions on templates that are
    # not pending need the status only. The rest, far fewer rows, are joined again below.
    by_token = F.col("token_state").isin("not_found", "used")
    placed = materialise(
        measured_lookup(asked.filter(~by_token), states, ["template_id"], "decision_id", "left", hot_rows), "placed"
    )
    open_rows = placed.filter(F.col("_open"))
    valid = open_rows.filter((F.col("token_state") == "valid") & is_pending)
    open_requests = valid if strict_reference else valid.filter(F.col("round") == F.col("_newest"))
    # First use of each token; a token belongs to one reviewer of one template.
    first_uses = materialise(
        open_requests.groupBy("token").agg(
            F.min(at).alias("at"),
            F.min_by("decision", at).alias("decision"),
            F.first("template_id").alias("template_id"),
            F.first("reviewer_email").alias("reviewer_email"),
        ),
        "first_uses",
    )
    required = reviewers.filter(F.col("reviewer_type") == "required").select("template_id", "reviewer_email")
    by_required = first_uses.join(
        required.withColumn("_required", F.lit(True)), ["template_id", "reviewer_email"], "left"
    )
    resets = F.lit(True) if strict_reference else F.coalesce(F.col("_required"), F.lit(False))
    rejected = (
        by_required.filter((F.col("decision") == "reject") & resets)
        .groupBy("template_id")
        .agg(F.min("at").alias("rejected_at"))
    )
    moment = _completion_by_rows if strict_reference else _completion_moment
    completed = moment(by_required, required, approvals)
    closed = (
        rejected.join(completed, "template_id", "full")
        .select("template_id", F.least("rejected_at", "completed_at").alias("closed_at"), "rejected_at", "completed_at")
    )
    uses = first_uses.select("token", F.col("at").alias("first_at"))
    judged = measured_lookup(open_rows, uses, ["token"], "decision_id", "left", hot_rows)
    judged = measured_lookup(judged, materialise(closed, "closed"), ["template_id"], "decision_id", "left", hot_rows)
    others = placed.filter(~F.coalesce("_open", F.lit(False)))
    # A decision comes once for each row of its template, should that be there repeatedly.
    repeated = states.filter("_copies > 1").select("template_id", F.col("_copies").cast("int")).distinct()
    used = measured_lookup(
        asked.filter(by_token), materialise(repeated, "repeated"), ["template_id"], "decision_id", "left", hot_rows
    ).withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.coalesce("_copies", F.lit(1)))))
    for settled in (others, used):
        judged = judged.unionByName(settled, allowMissingColumns=True)
    in_time = F.col("closed_at").isNull() | (at <= F.col("closed_at"))
    token_taken = (at > F.col("first_at")) & (F.col("closed_at").isNull() | (F.col("first_at") <= F.col("closed_at")))
    outcome = (
        F.when(F.col("token_state").isin("not_found", "used"), F.col("token_state"))
        .when(token_taken, "used")
        .when(F.col("token_state") == "expired", "expired")
        .when(F.col("_status").isNull() | (F.col("_status") != "Pending Approval"), "not_pending")
        .when(in_time & (F.col("round") < F.col("_newest")) & F.lit(not strict_reference), "old_round")
        .when(in_time, "recorded")
        .otherwise("not_pending")
    )
    recorded = F.col("outcome") == "recorded"
    return (
        judged.withColumn("outcome", outcome)
        .select(
            *decisions.columns,
            "template_id",
            "reviewer_email",
            "outcome",
            F.when(recorded, F.when(F.col("decision") == "approve", "approved").otherwise("rejected")).alias("action"),
            F.when(
                recorded,
                F.when(at == F.col("rejected_at"), "Draft")
                .when(at == F.col("completed_at"), "Pending DDL")
                .otherwise("Pending Approval"),
            ).alias("template_status"),
        )
    )


def _completion_by_rows(by_required: DataFrame, required: DataFrame, approvals: DataFrame) -> DataFrame:
    """(template_id, completed_at) when approval rows of required reviewers are counted, of
    any round: the first approval, by anyone, at which there are as many as required
    reviewers."""
    needed = required.groupBy("template_id").agg(F.count(F.lit(1)).alias("needed"))
    earlier = (
        approvals.filter(F.col("action") == "approved")
        .join(required, ["template_id", "reviewer_email"], "left_semi")
        .groupBy("template_id")
        .agg(F.count(F.lit(1)).alias("earlier"))
    )
    until_now = Window.partitionBy("template_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    arriving = by_required.filter(F.col("decision") == "approve").withColumn(
        "_now", F.sum(F.when(F.col("_required"), 1).otherwise(0)).over(until_now)
    )
    return (
        arriving.join(needed, "template_id")
        .join(earlier, "template_id", "left")
        .filter(F.coalesce("earlier", F.lit(0)) + F.col("_now") >= F.col("needed"))
        .groupBy("template_id")
        .agg(F.min("at").alias("completed_at"))
    )


def _completion_moment(by_required: DataFrame, required: DataFrame, approvals: DataFrame) -> DataFrame:
    """(template_id, completed_at): when the last missing required approval comes in. Where
    none was missing before this batch, the first approval by a required reviewer completes."""
    concerned = by_required.select("template_id").distinct()
    earlier = (
        latest_round(approvals.join(concerned, "template_id", "left_semi"))
        .filter(F.col("approved"))
        .select("template_id", "reviewer_email", F.lit(True).alias("_earlier"))
    )
    now = (
        by_required.filter((F.col("decision") == "approve") & F.col("_required"))
        .groupBy("template_id", "reviewer_email")
        .agg(F.min("at").alias("at"))
    )
    asked_now = now.select("template_id").distinct()
    return (
        required.join(asked_now, "template_id", "left_semi")
        .join(earlier, ["template_id", "reviewer_email"], "left")
        .join(now, ["template_id", "reviewer_email"], "left")
        .groupBy("template_id")
        .agg(
            F.count_if(F.col("_earlier").isNull()).alias("missing"),
            F.count_if(F.col("_earlier").isNull() & F.col("at").isNotNull()).alias("arriving"),
            F.max(F.when(F.col("_earlier").isNull(), F.col("at"))).alias("_last_missing"),
            F.min("at").alias("_first"),
        )
        .filter(F.col("missing") == F.col("arriving"))
        .withColumn("completed_at", F.when(F.col("missing") > 0, F.col("_last_missing")).otherwise(F.col("_first")))
        .select("template_id", "completed_at")
    )


# ---------------------------------------------------------------------------
# Completion and progress
# ---------------------------------------------------------------------------


def latest_round(approvals: DataFrame) -> DataFrame:
    """One row per reviewer in the latest round of each template: (template_id,
    reviewer_email, round, approved, acted, requested_at). Approval rows are combined per
    reviewer before anything is joined."""
    approvals = with_rounds(approvals)
    per_reviewer = approvals.groupBy("template_id", "round", "reviewer_email").agg(
        F.max(F.coalesce(F.col("action") == "approved", F.lit(False))).alias("approved"),
        F.max(F.col("action").isNotNull()).alias("acted"),
        F.min("created_at").alias("requested_at"),
    )
    # The newest round of a template from the combined rows: approvals are read once.
    newest = F.max("round").over(Window.partitionBy("template_id"))
    found = per_reviewer.withColumn("_newest", newest).filter(F.col("round") == F.col("_newest"))
    return found.select("template_id", "round", "reviewer_email", "approved", "acted", "requested_at")


def required_approvals(reviewers: DataFrame, approvals: DataFrame, row_counting: bool = False) -> DataFrame:
    """(template_id, required, approved) for templates with required reviewers.

    Distinct reviewers of the latest round count. With `row_counting` every approval row
    of any round does, so one person can stand in for another.
    """
    required = reviewers.filter(F.col("reviewer_type") == "required").select("template_id", "reviewer_email")
    if row_counting:
        given = (
            approvals.filter(F.col("action") == "approved")
            .groupBy("template_id", "reviewer_email")
            .agg(F.count(F.lit(1)).alias("_given"))
        )
    else:
        given = (
            latest_round(approvals)
            .filter(F.col("approved"))
            .select("template_id", "reviewer_email", F.lit(1).cast("bigint").alias("_given"))
        )
    return (
        required.join(given, ["template_id", "reviewer_email"], "left")
        .groupBy("template_id")
        .agg(
            F.count(F.lit(1)).alias("required"),
            F.coalesce(F.sum("_given"), F.lit(0).cast("bigint")).alias("approved"),
        )
    )


def fully_approved(
    reviewers: DataFrame, approvals: DataFrame, row_counting: bool = False, templates: DataFrame | None = None
) -> DataFrame:
    """(template_id, required, approved, fully_approved). With `templates` there is a row
    for each of them; without required reviewers a template is not fully approved."""
    counts = required_approvals(reviewers, approvals, row_counting)
    if templates is not None:
        counts = templates.select(F.col("id").alias("template_id")).join(counts, "template_id", "left")
        counts = counts.fillna(0, ["required", "approved"])
    enough = (F.col("required") > 0) & (F.col("approved") >= F.col("required"))
    return counts.withColumn("fully_approved", enough)


def applied_tables(
    outcomes: DataFrame, approvals: DataFrame, templates: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Approvals and templates after the recorded `outcomes` of `apply_decisions`: action,
    comment, token_used and actioned_at of the tokens used; status and, where they carry
    it, approved_at of the templates decided."""
    recorded = outcomes.filter(F.col("outcome") == "recorded")
    used = recorded.select(
        F.col("token").alias("approval_token"),
        F.col("action").alias("_action"),
        F.col("decided_at").alias("_at"),
        (F.col("comment") if "comment" in outcomes.columns else F.lit(None).cast("string")).alias("_comment"),
    )
    now = {
        "action": F.coalesce("_action", "action"),
        "token_used": F.col("_action").isNotNull() | F.col("token_used"),
        "actioned_at": F.coalesce("_at", "actioned_at"),
        "comment": F.coalesce("_comment", "comment") if "comment" in approvals.columns else F.col("_comment"),
    }
    after = approvals.join(used, "approval_token", "left").select(
        *[now[c].alias(c) if c in now else F.col(c) for c in approvals.columns]
    )
    decided = (
        recorded.filter(F.col("template_status") != "Pending Approval")
        .groupBy("template_id")
        .agg(F.max_by(F.struct("template_status", "decided_at"), F.struct("decided_at", "decision_id")).alias("_d"))
        .select(F.col("template_id").alias("id"), "_d")
    )
    fields = {"status": F.coalesce("_d.template_status", "status")}
    if "approved_at" in templates.columns:
        done = F.col("_d.template_status") == "Pending DDL"
        fields["approved_at"] = F.when(done, F.col("_d.decided_at")).otherwise(F.col("approved_at"))
    changed = templates.join(decided, "id", "left")
    return after, changed.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in templates.columns])


def submitted_templates(templates: DataFrame, submissions: DataFrame) -> DataFrame:
    """Templates after submission: Drafts that were submitted (template_id) are pending."""
    asked = submissions.select(F.col("template_id").alias("id"), F.lit(True).alias("_asked")).distinct()
    status = F.when(F.col("_asked") & (F.col("status") == "Draft"), "Pending Approval").otherwise(F.col("status"))
    return templates.join(asked, "id", "left").select(
        *[status.alias(c) if c == "status" else F.col(c) for c in templates.columns]
    )


def progress_messages(reviewers: DataFrame, approvals: DataFrame, decision: str = "approve") -> DataFrame:
    """(template_id, message): what the creator is told after a decision."""
    counts = required_approvals(reviewers, approvals)
    if decision == "reject":
        return counts.select("template_id", F.lit(BACK_TO_DRAFT).alias("message"))
    missing = F.col("required") - F.col("approved")
    message = F.when(missing <= 0, F.format_string(ALL_APPROVED, "required")).otherwise(
        F.format_string(PARTLY_APPROVED, F.col("approved"), F.col("required"), missing)
    )
    return counts.select("template_id", message.alias("message"))


def messages_after(outcomes: DataFrame, reviewers: DataFrame, approvals: DataFrame) -> DataFrame:
    """(decision_id, message): what the creator is told after each recorded approval, with
    the required reviewers counted who had approved in the latest round by then."""
    counts = required_approvals(reviewers, approvals)
    required = reviewers.filter(F.col("reviewer_type") == "required").select(
        "template_id", "reviewer_email", F.lit(True).alias("_required")
    )
    earlier = latest_round(approvals).filter("approved").select(
        "template_id", "reviewer_email", F.lit(True).alias("_earlier")
    )
    given = (
        outcomes.filter((F.col("outcome") == "recorded") & (F.col("decision") == "approve"))
        .join(required, ["template_id", "reviewer_email"], "left")
        .join(earlier, ["template_id", "reviewer_email"], "left")
    )
    order = ("decided_at", "decision_id")
    first = F.row_number().over(Window.partitionBy("template_id", "reviewer_email").orderBy(*order)) == 1
    new = F.when(F.col("_required") & F.col("_earlier").isNull() & F.col("_first"), 1).otherwise(0)
    so_far = F.sum(new).over(
        Window.partitionBy("template_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = given.withColumn("_first", first).withColumn("_new", so_far).join(counts, "template_id")
    approved = F.col("approved") + F.col("_new")
    missing = F.col("required") - approved
    message = F.when(missing <= 0, F.format_string(ALL_APPROVED, "required")).otherwise(
        F.format_string(PARTLY_APPROVED, approved, F.col("required"), missing)
    )
    return counted.select("decision_id", message.alias("message"))


# ---------------------------------------------------------------------------
# Lifecycle
# ---------------------------------------------------------------------------

INITIAL_STATUS = "Draft"


def replay_status(events: DataFrame) -> DataFrame:
    """(template_id, status, changed_at, n_events): the last status of each template."""
    moment = F.struct("ts", "event_id")
    return events.groupBy("template_id").agg(
        F.max_by("to_status", moment).alias("status"),
        F.max("ts").alias("changed_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def with_previous_status(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Add `from_status`, the status before each event (`Draft` before the first).

    Events are sorted by template and time and cut into pieces of about equal size, by
    default as many as shuffles have partitions, so that neither a template nor a moment with very many events is one
    task. Inside a piece an event follows the one before it; what a template's earlier
    pieces come to is their last status, carried in a table with a row for each template
    in a piece. Starts a job.
    """
    spark = events.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["template_id", "ts", "event_id"]
    cut = materialise(
        events.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()), "status_pieces"
    )
    inside = Window.partitionBy("template_id", "_piece").orderBy("ts", "event_id")
    ends = cut.groupBy("template_id", "_piece").agg(F.max_by("to_status", F.struct("ts", "event_id")).alias("_last"))
    before = materialise(
        ends.select(
            "template_id",
            "_piece",
            F.lag("_last").over(Window.partitionBy("template_id").orderBy("_piece")).alias("_carried"),
        ).filter(F.col("_carried").isNotNull()),
        "carried_status",
    )
    return (
        cut.withColumn("_prior", F.lag("to_status").over(inside))
        .join(broadcast_if_small(before), ["template_id", "_piece"], "left")
        .withColumn("from_status", F.coalesce("_prior", "_carried", F.lit(INITIAL_STATUS)))
        .select(*events.columns, "from_status")
    )


def is_legal(from_status: Column, to_status: Column) -> Column:
    pairs = [F.concat(F.lit(a), F.lit(">"), F.lit(b)) for a, b in LEGAL_TRANSITIONS]
    return F.concat(from_status, F.lit(">"), to_status).isin(*pairs)


def invalid_transitions(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Events whose change of status the lifecycle does not allow."""
    return with_previous_status(events, pieces).filter(~is_legal(F.col("from_status"), F.col("to_status")))


# ---------------------------------------------------------------------------
# Lists for people
# ---------------------------------------------------------------------------


def reminders(
    templates: DataFrame, reviewers: DataFrame, approvals: DataFrame, as_of: str, days: int = REMINDER_DAYS
) -> DataFrame:
    """Required reviewers who have not acted in the current round of a template that has
    been Pending Approval for more than `days` days: (template_id, reviewer_email,
    days_pending)."""
    now = _moment(approvals, "created_at", as_of)
    pending = templates.filter(F.col("status") == "Pending Approval").select(F.col("id").alias("template_id"))
    required = reviewers.filter(F.col("reviewer_type") == "required").select("template_id", "reviewer_email")
    return (
        latest_round(approvals)
        .filter(~F.col("acted") & (F.col("requested_at") < now - F.expr(f"INTERVAL {days} DAYS")))
        .join(pending, "template_id", "left_semi")
        .join(required, ["template_id", "reviewer_email"], "left_semi")
        .select("template_id", "reviewer_email", F.datediff(now, "requested_at").alias("days_pending"))
    )


def inbox(approvals: DataFrame, templates: DataFrame, as_of: str, reviewer_email: str | None = None) -> DataFrame:
    """Open requests with a live token on templates that are Pending Approval."""
    live = approvals.filter(
        F.col("action").isNull() & ~F.col("token_used")
        & (F.col("token_expires_at") >= _moment(approvals, "token_expires_at", as_of))
    )
    if reviewer_email is not None:
        live = live.filter(F.lower("reviewer_email") == reviewer_email.lower())
    pending = templates.filter(F.col("status") == "Pending Approval").select(
        F.col("id").alias("template_id"), "display_name"
    )
    return live.join(pending, "template_id").select(
        "reviewer_email", "template_id", "display_name", "approval_token", "token_expires_at"
    )


def audit_trail(approvals: DataFrame, templates: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Who decided what and when, per template. Sort what you show: the trail as a whole
    is not ordered."""
    names = templates.select(F.col("id").alias("template_id"), F.col("name").alias("template_name"))
    types = reviewers.select("template_id", "reviewer_email", "reviewer_type")
    details = [c for c in ("round", "comment") if c in approvals.columns]
    return (
        approvals.filter(F.col("action").isNotNull())
        .join(names, "template_id")
        .join(types, ["template_id", "reviewer_email"], "left")
        .select("template_id", "template_name", "reviewer_email", "reviewer_type", "action", "actioned_at", *details)
    )


def approval_requests(
    approvals: DataFrame, templates: DataFrame, domains: DataFrame, reviewers: DataFrame, base_url: str
) -> DataFrame:
    """Message data for every open approval request. A missing reviewer name falls back to
    the address, a missing type to `required`. `reviewers` may carry reviewer_name."""
    t = templates.select(
        F.col("id").alias("template_id"),
        F.col("display_name").alias("template_display_name"),
        F.coalesce("description", F.lit("")).alias("template_description"),
        "fully_qualified_name",
        "domain_id",
        F.col("created_by").alias("creator_email"),
    )
    d = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    r = reviewers.select(
        "template_id",
        "reviewer_email",
        "reviewer_type",
        (F.col("reviewer_name") if "reviewer_name" in reviewers.columns else F.lit(None).cast("string")).alias("_name"),
    )

    def link(verb: str) -> Column:
        return F.format_string(LINK, F.lit(base_url), "approval_token", F.lit(verb))

    return (
        approvals.filter(F.col("action").isNull())
        .join(t, "template_id")
        .join(d, "domain_id")
        .join(r, ["template_id", "reviewer_email"], "left")
        .select(
            "template_id",
            "reviewer_email",
            F.coalesce("_name", "reviewer_email").alias("reviewer_name"),
            F.coalesce("reviewer_type", F.lit("required")).alias("reviewer_type"),
            "creator_email",
            "template_display_name",
            "template_description",
            "fully_qualified_name",
            "domain_name",
            link("approve").alias("approve_url"),
            link("reject").alias("reject_url"),
            F.date_format("token_expires_at", DATE_FORMAT).alias("expires_on"),
        )
    )


def decision_notices(
    outcomes: DataFrame, templates: DataFrame, domains: DataFrame, messages: DataFrame
) -> DataFrame:
    """Message data for the creator after each recorded decision of `apply_decisions`, with
    the `messages` of `messages_after` (by decision) or `progress_messages` (by template)."""
    t = templates.select(
        F.col("id").alias("template_id"),
        F.col("display_name").alias("template_display_name"),
        "fully_qualified_name",
        "domain_id",
        F.col("created_by").alias("creator_email"),
    )
    d = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    rejected = F.col("decision") == "reject"
    return (
        outcomes.filter(F.col("outcome") == "recorded")
        .join(t, "template_id")
        .join(d, "domain_id")
        .join(messages, "decision_id" if "decision_id" in messages.columns else "template_id", "left")
        .select(
            "decision_id",
            "template_id",
            "creator_email",
            "reviewer_email",
            "template_display_name",
            "fully_qualified_name",
            "domain_name",
            F.col("action").alias("decision_past_tense"),
            F.when(rejected, REJECTED).otherwise(APPROVED).alias("headline"),
            F.when(rejected, BACK_TO_DRAFT).otherwise(F.col("message")).alias("status_message"),
        )
    )


def activation_failures(failures: DataFrame, templates: DataFrame, domains: DataFrame) -> DataFrame:
    """Message data for creators of templates whose provisioning failed (template_id,
    error_message)."""
    t = templates.select(
        F.col("id").alias("template_id"),
        F.col("display_name").alias("template_display_name"),
        "fully_qualified_name",
        "domain_id",
        F.col("created_by").alias("creator_email"),
    )
    d = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    return (
        failures.join(t, "template_id")
        .join(d, "domain_id")
        .select(
            "template_id",
            "creator_email",
            "template_display_name",
            "domain_name",
            "fully_qualified_name",
            "error_message",
        )
    )
