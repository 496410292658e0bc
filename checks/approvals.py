"""Registered queries of the approval workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import STORED, stored, table, view, with_views
from sluicegate.operators import approvals
from sluicegate.sources.workspace import materialise

AS_OF = "1998-06-01 00:00:00"
BASE_URL = "https://uploads.example.test"


def _views(spark, sf, *names):
    return [stored(spark, sf, n) if n in STORED else view(spark, sf, n) for n in names]


def submission_readiness(spark, sf):
    return approvals.readiness(*_views(spark, sf, "templates", "template_columns", "template_reviewers"))


def fanned_out(spark, sf):
    templates, reviewers = _views(spark, sf, "templates", "template_reviewers")
    submissions = templates.filter("status = 'Draft'").select(
        F.col("id").alias("template_id"), F.col("created_at").alias("submitted_at")
    )
    return approvals.fan_out(submissions, reviewers)


def token_states(spark, sf):
    return approvals.token_state(*_views(spark, sf, "decisions", "token_approvals"), as_of="1995-06-17 00:00:00")


def token_states_at_decision(spark, sf):
    return approvals.token_state(*_views(spark, sf, "decisions", "token_approvals"))


def _applied(spark, sf, strict=False):
    names = ("decisions", "token_approvals", "templates", "template_reviewers")
    return approvals.apply_decisions(*_views(spark, sf, *names), strict_reference=strict)


def all_approved(spark, sf):
    reviewers, rows, templates = _views(spark, sf, "template_reviewers", "template_approvals", "templates")
    return approvals.fully_approved(reviewers, rows, templates=templates)


def all_approved_by_rows(spark, sf):
    return approvals.fully_approved(*_views(spark, sf, "template_reviewers", "template_approvals"), row_counting=True)


def progress(spark, sf):
    return approvals.progress_messages(*_views(spark, sf, "template_reviewers", "template_approvals"))


def due_reminders(spark, sf):
    names = ("templates", "template_reviewers", "template_approvals")
    return approvals.reminders(*_views(spark, sf, *names), as_of=AS_OF)


def reviewer_inbox(spark, sf):
    return approvals.inbox(*_views(spark, sf, "template_approvals", "templates"), as_of=AS_OF)


def audit_trail(spark, sf):
    return approvals.audit_trail(*_views(spark, sf, "template_approvals", "templates", "template_reviewers"))


def _named_reviewers(spark, sf):
    """Names for every reviewer whose supplier number is odd, and no type for some."""
    reviewers = view(spark, sf, "template_reviewers")
    names = table(spark, sf, "supplier").filter("s_suppkey % 2 = 1").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@x.test")).alias("reviewer_email"),
        F.col("s_name").alias("reviewer_name"),
    )
    return reviewers.filter("template_id % 3 <> 0").join(names, "reviewer_email", "left")


def request_messages(spark, sf):
    pending, templates, domains = _views(spark, sf, "template_approvals", "templates", "domains")
    return approvals.approval_requests(pending, templates, domains, _named_reviewers(spark, sf), BASE_URL)


def decision_messages(spark, sf):
    templates, domains, reviewers = _views(spark, sf, "templates", "domains", "template_reviewers")
    outcomes = materialise(_applied(spark, sf), "outcomes")
    messages = approvals.messages_after(outcomes, reviewers, view(spark, sf, "token_approvals"))
    return approvals.decision_notices(outcomes, templates, domains, messages)


def tables_after_decisions(spark, sf):
    """Status and open requests of every template after the decisions were applied."""
    rows, templates = stored(spark, sf, "token_approvals"), view(spark, sf, "templates")
    outcomes = materialise(_applied(spark, sf), "outcomes")
    rows = rows.withColumn("actioned_at", F.lit(None).cast("timestamp_ntz"))
    after, changed = approvals.applied_tables(outcomes, rows, templates)
    counts = after.groupBy(F.col("template_id").alias("id")).agg(
        F.count_if("token_used").alias("used"), F.count_if(F.col("action") == "approved").alias("approved_rows")
    )
    return changed.join(counts, "id", "left").select(F.col("id").alias("template_id"), "status", "used", "approved_rows")


def failure_messages(spark, sf):
    templates, domains = _views(spark, sf, "templates", "domains")
    failures = templates.filter("status = 'DDL Failed'").select(
        F.col("id").alias("template_id"), F.concat(F.lit("run failed for "), F.col("name")).alias("error_message")
    )
    return approvals.activation_failures(failures, templates, domains)


_LATEST = """
latest as (select template_id, reviewer_email, bool_or(coalesce(action = 'approved', false)) as approved,
    bool_or(action is not null) as acted, min(created_at) as requested_at
  from template_approvals as a
  where round = (select max(round) from template_approvals as b where b.template_id = a.template_id)
  group by template_id, reviewer_email)"""
_REQUIRED = """
required as (select r.template_id, count(*) as required, count(*) filter (where approved) as approved
  from template_reviewers as r left join latest as l
    on l.template_id = r.template_id and l.reviewer_email = r.reviewer_email
  where reviewer_type = 'required' group by r.template_id)"""
_STATES = """
states as (select d.*, a.template_id, a.reviewer_email, a.round,
    case when a.approval_token is null then 'not_found' when token_used then 'used'
      when token_expires_at < {clock} then 'expired' else 'valid' end as token_state
  from decisions as d left join token_approvals as a on a.approval_token = d.token)"""

# Positions stand for (decided_at, decision_id). The decision that closes a template is
# the earliest of the first rejection that counts and the approval that completes it.
_APPLIED = (
    ","
    + _STATES.replace("{clock}", "decided_at")
    + ","
    + _LATEST
    + """,
seq as (select *, row_number() over (order by decided_at, decision_id) as pos from states),
open as (select s.* from seq as s join templates as t on t.id = s.template_id
  where token_state = 'valid' and status = 'Pending Approval'
    and round = (select max(round) from template_approvals as b where b.template_id = s.template_id)),
firsts as (select * from (select *, row_number() over (partition by token order by pos) as rn from open) as o
  where rn = 1),
req as (select template_id, reviewer_email from template_reviewers where reviewer_type = 'required'),
rejections as (select f.template_id, min(pos) as rejected_pos from firsts as f
  join req on req.template_id = f.template_id and req.reviewer_email = f.reviewer_email
  where decision = 'reject' group by f.template_id),
missing as (select req.* from req left join latest as l
    on l.template_id = req.template_id and l.reviewer_email = req.reviewer_email where not coalesce(l.approved, false)),
arrivals as (select m.template_id, m.reviewer_email, min(pos) as pos from missing as m left join firsts as f
    on f.template_id = m.template_id and f.reviewer_email = m.reviewer_email and decision = 'approve'
  group by m.template_id, m.reviewer_email),
completions as (select template_id, max(pos) as completed_pos from arrivals group by template_id
  having count(*) = count(pos)
  union all select f.template_id, min(pos) from firsts as f
  join req on req.template_id = f.template_id and req.reviewer_email = f.reviewer_email
  where decision = 'approve' and f.template_id not in (select template_id from missing) group by f.template_id),
closing as (select t.id as template_id, rejected_pos, completed_pos,
    least(coalesce(rejected_pos, 9e18), coalesce(completed_pos, 9e18)) as closed_pos
  from templates as t left join rejections as r on r.template_id = t.id
  left join completions as c on c.template_id = t.id),
judged as (select s.*, closed_pos, rejected_pos, completed_pos,
    case when s.token_state in ('not_found', 'used') then s.token_state
      when s.pos > f.pos and f.pos <= closed_pos then 'used' when s.token_state = 'expired' then 'expired'
      when coalesce(t.status, '') <> 'Pending Approval' then 'not_pending'
      when s.pos > closed_pos then 'not_pending'
      when s.round < (select max(round) from template_approvals as b where b.template_id = s.template_id) then 'old_round'
      else 'recorded' end as outcome
  from seq as s left join templates as t on t.id = s.template_id left join firsts as f on f.token = s.token
  left join closing as c on c.template_id = s.template_id),
applied as (select decision_id, decided_at, token, decision, template_id, reviewer_email, outcome,
    case when outcome <> 'recorded' then null when decision = 'approve' then 'approved' else 'rejected' end as action,
    case when outcome <> 'recorded' then null when pos = rejected_pos then 'Draft'
      when pos = completed_pos then 'Pending DDL' else 'Pending Approval' end as template_status
  from judged)"""
)
_APPLIED_VIEWS = "decisions token_approvals templates template_reviewers template_approvals"
# The round of the token table decides here, as in the query.
_APPLIED = _APPLIED.replace("from template_approvals", "from token_approvals")
_MESSAGE = """case when approved >= required then 'All ' || required
    || ' required reviewers have approved. The Unity Catalog table will be provisioned shortly.'
  else approved || ' of ' || required || ' required reviewers have approved. Awaiting '
    || (required - approved) || ' more.' end"""
# Counted decision by decision, in their order.
_MESSAGES = """,
reqs as (select template_id, count(*) as required from req group by template_id),
before as (select template_id, count(*) as n from latest natural join req where approved group by template_id),
texts as (select a.decision_id, q.required, coalesce(b.n, 0) + (select count(distinct o.reviewer_email)
    from applied as o join missing as m on m.template_id = o.template_id and m.reviewer_email = o.reviewer_email
    where o.template_id = a.template_id and o.outcome = 'recorded' and o.decision = 'approve'
      and (o.decided_at, o.decision_id) <= (a.decided_at, a.decision_id)) as approved
  from applied as a join reqs as q on q.template_id = a.template_id left join before as b on b.template_id = a.template_id
  where outcome = 'recorded')"""
_BACK = "'Your template has been moved back to Draft status. You can revise it and submit again.'"
_LINEAGE = """
, ordered as (select *, coalesce(lag(to_status) over (partition by template_id order by ts, event_id), 'Draft')
    as from_status from lifecycle_events)"""

QUERIES = {
    "submission_readiness": (
        submission_readiness,
        with_views(
            "templates template_columns template_reviewers",
            """select id as template_id, case when status <> 'Draft' then 'not_draft'
  when id not in (select template_id from template_columns) then 'no_columns'
  when id not in (select template_id from template_columns where is_included) then 'no_included_columns'
  when id not in (select template_id from template_reviewers) then 'no_reviewers'
  when id not in (select template_id from template_reviewers where reviewer_type = 'required')
    then 'no_required_reviewers' else 'ready' end as readiness from templates""",
        ),
    ),
    "approval_fan_out": (
        fanned_out,
        with_views(
            "templates template_reviewers",
            "select template_id, reviewer_email, reviewer_type, cast(null as varchar) as action, false as token_used, "
            "t.created_at, t.created_at + interval 30 day as token_expires_at from template_reviewers "
            "join templates as t on t.id = template_id where status = 'Draft'",
        ),
    ),
    "token_states": (
        token_states,
        with_views(
            "decisions token_approvals",
            ", " + _STATES.replace("{clock}", "timestamp '1995-06-17 00:00:00'")
            + " select decision_id, decided_at, token, decision, token_state from states",
        ),
    ),
    "token_states_at_decision": (
        token_states_at_decision,
        with_views(
            "decisions token_approvals",
            ", " + _STATES.replace("{clock}", "decided_at")
            + " select decision_id, decided_at, token, decision, token_state from states",
        ),
    ),
    "applied_decisions": (_applied, with_views(_APPLIED_VIEWS, _APPLIED + " select * from applied")),
    "fully_approved": (
        all_approved,
        with_views(
            "template_reviewers template_approvals templates",
            f",{_LATEST},{_REQUIRED} select id as template_id, coalesce(required, 0) as required, coalesce(approved, 0) "
            "as approved, coalesce(approved >= required, false) as fully_approved from templates "
            "left join required on template_id = id",
        ),
    ),
    "fully_approved_by_rows": (
        all_approved_by_rows,
        with_views(
            "template_reviewers template_approvals",
            """select *, approved >= required as fully_approved from (
  select r.template_id, count(distinct r.reviewer_email) as required, count(a.reviewer_email) as approved
  from template_reviewers as r left join template_approvals as a
    on a.template_id = r.template_id and a.reviewer_email = r.reviewer_email and a.action = 'approved'
  where reviewer_type = 'required' group by r.template_id) as x""",
        ),
    ),
    "approval_progress": (
        progress,
        with_views(
            "template_reviewers template_approvals",
            f",{_LATEST},{_REQUIRED} select template_id, {_MESSAGE} as message from required",
        ),
    ),
    "lifecycle_status": (
        lambda s, d: approvals.replay_status(view(s, d, "lifecycle_events")),
        with_views(
            "lifecycle_events",
            "select template_id, to_status as status, ts as changed_at, n_events from (select *, row_number() over "
            "(partition by template_id order by ts desc, event_id desc) as rn, count(*) over (partition by template_id) "
            "as n_events from lifecycle_events) as x where rn = 1",
        ),
    ),
    "invalid_transitions": (
        lambda s, d: approvals.invalid_transitions(view(s, d, "lifecycle_events")),
        with_views(
            "lifecycle_events",
            _LINEAGE
            + """ select * from ordered where (from_status, to_status) not in (('Draft', 'Pending Approval'),
  ('Pending Approval', 'Pending DDL'), ('Pending Approval', 'Draft'), ('Pending DDL', 'Approved'),
  ('Pending DDL', 'DDL Failed'), ('Approved', 'Deprecated'))""",
        ),
    ),
    "reminders": (
        due_reminders,
        with_views(
            "templates template_reviewers template_approvals",
            f""",{_LATEST}
select l.template_id, l.reviewer_email,
  cast(date_diff('day', cast(requested_at as date), date '1998-06-01') as int) as days_pending
from latest as l join templates as t on t.id = l.template_id and status = 'Pending Approval'
join template_reviewers as r on r.template_id = l.template_id and r.reviewer_email = l.reviewer_email
  and reviewer_type = 'required'
where not acted and requested_at < timestamp '{AS_OF}' - interval 3 day""",
        ),
    ),
    "reviewer_inbox": (
        reviewer_inbox,
        with_views(
            "template_approvals templates",
            f"""select reviewer_email, template_id, display_name, approval_token, token_expires_at
from template_approvals join templates as t on t.id = template_id
where action is null and not token_used and token_expires_at >= timestamp '{AS_OF}' and status = 'Pending Approval'""",
        ),
    ),
    "approval_audit_trail": (
        audit_trail,
        with_views(
            "template_approvals templates template_reviewers",
            """select a.template_id, t.name as template_name, a.reviewer_email, reviewer_type, action, actioned_at, round
from template_approvals as a join templates as t on t.id = a.template_id left join template_reviewers as r
  on r.template_id = a.template_id and r.reviewer_email = a.reviewer_email where action is not null""",
        ),
    ),
    "approval_requests": (
        request_messages,
        with_views(
            "template_approvals templates domains template_reviewers",
            f"""select a.template_id, a.reviewer_email, coalesce(s_name, a.reviewer_email) as reviewer_name,
  coalesce(reviewer_type, 'required') as reviewer_type, created_by as creator_email,
  display_name as template_display_name, coalesce(t.description, '') as template_description, fully_qualified_name,
  d.name as domain_name, '{BASE_URL}/api/v1/approvals/' || approval_token || '/approve' as approve_url,
  '{BASE_URL}/api/v1/approvals/' || approval_token || '/reject' as reject_url,
  strftime(token_expires_at, '%B %d, %Y') as expires_on
from template_approvals as a join templates as t on t.id = a.template_id join domains as d on d.id = t.domain_id
left join template_reviewers as r
  on r.template_id = a.template_id and r.reviewer_email = a.reviewer_email and r.template_id % 3 <> 0
left join supplier on 's' || s_suppkey || '@x.test' = r.reviewer_email and s_suppkey % 2 = 1
where action is null""",
        ),
    ),
    "decision_notices": (
        decision_messages,
        with_views(
            _APPLIED_VIEWS + " domains",
            _APPLIED
            + _MESSAGES
            + f""" select a.decision_id, a.template_id, created_by as creator_email, reviewer_email,
  display_name as template_display_name, fully_qualified_name, d.name as domain_name, action as decision_past_tense,
  case decision when 'reject' then 'Your template was rejected' else 'Your template has been approved' end as headline,
  case decision when 'reject' then {_BACK} else {_MESSAGE} end as status_message
from applied as a join templates as t on t.id = a.template_id join domains as d on d.id = t.domain_id
left join texts as q on q.decision_id = a.decision_id where outcome = 'recorded'""",
        ),
    ),
    "tables_after_decisions": (
        tables_after_decisions,
        with_views(
            _APPLIED_VIEWS,
            _APPLIED
            + """,
last as (select template_id, arg_max(template_status, (decided_at, decision_id)) as status from applied
  where outcome = 'recorded' and template_status <> 'Pending Approval' group by template_id),
now as (select a.template_id, a.approval_token, a.token_used or max(o.token) is not null as used,
    coalesce(max(o.action), a.action) as action from token_approvals as a
  left join applied as o on o.token = a.approval_token and o.outcome = 'recorded'
  group by a.template_id, a.approval_token, a.token_used, a.action)
select t.id as template_id, coalesce(l.status, t.status) as status, count(*) filter (n.used) as used,
  count(*) filter (n.action = 'approved') as approved_rows from templates as t left join last as l on l.template_id = t.id
left join now as n on n.template_id = t.id group by t.id, l.status, t.status""",
        ),
    ),
    "activation_failures": (
        failure_messages,
        with_views(
            "templates domains",
            "select t.id as template_id, created_by as creator_email, display_name as template_display_name, "
            "d.name as domain_name, fully_qualified_name, 'run failed for ' || t.name as error_message "
            "from templates as t join domains as d on d.id = t.domain_id where status = 'DDL Failed'",
        ),
    ),
}
