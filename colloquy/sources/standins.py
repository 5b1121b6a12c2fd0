"""Business tables derived from the given tables.

The given tables hold no meeting text and no billing rows, so each business table is a
plain projection or union of them, row for row: a transcript per order, a user per
customer, a webhook per event.  The statements use only SQL that Spark and ANSI engines
share, so a test engine can build the very same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
NAMES = ("Priya", "Jordan", "Alex", "Morgan")


def _name(shift: int) -> str:
    arms = " ".join(f"when {i} then '{n}'" for i, n in enumerate(NAMES[:3]))
    return f"case (o_orderkey + {shift}) % 4 {arms} else '{NAMES[3]}' end"


_SLOTS = {
    "A": _name(0),
    "B": _name(1),
    "C": _name(2),
    "n": "cast(o_orderkey as varchar(20))",
    "m7": "cast(2 + o_orderkey % 7 as varchar(20))",
    "m20": "cast(o_orderkey % 20 as varchar(20))",
    "m30": "cast(o_orderkey % 30 as varchar(20))",
    "m50": "cast(o_orderkey % 50 as varchar(20))",
    "dd": "cast(10 + o_orderkey % 18 as varchar(20))",
}


def _template(text: str) -> str:
    """``'{A}: hello {n}.'`` as a SQL concat of literals and slots."""
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        if piece.startswith("{"):
            parts.append(_SLOTS[piece[1:-1]])
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return ", ".join(parts)


def _line(condition: str, text: str) -> str:
    return f"case when {condition} then concat({_template(text)}, {NL}) else '' end"


# (condition, line): every operator branch has hits and misses over the order keys
MEETING_LINES = (
    ("o_orderkey % 3 = 0", "Priya: Section 1: Opening and goals."),
    ("o_orderkey % 2 = 0", "{A}: The purpose of this meeting is to review order {n}."),
    (
        "o_orderkey % 5 = 1",
        "{B}: By the end of the meeting we should leave with a plan for lane {m20}.",
    ),
    ("o_orderkey % 3 = 1", "{A}: We decided to keep lane {m20} for the pilot."),
    (
        "o_orderkey % 4 = 1",
        "{B}: Decision confirmed: Support will use lane {m20}. That keeps the cost low.",
    ),
    (
        "o_orderkey % 7 = 2",
        "{A}: Decision one: Keep the weekly review. Decision two: Limit the pilot to {m7} teams.",
    ),
    ("o_orderkey % 12 = 7", "So the final decision is that we will use the shared inbox for lane {m20}."),
    ("o_orderkey % 3 = 0", "Jordan: Section 2: Delivery plan."),
    ("o_orderkey % 2 = 1", "{A}: I will review the order file {m50} by Friday."),
    ("o_orderkey % 4 = 3", "{A}: I will review the order file {m50} again by Friday."),
    ("o_orderkey % 6 = 1", "{B}: I will review the order file {m50} by Friday."),
    ("o_orderkey % 5 = 2", "{B} will send the pricing sheet {m20} before the launch."),
    ("o_orderkey % 10 = 2", "{B} will send the pricing sheet {m20}, and the summary, before the launch."),
    (
        "o_orderkey % 5 = 3",
        "We need to update the rollout note and share the test report next week.",
    ),
    ("o_orderkey % 8 = 5", "Please schedule the supplier call for lane {m20} tomorrow."),
    ("o_orderkey % 3 = 2", "{A}: The main risk is that batch {m30} may delay delivery."),
    ("o_orderkey % 6 = 2", "{B}: Risk: batch {m30} may delay delivery."),
    (
        "o_orderkey % 9 = 4",
        "{B}: No risk was raised for lane {m20}, and the blocker is resolved.",
    ),
    ("o_orderkey % 10 = 7", "There is a concern that the supplier portal {m20} could miss the compliance check."),
    ("o_orderkey % 3 = 0", "Alex: Section 3: Questions and risks."),
    ("o_orderkey % 4 = 2", "{A}: Should we keep lane {m20}?"),
    ("o_orderkey % 8 = 2", "{B}: We decided to keep lane {m20} open for the pilot teams."),
    ("o_orderkey % 6 = 5", "{B}: Open question: who will own the pricing page {m20}?"),
    ("o_orderkey % 18 = 5", "Open questions: - who signs the supplier note {m20}? * when does lane {m30} ship?"),
    ("o_orderkey % 16 = 9", "{A}: We still need to confirm whether the support page {m20} is final."),
    ("o_orderkey % 21 = 4", "{B}, please verify the export job {m30} by five pm on July twenty first."),
    ("o_orderkey % 22 = 9", "Known blocker: the import job {m30} is waiting on access, so longer files may run into time out {m20}."),
    ("o_orderkey % 20 = 13", "We agreed to publish the weekly digest {m20}. The beta list and the git hub page come later."),
    ("o_orderkey % 6 = 4", "Owners today: Priya for pricing, Jordan for order file and demo script, and Alex for rollout note."),
    ("o_orderkey % 9 = 2", "{A}: I accept the first action. I will upload the signed order file {m50} by Monday."),
    ("o_orderkey % 12 = 5", "Marketing should draft the launch post {m20} this week. One risk is that the post {m20} is not clear."),
    ("o_orderkey % 14 = 3", "The product status is stable, and the landing page {m20} is live for the pilot."),
    (
        "o_orderkey % 5 = 4",
        "{A}: Recap action: Send the pricing sheet {m20}. Owner: {B}. Deadline: Friday.",
    ),
    (
        "o_orderkey % 10 = 4",
        "{A}: Explicit action: Prepare the demo script {m20}. I accept ownership and will complete it.",
    ),
    (
        "o_orderkey % 7 = 3",
        "Action item for {B}: prepare the demo script and send the rollout note by Monday.",
    ),
    (
        "o_orderkey % 11 = 5",
        "Um, you know, we should confirm the schedule at five pm on June eighteenth , okay.",
    ),
    ("o_orderkey % 13 = 6", "{A}: It’s fine — the “pilot” will start on 2026-06-{dd} at noon."),
    ("o_orderkey % 3 > 0", "{C}: Thanks, that was a helpful update for everyone today."),
    ("o_orderkey % 15 = 8", "{C}: [noise] The smoke test | works end to end , and the runtime is basically stable"),
    ("o_orderkey % 6 = 0", "Morgan: Section 4: Closing."),
    ("o_orderkey % 12 = 0", "Priya: Section 5: Next steps and owners."),
    (
        "o_orderkey % 2 = 0",
        "{B}: Let me summarize the final action items. {A} will finalize the pilot plan {m20} by Monday. The next step is to publish the notes {m50}.",
    ),
)

NARRATIVE_LINES = (
    "He said the old gentleman went to the river {m20} and looked at the autumn sky.",
    "She replied that the story of the chair was found in a narrative long ago.",
    "Holmes remarked that the house was quiet, and the visitor asked for tea.",
)

_MEETING_TEXT = "concat(" + ", ".join(_line(c, t) for c, t in MEETING_LINES) + ")"
_NARRATIVE_TEXT = "concat(" + ", ".join(_line("1 = 1", t) for t in NARRATIVE_LINES) + ")"

TRANSCRIPTS = f"""
select o_orderkey as doc_id, o_custkey as user_id, o_orderdate as created_at,
  cast(60 * (o_orderkey % 400) as double) as duration_seconds,
  case when o_orderkey % 101 = 100 then null
       when o_orderkey % 97 = 96 then ''
       when o_orderkey % 103 = 102 then 'Okay'
       when o_orderkey % 17 = 7 then {_NARRATIVE_TEXT}
       else {_MEETING_TEXT} end as text
from {{orders}}
"""

USERS = """
select c_custkey as id,
  case when c_custkey % 5 = 0 then concat(' User', cast(c_custkey as varchar(20)), '@Example.com')
       else concat('user', cast(c_custkey as varchar(20)), '@example.com') end as email,
  c_name as first_name, c_mktsegment as organization_name
from {customer}
"""

MEETINGS = """
select o_orderkey as id, concat('Order review ', cast(o_orderkey % 500 as varchar(20)), ' ', o_orderpriority) as title,
  case when o_custkey % 37 = 0 then null else o_custkey end as user_id,
  case when o_orderkey % 89 = 0 then null
       when o_orderstatus = 'F' and o_orderkey % 5 = 0 then ' Completed '
       when o_orderstatus = 'F' then 'DONE'
       when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'queued'
       when o_orderstatus = 'O' and o_orderkey % 3 = 1 then 'transcribing'
       when o_orderstatus = 'O' then 'PROCESSING'
       when o_orderkey % 7 = 0 then 'failed' else 'ERROR' end as status,
  case o_orderkey % 9 when 0 then 'uploaded' when 1 then 'validating_media' when 2 then 'processing_audio'
       when 3 then 'Transcribing ' when 4 then 'generating_notes' when 5 then 'finalizing'
       when 6 then 'completed' when 7 then 'failed' else null end as processing_stage,
  o_orderkey % 4 as processing_attempts,
  case when o_orderkey % 6 = 0 then null
       when o_orderkey % 6 = 1 then 'Worker job timeout after 3600 s, token=abc123 at /var/app/run.py'
       when o_orderkey % 6 = 2 then 'Transcription backend refused: Bearer abc.def-ghi, api_key=zzz'
       when o_orderkey % 6 = 3 then concat('RuntimeError: bad header in /tmp/file_', cast(o_orderkey as varchar(20)), '.mp3')
       else 'ValueError: unknown codec' end as error_text,
  case when o_orderkey % 8 = 0 then null
       when o_orderkey % 8 = 1 then concat('s3://media/raw_media/meeting_', cast(o_orderkey as varchar(20)), '.mp4')
       when o_orderkey % 8 = 2 then concat('https://cdn.example.com/m/', cast(o_orderkey as varchar(20)), '.mp4')
       when o_orderkey % 8 = 3 then concat(' /storage/meeting_', cast(o_orderkey as varchar(20)), '.wav ')
       when o_orderkey % 8 = 4 then 's3://media/'
       else concat('raw_media/meeting_', cast(o_orderkey as varchar(20)), '.m4a') end as raw_media_path,
  case o_orderkey % 10 when 0 then 'Talk.MP3' when 1 then 'notes.pdf' when 2 then 'call.wav' when 3 then 'archive'
       when 4 then concat('C:', chr(92), 'Users', chr(92), 'rec.webm') when 5 then '../up/voice.ogg' else 'meeting.m4a' end as media_filename,
  case when o_orderkey % 23 = 0 then null else cast(o_totalprice / 40.0 as double) end as media_duration_seconds,
  cast(floor(o_totalprice * 70.0) as bigint) as media_size_bytes,
  o_orderkey % 6 < 2 as confidential_mode,
  case when o_orderkey % 6 >= 2 then 'not_required' when o_orderkey % 5 = 0 then 'deleted' else 'pending' end as recording_delete_status,
  o_orderdate + (o_orderkey % 24) * interval '1' hour as created_at,
  case when o_orderkey % 41 = 0 then null
       else o_orderdate + (o_orderkey % 24) * interval '1' hour + (o_orderkey % 300) * interval '1' minute end as updated_at
from {orders}
"""

UPLOAD_LEDGER = """
select concat('u', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20))) as id,
  cast(o_custkey as varchar(20)) as user_id, cast(l_orderkey as varchar(20)) as meeting_id,
  case when l_linenumber % 4 = 3 then 'started' else 'counted' end as status,
  cast(floor(l_extendedprice * 100.0) as bigint) as file_size_bytes,
  case when l_linenumber % 4 = 3 then null else l_shipdate end as counted_at,
  case when l_returnflag = 'R' then l_shipdate + interval '5' day else null end as deleted_at
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

BILLING_SUBSCRIPTIONS = """
select o_orderkey as id, o_custkey as user_id,
  case when o_orderkey % 2 = 0 then 'paypal' else 'square' end as provider,
  case o_orderkey % 6 when 0 then 'starter' when 1 then 'pro_pilot' when 2 then 'paid_pro' when 3 then 'Business'
       when 4 then 'team' else 'custom' end as plan_code,
  case o_orderkey % 5 when 0 then 'canceled' when 1 then 'active' when 2 then 'trialing' when 3 then 'paid' else 'past_due' end as status,
  concat('sub-', cast(o_orderkey % 4000 as varchar(20))) as provider_subscription_id,
  concat('pay-', cast(o_orderkey as varchar(20))) as provider_payment_id,
  o_orderdate as current_period_start,
  case when o_orderkey % 11 = 0 then null else o_orderdate + (o_orderkey % 700) * interval '1' day end as current_period_end,
  o_orderdate as created_at
from {orders}
where o_orderstatus <> 'P'
"""

MANUAL_BILLING_OVERRIDES = """
select o_orderkey as id, o_custkey as user_id,
  case when o_orderkey % 3 = 0 then 'paid_pro' when o_orderkey % 3 = 1 then 'enterprise' else 'starter' end as plan_code,
  case when o_orderkey % 4 = 0 then 'canceled' else 'active' end as status,
  o_orderdate as starts_at,
  case when o_orderkey % 13 = 0 then null else o_orderdate + (o_orderkey % 500) * interval '1' day end as ends_at
from {orders}
where o_orderstatus = 'P'
"""

BILLING_PAYMENT_ATTEMPTS = """
select o_orderkey as id, o_custkey as user_id,
  case when o_orderkey % 2 = 0 then 'paypal' else 'square' end as provider,
  case when o_orderkey % 3 = 0 then 'starter' else 'pro_pilot' end as plan_code,
  case o_orderkey % 7 when 0 then 'created' when 1 then 'captured' when 2 then 'succeeded' when 3 then 'failed'
       when 4 then 'cancelled' when 5 then 'completed' else 'error' end as status,
  cast(floor(o_totalprice * 100.0) as bigint) as amount_cents, 'USD' as currency_code,
  concat('ord-', cast(o_orderkey as varchar(20))) as provider_order_id,
  case when o_orderkey % 3 = 0 then concat('pay-', cast(o_orderkey as varchar(20))) else null end as provider_payment_id,
  o_orderdate as created_at
from {orders}
"""

# One webhook per event row, plus a second delivery of some of them.
_EVENT = """
select event_id, ts, {delay} as arrived_at, {copy} as copy_no, user_id, event_type, value, props
from {{events}} {where}
"""
_EVENTS_TWICE = (
    _EVENT.format(delay="ts", copy="0", where="")
    + " union all "
    + _EVENT.format(delay="ts + interval '20' minute", copy="1", where="where event_id % 6 = 1")
)

WEBHOOKS = f"""
select event_id, copy_no, ts, arrived_at,
  case when event_id % 2 = 0 then 'square' else 'paypal' end as provider,
  case when event_id % 29 = 0 then ''
       else concat('evt-', cast(event_id as varchar(20))) end as provider_event_id,
  case when event_id % 2 = 0 then
    case event_type when 'signup' then 'invoice.payment_made' when 'purchase' then 'payment.updated'
      when 'click' then 'invoice.canceled' when 'error' then 'refund.created' else 'customer.updated' end
  else
    case event_type when 'signup' then 'BILLING.SUBSCRIPTION.ACTIVATED' when 'purchase' then 'PAYMENT.SALE.COMPLETED'
      when 'click' then 'BILLING.SUBSCRIPTION.CANCELLED' when 'error' then 'PAYMENT.CAPTURE.REFUNDED' else 'CATALOG.PRODUCT.CREATED' end
  end as event_type,
  case when event_id % 2 = 0 then
    concat('{{{{"event_id": "evt-', cast(event_id as varchar(20)), '", "data": {{{{"id": "d', cast(event_id as varchar(20)),
      '", "object": {{{{"payment": {{{{"status": "', case when event_id % 3 = 0 then 'pending' else 'completed' end,
      '", "order_id": "ord-', cast(event_id as varchar(20)),
      case when event_id % 4 = 0 then concat('", "note": "User', cast(user_id as varchar(20)), '@example.com') else '", "note": "no mail here' end,
      '", "buyer_email_address": "', case when event_id % 10 = 0 then 'nobody@elsewhere.org' else concat('user', cast(user_id as varchar(20)), '@example.com') end,
      '", "customer_id": "c', cast(user_id as varchar(20)),
      '"}}}}, "invoice": {{{{"subscription_id": "sub-', cast(user_id % 40 as varchar(20)), '"}}}}}}}}}}}}}}}}')
  else
    concat('{{{{"id": "evt-', cast(event_id as varchar(20)), '", "resource": {{{{"id": "pay-', cast(event_id as varchar(20)),
      case when event_id % 3 = 0 then concat('", "billing_agreement_id": "sub-', cast(user_id % 40 as varchar(20))) else '' end,
      '", "custom_id": "', case when event_id % 5 = 0 then 'none' else concat('user', cast(user_id as varchar(20)), '@example.com') end,
      '", "billing_info": {{{{"next_billing_time": "2024-0', cast(2 + event_id % 7 as varchar(20)), '-01T00:00:00Z"}}}}}}}}}}}}')
  end as payload_json
from ({_EVENTS_TWICE}) e
"""

HTTP_REQUESTS = """
select event_id, ts, case event_type when 'signup' then 'POST' when 'purchase' then 'POST' when 'error' then 'PUT' else 'GET' end as method,
  concat('/v1/', event_type) as path,
  case when event_type = 'error' and event_id % 4 = 0 then '503' when event_type = 'error' then '404' else '200' end as status,
  value / 100.0 as duration_seconds
from {events}
"""

JOBS = """
select concat('j', cast(event_id as varchar(20))) as id,
  case event_type when 'signup' then 'demo' when 'purchase' then 'summarize' else 'ocr_slides' end as job_type,
  concat('{{"user":', cast(user_id as varchar(20)), ',"kind":', cast(event_id % 3 as varchar(20)), '}}') as payload,
  case event_id % 9 when 0 then 'queued' when 1 then 'deferred' when 2 then 'scheduled' when 3 then 'started' when 4 then 'finished'
       when 5 then 'failed' when 6 then 'stopped' when 7 then 'canceled' else 'mystery' end as rq_status,
  case when event_id % 2 = 0 then 'default' else 'media' end as queue,
  ts as created_at, ts + (event_id % 50) * interval '1' second as started_at,
  case when event_id % 9 < 4 then null else ts + (event_id % 50 + event_id % 700) * interval '1' second end as ended_at
from {events}
"""

FEEDBACK = """
select event_id as id, user_id, event_id % 40 as meeting_id,
  case event_id % 3 when 0 then 'very_useful' when 1 then 'somewhat_useful' else 'not_useful' end as usefulness,
  case event_id % 4 when 0 then 'summary' when 1 then 'action_items' when 2 then 'decisions' else 'key_points' end as most_useful,
  case event_id % 5 when 0 then '   ' when 1 then null else concat(' more on ', event_type, ' ') end as improvement_text,
  ts as updated_at
from {events}
"""

STAGE_EVENTS = """
select o_orderkey as meeting_id, l_linenumber as seq,
  case l_linenumber % 7 when 1 then 'validating_media' when 2 then 'processing_audio' when 3 then 'transcribing'
    when 4 then 'generating_notes' when 5 then 'finalizing' when 6 then 'completed' else 'failed' end as stage,
  case l_linenumber % 7 when 1 then 'media_validation_started_at' when 2 then 'audio_conversion_started_at'
    when 3 then 'transcription_started_at' when 4 then 'notes_generation_started_at' when 5 then 'finalization_started_at'
    when 6 then 'processing_completed_at' else 'processing_failed_at' end as boundary,
  l_shipdate + (l_partkey % 86400) * interval '1' second as happened_at
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

# Stored notes, a row per meeting version; list fields are '|' separated text here and
# become arrays in ``notes``.
NOTES_RAW = """
select o_orderkey as id, o_orderkey - o_orderkey % 2 as meeting_id, o_custkey as user_id,
  case when o_orderkey % 19 = 0 then '' else concat('Summary of order ', cast(o_orderkey as varchar(20)), ' , reviewed by the team.') end as summary,
  case when o_orderkey % 4 = 0 then '' else concat('The purpose of this meeting is to review order ', cast(o_orderkey % 50 as varchar(20)), '.') end as purpose,
  case when o_orderkey % 5 = 0 then '' else concat('The team agreed to keep lane ', cast(o_orderkey % 20 as varchar(20)), ' open.') end as outcome,
  concat('Lane ', cast(o_orderkey % 20 as varchar(20)), ' is ready for the pilot teams.|The team agreed to keep lane ', cast(o_orderkey % 20 as varchar(20)),
    ' open.|lane ', cast(o_orderkey % 20 as varchar(20)), ' is ready for the pilot teams|Thanks everyone.',
    case when o_orderkey % 3 = 0 then '|The main risk is that batch may slip.' else '' end) as key_points,
  concat('Keep lane ', cast(o_orderkey % 20 as varchar(20)), ' open|Use email as the support channel',
    case when o_orderkey % 4 = 1 then concat('|Keep lane ', cast(o_orderkey % 20 as varchar(20)), ' open.') else '' end) as decisions,
  case when o_orderkey % 3 = 0 then '' else concat('Batch ', cast(o_orderkey % 30 as varchar(20)), ' may delay delivery|The supplier portal could miss the check') end as risks,
  case when o_orderkey % 6 = 0 then '' else concat('Should we keep lane ', cast(o_orderkey % 20 as varchar(20)), '?') end as open_questions,
  case when o_orderkey % 7 = 0 then 'Publish the notes' else '' end as next_steps,
  concat('Priya - Review the order file ', cast(o_orderkey % 50 as varchar(20)), ' (due: Friday)|Unassigned - Update the rollout note',
    case when o_orderkey % 2 = 0 then concat('|Priya - review the order file ', cast(o_orderkey % 50 as varchar(20)), '.') else '' end,
    case when o_orderkey % 5 = 0 then '|Send the pricing sheet (due: Monday)' else '' end,
    case when o_orderkey % 9 = 0 then '|Jordan - Maybe think about the agenda' else '' end) as action_items,
  case when o_orderkey % 3 = 0 then 'local-summary-v1' when o_orderkey % 3 = 1 then 'local-summary-v1+qev3' else 'llm' end as model_version,
  o_orderdate as created_at
from {orders}
"""

# Stored notes with their transcript, one row per meeting.
# Expected and produced items of a case.  Lists are '|' separated, action fields '~'.
CASES = """
select o_orderkey as case_id, case o_orderkey % 3 when 0 then 'short' when 1 then 'medium' else 'long' end as category,
  case when o_orderkey % 31 = 30 then 'draft' else 'complete' end as ground_truth_status,
  case when o_orderkey % 13 = 12 then '' else concat('Keep lane ', cast(o_orderkey % 20 as varchar(20)), ' open for the pilot teams',
    case when o_orderkey % 3 = 0 then concat('|Publish the roadmap for batch ', cast(o_orderkey % 30 as varchar(20))) else '' end) end as expected_decisions,
  concat('Priya~Review the order file ', cast(o_orderkey % 50 as varchar(20)), ' with finance~2026-06-', cast(10 + o_orderkey % 9 as varchar(20)),
    '|Unassigned~Update the rollout note and the test report~No deadline stated',
    case when o_orderkey % 4 = 0 then concat('|Jordan~Send the pricing sheet ', cast(o_orderkey % 20 as varchar(20)), '~') else '' end,
    case when o_orderkey % 6 = 1 then '|Alex~TBD after transcript review~TBD' else '' end) as expected_actions,
  case when o_orderkey % 5 = 0 then '' else concat('Batch ', cast(o_orderkey % 30 as varchar(20)), ' may delay delivery') end as expected_risks,
  case when o_orderkey % 7 = 0 then '' else concat('The meeting reviewed order ', cast(o_orderkey % 50 as varchar(20)), ' and the pilot lanes') end as expected_context,
  concat('We keep lane ', cast(o_orderkey % 20 as varchar(20)), ' open', case when o_orderkey % 2 = 0 then '|Use email as the support channel' else '|Keep lane open for teams' end) as actual_decisions,
  concat(case when o_orderkey % 7 = 0 then 'Morgan' else 'Priya' end, '~Review order file ', cast(o_orderkey % 50 as varchar(20)), case when o_orderkey % 5 = 1 then '' else ' with finance' end, '~by 2026-06-', cast(10 + o_orderkey % 8 as varchar(20)),
    case when o_orderkey % 3 > 0 then '|Team~Update the rollout note~No deadline stated' else '' end,
    case when o_orderkey % 8 = 0 then '|Jordan~send the pricing sheet~Friday' else '' end,
    case when o_orderkey % 9 = 0 then '|~Book the travel desk~' else '' end) as actual_actions,
  case when o_orderkey % 4 = 0 then '' else concat('Batch ', cast(o_orderkey % 30 as varchar(20)), ' may slip|Delivery could be late') end as actual_risks,
  concat('Summary: the team reviewed order ', cast(o_orderkey % 50 as varchar(20)), ' and pilot lanes.') as actual_summary
from {orders}
"""


def _select_list(statement: str) -> str:
    """The expressions between SELECT and FROM of a one-table statement."""
    body = statement.strip()
    return body[len("select ") : body.rindex("\nfrom")]


RECORDS = (
    "select "
    + _select_list(TRANSCRIPTS)
    + ", "
    + _select_list(NOTES_RAW.replace("as user_id", "as note_user_id").replace("as created_at", "as note_created_at"))
    + "\nfrom {orders}\n"
)

STANDINS = {
    "records": RECORDS,
    "cases": CASES,
    "transcripts": TRANSCRIPTS,
    "users": USERS,
    "meetings": MEETINGS,
    "upload_ledger": UPLOAD_LEDGER,
    "billing_subscriptions": BILLING_SUBSCRIPTIONS,
    "manual_billing_overrides": MANUAL_BILLING_OVERRIDES,
    "billing_payment_attempts": BILLING_PAYMENT_ATTEMPTS,
    "webhooks": WEBHOOKS,
    "http_requests": HTTP_REQUESTS,
    "jobs": JOBS,
    "feedback": FEEDBACK,
    "stage_events": STAGE_EVENTS,
    "notes_raw": NOTES_RAW,
}
GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def base_tables(statement: str) -> list[str]:
    return sorted(t for t in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", statement)) if t in GIVEN)


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PARTITIONS_KEY = "spark.colloquy.textPartitions"


def text_partitions(spark: SparkSession) -> int:
    """Into how many partitions the queries deal their text rows: a setting of the session.

    Text work is heavy per row, and a table may come in one file.  The setting defaults to the
    session's shuffle partitions; 0 leaves rows where they lie, which suits tables of many files.
    """
    return int(spark.conf.get(PARTITIONS_KEY, spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal rows out into that many partitions, or, for 0, leave them; the data decide nothing."""
    return df.repartition(partitions) if partitions else df


TEXT_HEAVY = ("transcripts", "notes_raw", "records", "cases")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    statement = STANDINS[name]
    frames = {t: given(spark, sf_dir, t) for t in base_tables(statement)}
    if name in TEXT_HEAVY:
        # the narrow base rows move, the text is made after
        frames = {t: spread(f, text_partitions(spark)) for t, f in frames.items()}
    return spark.sql(statement, **frames)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given(spark, sf_dir, "documents").select("doc_id", "text"), text_partitions(spark))


def standin_sql(name: str) -> str:
    """The same statement over tables registered under their own names."""
    statement = STANDINS[name]
    return statement.format(**{t: t for t in base_tables(statement)})
