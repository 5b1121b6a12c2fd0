"""Plans, usage, billing and meeting status over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.operators import accounts as A, meetings as M
from colloquy.sources.standins import standin

AS_OF = "2001-08-01 12:00:00"
PLAN_AS_OF = "1998-06-15 12:00:00"
LIMITS = A.Limits(
    pilot_emails=tuple(f"user{i}@example.com" for i in range(0, 50, 5)),
    long_test_emails=tuple(f"user{i}@example.com" for i in range(3, 60, 7)),
)
PILOT_SQL = ", ".join(f"'{e}'" for e in LIMITS.pilot_emails)
LONG_SQL = ", ".join(f"'{e}'" for e in LIMITS.long_test_emails)
TS = "%Y-%m-%d %H:%M:%S"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


cte(
    "man_now",
    f"""select user_id, arg_max(plan_code, id) as m_plan, arg_max(status, id) as m_status, max(id) as m_id
    from manual_billing_overrides where status = 'active' and (ends_at is null or ends_at >= timestamp '{PLAN_AS_OF}') group by user_id""",
)
cte(
    "sub_now",
    f"""select user_id, max(id) as s_id from billing_subscriptions where status in ('active','trialing','paid')
    and (current_period_end is null or current_period_end >= timestamp '{PLAN_AS_OF}') group by user_id""",
)
cte(
    "plan_now",
    """select u.id as user_id, u.email, case when m.user_id is not null then m.plan_code when s.user_id is not null then s.plan_code else 'free_trial' end as plan_code,
    case when m.user_id is not null then m.status when s.user_id is not null then s.status else 'free_trial' end as billing_status,
    case when m.user_id is not null then 'manual' when s.user_id is not null then s.provider end as provider,
    case when m.user_id is not null then m.ends_at when s.user_id is not null then s.current_period_end end as current_period_end,
    case when m.user_id is not null then 'manual_override' when s.user_id is not null then 'subscription' else 'default' end as source
    from users u left join (select o.* from manual_billing_overrides o join man_now on o.id = m_id) m on m.user_id = u.id
    left join (select o.* from billing_subscriptions o join sub_now on o.id = s_id) s on s.user_id = u.id""",
)
cte(
    "limits_now",
    f"""select user_id, email, plan_code, lower(trim(email)) in ({PILOT_SQL}) as is_pilot,
    case when plan_code in ('paid_pro','starter') then 20 when plan_code = 'pro_pilot' then 100
      when lower(trim(plan_code)) in ('business','team','premium','custom','enterprise') then 300 end as monthly_limit,
    coalesce(case when plan_code in ('paid_pro','starter') then 20 when plan_code = 'pro_pilot' then 100
      when lower(trim(plan_code)) in ('business','team','premium','custom','enterprise') then 300 end,
      case when lower(trim(email)) in ({PILOT_SQL}) then 3 else 1 end) as upload_limit,
    greatest(coalesce(case when plan_code in ('paid_pro','starter') then 3600 when plan_code = 'pro_pilot' then 7200
      when lower(trim(plan_code)) in ('business','team','premium','custom','enterprise') then 10800 end,
      case when lower(trim(email)) in ({PILOT_SQL}) then 3600 else 1800 end),
      case when lower(trim(email)) in ({LONG_SQL}) then 18300 else 0 end) as max_duration_seconds,
    lower(trim(plan_code)) in ('pro_pilot','business','team','premium','custom','enterprise') as can_use_confidential
    from plan_now""",
)
cte(
    "usage_now",
    f"""select cast(user_id as bigint) as user_id, count(*) as used_ever,
    count(*) filter (counted_at >= date_trunc('month', timestamp '{PLAN_AS_OF}')) as used_this_month
    from upload_ledger where counted_at is not null and deleted_at is null group by 1""",
)
cte(
    "quota_now",
    """select l.*, coalesce(case when monthly_limit is not null then used_this_month else used_ever end, 0) as meetings_used
    from limits_now l left join usage_now using (user_id)""",
)


def _plans(spark, sf):
    return A.effective_plan(
        standin(spark, sf, "users"),
        standin(spark, sf, "billing_subscriptions"),
        standin(spark, sf, "manual_billing_overrides"),
        PLAN_AS_OF,
    )


def _limits(spark, sf):
    return A.plan_limits(_plans(spark, sf), LIMITS)


def _usage(spark, sf):
    return A.ledger_usage(standin(spark, sf, "upload_ledger"), PLAN_AS_OF)


@query(
    "j03_effective_plan",
    oracle(
        f"""select user_id, plan_code, billing_status, provider, strftime(current_period_end, '{TS}') as current_period_end, source from plan_now"""
    ),
)
def j03(spark, sf):
    return (
        _plans(spark, sf)
        .withColumn("current_period_end", stamp("current_period_end"))
        .drop("email")
    )


@query(
    "a08_plan_limits",
    oracle(
        "select user_id, plan_code, is_pilot, upload_limit, max_duration_seconds, can_use_confidential from limits_now"
    ),
)
def a08(spark, sf):
    return _limits(spark, sf).drop("email", "monthly_limit")


@query("a04_lifetime_usage", oracle("select user_id, used_ever from usage_now"))
def a04(spark, sf):
    return _usage(spark, sf).select(F.col("user_id").cast("long").alias("user_id"), "used_ever")


@query("a05_monthly_usage", oracle("select user_id, used_this_month from usage_now"))
def a05(spark, sf):
    return _usage(spark, sf).select(
        F.col("user_id").cast("long").alias("user_id"), "used_this_month"
    )


@query(
    "a06_quota_decision",
    oracle(
        """select user_id, plan_code, meetings_used, upload_limit, meetings_used < upload_limit as allowed,
        case when meetings_used < upload_limit then '' when monthly_limit is not null then 'monthly_limit_reached' else 'free_trial_limit_reached' end as reason from quota_now"""
    ),
)
def a06(spark, sf):
    return A.quota_decision(_limits(spark, sf), _usage(spark, sf))


@query(
    "a07_usage_dashboard",
    oracle(
        """select user_id, case when monthly_limit is not null then plan_code when is_pilot then 'pilot' else 'free_trial' end as plan, is_pilot,
        meetings_used, upload_limit, greatest(0, upload_limit - meetings_used) as remaining_uploads, max_duration_seconds, max_duration_seconds // 60 as max_duration_minutes from quota_now"""
    ),
)
def a07(spark, sf):
    return A.usage_dashboard(_limits(spark, sf), _usage(spark, sf))


@query(
    "p10_upload_gate",
    oracle(
        """select id, user_id, reason, reason = '' as accepted from (
        select m.id, m.user_id, case when confidential_mode and not coalesce(can_use_confidential, false) then 'confidential_not_allowed'
          when media_size_bytes > 25165824 then 'too_large'
          when media_filename is null or not regexp_matches(lower(media_filename), '\\.(mp3|mp4|m4a|wav|webm|ogg|flac)$') then 'bad_type'
          when media_duration_seconds is null then 'duration_unknown'
          when media_duration_seconds > coalesce(max_duration_seconds, 1800) then 'too_long' else '' end as reason
        from meetings m left join limits_now l on l.user_id = m.user_id) t"""
    ),
)
def p10(spark, sf):
    return A.upload_gate(standin(spark, sf, "meetings"), _limits(spark, sf))


@query(
    "a03_billing_overview",
    oracle(
        """select * from (select count(distinct user_id) filter (status in ('active','trialing','paid')) as active_paid_users,
        count(*) filter (status in ('active','trialing','paid')) as active_subscriptions, count(*) as total_subscriptions from billing_subscriptions),
        (select count(*) as total_payment_attempts, count(*) filter (status in ('captured','succeeded','completed','paid')) as successful_payment_attempts,
        count(*) filter (status in ('failed','canceled','cancelled','error')) as failed_payment_attempts from billing_payment_attempts)"""
    ),
)
def a03(spark, sf):
    return A.billing_overview(
        standin(spark, sf, "billing_subscriptions"), standin(spark, sf, "billing_payment_attempts")
    )


@query(
    "j02_billing_left_users",
    oracle(
        f"""select s.id, user_id, u.email as user_email, provider, plan_code, status, strftime(created_at, '{TS}') as created_at
        from (select * from billing_subscriptions order by created_at desc, id desc limit 10) s left join users u on u.id = s.user_id"""
    ),
)
def j02(spark, sf):
    return A.newest_with_email(
        standin(spark, sf, "billing_subscriptions"), standin(spark, sf, "users")
    ).select("id", "user_id", "user_email", "provider", "plan_code", "status", stamp("created_at").alias("created_at"))


@query(
    "l02_newest_10",
    oracle(
        """select s.id, user_id, u.email as user_email, provider, amount_cents, status
        from (select * from billing_payment_attempts order by created_at desc, id desc limit 10) s left join users u on u.id = s.user_id"""
    ),
)
def l02(spark, sf):
    return A.newest_with_email(
        standin(spark, sf, "billing_payment_attempts"), standin(spark, sf, "users")
    ).select("id", "user_id", "user_email", "provider", "amount_cents", "status")


@query(
    "t05_override_state",
    oracle(
        """select m.id, m.user_id, case when c.cid is not null then 'canceled' else m.status end as status from
        (select id, user_id, status from manual_billing_overrides union all
         select 1000000000 + id, id as user_id, 'active' from users where organization_name = 'BUILDING') m
        left join (select user_id, max(id) as cid from (select id, user_id, status from manual_billing_overrides union all
         select 1000000000 + id, id as user_id, 'active' from users where organization_name = 'BUILDING') g
         where status = 'active' and user_id in (select id from users where organization_name in ('MACHINERY', 'BUILDING') and id % 2 = 0) group by user_id) c on c.cid = m.id"""
    ),
)
def t05(spark, sf):
    users = standin(spark, sf, "users")
    grants = users.filter(F.col("organization_name") == "BUILDING").select(
        (F.col("id") + 1000000000).alias("id"), F.col("id").alias("user_id"), F.lit("active").alias("status")
    )
    cancels = users.filter(
        F.col("organization_name").isin("MACHINERY", "BUILDING") & (F.col("id") % 2 == 0)
    ).select(F.col("id").alias("user_id"))
    overrides = standin(spark, sf, "manual_billing_overrides").select("id", "user_id", "status")
    return A.grant_overrides(overrides, grants, cancels).select("id", "user_id", "status")


# ---- meetings ----------------------------------------------------------------------
cte(
    "meetings_n",
    """select *, lower(trim(coalesce(status, 'unknown'))) as ns from meetings""",
)
DONE_SQL = "('complete','completed','done','success','succeeded')"
FAIL_SQL = "('error','failed','failure')"
PROC_SQL = "('in_progress','processing','summarizing','transcribing')"


@query("p01_status_normalize", oracle("select id, ns as status from meetings_n"))
def p01(spark, sf):
    return standin(spark, sf, "meetings").select(
        "id", M.normalized_status(F.col("status")).alias("status")
    )


@query(
    "p02_status_vocabulary",
    oracle(
        f"""select 'meeting' as kind, cast(id as varchar) as id, case when ns in {DONE_SQL} then 'completed' when ns in {FAIL_SQL} then 'failed' when ns in {PROC_SQL} then 'processing' when ns = 'queued' then 'queued' else 'other' end as state from meetings_n
        union all select 'job', id, case when rq_status in ('queued','deferred','scheduled') then 'queued' when rq_status = 'started' then 'running' when rq_status = 'finished' then 'succeeded' when rq_status in ('failed','stopped','canceled','cancelled') then 'failed' else 'running' end from jobs"""
    ),
)
def p02(spark, sf):
    meetings = standin(spark, sf, "meetings").select(
        F.lit("meeting").alias("kind"),
        F.col("id").cast("string").alias("id"),
        M.status_bucket(F.col("status")).alias("state"),
    )
    jobs = standin(spark, sf, "jobs").select(
        F.lit("job").alias("kind"), "id", M.queue_state(F.col("rq_status")).alias("state")
    )
    return meetings.unionByName(jobs)


@query(
    "p03_progress_label",
    oracle(
        """select id, case lower(trim(coalesce(processing_stage, ''))) when 'uploaded' then 'Upload received' when 'validating_media' then 'Checking the recording'
        when 'processing_audio' then 'Preparing audio' when 'transcribing' then 'Transcribing audio' when 'generating_notes' then 'Generating notes'
        when 'finalizing' then 'Finalizing notes' when 'completed' then 'Notes ready' when 'failed' then 'Processing failed' else 'Processing' end as label from meetings"""
    ),
)
def p03(spark, sf):
    return standin(spark, sf, "meetings").select(
        "id", M.progress_label(F.col("processing_stage")).alias("label")
    )


@query(
    "p04_stuck_flag",
    oracle(
        f"""select id, coalesce(ns in ('queued', 'in_progress','processing','summarizing','transcribing') and updated_at < timestamp '{AS_OF}' - interval '45' minute, false) as is_stuck from meetings_n"""
    ),
)
def p04(spark, sf):
    return standin(spark, sf, "meetings").select(
        "id", M.is_stuck(F.col("status"), F.col("updated_at"), AS_OF).alias("is_stuck")
    )


STALE_ORACLE = f"""select id, case when stale then 'ERROR' else status end as status, case when stale then 'failed' else processing_stage end as processing_stage,
    case when stale then 'processing_stale' end as processing_error_code, case when stale then '{M.STALE_ERROR}' end as last_error, stale as changed from (
    select *, coalesce(upper(status) = 'PROCESSING' and coalesce(processing_stage, '') <> 'completed' and epoch(timestamp '{AS_OF}') - epoch(updated_at) >= 14400, false) as stale from meetings) t"""


@query("p05_stale_transition", oracle(STALE_ORACLE))
def p05(spark, sf):
    return M.fail_stale(standin(spark, sf, "meetings"), AS_OF)


@query(
    "p06_error_classify",
    oracle(
        f"""select id, code, case code when 'processing_timeout' then '{M.TIMEOUT_ERROR}' when 'transcription_failed' then '{M.TRANSCRIPTION_ERROR}' else '{M.GENERIC_ERROR}' end as message from (
        select id, case when contains(lower(coalesce(error_text,'')), 'timeout') or contains(lower(coalesce(error_text,'')), 'timed out') then 'processing_timeout'
        when lower(coalesce(processing_stage,'')) = 'transcribing' or contains(lower(coalesce(error_text,'')), 'transcrib') then 'transcription_failed' else 'processing_failed' end as code from meetings) t"""
    ),
)
def p06(spark, sf):
    code, message = M.error_class(F.col("error_text"), F.col("processing_stage"))
    return standin(spark, sf, "meetings").select("id", code.alias("code"), message.alias("message"))


REDACT_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?i)(api[_-]?key|token|secret|password)=\S+', '\1=[redacted]', 'g'), "
    r"'(?i)bearer\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), '/(?:Users|private|tmp|var|opt|home)/[^\s,;:]+', '[path]', 'g'), '[A-Za-z]:\\[^\s,;:]+', '[path]', 'g')"
)


@query(
    "p07_diagnostic_redact",
    oracle(
        f"""select 'meeting' as kind, id, left({REDACT_SQL.format(c='error_text')}, 1000) as diagnostic from meetings
        union all select 'document', doc_id, {REDACT_SQL.format(c='text')} from documents"""
    ),
)
def p07(spark, sf):
    from colloquy.sources.standins import given

    a = standin(spark, sf, "meetings").select(
        F.lit("meeting").alias("kind"), "id", M.redact(F.col("error_text")).alias("diagnostic")
    )
    b = given(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), M.redact(F.col("text"), None).alias("diagnostic")
    )
    return a.unionByName(b)


@query(
    "p08_email_mask",
    oracle(
        """select id, case when position('@' in e) > 0 and split_part(e, '@', 1) <> '' and substr(e, position('@' in e) + 1) <> '' then
        concat(case when length(split_part(e, '@', 1)) > 2 then left(split_part(e, '@', 1), 2) else left(split_part(e, '@', 1), 1) end, '***@', substr(e, position('@' in e) + 1)) else '' end as masked
        from (select id, lower(trim(email)) as e from users) t"""
    ),
)
def p08(spark, sf):
    return standin(spark, sf, "users").select("id", M.mask_email(F.col("email")).alias("masked"))


@query(
    "p09_storage_key",
    oracle(
        """select id, nullif(case when v like 's3://%' then ltrim(case when position('/' in substr(v, 6)) > 0 then substr(substr(v, 6), position('/' in substr(v, 6))) else '' end, '/')
        when v like 'http://%' or v like 'https://%' then null else ltrim(v, '/') end, '') as storage_key from (select id, trim(raw_media_path) as v from meetings) t"""
    ),
)
def p09(spark, sf):
    return standin(spark, sf, "meetings").select(
        "id", M.storage_key(F.col("raw_media_path")).alias("storage_key")
    )


@query(
    "f25_filename_sanitize",
    oracle(
        "select id, list_extract(string_split(replace(trim(media_filename), chr(92), '/'), '/'), -1) as filename from meetings"
    ),
)
def f25(spark, sf):
    return standin(spark, sf, "meetings").select(
        "id", M.file_name(F.col("media_filename")).alias("filename")
    )


@query(
    "p11_case_insensitive_search",
    oracle(
        """select m.id, title, u.email as user_email from meetings m left join users u on u.id = m.user_id
        where lower(status) = 'done' and (title ilike '%review 49%' or u.email ilike '%USER1%')"""
    ),
)
def p11(spark, sf):
    joined = M.with_user_email(standin(spark, sf, "meetings"), standin(spark, sf, "users"))
    both = M.search(joined, "Done ", "review 49").select("id", "title", "user_email")
    mail = M.search(joined, "done", " USER1 ").select("id", "title", "user_email")
    return both.union(mail).distinct()


@query(
    "p12_owner_scoped_filter",
    oracle("select id, title, status from meetings where user_id = 7 and status = 'DONE'"),
)
def p12(spark, sf):
    return (
        standin(spark, sf, "meetings")
        .filter((F.col("user_id") == 7) & (F.col("status") == "DONE"))
        .select("id", "title", "status")
    )


@query(
    "j01_meetings_left_users",
    oracle(
        """select m.id, m.user_id, u.email as user_email, title from meetings m left join users u on u.id = m.user_id"""
    ),
)
def j01(spark, sf):
    return M.with_user_email(standin(spark, sf, "meetings"), standin(spark, sf, "users")).select(
        "id", "user_id", "user_email", "title"
    )


@query(
    "l01_page",
    oracle(
        f"""select m.id, title, status, u.email as user_email, strftime(created_at, '{TS}') as created_at, (select count(*) from meetings) as total
        from meetings m left join users u on u.id = m.user_id order by m.created_at desc, m.id desc limit 20 offset 40"""
    ),
)
def l01(spark, sf):
    meetings = standin(spark, sf, "meetings")
    total = meetings.agg(F.count(F.lit(1))).scalar()
    shown = M.page(meetings, 20, 40)
    owners = standin(spark, sf, "users").join(
        F.broadcast(shown.select(F.col("user_id").alias("id")).distinct()), "id", "left_semi"
    )
    return (
        M.with_user_email(shown, owners)
        .withColumn("total", total)
        .select("id", "title", "status", "user_email", stamp("created_at").alias("created_at"), "total")
    )


@query("a01_status_counts", oracle("select ns as status, count(*) as n from meetings_n group by ns"))
def a01(spark, sf):
    return M.status_counts(standin(spark, sf, "meetings"))


@query(
    "a02_overview",
    oracle(
        f"""select *, case when completed + failed > 0 then round(100.0 * completed / (completed + failed), 1) end as success_rate_percent, (select count(*) from users) as total_users from (
        select count(*) as total_meetings, count(*) filter (created_at >= date_trunc('day', timestamp '{AS_OF}')) as meetings_today,
        count(*) filter (created_at >= timestamp '{AS_OF}' - interval '7' day) as meetings_last_7_days, count(*) filter (created_at >= timestamp '{AS_OF}' - interval '30' day) as meetings_last_30_days,
        count(*) filter (ns in {DONE_SQL}) as completed, count(*) filter (ns in {FAIL_SQL}) as failed, count(*) filter (ns in {PROC_SQL}) as processing, count(*) filter (ns = 'queued') as queued,
        count(*) filter (lower(status) in ('queued','in_progress','processing','summarizing','transcribing') and updated_at < timestamp '{AS_OF}' - interval '45' minute) as stuck from meetings_n) t"""
    ),
)
def a02(spark, sf):
    return M.overview(standin(spark, sf, "meetings"), standin(spark, sf, "users"), AS_OF)


@query(
    "a22_labelled_counters",
    oracle("select method, path, status, count(*) as total from http_requests group by all"),
)
def a22(spark, sf):
    return M.labelled_counters(standin(spark, sf, "http_requests"), ["method", "path", "status"])


@query(
    "a23_latency_summary",
    oracle(
        "select method, path, status, count(*) as n, round(sum(duration_seconds), 4) as sum_seconds, round(avg(duration_seconds), 6) as avg_seconds from http_requests group by all"
    ),
)
def a23(spark, sf):
    return M.latency_summary(
        standin(spark, sf, "http_requests"), ["method", "path", "status"], "duration_seconds"
    )


cte(
    "boundaries",
    """select meeting_id, min(happened_at) filter (boundary = 'media_validation_started_at') as media_validation_started_at, min(happened_at) filter (boundary = 'audio_conversion_started_at') as audio_conversion_started_at,
    min(happened_at) filter (boundary = 'transcription_started_at') as transcription_started_at, min(happened_at) filter (boundary = 'notes_generation_started_at') as notes_generation_started_at,
    min(happened_at) filter (boundary = 'finalization_started_at') as finalization_started_at, min(happened_at) filter (boundary = 'processing_completed_at') as processing_completed_at,
    min(happened_at) filter (boundary = 'processing_failed_at') as processing_failed_at, count(*) filter (stage = 'validating_media') as processing_attempts from stage_events group by meeting_id""",
)
BOUND = [
    "media_validation_started_at",
    "audio_conversion_started_at",
    "transcription_started_at",
    "notes_generation_started_at",
    "finalization_started_at",
    "processing_completed_at",
    "processing_failed_at",
]


@query(
    "w18_first_boundary_time",
    oracle(
        "select b.meeting_id, "
        + ", ".join(f"strftime({b}, '{TS}') as {b}" for b in BOUND)
        + """, processing_attempts, s.stage as processing_stage from boundaries b join
        (select *, row_number() over (partition by meeting_id order by happened_at desc, seq desc, stage desc) as rn from stage_events) s on s.meeting_id = b.meeting_id and rn = 1"""
    ),
)
def w18(spark, sf):
    out = M.first_boundaries(standin(spark, sf, "stage_events"))
    return out.select(
        "meeting_id", *[stamp(b).alias(b) for b in BOUND], "processing_attempts", "processing_stage"
    )


# a time map per meeting, as JSON text with broken values mixed in
_TIMES = {
    "upload_received_at": "created_at",
    "media_validation_started_at": "created_at + (id % 7) * interval '1' second",
    "media_validation_completed_at": "created_at + (id % 90 + 9) * interval '1' second",
    "transcription_started_at": "created_at + (id % 90 + 60) * interval '1' second",
    "transcription_completed_at": "created_at + (id % 5000 + 60) * interval '1' second",
    "notes_generation_started_at": "created_at + (id % 90 + 100) * interval '1' second",
    "processing_completed_at": "created_at + (id % 6000 + 100) * interval '1' second",
}
A24_SQL = """select id, null as audio_conversion_seconds, null as finalization_seconds, null as notes_generation_seconds, null as quality_engine_seconds,
    cast(id % 90 + 9 - id % 7 as double) as media_validation_seconds,
    case when id % 13 = 0 then null else cast(id % 5000 - id % 90 as double) end as transcription_seconds,
    case when id % 11 = 0 then null else cast(id % 6000 + 100 as double) end as processing_total_seconds from meetings"""


@query("a24_stage_durations", oracle(A24_SQL))
def a24(spark, sf):
    times = []
    for key, sql in _TIMES.items():
        text = F.date_format(F.expr(sql), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
        if key == "transcription_completed_at":
            text = F.when(F.col("id") % 13 == 0, "not a time").otherwise(text)
        if key == "processing_completed_at":
            text = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(text)
        times += [F.lit(key), text]
    meetings = standin(spark, sf, "meetings").withColumn("timings", F.create_map(*times))
    return M.stage_durations(meetings, "timings")


@query(
    "a28_job_duration_histogram",
    oracle(
        """select job_type, state as status, count(*) as n, round(sum(d), 3) as sum_seconds, """
        + ", ".join(f"count(*) filter (d <= {b}) as le_{b}" for b in (5, 10, 30, 60, 120, 300, 600))
        + """ from (select *, epoch(ended_at) - epoch(started_at) as d, case when rq_status in ('queued','deferred','scheduled') then 'queued' when rq_status = 'started' then 'running' when rq_status = 'finished' then 'succeeded'
        when rq_status in ('failed','stopped','canceled','cancelled') then 'failed' else 'running' end as state from jobs) t group by 1, 2"""
    ),
)
def a28(spark, sf):
    return M.duration_histogram(standin(spark, sf, "jobs"))


@query(
    "t12_retention",
    oracle(
        f"""select id, due, case when due then k end as delete_key, case when due and k is null then 'failed' else recording_delete_status end as recording_delete_status,
        case when due and k is null then 'No recording path was available for deletion.' end as recording_delete_error from (
        select id, recording_delete_status, confidential_mode and ns in {DONE_SQL} and recording_delete_status = 'pending' as due,
        nullif(case when v like 's3://%' then ltrim(case when position('/' in substr(v, 6)) > 0 then substr(substr(v, 6), position('/' in substr(v, 6))) else '' end, '/')
        when v like 'http%://%' then null else ltrim(v, '/') end, '') as k from (select *, trim(raw_media_path) as v from meetings_n) x) t"""
    ),
)
def t12(spark, sf):
    return M.retention(standin(spark, sf, "meetings"))


# object keys: one per line item, some of them folder markers
OBJECTS_SQL = """select case when l_linenumber % 5 = 0 then concat('m', cast(l_orderkey % 700 as varchar(20)), '/slides/') else
    concat('m', cast(l_orderkey % 700 as varchar(20)), '/slides/p', cast(l_linenumber as varchar(20)), '.png') end as path, l_partkey as size, l_shipdate as last_modified from {lineitem}"""
cte("objects", OBJECTS_SQL.format(lineitem="lineitem"))
cte("slides", "select split_part(path, '/', 1) as meeting_id, path, size, last_modified from objects where path not like '%/'")


def _objects(spark, sf):
    from colloquy.sources.standins import given

    return spark.sql(OBJECTS_SQL, lineitem=given(spark, sf, "lineitem"))


@query(
    "s10_object_listing",
    oracle(
        f"select meeting_id, path as key, split_part(path, '/', 3) as filename, size, strftime(last_modified, '{TS}') as last_modified from slides"
    ),
)
def s10(spark, sf):
    return M.object_listing(_objects(spark, sf), "path", "size", "last_modified").withColumn(
        "last_modified", stamp("last_modified")
    )


@query(
    "a25_slides_per_meeting",
    oracle(
        f"select meeting_id, count(*) as slides_count, strftime(max(last_modified), '{TS}') as last_slide_at from slides group by 1"
    ),
)
def a25(spark, sf):
    listed = M.object_listing(_objects(spark, sf), "path", "size", "last_modified")
    return M.objects_per_meeting(listed).withColumn("last_slide_at", stamp("last_slide_at"))
