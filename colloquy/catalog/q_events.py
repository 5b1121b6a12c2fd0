"""Webhooks, alerts, jobs: batch forms and their streaming twins on the same oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_accounts import TS, stamp
from colloquy.operators import meetings as M
from colloquy.sources.standins import STANDINS, standin
from colloquy.streaming import alerts, jobs as J, webhooks as W
from colloquy.streaming.runner import drain_append, drain_batches, drain_new_keys, query_home, stream_table
from colloquy.streaming.state import drain_state

AS_OF = "2024-01-20 12:00:00"
EMAIL_SQL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _jx(path: str) -> str:
    return f"nullif(json_extract_string(payload_json, '{path}'), '')"


def _mail(path: str) -> str:
    v = f"lower(trim(json_extract_string(payload_json, '{path}')))"
    return f"case when regexp_matches({v}, '{EMAIL_SQL}') then {v} end"


def _paths(paths, fn=_jx):
    return "coalesce(" + ", ".join(fn(p) for p in paths) + ")" if paths else "null"


def _pick(field):
    arms = " ".join(
        f"when '{p}' then {_paths(paths[field])}" for p, paths in W.ID_PATHS.items()
    )
    return f"case provider {arms} end as {field}"


cte(
    "hooks_flat",
    f"""select event_id, copy_no, ts, arrived_at, provider, provider_event_id, event_type,
    coalesce(case provider when 'square' then {_paths(W.EMAIL_PATHS['square'], _mail)} else {_paths(W.EMAIL_PATHS['paypal'], _mail)} end,
      lower(nullif(regexp_extract(payload_json, '{W.ANY_EMAIL}', 1), ''))) as email,
    upper(json_extract_string(payload_json, '{W.PAYMENT}.status')) as payment_status,
    {_pick('order_id')}, {_pick('payment_id')}, {_pick('subscription_id')}, {_pick('customer_id')},
    case when provider = 'paypal' then try_cast(replace(json_extract_string(payload_json, '{W.PERIOD_END}'), 'Z', '') as timestamp) end as period_end
    from webhooks""",
)
cte(
    "hooks_first",
    """select * from (select *, count(*) over (partition by provider, provider_event_id) as deliveries,
    row_number() over (partition by provider, provider_event_id order by arrived_at, event_id, copy_no) as rn
    from hooks_flat where provider_event_id <> '') t where rn = 1""",
)
cte(
    "hooks_user",
    "select h.*, u.id as matched_user_id from hooks_first h left join users u on lower(trim(u.email)) = h.email",
)


def _in(table, provider):
    return "(" + ", ".join(f"'{x}'" for x in table[provider]) + ")"


_ACT = " or ".join(
    f"(provider = '{p}' and event_type in {_in(W.ACTIVE_EVENTS, p)})" for p in W.ACTIVE_EVENTS
)
_CAN = " or ".join(
    f"(provider = '{p}' and event_type in {_in(W.CANCEL_EVENTS, p)})" for p in W.CANCEL_EVENTS
)
_REV = " or ".join(
    f"(provider = '{p}' and event_type in {_in(W.REVIEW_EVENTS, p)})" for p in W.REVIEW_EVENTS
)
cte(
    "hooks_routed",
    f"""select *, case when act and matched_user_id is null then 'unmatched' when act or can then 'processed' when {_REV} then 'review' else 'ignored' end as status,
    case when act and matched_user_id is not null then 'activate' when can then 'cancel' else 'none' end as effect,
    coalesce(subscription_id, order_id, payment_id) as subscription_key from (
    select *, ({_ACT}) and not (event_type = 'payment.updated' and coalesce(payment_status, '') <> 'COMPLETED') as act, ({_CAN}) as can from hooks_user) t""",
)


def _flat(spark, sf):
    return W.project_payload(standin(spark, sf, "webhooks"))


def _routed(spark, sf):
    return W.route(W.match_users(W.first_deliveries(_flat(spark, sf)), standin(spark, sf, "users")))


@query(
    "p24_payload_project",
    oracle(
        f"""select provider, event_id, copy_no, email, payment_status, order_id, payment_id, subscription_id, customer_id, strftime(period_end, '{TS}') as period_end from hooks_flat"""
    ),
)
def p24(spark, sf):
    return _flat(spark, sf).select(
        "provider", "event_id", "copy_no", "email", "payment_status", "order_id", "payment_id",
        "subscription_id", "customer_id", stamp("period_end").alias("period_end"),
    )


# the type goes into the payload, under one of the names that it may have, or under none
_TYPED = """concat('{"', case when provider = 'square' and event_id % 4 <> 0 then 'type' when provider = 'paypal' and event_id % 6 = 1 then 'kind' else 'event_type' end,
    '": "', event_type, '", ', substr(payload_json, 2))"""


@query(
    "p24_payload_identity",
    oracle(
        f"""select provider, event_id, copy_no, case when provider = 'square' then coalesce(nullif(p ->> '$.event_id', ''), nullif(p ->> '$.id', ''), '') else coalesce(p ->> '$.id', '') end as provider_event_id,
        case when provider = 'square' then coalesce(p ->> '$.type', p ->> '$.event_type', '') else coalesce(p ->> '$.event_type', 'unknown') end as event_type
        from (select provider, event_id, copy_no, {_TYPED} as p from webhooks) t"""
    ),
)
def p24_identity(spark, sf):
    bare = standin(spark, sf, "webhooks").withColumn("payload_json", F.expr(_TYPED)).drop("provider_event_id", "event_type")
    return W.payload_identity(bare).select("provider", "event_id", "copy_no", "provider_event_id", "event_type")


T01_SQL = f"""select provider, provider_event_id, event_type, event_id, strftime(arrived_at, '{TS}') as arrived_at, deliveries, 'accepted' as status from hooks_first
    union all select provider, provider_event_id, event_type, event_id, strftime(arrived_at, '{TS}'), 1, 'ignored' from webhooks where provider_event_id = ''"""


@query("t01_webhook_dedupe", oracle(T01_SQL))
def t01(spark, sf):
    hooks = standin(spark, sf, "webhooks").drop("payload_json")
    first = W.first_deliveries(hooks).withColumn("status", F.lit("accepted"))
    lost = (
        hooks.filter(F.col("provider_event_id") == "")
        .withColumn("deliveries", F.lit(1))
        .withColumn("status", F.lit("ignored"))
    )
    cols = ["provider", "provider_event_id", "event_type", "event_id"]
    tail = [stamp("arrived_at").alias("arrived_at"), "deliveries", "status"]
    return first.select(*cols, *tail).unionByName(lost.select(*cols, *tail))


@query(
    "t01_webhook_dedupe_stream",
    oracle("select provider, provider_event_id, event_type, event_id from hooks_first"),
)
def t01_stream(spark, sf):
    events = stream_table(spark, f"{sf}/events.parquet")
    hooks = spark.sql(STANDINS["webhooks"], events=events).drop("payload_json")
    home = query_home(spark, "webhook-dedupe", sf)
    kept = drain_new_keys(spark, hooks, "webhook-dedupe", ["provider", "provider_event_id"], W.first_deliveries, home)
    return kept.select("provider", "provider_event_id", "event_type", "event_id")


@query(
    "t01_webhook_answers",
    oracle(
        f"""select provider, provider_event_id, event_id, copy_no, strftime(arrived_at, '{TS}') as arrived_at, case when provider_event_id = '' then 'ignored'
        when row_number() over (partition by provider, provider_event_id order by arrived_at, event_id, copy_no) = 1 then 'accepted' else 'duplicate' end as status from webhooks"""
    ),
)
def t01_answers(spark, sf):
    """Every delivery gets an answer: the first of an id is accepted, later ones are duplicates."""
    out = W.delivery_answers(standin(spark, sf, "webhooks").drop("payload_json"))
    return out.select("provider", "provider_event_id", "event_id", "copy_no", stamp("arrived_at").alias("arrived_at"), "status")


@query(
    "j04_event_user_match",
    oracle("select provider, provider_event_id, email, matched_user_id from hooks_user"),
)
def j04(spark, sf):
    matched = W.match_users(W.first_deliveries(_flat(spark, sf)), standin(spark, sf, "users"))
    return matched.select("provider", "provider_event_id", "email", "matched_user_id")


@query(
    "t02_webhook_route",
    oracle(
        "select provider, provider_event_id, event_type, status, effect, matched_user_id, deliveries from hooks_routed"
    ),
)
def t02(spark, sf):
    return _routed(spark, sf).select(
        "provider", "provider_event_id", "event_type", "status", "effect", "matched_user_id", "deliveries"
    )


T03_SQL = f"""select provider, subscription_key, user_id, case when coalesce(last_off > last_on, false) then 'canceled' else 'active' end as status, strftime(activated_at, '{TS}') as activated_at from (
    select provider, subscription_key, coalesce(u, newest) as user_id, min(ts) filter (effect = 'activate') as activated_at, max(row(ts, event_id)) filter (effect = 'activate') as last_on, max(row(ts, event_id)) filter (effect = 'cancel') as last_off from (
      select *, last_value(case when effect = 'activate' and n = 1 then u end ignore nulls) over (partition by provider, subscription_key order by ts, event_id rows between unbounded preceding and current row) as newest from (
        select provider, subscription_key, effect, ts, event_id, u, row_number() over (partition by provider, subscription_key, u, effect order by ts, event_id) as n
        from (select *, case when effect = 'activate' then matched_user_id end as u from hooks_routed where effect <> 'none') a) b) c where coalesce(u, newest) is not null group by 1, 2, 3) d"""


@query("t03_subscription_state", oracle(T03_SQL))
def t03(spark, sf):
    return W.subscription_state(W.subscription_effects(_routed(spark, sf))).withColumn("activated_at", stamp("activated_at"))


@query("t03_subscription_state_stream", oracle(T03_SQL))
def t03_stream(spark, sf):
    """Each micro-batch stores its effects; a repeated delivery is the same effect and counts once."""
    events = stream_table(spark, f"{sf}/events.parquet")
    hooks = W.project_payload(spark.sql(STANDINS["webhooks"], events=events))
    routed = W.route(W.match_users(hooks.filter(F.col("provider_event_id") != ""), standin(spark, sf, "users")))
    home = query_home(spark, "subscription-effects", sf)
    stored = drain_batches(spark, routed, "subscription-effects", W.subscription_effects, home=home)
    return W.subscription_state(stored.drop("batch_id").distinct()).withColumn("activated_at", stamp("activated_at"))


cte(
    "hooks_attempt",
    """select h.*, coalesce(o.id, p.id) as attempt_id from hooks_routed h
    left join billing_payment_attempts o on o.provider = h.provider and o.provider_order_id = h.order_id
    left join billing_payment_attempts p on p.provider = h.provider and p.provider_payment_id = h.payment_id""",
)


@query(
    "j05_event_attempt_match",
    oracle("select provider, provider_event_id, order_id, payment_id, attempt_id from hooks_attempt"),
)
def j05(spark, sf):
    matched = W.match_attempts(_routed(spark, sf), standin(spark, sf, "billing_payment_attempts"))
    return matched.select("provider", "provider_event_id", "order_id", "payment_id", "attempt_id")


T04_SQL = f"""select a.id, a.user_id, case when c.attempt_id is not null then 'captured' else a.status end as status,
        coalesce(c.paid_by, a.provider_payment_id) as provider_payment_id, strftime(c.completed_at, '{TS}') as completed_at
        from billing_payment_attempts a left join (select attempt_id, min(ts) as completed_at, arg_max(payment_id, ts) as paid_by
        from hooks_attempt where effect = 'activate' and attempt_id is not null group by 1) c on c.attempt_id = a.id"""


@query("t04_attempt_state", oracle(T04_SQL))
def t04(spark, sf):
    attempts = standin(spark, sf, "billing_payment_attempts")
    matched = W.match_attempts(_routed(spark, sf), attempts)
    return W.attempt_state(attempts, matched).withColumn("completed_at", stamp("completed_at"))


@query("t04_attempt_state_stream", oracle(T04_SQL))
def t04_stream(spark, sf):
    """Micro-batches merge into a bucketed state; a repeated delivery changes nothing."""
    attempts = standin(spark, sf, "billing_payment_attempts")
    events = stream_table(spark, f"{sf}/events.parquet")
    hooks = W.project_payload(spark.sql(STANDINS["webhooks"], events=events)).filter(F.col("provider_event_id") != "")
    matched = W.match_attempts(W.route(W.match_users(hooks, standin(spark, sf, "users"))), attempts)
    home = query_home(spark, "attempt-state", sf)
    state, _ = drain_state(spark, matched, "attempt-state", ["attempt_id"], W.captures, W.merge_captures, home)
    return W.with_captures(attempts, state).withColumn("completed_at", stamp("completed_at"))


T06_SQL = f"""select id, case when stale then 'ERROR' else status end as status, stale as changed from (
    select id, status, coalesce(upper(status) = 'PROCESSING' and coalesce(processing_stage, '') <> 'completed' and updated_at <= timestamp '{AS_OF}' - interval '4' hour, false) as stale from meetings) t"""


@query("t06_stale_detection", oracle(T06_SQL))
def t06(spark, sf):
    return M.fail_stale(standin(spark, sf, "meetings"), AS_OF).select("id", "status", "changed")


# how late a row of the sample feeds may come; a window or session closes, and comes out, only
# when the newest row is that much past its end
DELAY = "1 hour"

# processing updates of a recording, one per event: the recording is the user's stream
UPDATES_SQL = """select user_id as id, ts as updated_at, case when event_type = 'view' then 'DONE' else 'PROCESSING' end as status,
    case when event_type = 'click' then 'completed' else 'transcribing' end as processing_stage from {events}"""


@query(
    "t06_stale_detection_stream",
    oracle(
        f"""select id, 'ERROR' as status, 'failed' as processing_stage, 'processing_stale' as processing_error_code,
        strftime(updated_at + interval '4' hour, '{TS}') as stale_at from (
        select user_id as id, ts as updated_at, event_type, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) t
        where (nxt is null or nxt > updated_at + interval '4' hour) and event_type not in ('view', 'click')
        and updated_at + interval '4' hour <= (select max(ts) - interval '1' hour from events)"""
    ),
)
def t06_stream(spark, sf):
    events = stream_table(spark, f"{sf}/events.parquet")
    updates = spark.sql(UPDATES_SQL, events=events).withColumn(
        "updated_at", F.col("updated_at").cast("timestamp")
    )
    stale = J.silent_sessions(updates, delay=DELAY)
    return drain_append(spark, stale, "stale", query_home(spark, "stale", sf)).withColumn("stale_at", stamp("stale_at"))


T07_SQL = f"""select strftime(w, '{TS}') as window_start, requests, errors, round(errors / requests, 6) as error_share, errors / requests > 0.05 and requests / 3600.0 > 0.001 as firing from (
    select time_bucket(interval '1 hour', ts) as w, count(*) as requests, count(*) filter (status like '5%') as errors from http_requests group by 1) t"""


@query("t07_error_rate_alert", oracle(T07_SQL))
def t07(spark, sf):
    # the sample feed is thin, so the window is an hour and the volume line low
    out = alerts.error_rate(standin(spark, sf, "http_requests"), "1 hour", min_rate=0.001)
    return out.withColumn("window_start", stamp("window_start"))


@query("t07_error_rate_alert_stream", oracle(T07_SQL + " where w + interval '1' hour <= (select max(ts) - interval '1' hour from http_requests)"))
def t07_stream(spark, sf):
    events = stream_table(spark, f"{sf}/events.parquet")
    requests = spark.sql(STANDINS["http_requests"], events=events).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    fired = alerts.error_rate(requests, "1 hour", min_rate=0.001, delay=DELAY)
    return drain_append(spark, fired, "error-rate", query_home(spark, "error-rate", sf)).withColumn("window_start", stamp("window_start"))


@query("t07_error_rate_corrected_stream", oracle(T07_SQL))
def t07_corrected(spark, sf):
    """Windows as a state that late rows correct, so all windows equal the batch result."""
    events = stream_table(spark, f"{sf}/events.parquet")
    requests = spark.sql(STANDINS["http_requests"], events=events).withColumn("ts", F.col("ts").cast("timestamp"))
    counts, _ = drain_state(
        spark, requests, "window-counts", ["window_start"], lambda batch: alerts.window_counts(batch, "1 hour"), alerts.merge_counts,
        query_home(spark, "window-counts", sf), event_time="ts", delay=DELAY,
    )
    return alerts.rate_of_counts(counts, "1 hour", min_rate=0.001).withColumn("window_start", stamp("window_start"))


@query(
    "t07_error_rate_sliding",
    oracle(
        f"""select strftime(w, '{TS}') as window_start, requests, errors, round(errors / requests, 6) as error_share, errors / requests > 0.05 and requests / 3600.0 > 0.001 as firing from (
        select time_bucket(interval '15 minutes', ts) - s * interval '15' minute as w, count(*) as requests, count(*) filter (status like '5%') as errors
        from http_requests, (select unnest([0, 1, 2, 3]) as s) k group by 1) t"""
    ),
)
def t07_sliding(spark, sf):
    out = alerts.error_rate(standin(spark, sf, "http_requests"), "1 hour", "15 minutes", min_rate=0.001)
    return out.withColumn("window_start", stamp("window_start"))


@query(
    "t08_latency_alert",
    oracle(
        f"""select strftime(w, '{TS}') as window_start, requests, p95, p95 > 1.0 as firing from (
        select time_bucket(interval '6 hours', ts) as w, count(*) as requests, quantile_disc(duration_seconds, 0.95) as p95 from http_requests group by 1) t"""
    ),
)
def t08(spark, sf):
    out = alerts.latency_p95(standin(spark, sf, "http_requests"), "6 hours")
    return out.withColumn("window_start", stamp("window_start"))


@query(
    "t09_failure_rate_alert",
    oracle(
        f"""select queue, strftime(w, '{TS}') as window_start, failures, failures / 3600.0 > 0.001 as firing from (
        select queue, time_bucket(interval '1 hour', ended_at) as w, count(*) as failures from jobs where rq_status in ('failed','stopped','canceled','cancelled') and ended_at is not null group by 1, 2) t"""
    ),
)
def t09(spark, sf):
    out = alerts.failure_rate(standin(spark, sf, "jobs"), "1 hour", rate=0.001)
    return out.withColumn("window_start", stamp("window_start"))


@query(
    "t09_queue_backlog",
    oracle(
        f"""select queue, strftime(w, '{TS}') as window_start, net, depth, depth > 100 as firing from (
        select *, sum(net) over (partition by queue order by w) as depth from (
        select queue, time_bucket(interval '1 hour', t) as w, cast(sum(d) as bigint) as net from (
          select queue, created_at as t, 1 as d from jobs union all select queue, ended_at, -1 from jobs where ended_at is not null) x group by 1, 2) y) z"""
    ),
)
def t09_backlog(spark, sf):
    out = alerts.backlog(standin(spark, sf, "jobs"))
    return out.withColumn("window_start", stamp("window_start"))


CANON = """concat('{"kind":', json_extract_string(payload, '$.kind'), ',"user":', json_extract_string(payload, '$.user'), '}')"""


@query(
    "f23_input_hash",
    oracle(f"select id, sha256(concat(job_type, '|', {CANON}, '|v1')) as input_hash from jobs"),
)
def f23(spark, sf):
    return standin(spark, sf, "jobs").select(
        "id",
        J.input_hash(F.col("job_type"), J.canonical_json(F.col("payload"))).alias("input_hash"),
    )


@query(
    "t10_job_idempotence",
    oracle(
        f"""select job_type, input_hash, id, state as status, requests from (select *, count(*) over (partition by job_type, input_hash) as requests,
        row_number() over (partition by job_type, input_hash order by created_at, id) as rn,
        case when rq_status in ('queued','deferred','scheduled') then 'queued' when rq_status = 'started' then 'running' when rq_status = 'finished' then 'succeeded'
        when rq_status in ('failed','stopped','canceled','cancelled') then 'failed' else 'running' end as state
        from (select *, sha256(concat(job_type, '|', {CANON}, '|v1')) as input_hash from jobs) j) t where rn = 1"""
    ),
)
def t10(spark, sf):
    return J.existing_job(standin(spark, sf, "jobs"))
