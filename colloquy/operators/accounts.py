"""Plans, quotas, usage and billing over users, ledger rows and subscriptions.

Per-user state is always reached by a partial aggregate (``max_by``/``count_if``), so a
user who owns a third of the rows is reduced on the map side before any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: plan codes and limits
FREE_TRIAL = "free_trial"
ACTIVE_STATUSES = ("active", "trialing", "paid")
STARTER_CODES = ("paid_pro", "starter")
PRO_PILOT = "pro_pilot"
BUSINESS_CODES = ("business", "team", "premium", "custom", "enterprise")
CONFIDENTIAL_CODES = ("pro_pilot", "business", "team", "premium", "custom", "enterprise")
SUCCESSFUL_ATTEMPTS = ("captured", "succeeded", "completed", "paid")
FAILED_ATTEMPTS = ("failed", "canceled", "cancelled", "error")
UPLOAD_EXTENSIONS = (".mp3", ".mp4", ".m4a", ".wav", ".webm", ".ogg", ".flac")
MAX_UPLOAD_BYTES = 24 * 1024 * 1024


@dataclass(frozen=True)
class Limits:
    """Plan limits and the two per-email overrides (fixed values by default)."""

    free_uploads: int = 1
    free_seconds: int = 30 * 60
    pilot_uploads: int = 3
    pilot_seconds: int = 60 * 60
    starter_uploads: int = 20
    starter_seconds: int = 60 * 60
    pro_uploads: int = 100
    pro_seconds: int = 120 * 60
    business_uploads: int = 300
    business_seconds: int = 180 * 60
    long_test_seconds: int = 305 * 60
    pilot_emails: tuple[str, ...] = field(default=())
    long_test_emails: tuple[str, ...] = field(default=())


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def norm_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def _newest_valid(rows: DataFrame, statuses: tuple[str, ...], end: str, as_of: str) -> DataFrame:
    """Per user, the row with the highest id among those of a status and not yet ended."""
    current = rows.filter(
        F.col("status").isin(*statuses) & (F.col(end).isNull() | (F.col(end) >= at(as_of)))
    )
    picked = F.max_by(F.struct(*rows.columns), "id").alias("r")
    return current.groupBy("user_id").agg(picked)


def effective_plan(
    users: DataFrame, subscriptions: DataFrame, overrides: DataFrame, as_of: str
) -> DataFrame:
    """Override beats subscription beats free trial, each the newest valid by id."""
    sub = _newest_valid(subscriptions, ACTIVE_STATUSES, "current_period_end", as_of)
    man = _newest_valid(overrides, ("active",), "ends_at", as_of)
    joined = (
        users.select(F.col("id").alias("user_id"), "email")
        .join(man.withColumnRenamed("r", "m"), "user_id", "left")
        .join(sub.withColumnRenamed("r", "s"), "user_id", "left")
    )
    has_m, has_s = F.col("m").isNotNull(), F.col("s").isNotNull()
    return joined.select(
        "user_id",
        "email",
        F.when(has_m, F.col("m.plan_code"))
        .when(has_s, F.col("s.plan_code"))
        .otherwise(FREE_TRIAL)
        .alias("plan_code"),
        F.when(has_m, F.col("m.status"))
        .when(has_s, F.col("s.status"))
        .otherwise(FREE_TRIAL)
        .alias("billing_status"),
        F.when(has_m, F.lit("manual")).when(has_s, F.col("s.provider")).alias("provider"),
        F.when(has_m, F.col("m.ends_at"))
        .when(has_s, F.col("s.current_period_end"))
        .alias("current_period_end"),
        F.when(has_m, F.lit("manual_override"))
        .when(has_s, F.lit("subscription"))
        .otherwise("default")
        .alias("source"),
    )


def _by_plan(plan: Column, starter: int, pro: int, business: int) -> Column:
    """The starter and pro codes match exactly, the business codes in any case."""
    return (
        F.when(plan.isin(*STARTER_CODES), F.lit(starter))
        .when(plan == PRO_PILOT, F.lit(pro))
        .when(F.lower(F.trim(plan)).isin(*BUSINESS_CODES), F.lit(business))
    )


def plan_limits(plans: DataFrame, limits: Limits) -> DataFrame:
    """Upload and duration limits per user from the plan and the email overrides."""
    mail = norm_email(F.col("email"))
    pilot = mail.isin(*limits.pilot_emails) if limits.pilot_emails else F.lit(False)
    long_test = mail.isin(*limits.long_test_emails) if limits.long_test_emails else F.lit(False)
    plan = F.col("plan_code")
    monthly = _by_plan(plan, limits.starter_uploads, limits.pro_uploads, limits.business_uploads)
    seconds = _by_plan(plan, limits.starter_seconds, limits.pro_seconds, limits.business_seconds)
    base = F.coalesce(
        seconds, F.when(pilot, limits.pilot_seconds).otherwise(limits.free_seconds)
    )
    return plans.select(
        "user_id",
        "email",
        "plan_code",
        F.coalesce(pilot, F.lit(False)).alias("is_pilot"),
        monthly.alias("monthly_limit"),
        F.coalesce(
            monthly, F.when(pilot, limits.pilot_uploads).otherwise(limits.free_uploads)
        ).alias("upload_limit"),
        F.when(long_test, F.greatest(base, F.lit(limits.long_test_seconds)))
        .otherwise(base)
        .alias("max_duration_seconds"),
        F.lower(F.trim(plan)).isin(*CONFIDENTIAL_CODES).alias("can_use_confidential"),
    )


def ledger_usage(
    ledger: DataFrame, as_of: str, exclude_meeting: str | None = None
) -> DataFrame:
    """A04 and A05 in one pass: live counted rows per user, ever and since the month start."""
    live = ledger.filter(F.col("counted_at").isNotNull() & F.col("deleted_at").isNull())
    if exclude_meeting is not None:
        live = live.filter(F.col("meeting_id") != exclude_meeting)
    month_start = F.date_trunc("month", at(as_of)).cast("timestamp_ntz")
    return live.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("used_ever"),
        F.count_if(F.col("counted_at") >= month_start).alias("used_this_month"),
    )


def _with_usage(limits_df: DataFrame, usage: DataFrame) -> DataFrame:
    keyed = usage.select(
        F.col("user_id").cast("long").alias("user_id"), "used_ever", "used_this_month"
    )
    used = F.when(F.col("monthly_limit").isNotNull(), F.col("used_this_month")).otherwise(
        F.col("used_ever")
    )
    return limits_df.join(keyed, "user_id", "left").withColumn(
        "meetings_used", F.coalesce(used, F.lit(0))
    )


def quota_decision(limits_df: DataFrame, usage: DataFrame) -> DataFrame:
    """May the user add a meeting, and which limit says no."""
    allowed = F.col("meetings_used") < F.col("upload_limit")
    return _with_usage(limits_df, usage).select(
        "user_id",
        "plan_code",
        "meetings_used",
        "upload_limit",
        allowed.alias("allowed"),
        F.when(allowed, "")
        .when(F.col("monthly_limit").isNotNull(), "monthly_limit_reached")
        .otherwise("free_trial_limit_reached")
        .alias("reason"),
    )


def usage_dashboard(limits_df: DataFrame, usage: DataFrame) -> DataFrame:
    """What a user sees about plan, use and room left."""
    return _with_usage(limits_df, usage).select(
        "user_id",
        F.when(F.col("monthly_limit").isNotNull(), F.col("plan_code"))
        .when(F.col("is_pilot"), "pilot")
        .otherwise(FREE_TRIAL)
        .alias("plan"),
        "is_pilot",
        "meetings_used",
        "upload_limit",
        F.greatest(F.lit(0), F.col("upload_limit") - F.col("meetings_used")).alias(
            "remaining_uploads"
        ),
        "max_duration_seconds",
        F.floor(F.col("max_duration_seconds") / 60).cast("long").alias("max_duration_minutes"),
    )


def file_extension(name: Column) -> Column:
    """Lower-case suffix of the last path segment, '' when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/\\.][^/\\]*?(\.[^./\\\s]+)$", 1))


def upload_gate(uploads: DataFrame, limits_df: DataFrame) -> DataFrame:
    """P10: accept or refuse an upload; the first failing test names the reason."""
    joined = uploads.join(
        limits_df.select("user_id", "max_duration_seconds", "can_use_confidential"),
        "user_id",
        "left",
    )
    limit = F.coalesce(F.col("max_duration_seconds"), F.lit(Limits().free_seconds))
    reason = (
        F.when(
            F.col("confidential_mode")
            & ~F.coalesce(F.col("can_use_confidential"), F.lit(False)),
            "confidential_not_allowed",
        )
        .when(F.col("media_size_bytes") > MAX_UPLOAD_BYTES, "too_large")
        .when(~file_extension(F.col("media_filename")).isin(*UPLOAD_EXTENSIONS), "bad_type")
        .when(F.col("media_duration_seconds").isNull(), "duration_unknown")
        .when(F.col("media_duration_seconds") > limit, "too_long")
        .otherwise("")
    )
    return joined.select(
        "id", "user_id", reason.alias("reason"), (reason == "").alias("accepted")
    )


def billing_overview(subscriptions: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row of billing counts; each table is scanned once."""
    active = F.col("status").isin(*ACTIVE_STATUSES)
    subs = subscriptions.agg(
        F.count_distinct(F.when(active, F.col("user_id"))).alias("active_paid_users"),
        F.count_if(active).alias("active_subscriptions"),
        F.count(F.lit(1)).alias("total_subscriptions"),
    )
    status = F.col("status")
    counts = {
        "total_payment_attempts": F.count(F.lit(1)),
        "successful_payment_attempts": F.count_if(status.isin(*SUCCESSFUL_ATTEMPTS)),
        "failed_payment_attempts": F.count_if(status.isin(*FAILED_ATTEMPTS)),
    }
    # one-row aggregates come in as scalar subqueries, never as a join
    return subs.withColumns({name: attempts.agg(n).scalar() for name, n in counts.items()})


def newest_with_email(rows: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The newest rows and their users' emails.

    The top n are cut first; both broadcasts are bounded by n, so the user table is
    filtered where it lies and never shuffled.
    """
    top = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
    owners = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    wanted = owners.join(F.broadcast(top.select("user_id").distinct()), "user_id", "left_semi")
    return top.join(F.broadcast(wanted), "user_id", "left")


def grant_overrides(overrides: DataFrame, grants: DataFrame, cancels: DataFrame) -> DataFrame:
    """Append granted overrides, then cancel the newest active one of each listed user."""
    merged = overrides.unionByName(grants)
    newest = (
        merged.filter(F.col("status") == "active")
        .join(cancels.select("user_id").distinct(), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.max("id").alias("cancel_id"))
    )
    flagged = merged.join(newest, "user_id", "left")
    return flagged.withColumn(
        "status",
        F.when(F.col("id") == F.col("cancel_id"), "canceled").otherwise(F.col("status")),
    ).drop("cancel_id")
