"""Meeting status, listing, timing and diagnostic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.accounts import at

# fixed values: status vocabularies, stage labels, error texts
COMPLETED = ("complete", "completed", "done", "success", "succeeded")
FAILED = ("error", "failed", "failure")
PROCESSING = ("in_progress", "processing", "summarizing", "transcribing")
QUEUED = ("queued",)
STUCK_AFTER_MINUTES = 45
STALE_AFTER_SECONDS = 4 * 60 * 60
STAGE_LABELS = {
    "uploaded": "Upload received",
    "validating_media": "Checking the recording",
    "processing_audio": "Preparing audio",
    "transcribing": "Transcribing audio",
    "generating_notes": "Generating notes",
    "finalizing": "Finalizing notes",
    "completed": "Notes ready",
    "failed": "Processing failed",
}
QUEUE_STATES = {
    "queued": "queued",
    "deferred": "queued",
    "scheduled": "queued",
    "started": "running",
    "finished": "succeeded",
    "failed": "failed",
    "stopped": "failed",
    "canceled": "failed",
    "cancelled": "failed",
}
GENERIC_ERROR = "We could not process this recording. Please check the file format and try again."
TIMEOUT_ERROR = "Processing took longer than expected. Please try again or contact support."
STALE_ERROR = (
    "Processing took longer than expected. Please retry processing. "
    "If it fails again, contact support and include this Meeting ID."
)
TRANSCRIPTION_ERROR = "Transcription failed. Please try a shorter or clearer recording."
STAGE_PAIRS = {
    "media_validation_seconds": ("media_validation_started_at", "media_validation_completed_at"),
    "audio_conversion_seconds": ("audio_conversion_started_at", "audio_conversion_completed_at"),
    "transcription_seconds": ("transcription_started_at", "transcription_completed_at"),
    "notes_generation_seconds": ("notes_generation_started_at", "notes_generation_completed_at"),
    "quality_engine_seconds": ("quality_engine_started_at", "quality_engine_completed_at"),
    "finalization_seconds": ("finalization_started_at", "finalization_completed_at"),
}


def lookup(value: Column, table: dict[str, str], default: str) -> Column:
    """A fixed-size dictionary as a literal map (no join, no shuffle)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def normalized_status(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.when(status != "", status), F.lit("unknown"))))


def status_bucket(status: Column) -> Column:
    """The four admin buckets, else 'other'."""
    s = normalized_status(status)
    return (
        F.when(s.isin(*COMPLETED), "completed")
        .when(s.isin(*FAILED), "failed")
        .when(s.isin(*PROCESSING), "processing")
        .when(s.isin(*QUEUED), "queued")
        .otherwise("other")
    )


def queue_state(status: Column) -> Column:
    return lookup(status, QUEUE_STATES, "running")


def progress_label(stage: Column) -> Column:
    return lookup(F.lower(F.trim(F.coalesce(stage, F.lit("")))), STAGE_LABELS, "Processing")


def is_stuck(status: Column, updated_at: Column, as_of: str) -> Column:
    """Queued or processing and silent for 45 minutes; an unknown time is not stuck."""
    cutoff = at(as_of) - F.expr(f"interval {STUCK_AFTER_MINUTES} minutes")
    return F.coalesce(
        normalized_status(status).isin(*(QUEUED + PROCESSING)) & (updated_at < cutoff),
        F.lit(False),
    )


def is_stale(
    status: Column, stage: Column, updated_at: Column, as_of: str, seconds: int = STALE_AFTER_SECONDS
) -> Column:
    cutoff = at(as_of) - F.expr(f"interval {seconds} seconds")
    return F.coalesce(
        (F.upper(status) == "PROCESSING")
        & (F.coalesce(stage, F.lit("")) != "completed")
        & (updated_at <= cutoff),
        F.lit(False),
    )


def fail_stale(meetings: DataFrame, as_of: str, seconds: int = STALE_AFTER_SECONDS) -> DataFrame:
    """One guard rewrites status, stage and error columns together."""
    stale = is_stale(
        F.col("status"), F.col("processing_stage"), F.col("updated_at"), as_of, seconds
    )
    marked = meetings.withColumn("stale", stale)
    return marked.select(
        "id",
        F.when(F.col("stale"), "ERROR").otherwise(F.col("status")).alias("status"),
        F.when(F.col("stale"), "failed").otherwise(F.col("processing_stage")).alias(
            "processing_stage"
        ),
        F.when(F.col("stale"), "processing_stale").alias("processing_error_code"),
        F.when(F.col("stale"), STALE_ERROR).alias("last_error"),
        F.col("stale").alias("changed"),
    )


def error_class(text: Column, stage: Column) -> tuple[Column, Column]:
    """(code, message a user may see); timeout beats transcription beats generic."""
    t = F.lower(F.coalesce(text, F.lit("")))
    timeout = t.contains("timeout") | t.contains("timed out")
    speech = (F.lower(F.coalesce(stage, F.lit(""))) == "transcribing") | t.contains("transcrib")
    code = (
        F.when(timeout, "processing_timeout")
        .when(speech, "transcription_failed")
        .otherwise("processing_failed")
    )
    message = (
        F.when(timeout, TIMEOUT_ERROR).when(speech, TRANSCRIPTION_ERROR).otherwise(GENERIC_ERROR)
    )
    return code, message


def redact(text: Column, limit: int | None = 1000) -> Column:
    """Hide keys, tokens, bearer values and paths in the whole text, then cap a diagnostic."""
    out = F.regexp_replace(text, r"(?i)(api[_-]?key|token|secret|password)=\S+", "$1=[redacted]")
    out = F.regexp_replace(out, r"(?i)bearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r"/(?:Users|private|tmp|var|opt|home)/[^\s,;:]+", "[path]")
    out = F.regexp_replace(out, r"[A-Za-z]:\\[^\s,;:]+", "[path]")
    return out if limit is None else F.substring(out, 1, limit)


def mask_email(email: Column) -> Column:
    """Keep one or two leading characters of the local part."""
    value = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    local = F.substring_index(value, "@", 1)
    domain = F.regexp_extract(value, r"^[^@]*@(.*)$", 1)
    shown = F.when(F.length(local) > 2, F.substring(local, 1, 2)).otherwise(
        F.substring(local, 1, 1)
    )
    usable = value.contains("@") & (local != "") & (domain != "")
    return F.when(usable, F.concat(shown, F.lit("***@"), domain)).otherwise("")


def storage_key(uri: Column) -> Column:
    """Object key of a stored recording; a web address has none."""
    value = F.trim(uri)
    key = (
        F.when(value.startswith("s3://"), F.regexp_extract(value, r"^s3://[^/?#]*([^?#]*)", 1))
        .when(value.rlike("^https?://"), F.lit(""))
        .otherwise(value)
    )
    return F.nullif(F.regexp_replace(key, "^/+", ""), F.lit(""))


def file_name(path: Column) -> Column:
    """the last path segment."""
    return F.element_at(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), -1)


def status_counts(meetings: DataFrame) -> DataFrame:
    """A01."""
    return meetings.groupBy(normalized_status(F.col("status")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


def overview(meetings: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Every count of the overview from one scan of the meetings."""
    now = at(as_of)
    bucket = status_bucket(F.col("status"))
    created = F.col("created_at")

    def since(days: int) -> Column:
        return F.count_if(created >= now - F.expr(f"interval {days} days"))

    counted = meetings.agg(
        F.count(F.lit(1)).alias("total_meetings"),
        F.count_if(created >= F.date_trunc("day", now).cast("timestamp_ntz")).alias(
            "meetings_today"
        ),
        since(7).alias("meetings_last_7_days"),
        since(30).alias("meetings_last_30_days"),
        F.count_if(bucket == "completed").alias("completed"),
        F.count_if(bucket == "failed").alias("failed"),
        F.count_if(bucket == "processing").alias("processing"),
        F.count_if(bucket == "queued").alias("queued"),
        F.count_if(
            F.lower(F.col("status")).isin(*(QUEUED + PROCESSING))
            & (F.col("updated_at") < now - F.expr(f"interval {STUCK_AFTER_MINUTES} minutes"))
        ).alias("stuck"),
    )
    finished = F.col("completed") + F.col("failed")
    rated = counted.withColumn(
        "success_rate_percent",
        F.when(finished > 0, F.round(100.0 * F.col("completed") / finished, 1)),
    )
    return rated.withColumn("total_users", users.agg(F.count(F.lit(1))).scalar())


def with_user_email(meetings: DataFrame, users: DataFrame) -> DataFrame:
    """Left join; AQE splits a hot user's partition, the user side stays one row per key."""
    return meetings.join(
        users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")),
        "user_id",
        "left",
    )


def search(meetings: DataFrame, status: str | None, term: str | None) -> DataFrame:
    """Status equality and a case-insensitive term in title or email."""
    out = meetings
    if status:
        out = out.filter(F.lower(F.col("status")) == status.strip().lower())
    if term:
        pattern = f"%{term.strip()}%"
        out = out.filter(F.col("title").ilike(pattern) | F.col("user_email").ilike(pattern))
    return out


def page(meetings: DataFrame, limit: int, offset: int) -> DataFrame:
    """Newest first, ties by id."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    return (
        meetings.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
        .offset(offset)
        .limit(limit)
    )


def first_boundaries(stage_events: DataFrame) -> DataFrame:
    """First time of each boundary, latest stage, number of attempts, per meeting."""
    keys = [
        "media_validation_started_at",
        "audio_conversion_started_at",
        "transcription_started_at",
        "notes_generation_started_at",
        "finalization_started_at",
        "processing_completed_at",
        "processing_failed_at",
    ]
    return stage_events.groupBy("meeting_id").agg(
        *[F.min(F.when(F.col("boundary") == k, F.col("happened_at"))).alias(k) for k in keys],
        F.max_by("stage", F.struct("happened_at", "seq", "stage")).alias("processing_stage"),
        F.count_if(F.col("stage") == "validating_media").alias("processing_attempts"),
    )


def seconds_between(started: Column, finished: Column) -> Column:
    """Difference of two time strings in seconds, 3 decimals, null when either is unreadable."""
    a = F.try_to_timestamp(started)
    b = F.try_to_timestamp(finished)
    return F.round((F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6), 3)


def stage_durations(meetings: DataFrame, timings: str) -> DataFrame:
    """Six stage durations and the total from a map of time strings, wide form."""
    t = F.col(timings)
    started = F.coalesce(t["upload_received_at"], t["media_validation_started_at"])
    finished = F.coalesce(t["processing_completed_at"], t["processing_failed_at"])
    return meetings.select(
        "id",
        *[seconds_between(t[a], t[b]).alias(label) for label, (a, b) in STAGE_PAIRS.items()],
        seconds_between(started, finished).alias("processing_total_seconds"),
    )


def labelled_counters(events: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    """A22."""
    amount = F.sum(value if value is not None else F.lit(1))
    return events.groupBy(*labels).agg(amount.alias("total"))


def latency_summary(events: DataFrame, labels: list[str], seconds: str) -> DataFrame:
    """A23."""
    return events.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(seconds), 4).alias("sum_seconds"),
        F.round(F.avg(seconds), 6).alias("avg_seconds"),
    )


def duration_histogram(
    jobs: DataFrame, buckets: tuple[float, ...] = (5, 10, 30, 60, 120, 300, 600)
) -> DataFrame:
    """Jobs by type and status, with cumulative counts per duration bound."""
    spent = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    secs = spent / F.lit(1e6)
    return jobs.groupBy("job_type", queue_state(F.col("rq_status")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(secs), 3).alias("sum_seconds"),
        *[F.count_if(secs <= float(b)).alias(f"le_{int(b)}") for b in buckets],
    )


def object_listing(files: DataFrame, path: str, size: str, at_col: str) -> DataFrame:
    """Objects with the meeting taken from the first key segment; folders are skipped."""
    return files.filter(~F.col(path).endswith("/")).select(
        F.element_at(F.split(F.col(path), "/"), 1).alias("meeting_id"),
        F.col(path).alias("key"),
        file_name(F.col(path)).alias("filename"),
        F.col(size).alias("size"),
        F.col(at_col).alias("last_modified"),
    )


def objects_per_meeting(objects: DataFrame) -> DataFrame:
    """A25."""
    return objects.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("slides_count"), F.max("last_modified").alias("last_slide_at")
    )


def retention(meetings: DataFrame) -> DataFrame:
    """Which recordings are due for deletion and the state each row takes."""
    due = (
        F.col("confidential_mode")
        & (status_bucket(F.col("status")) == "completed")
        & (F.col("recording_delete_status") == "pending")
    )
    key = storage_key(F.col("raw_media_path"))
    return meetings.select(
        "id",
        due.alias("due"),
        F.when(due, key).alias("delete_key"),
        F.when(due & key.isNull(), "failed")
        .otherwise(F.col("recording_delete_status"))
        .alias("recording_delete_status"),
        F.when(due & key.isNull(), "No recording path was available for deletion.").alias(
            "recording_delete_error"
        ),
    )
