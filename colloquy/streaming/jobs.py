"""Job idempotence and the stale-meeting detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.meetings import queue_state

VERSION = 1


def input_hash(job_type: Column, canonical_json: Column) -> Column:
    """dedupe key of a job: type, canonical payload and version."""
    return F.sha2(F.concat(job_type, F.lit("|"), canonical_json, F.lit(f"|v{VERSION}")), 256)


def canonical_json(payload: Column) -> Column:
    """A flat JSON object as compact text with sorted keys; values keep their own spelling."""
    entries = F.sort_array(
        F.map_entries(F.from_json(payload, "map<string,string>", {"primitivesAsString": "true"}))
    )
    pairs = F.transform(
        entries,
        lambda e: F.concat(
            F.lit('"'),
            e["key"],
            F.lit('":'),
            F.when(
                e["value"].rlike(r"^-?\d+(\.\d+)?$|^true$|^false$|^null$"), e["value"]
            ).otherwise(F.concat(F.lit('"'), e["value"], F.lit('"'))),
        ),
    )
    return F.concat(F.lit("{"), F.concat_ws(",", F.coalesce(pairs, F.array().cast("array<string>"))), F.lit("}"))


def existing_job(jobs: DataFrame) -> DataFrame:
    """The first job of each (type, input hash); later requests get that job back."""
    keyed = jobs.withColumn("input_hash", input_hash(F.col("job_type"), canonical_json(F.col("payload"))))
    first = F.min_by(F.struct("id", "rq_status", "created_at"), F.struct("created_at", "id"))
    return (
        keyed.groupBy("job_type", "input_hash")
        .agg(first.alias("j"), F.count(F.lit(1)).alias("requests"))
        .select(
            "job_type",
            "input_hash",
            F.col("j.id").alias("id"),
            queue_state(F.col("j.rq_status")).alias("status"),
            "requests",
        )
    )


def silent_sessions(updates: DataFrame, gap: str = "4 hours", delay: str | None = None) -> DataFrame:
    """T06 as a stream: a session of updates that stays silent for ``gap`` while processing.

    The session closes when the watermark passes its end, which is exactly "no update for
    four hours" once rows later than ``delay`` are ruled out; Spark keeps the timers.
    """
    updates = updates.withWatermark("updated_at", delay) if delay else updates
    closed = updates.groupBy("id", F.session_window("updated_at", gap).alias("w")).agg(
        F.max_by(F.struct("status", "processing_stage"), "updated_at").alias("last")
    )
    stale = (F.upper(F.col("last.status")) == "PROCESSING") & (
        F.coalesce(F.col("last.processing_stage"), F.lit("")) != "completed"
    )
    return closed.filter(stale).select(
        "id",
        F.lit("ERROR").alias("status"),
        F.lit("failed").alias("processing_stage"),
        F.lit("processing_stale").alias("processing_error_code"),
        F.col("w.end").alias("stale_at"),
    )
