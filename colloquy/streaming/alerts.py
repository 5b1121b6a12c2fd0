"""Windowed rates over request and job feeds; the same code serves batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: alert thresholds
ERROR_SHARE = 0.05
MIN_RATE = 0.1
LATENCY_P95 = 1.0
FAILURE_RATE = 0.1
BACKLOG = 100


def _window(ts: str, length: str, step: str | None) -> Column:
    return F.window(ts, length, step) if step else F.window(ts, length)


def _seconds(length: str) -> int:
    n, unit = length.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def error_rate(
    requests: DataFrame,
    length: str = "5 minutes",
    step: str | None = None,
    min_rate: float = MIN_RATE,
    delay: str | None = None,
) -> DataFrame:
    """Share of 5xx answers per window, firing above the share and the volume line.

    A stream names the ``delay`` after which a row counts as lost; a window comes out when the
    newest row is that far past its end, so the last windows of a feed stay open.
    """
    requests = requests.withWatermark("ts", delay) if delay else requests
    out = requests.groupBy(_window("ts", length, step).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status").startswith("5")).alias("errors")
    )
    share = F.col("errors") / F.col("requests")
    return out.select(
        F.col("w.start").alias("window_start"),
        "requests",
        "errors",
        F.round(share, 6).alias("error_share"),
        ((share > ERROR_SHARE) & (F.col("requests") / _seconds(length) > min_rate)).alias("firing"),
    )


def window_counts(requests: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Requests and errors per window, as a state that merges by sums."""
    return requests.groupBy(F.window("ts", length)["start"].alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status").startswith("5")).alias("errors")
    )


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_start").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))


def rate_of_counts(counts: DataFrame, length: str = "5 minutes", min_rate: float = MIN_RATE) -> DataFrame:
    """T07 from window counts, late rows and windows still open with them."""
    share = F.col("errors") / F.col("requests")
    firing = (share > ERROR_SHARE) & (F.col("requests") / _seconds(length) > min_rate)
    return counts.select("window_start", "requests", "errors", F.round(share, 6).alias("error_share"), firing.alias("firing"))


def latency_p95(
    requests: DataFrame, length: str = "5 minutes", step: str | None = None, accuracy: int = 100000
) -> DataFrame:
    """95th percentile per window; the sketch keeps state bounded at any volume."""
    out = requests.groupBy(_window("ts", length, step).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.percentile_approx("duration_seconds", 0.95, accuracy).alias("p95"),
    )
    return out.select(
        F.col("w.start").alias("window_start"),
        "requests",
        "p95",
        (F.col("p95") > LATENCY_P95).alias("firing"),
    )


def failure_rate(jobs: DataFrame, length: str = "5 minutes", rate: float = FAILURE_RATE) -> DataFrame:
    """Failed jobs per queue and window, as a rate."""
    failed = F.col("rq_status").isin("failed", "stopped", "canceled", "cancelled")
    out = (
        jobs.filter(failed & F.col("ended_at").isNotNull())
        .groupBy("queue", F.window("ended_at", length).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )
    return out.select(
        "queue",
        F.col("w.start").alias("window_start"),
        "failures",
        (F.col("failures") / _seconds(length) > rate).alias("firing"),
    )


def backlog(jobs: DataFrame, length: str = "1 hour", threshold: int = BACKLOG) -> DataFrame:
    """Queue depth at the end of each window.

    Arrivals and departures are first summed per window; the running sum then goes over
    windows, whose number depends on the time span and not on the volume.
    """
    moves = jobs.select("queue", F.col("created_at").alias("at"), F.lit(1).alias("delta")).unionAll(
        jobs.filter(F.col("ended_at").isNotNull()).select(
            "queue", F.col("ended_at").alias("at"), F.lit(-1).alias("delta")
        )
    )
    net = moves.groupBy("queue", F.window("at", length).alias("w")).agg(F.sum("delta").alias("net"))
    running = Window.partitionBy("queue").orderBy("window_start")
    return (
        net.select("queue", F.col("w.start").alias("window_start"), "net")
        .withColumn(
            "depth",
            F.sum("net").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .withColumn("firing", F.col("depth") > threshold)
    )
