"""Keyed state of streams: merged per batch, late rows kept aside, retried batches."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from colloquy.streaming import alerts
from colloquy.streaming.runner import stream_table
from colloquy.streaming.state import KeyedState, drain_state

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, status string"


def minutes(*at):
    return [(T0 + timedelta(minutes=m), "500" if m % 3 == 0 else "200") for m in at]


def counted(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_with_late_rows_equal_the_batch_result(spark, tmp_path):
    feed, home = str(tmp_path / "feed"), str(tmp_path / "home")
    files = [minutes(*range(0, 30)), minutes(*range(25, 90)), minutes(3, 4, 100, 59, 61, 3), [], minutes(62, 101, 9), [(None, "200")]]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = stream_table(spark, feed, files_per_batch=1)
        counts, late = drain_state(
            spark, stream, "counts", ["window_start"], lambda b: alerts.window_counts(b, "10 minutes"), alerts.merge_counts,
            home, buckets=4, event_time="ts", delay="30 minutes",
        )
    whole = spark.read.schema(SCHEMA).parquet(feed)
    assert counted(counts) == counted(alerts.window_counts(whole, "10 minutes"))
    # newest before the third file is minute 89, before the fifth minute 100
    assert counted(late) == sorted(minutes(3, 4, 3, 62, 9))


def test_reading_costs_the_state_and_not_the_history(spark, tmp_path):
    home = str(tmp_path / "home")
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    state = KeyedState(spark, home, ["k"], lambda b: b.groupBy("k").agg(F.count("*").alias("n")), merge, buckets=3)
    want, files = {}, []
    for at in range(8):
        keys = [at % 3, 7, None]
        batch = spark.createDataFrame([(k,) for k in keys], "k int").coalesce(1)
        state.apply(batch, at)
        for k in keys:
            want[k] = want.get(k, 0) + 1
        if at in (4, 7):
            state.apply(batch, at)  # a retried batch
        files.append(len(list(Path(home).rglob("*.parquet"))))
    assert {r["k"]: r["n"] for r in state.rows(state.pointer(7), "k int, n long").collect()} == want
    assert max(files[3:]) <= files[2] + 3 and len(state.pointer(7).versions) <= 3
    # a batch reads and writes only the buckets of its keys
    one = spark.createDataFrame([(7,)], "k int")
    before = state.pointer(7).versions
    state.apply(one, 8)
    assert sum(before[b] != v for b, v in state.pointer(8).versions.items()) == 1


def test_state_of_an_empty_feed(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([], SCHEMA).write.parquet(feed)
    counts, late = drain_state(spark, stream_table(spark, feed), "none", ["window_start"], alerts.window_counts, alerts.merge_counts, event_time="ts", delay="1 hour")
    assert counts.count() == 0 and late.count() == 0
