"""Keyed state of a stream in a bucketed table that each micro-batch merges into.

Keys are dealt into buckets by hash.  A batch reduces its rows to one partial row per key, reads
the buckets that its keys fall into, merges, and writes those buckets anew as a version named after
the batch; a pointer table per batch says which version of each bucket counts.  So a batch costs
its own rows and the buckets they touch, and reading costs the state, however many batches came
before.  A retried batch starts again from the pointer of the batch before it and overwrites what it
wrote, so sums count once.  What the last two pointers do not name is removed; a reader that
started before the last batch is not disturbed.

With ``event_time`` and ``delay`` rows that come later than the delay are kept aside as well: those
older than the newest row of all batches before theirs, less the delay.  They still count in the
state, so a window that was reported before is corrected.

Null keys are a key like others.  A batch without rows changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.session import fresh_path

BUCKETS = 64
POINTER = "bucket int, version long, newest long"  # the newest event time in microseconds
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pointer:
    versions: dict[int, int]
    newest: int | None = None


@dataclass(frozen=True)
class KeyedState:
    """``partial``: a batch to one row per key; ``merge``: rows of several to one row per key."""

    spark: SparkSession
    home: str
    keys: list[str]
    partial: Step
    merge: Step
    buckets: int = BUCKETS
    event_time: str | None = None
    delay: str | None = None

    def folder(self, version: int, bucket: int | None = None) -> str:
        return f"{self.home}/state/version={version}" + ("" if bucket is None else f"/bucket={bucket}")

    def pointer(self, batch: int) -> Pointer:
        """What counts after a batch; there is nothing before the first."""
        if batch < 0:
            return Pointer({})
        rows = self.spark.read.schema(POINTER).parquet(f"{self.home}/pointer/batch={batch}").collect()  # a row per bucket
        return Pointer({r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, max((r["newest"] for r in rows if r["newest"] is not None), default=None))

    def rows(self, pointer: Pointer, ddl: str, only: set[int] | None = None) -> DataFrame:
        paths = [self.folder(v, b) for b, v in sorted(pointer.versions.items()) if only is None or b in only]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def apply(self, batch: DataFrame, at: int) -> None:
        """Merge a micro-batch into the state."""
        before = self.pointer(at - 1)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = before.newest
        if self.event_time:
            newest = self.set_aside(batch, at, before.newest)
        reduced = self.partial(batch)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reduced.schema)
        path = f"{self.home}/reduced/batch={at}"
        reduced.withColumn("bucket", bucket).write.mode("overwrite").parquet(path)
        staged = self.spark.read.schema(f"{ddl}, bucket int").parquet(path)
        touched = {r["bucket"] for r in staged.select("bucket").distinct().collect()}  # at most ``buckets``
        if touched:
            old = self.rows(before, ddl, touched)
            merged = self.merge(old.unionByName(staged.drop("bucket"))).select(*reduced.columns)
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder(at))
        versions = before.versions | dict.fromkeys(touched, at)
        rows = [(b, v, newest) for b, v in versions.items()] or [(None, None, newest)]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/pointer/batch={at}")
        self.remove_unnamed(at)

    def set_aside(self, batch: DataFrame, at: int, newest: int | None) -> int | None:
        """Write the late rows of a batch; the newest event time up to and with it."""
        late = F.lit(False) if newest is None else F.col(self.event_time) < F.timestamp_micros(F.lit(newest)) - F.expr(f"interval {self.delay}")
        batch.where(late).write.mode("overwrite").parquet(f"{self.home}/late/batch={at}")
        mine = batch.agg(F.unix_micros(F.max(self.event_time)).alias("t")).first()["t"]
        return max((t for t in (newest, mine) if t is not None), default=None)

    def remove_unnamed(self, at: int) -> None:
        """Versions that pointer ``at - 1`` had replaced: neither it nor ``at`` names them.

        The older pointer goes last, so a batch that is tried again finds it or has nothing left to do.
        """
        older = f"{self.home}/pointer/batch={at - 2}"
        if at < 2 or not exists(self.spark, older):
            return
        gone, kept = self.pointer(at - 2).versions, self.pointer(at - 1).versions
        old = [self.folder(v, b) for b, v in gone.items() if kept.get(b) != v]
        for path in [*old, f"{self.home}/reduced/batch={at - 1}", older]:
            fs, where = located(self.spark, path)
            fs.delete(where, True)


def located(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = located(spark, path)
    return fs.exists(where)


def last_batch(spark: SparkSession, home: str) -> int:
    """The batch of the newest pointer, or -1."""
    fs, where = located(spark, f"{home}/pointer/batch=*/_SUCCESS")
    found = fs.globStatus(where) or []
    return max((int(re.search(r"batch=(\d+)/", str(f.getPath()))[1]) for f in found), default=-1)


def drain_state(
    spark: SparkSession,
    stream: DataFrame,
    label: str,
    keys: list[str],
    partial: Step,
    merge: Step,
    home: str | None = None,
    buckets: int = BUCKETS,
    event_time: str | None = None,
    delay: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(state, late rows) after the files present; late rows only with an event time."""
    home = home or fresh_path(spark, label)
    state = KeyedState(spark, home, keys, partial, merge, buckets, event_time, delay)
    run = (
        stream.writeStream.foreachBatch(state.apply)
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in partial(stream).schema)
    found = state.rows(state.pointer(last_batch(spark, home)), ddl)
    if not event_time:
        return found, None
    late = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    if last_batch(spark, home) < 0:
        return found, spark.createDataFrame([], late)
    return found, spark.read.schema(late).option("recursiveFileLookup", True).parquet(f"{home}/late")
