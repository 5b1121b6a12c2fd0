"""Run a streaming frame to completion over the files present, into a table.

Output and checkpoint of a stream lie under one folder.  Given a folder, a later run goes on where
the last one stopped: files that were read are not read again, and the output holds what all runs
together have written.  Without one, each call is a run of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.session import fresh_path, shared_dir


def stream_home(spark: SparkSession, label: str, source: str) -> str:
    """The folder of a named stream over a source: the same for every run of it."""
    return f"{shared_dir(spark)}/streams/{label}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"


def query_home(spark: SparkSession, label: str, source: str) -> str:
    """The folder of a registered query's stream: that of the run which ``spark.colloquy.streamRun``
    names, or a new one, so that a call covers the whole table as it is now."""
    named = spark.conf.get("spark.colloquy.streamRun", "")
    return stream_home(spark, label, f"{source}\n{named}") if named else fresh_path(spark, label)


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a stream, with the schema of the files.

    The path is given as a glob that matches only itself: the file source then takes a
    single file as well as a folder of files.
    """
    glob = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(glob)


def drain_append(spark: SparkSession, stream: DataFrame, label: str, home: str | None = None) -> DataFrame:
    """Append-mode run into a parquet table; exactly once through the checkpoint in ``home``."""
    home = home or fresh_path(spark, label)
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{home}/out")
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def drain_batches(
    spark: SparkSession,
    stream: DataFrame,
    label: str,
    apply: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    home: str | None = None,
) -> DataFrame:
    """foreachBatch run; each batch overwrites its own folder, so a retried batch is harmless."""
    home = home or fresh_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    run = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def drain_new_keys(
    spark: SparkSession,
    stream: DataFrame,
    label: str,
    keys: list[str],
    first: Callable[[DataFrame], DataFrame],
    home: str | None = None,
) -> DataFrame:
    """Insert-if-absent against everything stored so far: a key is unique for ever, however late
    it comes again.  ``first`` picks one row per key of a batch.

    A retried batch compares with the other batches' folders only, so it writes what it wrote.
    """
    home = home or fresh_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = first(batch)
        if batch_id:
            stored = spark.read.schema(f"batch_id long, {stored_ddl(new, keys)}").parquet(f"{home}/out")
            old = stored.where(f"batch_id < {batch_id}").select(*keys).distinct()
            new = new.join(old, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out").drop("batch_id")


def stored_ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
