"""Session settings and the shared scratch folder.

Nothing here forces a cluster layout: a session handed in by the caller is used as it
is.  ``local_session`` is only for tests, the bench and the command line.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("colloquy")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's own setting, else a test folder.

    Checkpoints and intermediate tables go here, so a lost executor costs a re-read and
    never a recomputation from the start.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="colloquy-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never used by another run."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
