"""Word lists as a table a user can replace, folded back to literals when a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions import lexicons as L

MAX_ENTRIES = 20_000


def lexicon_frame(spark: SparkSession) -> DataFrame:
    """Every built-in flat list as (name, pos, entry)."""
    rows = [
        (name, i, entry)
        for name, value in sorted(vars(L).items())
        if name.isupper() and isinstance(value, tuple)
        for i, entry in enumerate(value)
    ]
    return spark.createDataFrame(rows, "name string, pos int, entry string")


def load_lexicons(table: DataFrame, version: int | None = None) -> dict[str, tuple[str, ...]]:
    """Lists by name.  The size is checked before anything is brought to the driver.

    A table with a column ``version`` holds each list as it was and is: of each name the newest
    version counts, or the newest that is not past the one asked for.  A null entry stands for
    no entry, so a list can be replaced by an empty one.
    """
    if "version" in table.columns:
        known = table if version is None else table.where(F.col("version") <= version)
        newest = known.groupBy("name").agg(F.max("version").alias("version"))
        table = known.join(newest, ["name", "version"])
    n = table.limit(MAX_ENTRIES + 1).count()
    if n > MAX_ENTRIES:
        raise ValueError(f"a lexicon table may hold at most {MAX_ENTRIES} entries")
    lists: dict[str, list[str]] = {}
    for row in table.orderBy("name", "pos").select("name", F.col("entry")).collect():
        lists.setdefault(row["name"], []).extend([] if row["entry"] is None else [row["entry"]])
    return {name: tuple(entries) for name, entries in lists.items()}
