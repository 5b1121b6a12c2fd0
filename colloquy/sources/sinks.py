"""Sinks: files, replace by key, upsert, insert-if-absent, cascade delete, partial update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """S11."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))


def create_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    with_bucket(df, key, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_by_key(
    spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int, staging: str
) -> None:
    """Rows of the keys in ``new`` are replaced; only their buckets are rewritten.

    The result is staged first, so a bucket is never read and overwritten in one job and a
    lost executor can always re-read its input.
    """
    fresh = with_bucket(new, key, buckets)
    touched = fresh.select("bucket").distinct()
    old = spark.read.parquet(path)
    # at most ``buckets`` rows, so the broadcast is bounded
    same = old.join(F.broadcast(touched), "bucket", "left_semi")
    kept = same.join(new.select(key).distinct(), key, "left_anti")
    kept.unionByName(fresh).write.mode("overwrite").parquet(staging)
    swap_buckets(spark, staging, path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the newest; new rows win over old ones of the same time."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "gen")).alias("r"))
    return best.select(*keys, "r.*")


def upsert_into(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str], bucket_key: str, buckets: int, staging: str
) -> None:
    """S14 in storage: only the buckets that get new rows are rewritten, by way of a staged copy."""
    fresh = with_bucket(new, bucket_key, buckets)
    touched = fresh.select("bucket").distinct()
    # at most ``buckets`` rows, so the broadcast is bounded
    same = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")
    upsert(same.select(*fresh.columns), fresh, keys, order).write.mode("overwrite").parquet(staging)
    swap_buckets(spark, staging, path)


def swap_buckets(spark: SparkSession, staging: str, path: str) -> None:
    """Overwrite the buckets that the staged table has; other buckets stay as they are."""
    writer = spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def append_absent(spark: SparkSession, path: str, new: DataFrame, keys: list[str], live: Column, order: list[str]) -> None:
    """S15 in storage: the rows that ``insert_if_absent`` lets in are appended."""
    old = spark.read.parquet(path)
    insert_if_absent(old, new, keys, live, order).select(*old.columns).write.mode("append").parquet(path)


def delete_from(
    spark: SparkSession, tables: dict[str, tuple[str, str]], deleted: DataFrame, key: str, target: str
) -> dict[str, str]:
    """S16 in storage: each stored table is written anew without the deleted keys.

    A reader keeps the old files until it is given the new paths, which this returns.
    """
    left = cascade_delete({n: (spark.read.parquet(p), c) for n, (p, c) in tables.items()}, deleted, key)
    for name, df in left.items():
        df.write.parquet(f"{target}/{name}")
    return {name: f"{target}/{name}" for name in left}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], live: Column, order: list[str]) -> DataFrame:
    """New rows whose key has no live row yet, the first per key, to be appended."""
    rest = [c for c in new.columns if c not in keys]
    first = (
        new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    )
    return first.join(old.filter(live).select(*keys).distinct(), keys, "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys; each names its own key column."""
    gone = deleted.select(key).distinct()
    return {
        name: df.join(gone.withColumnRenamed(key, col), col, "left_anti") for name, (df, col) in tables.items()
    }


def partial_update(rows: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only supplied (non-null) fields change."""
    e = edits.select(key, *[F.col(f).alias(f"e_{f}") for f in fields])
    out = rows.join(e, key, "left")
    return out.withColumns({f: F.coalesce(F.col(f"e_{f}"), F.col(f)) for f in fields}).drop(
        *[f"e_{f}" for f in fields]
    )


def section_edit(notes: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """One section per edit; edited actions empty the generated objects."""
    out = notes.join(edits.select(key, "section", "text_value", "list_value"), key, "left")
    section = F.coalesce("section", F.lit(""))
    text = F.trim(F.coalesce("text_value", F.lit("")))
    items = F.filter(
        F.transform("list_value", lambda s: F.trim(s)), lambda s: s != ""
    )
    summary = (section == "summary") & (text != "")
    return out.withColumns(
        {
            "summary": F.when(summary, text).otherwise(F.col("summary")),
            "edited_summary": F.when(summary, text),
            "key_points": F.when(section == "key_points", items).otherwise(F.col("key_points")),
            "action_items": F.when(section == "action_items", items).otherwise(F.col("action_items")),
            "action_item_objects": F.when(
                section == "action_items", F.array().cast("array<string>")
            ).otherwise(F.col("action_item_objects")),
        }
    ).drop("section", "text_value", "list_value")
