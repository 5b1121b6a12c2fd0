"""Readers: tables with explicit schemas, documents as files, and text formats as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colloquy.functions.arrays import let, no_blank

# Schemas of the business tables
_L, _S, _D, _TS, _B, _I = (
    T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType(), T.IntegerType(),
)


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


SCHEMAS = {
    "users": _schema(id=_L, email=_S, first_name=_S, last_name=_S, organization_name=_S, created_at=_TS),
    "meetings": _schema(
        id=_L, title=_S, user_id=_L, status=_S, processing_stage=_S, processing_attempts=_I,
        processing_timings=T.MapType(_S, _S), processing_error_code=_S, last_error=_S,
        media_duration_seconds=_D, media_size_bytes=_L, confidential_mode=_B,
        recording_delete_status=_S, created_at=_TS, updated_at=_TS,
    ),
    "meeting_notes": _schema(
        id=_L, meeting_id=_L, raw_transcript=_S, summary=_S,
        summary_slots=_schema(
            purpose=_S, outcome=_S, edited_summary=_S, risks=T.ArrayType(_S),
            next_steps=T.ArrayType(_S), open_questions=T.ArrayType(_S),
        ),
        key_points=T.ArrayType(_S), decisions=T.ArrayType(_S), action_items=T.ArrayType(_S),
        model_version=_S, created_at=_TS,
    ),
    "upload_ledger": _schema(
        id=_S, user_id=_S, meeting_id=_S, status=_S, file_size_bytes=_L, counted_at=_TS, deleted_at=_TS
    ),
    "billing_subscriptions": _schema(
        id=_L, user_id=_L, provider=_S, plan_code=_S, status=_S, provider_subscription_id=_S,
        provider_payment_id=_S, current_period_start=_TS, current_period_end=_TS, created_at=_TS,
    ),
    "manual_billing_overrides": _schema(
        id=_L, user_id=_L, plan_code=_S, status=_S, starts_at=_TS, ends_at=_TS
    ),
    "billing_payment_attempts": _schema(
        id=_L, user_id=_L, provider=_S, status=_S, amount_cents=_L, currency_code=_S,
        provider_order_id=_S, provider_payment_id=_S, completed_at=_TS, created_at=_TS,
    ),
    "billing_events": _schema(
        provider=_S, provider_event_id=_S, event_type=_S, user_id=_L, payload_json=_S,
        processing_status=_S, created_at=_TS,
    ),
    "meeting_feedback": _schema(
        id=_L, user_id=_L, meeting_id=_L, usefulness=_S, most_useful=_S, improvement_text=_S,
        would_use_again=_S, meeting_type=_S, updated_at=_TS,
    ),
    "jobs": _schema(
        id=_S, job_type=_S, input_hash=_S, status=_S, retries=_I, created_at=_TS, started_at=_TS, ended_at=_TS
    ),
}


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet under an explicit schema; absent columns read as null."""
    return spark.read.schema(schema).parquet(path)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """S01 from a database, split on a numeric key; filters and columns are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
            numPartitions=str(parts), **options,
        )
        .load()
    )


def latest_rows(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest whole row per key, whatever the columns; reduced on the map side."""
    rest = [c for c in table.columns if c not in keys]
    picked = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*keys, "r.*")


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, whole_file: bool = True
) -> DataFrame:
    """JSON documents with the file they came from; one per file, or one per line."""
    reader = spark.read.schema(schema).option("multiLine", str(whole_file).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    docs = reader.json(path)
    return docs.withColumn("file_path", F.col("_metadata.file_path")).withColumn(
        "file_name", F.col("_metadata.file_name")
    )


def case_id_from_path(path: Column, suffix: str = "_current_notes.json") -> Column:
    """The case id is the file name without the known suffix, else without extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.endswith(suffix), F.regexp_replace(name, f"{suffix.replace('.', '[.]')}$", "")).otherwise(
        F.regexp_replace(name, r"\.[^.]*$", "")
    )


def load_manifest(manifest: DataFrame, documents: DataFrame, on: list[str]) -> DataFrame:
    """Documents that a complete manifest case refers to."""
    wanted = manifest.filter(F.col("ground_truth_status") == "complete").select(*on)
    return documents.join(wanted, on, "left_semi")


def read_texts(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """Whole text files with directory and name."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).text(path)
    full = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(full, r"([^/]+)/[^/]+$", 1).alias("dir"),
        F.col("_metadata.file_name").alias("name"),
        F.col("value").alias("text"),
    )


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of stored objects; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


# fixed values: candidate file names of a transcript, best first
TRANSCRIPT_SUFFIXES = (
    "_transcript.txt", "_transcript.md", "_source.txt", "_source.md", "_raw_transcript.txt", ".txt", ".md",
)


def _strip(name: str) -> Column:
    return F.regexp_replace(F.col(name), r"^\s+|\s+$", "")


def resolve_transcripts(embedded: DataFrame, files: DataFrame) -> DataFrame:
    """Text inside the notes, else the first non-empty candidate file, else none."""
    rank = F.lit(None).cast("int")
    for i, suffix in reversed(list(enumerate(TRANSCRIPT_SUFFIXES))):
        rank = F.when(F.col("name") == F.concat("case_id", F.lit(suffix)), F.lit(i + 1)).otherwise(rank)
    cols = ["case_id", "rank", "text", "source"]
    inside = embedded.select(
        "case_id", F.lit(0).alias("rank"), _strip("text").alias("text"), F.lit("embedded").alias("source")
    )
    found = files.withColumn("rank", rank).filter(F.col("rank").isNotNull()).select(
        "case_id", "rank", _strip("text").alias("text"), F.col("name").alias("source")
    )
    usable = inside.select(*cols).unionByName(found.select(*cols)).filter(F.coalesce("text", F.lit("")) != "")
    best = usable.groupBy("case_id").agg(F.min_by(F.struct("text", "source"), "rank").alias("b"))
    return (
        embedded.select("case_id")
        .join(best, "case_id", "left")
        .select(
            "case_id",
            F.coalesce("b.text", F.lit("")).alias("text"),
            F.coalesce("b.source", F.lit("not available")).alias("source"),
        )
    )


# ---- Markdown ------------------------------------------------------------------------------------
def markdown_table_rows(text: Column) -> Column:
    """Cells of pipe rows; rule lines and the header are dropped."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    body = F.filter(
        lines, lambda s: s.startswith("|") & ~s.contains("---") & ~s.contains("must_capture")
    )
    return F.transform(
        body,
        lambda s: F.transform(
            F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)
        ),
    )


def expected_from_markdown(text: Column) -> Column:
    """Must-capture rows of six cells as (owner, action, deadline, evidence, notes)."""
    good = F.filter(
        markdown_table_rows(text),
        lambda r: (F.size(r) >= 6)
        & (F.lower(F.get(r, F.lit(0))) == "yes")
        & ~F.lower(F.get(r, F.lit(2))).rlike("^tbd"),
    )
    return F.transform(
        good,
        lambda r: F.struct(
            *[F.get(r, F.lit(i + 1)).alias(n) for i, n in enumerate(("owner", "action", "deadline", "evidence", "notes"))]
        ),
    )


# fixed values: bullets that are metadata
META_BULLETS = (
    "capture type", "meeting id", "status", "source endpoint", "source file",
    "duration seconds", "expected absent", "model version",
)
EMPTY_BULLETS = ("", "none", "n/a", "no action items", "no actions")


def section_bullets(text: Column, section: str) -> Column:
    """Bullets under '## section', without checkbox marks and metadata."""

    def cut(lines: Column) -> Column:
        heads = F.transform(
            lines,
            lambda s: s.startswith("## ") & (F.lower(F.trim(F.regexp_replace(s, "^#+", ""))) == section.lower()),
        )
        start = F.array_position(heads, F.lit(True)).cast("int")

        def body(p: Column) -> Column:
            rest = F.slice(lines, p + 1, F.size(lines))
            return let(
                rest,
                lambda r: let(
                    F.array_position(F.transform(r, lambda s: s.startswith("#")), F.lit(True)).cast("int"),
                    lambda q: F.when(q > 0, F.slice(r, F.lit(1), q - 1)).otherwise(r),
                ),
            )

        return let(start, lambda p: F.when(p > 0, body(p)).otherwise(F.slice(lines, 1, 0)))

    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    marked = F.filter(let(lines, cut), lambda s: s.startswith("-") | s.startswith("*"))
    clean = F.transform(
        marked,
        lambda s: F.regexp_replace(
            F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*[-*]\s*", ""), r"^\[[ xX]\]\s*", "")), r"\.+$", ""
        ),
    )
    return F.filter(
        clean,
        lambda b: ~F.lower(F.trim(b)).isin(*EMPTY_BULLETS)
        & ~F.lower(b).rlike("^(?:" + "|".join(META_BULLETS) + "):"),
    )


def last_json_block(text: Column) -> Column:
    """The last fenced JSON block that parses to an object, as a map of raw values."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)\n```"), F.lit(1))
    parsed = F.filter(
        blocks,
        lambda b: F.coalesce(F.schema_of_variant(F.try_parse_json(b)).startswith("OBJECT"), F.lit(False)),
    )
    return F.element_at(F.when(F.size(parsed) > 0, parsed), -1)


def actions_after(text: Column) -> Column:
    """Action items of the block, else of its objects, else bullets of the section."""
    block = last_json_block(text)
    shape = "struct<action_items:array<string>,action_item_objects:array<struct<text:string,owner:string,task:string>>>"

    def pick(p: Column) -> Column:
        objects = F.transform(
            p["action_item_objects"],
            lambda o: F.when(F.coalesce(o["text"], F.lit("")) != "", F.trim(o["text"]))
            .when(
                (F.coalesce(o["owner"], F.lit("")) != "") & (F.coalesce(o["task"], F.lit("")) != ""),
                F.concat(o["owner"], F.lit(" - "), o["task"]),
            )
            .otherwise(F.coalesce(o["task"], F.lit(""))),
        )
        return (
            F.when(p["action_items"].isNotNull(), no_blank(F.transform(p["action_items"], lambda s: F.trim(s))))
            .when(p["action_item_objects"].isNotNull(), no_blank(objects))
            .otherwise(section_bullets(text, "action items"))
        )

    return let(F.from_json(block, shape), pick)


def gather_directories(files: DataFrame, nothing: str = "No readable content found.") -> DataFrame:
    """The text files of each directory in name order, joined by blank lines."""
    readable = F.col("name").rlike(r"\.(txt|md)$")
    # .txt files come before .md files
    part = F.struct((~F.col("name").endswith(".txt")).alias("late"), "name", "text")
    grouped = files.groupBy("dir").agg(F.sort_array(F.collect_list(F.when(readable, part))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return grouped.select("dir", F.when(F.size("parts") > 0, text).otherwise(nothing).alias("text"))
