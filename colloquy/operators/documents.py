"""Free-form JSON: text leaves, values by key, first non-empty field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values
SKIPPED_KEYS = ("id", "meeting_id", "audio_file", "transcript_file", "source_metadata_file")
TEXT_FIELDS = ("action", "task", "text", "description", "title", "summary")


def first_text(item: Column, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """The first non-empty of several fields of a struct."""
    return F.coalesce(*[F.nullif(item[f], F.lit("")) for f in fields], F.lit(""))


NODES = "array<struct<keys:array<string>,v:variant>>"
LEAVES = "array<struct<keys:array<string>,text:string>>"


def leaf_array(payload: str) -> Column:
    """Every text leaf of a JSON column with the object keys on its way, at any depth.

    One fold inside the row: a step opens one layer of all that is still open.  There are at most
    as many layers as opening brackets, and a step that finds nothing open does no work.
    """
    kind = "schema_of_variant(n.v)"
    return F.expr(f"""
        aggregate(
          sequence(0, length({payload}) - length(translate({payload}, '{{[', ''))),
          named_struct(
            'open', filter(array(named_struct('keys', cast(array() as array<string>), 'v', try_parse_json({payload}))), n -> n.v is not null),
            'done', cast(array() as {LEAVES})),
          (s, i) -> if(size(s.open) = 0, s, named_struct(
            'open', flatten(transform(s.open, n -> case
              when {kind} like 'OBJECT%' then transform(map_entries(cast(n.v as map<string,variant>)),
                e -> named_struct('keys', concat(n.keys, array(lower(e.key))), 'v', e.value))
              when {kind} like 'ARRAY%' then transform(cast(n.v as array<variant>), x -> named_struct('keys', n.keys, 'v', x))
              else cast(array() as {NODES}) end)),
            'done', concat(s.done, transform(
              filter(s.open, n -> not ({kind} like 'OBJECT%' or {kind} like 'ARRAY%')),
              n -> named_struct('keys', n.keys, 'text', cast(n.v as string)))))),
          s -> filter(s.done, l -> l.text is not null))""")


def under(leaf: Column, keys: tuple[str, ...]) -> Column:
    return F.arrays_overlap(leaf["keys"], F.array(*[F.lit(k) for k in keys]))


def flatten_text(df: DataFrame, key: str, payload: str, skipped: tuple[str, ...] = SKIPPED_KEYS) -> DataFrame:
    """Leaves that lie under no id key."""
    kept = F.filter("leaves", lambda leaf: ~under(leaf, skipped))
    rows = df.withColumn("leaves", leaf_array(payload)).select(key, F.explode_outer(kept).alias("leaf"))
    return rows.where("leaf is not null").select(key, "leaf.text")


def collect_by_key(df: DataFrame, key: str, payload: str, accepted: tuple[str, ...]) -> DataFrame:
    """Leaves under an accepted key, or all leaves of a document that has none."""
    hit = F.exists("leaves", lambda leaf: under(leaf, accepted))
    kept = F.filter("leaves", lambda leaf: under(leaf, accepted) | ~F.col("hit"))
    rows = df.withColumn("leaves", leaf_array(payload)).withColumn("hit", hit)
    return rows.select(key, F.explode_outer(kept).alias("leaf")).where("leaf is not null").select(key, "leaf.text")
