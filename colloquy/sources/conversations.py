"""Transcripts from tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PART_TURNS = 500
PARTS = 1_000_000


def conversation_transcripts(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(doc_id, text): turns (conv_id, turn, role, text) joined in order as 'Role: text'.

    A transcript holds at most ``part_turns`` turn numbers; a longer conversation becomes several,
    so that no conversation, however long, has to fit into one row.
    """
    said = F.concat(F.initcap(F.coalesce("role", F.lit(""))), F.lit(": "), F.trim(F.coalesce("text", F.lit(""))))
    part = F.floor(F.col("turn") / part_turns).cast("long")
    grouped = turns.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["said"]), " ")
    return grouped.select((F.col("conv_id") * PARTS + F.col("part")).alias("doc_id"), text.alias("text"))

