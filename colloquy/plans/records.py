"""The notes record: one row per meeting with its transcript and list fields as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.arrays import no_blank

LISTS = ("key_points", "decisions", "risks", "open_questions", "next_steps", "action_items")


def as_list(c: Column, mark: str = r"\|") -> Column:
    return no_blank(F.split(F.coalesce(c, F.lit("")), mark))


def notes_records(raw: DataFrame) -> DataFrame:
    """List fields from '|' separated text to arrays."""
    return raw.withColumns({c: as_list(F.col(c)) for c in LISTS})
