"""Clean a legacy notes record: summary, points and actions by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import text as T
from colloquy.functions.arrays import let
from colloquy.operators import points as P


def legacy_clean(records: DataFrame) -> DataFrame:
    c = F.col

    def tidy(name: str):
        filled = F.filter(c(name), lambda s: F.trim(s) != "")
        return F.transform(filled, T.sentence_clean)

    points = P.dedupe_texts(tidy("key_points"), 8)
    good = F.filter(
        P.dedupe_texts(tidy("action_items"), 7), lambda a: T.action_confidence(a) >= 2
    )
    # one action alone must be a sure one
    actions = let(
        good,
        lambda g: F.when(
            (F.size(g) == 1) & (T.action_confidence(F.get(g, F.lit(0))) < 3), F.slice(g, 1, 0)
        ).otherwise(g),
    )
    summary = T.sentence_clean(F.coalesce(c("summary"), F.lit("")))
    out = records.withColumns({"key_points": points, "action_items": actions, "summary": summary})
    return out.withColumn(
        "summary",
        F.when(c("summary") != "", c("summary")).otherwise(P.build_summary(c("key_points"))),
    )
