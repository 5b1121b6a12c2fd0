"""Q11: the last polish of long meetings' notes, with purpose and outcome rebuilt.

What a long meeting was for and what came of it is judged by joined evidence: transcript, summary,
slots, key points and decisions.  A slot stays if it says something specific; else the first choice
whose terms the evidence has takes its place, or the default.  Choices are arguments, as phrases
about particular recordings are no part of the library.

Everything works inside the row.  Whether a meeting is long is told by its transcript alone, so notes
that speak of long recordings do not make a short meeting one; its record comes out unchanged.  Null
texts and lists count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import head, let
from colloquy.operators import recall as R
from colloquy.plans import guards as G

LONG_CHARS = 75_000
SEEN = 8  # key points and decisions that count as evidence


@dataclass(frozen=True)
class SlotRule:
    """When a slot stays, and what takes its place.

    A choice is (groups of terms, text): it is taken if of each group some term is in the evidence.
    """

    generic: tuple[str, ...]
    specific: tuple[str, ...]
    default: str
    choices: tuple[tuple[tuple[tuple[str, ...], ...], str], ...] = ()


# fixed values: marks of slots that say nothing, marks of slots to keep, and texts in their place
PURPOSE = SlotRule(
    generic=("main priorities and next steps", "key priorities and next steps", "align on main priorities"),
    specific=("3-hour", "3 hour", "long recording", "long-recording", "processing reliability", "upload expectations"),
    default="Review long-recording support, processing reliability, upload expectations, and note-quality readiness.",
)
OUTCOME = SlotRule(
    generic=("alignment on key priorities", "aligned on key priorities", "main priorities and next steps", "subsequent actions"),
    specific=("3-hour", "3 hour", "long recording", "long-recording", "processing reliability", "quality review"),
    default="The team aligned on long-recording support, reliability risks, quality review, and customer upload expectations.",
)


def evidence(slots: tuple[str, ...] = ("purpose", "outcome")) -> Column:
    """Lower-cased text of a record: transcript, summary, slots, first key points and decisions."""

    def listed(name: str, most: int | None = None) -> Column:
        items = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.array_join(items if most is None else head(items, most), " ")

    parts = [F.coalesce(F.col(x), F.lit("")) for x in ("text", "summary", *slots)]
    lists = [listed("risks"), listed("next_steps"), listed("key_points", SEEN), listed("decisions", SEEN)]
    return F.lower(T.squash(F.concat_ws(" ", *parts, *lists)))


def rebuilt_slot(current: Column, found: Column, rule: SlotRule) -> Column:
    def chosen(s: Column) -> Column:
        made = F.lit(None).cast("string")
        for groups, text in reversed(rule.choices):
            test = F.lit(True)
            for terms in groups:
                test = test & s["found"].rlike(J.any_text(terms))
            made = F.when(test, F.lit(text)).otherwise(made)
        low = F.lower(s["now"])
        # a slot without words has no mark that would keep it
        stays = low.rlike(J.any_text(rule.specific))
        if rule.generic:
            stays = stays & ~low.rlike(J.any_text(rule.generic))
        return F.when(stays, s["now"]).otherwise(F.coalesce(made, F.lit(rule.default)))

    return let(F.struct(T.squash(F.coalesce(current, F.lit(""))).alias("now"), found.alias("found")), chosen)


def tidy_commas(c: Column) -> Column:
    """No space before a comma, and no comma before "or"."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+,", ","), r",\s+or\s+", " or ")


def polished(
    records: DataFrame,
    point_rules: tuple[R.PhraseRule, ...] = (),
    purpose: SlotRule = PURPOSE,
    outcome: SlotRule = OUTCOME,
    min_chars: int = LONG_CHARS,
) -> DataFrame:
    """Records with ``is_long``; of long ones risks, key points, purpose, outcome and summary are new."""
    c = F.col
    talk = F.coalesce(c("text"), F.lit(""))
    is_long = (F.length(talk) >= min_chars) | F.lower(talk).rlike(J.any_text(G.LONG_WORDS))
    out = records.withColumn("is_long", is_long).withColumn("_found", F.when(c("is_long"), evidence()))
    risks = F.coalesce(c("risks"), F.array().cast("array<string>"))
    points = F.coalesce(c("key_points"), F.array().cast("array<string>"))
    tidy = G.polish_risks(F.transform(risks, tidy_commas))
    more = G.points_with_rules(points, c("_found"), point_rules) if point_rules else G.polish_points(points)
    slots = {
        "purpose": F.when(c("is_long"), rebuilt_slot(c("purpose"), c("_found"), purpose)).otherwise(c("purpose")),
        "outcome": F.when(c("is_long"), rebuilt_slot(c("outcome"), c("_found"), outcome)).otherwise(c("outcome")),
        "risks": F.when(c("is_long"), tidy).otherwise(c("risks")),
        "key_points": F.when(c("is_long"), head(more, 8)).otherwise(c("key_points")),
    }
    told = F.trim(F.concat_ws(" ", "purpose", "outcome"))
    return out.withColumns(slots).withColumn("summary", F.when(c("is_long"), told).otherwise(c("summary"))).drop("_found")
