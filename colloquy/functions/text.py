"""Column functions over one text value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from colloquy.functions import lexicons as L, patterns as J
from colloquy.functions.arrays import let, no_blank

EDGE = r"[ \-–—•\t]+"
EDGE_V1 = r"[ \-•\t]+"


def squash(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed; single spaces are left untouched."""
    return F.trim(F.regexp_replace(c, J.LOOSE, " "))


def strip_edges(c: Column, chars: str = EDGE) -> Column:
    return J.replace(c, f"^{chars}|{chars}$", "")


def clean(c: Column) -> Column:
    """Squash, then strip bullets and dashes from the ends."""
    return strip_edges(squash(c))


def clean_slot(c: Column) -> Column:
    return squash(strip_edges(c, EDGE_V1))


def words(c: Column) -> Column:
    # a split would compile its pattern for every text
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_any(c: Column, cues) -> Column:
    """Lower-cased text contains any of the literal cues."""
    return F.lower(c).rlike(J.any_text(L.shortest(cues)))


def matches_any(c: Column, patterns) -> Column:
    return F.lower(c).rlike(J.ahead(L.any_of(patterns)))


def first_group(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern`` or null."""
    return F.nullif(F.regexp_extract(c, J.ahead(pattern), group), F.lit(""))


def first_of(c: Column, patterns, group: int = 0) -> Column:
    """First match of the first pattern that matches (ordered), or null."""
    return F.coalesce(*[first_group(c, f"(?i){p}", group) for p in patterns])


def capital_first(c: Column) -> Column:
    return let(c, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2147483647)))


# ---- keys and token sets -----------------------------------------------------------------
def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), J.NOT_ALNUM_RUN, "")


def spaced_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), J.NOT_ALNUM_RUN, " "))


def merge_key(c: Column) -> Column:
    """Letters, digits and single spaces."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(c)), J.NOT_ALNUM_SPACE_RUN, ""), J.LOOSE, " "
    )


def content_key(c: Column) -> Column:
    """Spaced key without articles, prepositions and today/tomorrow."""
    found = F.split(F.regexp_replace(F.lower(c), J.NOT_ALNUM_RUN, " "), " ")
    return F.array_join(F.filter(found, lambda w: ~w.isin("", *L.V3_KEY_STOP)), " ")


def token_set(c: Column, pattern: str, stop, min_len: int = 1) -> Column:
    """Distinct lower-case tokens, stop words and short ones removed, in text order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    # array_except would build a set of the stop words for every text
    tests = [lambda t: F.length(t) >= min_len] * (min_len > 1) + [lambda t: ~t.isin(*stop)] * (len(stop) > 0)
    return F.array_distinct(F.filter(found, lambda t: reduce(Column.__and__, [test(t) for test in tests])) if tests else found)


def sorted_token_key(c: Column, stop=L.SIGNAL_STOP, min_len: int = 2) -> Column:
    return F.array_join(F.sort_array(token_set(c, "[a-z0-9]+", stop, min_len)), " ")


def stripped_tokens(c: Column, stop=L.MERGE_STOP) -> Column:
    """Space-separated tokens without the punctuation at their ends."""
    mark = r".,:;!?()\[\]{}"
    found = words(F.lower(c))
    # a line end that closes a token is passed over by '$'
    odd = reduce(Column.__or__, [c.contains(x) for x in J.LINE_ENDS if x not in J.WHITE])
    bare = F.when(odd, F.transform(found, lambda w: F.regexp_replace(w, f"^[{mark}]+|[{mark}]+$", ""))).otherwise(
        F.transform(found, lambda w: F.btrim(w, F.lit(".,:;!?()[]{}")))
    )
    return F.array_distinct(F.filter(bare, lambda w: ~w.isin("", *stop)))


def point_tokens(c: Column) -> Column:
    return token_set(c, "[a-z0-9']+", L.POINT_STOP, 3)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set, 0 when either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def recall(expected: Column, actual: Column) -> Column:
    """Shared tokens over the expected set, 1 when nothing is expected."""
    n = F.size(expected)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(expected, actual)) / n)


def text_similarity(a: Column, b: Column, stop=L.MERGE_STOP) -> Column:
    """F05 with containment: 1 when one normalized text holds the other, else token overlap."""
    left, right = F.lower(squash(a)), F.lower(squash(b))
    blank = (left == "") | (right == "")
    inside = F.contains(right, left) | F.contains(left, right)
    return (
        F.when(blank, F.lit(0.0))
        .when(inside, F.lit(1.0))
        .otherwise(overlap(stripped_tokens(a, stop), stripped_tokens(b, stop)))
    )


# ---- normalization -----------------------------------------------------------------------
def noise_normalize(c: Column) -> Column:
    """typographic marks, acronym and phrase spellings, noise marks, pipes, spaces."""
    out = F.translate(c, "’‘“”–—\u00a0", "''\"\"-- ")
    for table in (L.ACRONYMS, L.NOISE_PHRASES):
        for source, target in table.items():
            out = F.regexp_replace(out, "(?i)" + L.any_text([source]), target)
    for pattern, target in L.SPACED_ACRONYMS.items():
        out = F.regexp_replace(out, f"(?i){pattern}", target)
    for pattern in L.NOISE:
        out = F.regexp_replace(out, f"(?i){pattern}", " ")
    out = F.regexp_replace(out, r"[|]+", ". ")
    return F.coalesce(squash(out), F.lit(""))


def whitespace_normalize(c: Column) -> Column:
    """one line-end form, single spaces, at most one blank line."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


RARE_NOISE = r"(?i)(?=[adot,])(?:, agreed|also us to|decision|to will)"


def strip_speaker_noise(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?i)^(?:and|but|so)\s+", "")
    out = F.regexp_replace(
        out, r"^(?:[A-Z][a-z]+,\s*){1,3}(?=[A-Z]?[a-z]+\s+(?:will|should|can|needs?\s+to|to))", ""
    )
    out = F.regexp_replace(out, r"^(?:[A-Z][a-z]+,\s*)+", "")

    def rare(s: Column) -> Column:
        s = F.regexp_replace(s, r"(?i)^(?:[A-Z][a-z]+,\s*)?Decision\s+\d+[,\s:-]*", "")
        s = J.replace(s, r"(?i)\bto will\b", "will")
        s = J.replace(s, r"(?i)\bI would also us to confirm\b", "We should confirm")
        return F.regexp_replace(s, r"(?i)\b[A-Z][a-z]+, agreed\.?$", "")

    # one search tells the many texts that hold none of the words
    out = let(out, lambda s: F.when(s.rlike(RARE_NOISE), rare(s)).otherwise(s))
    return J.replace(out, r"^[ ,.\-]+|[ ,.\-]+$", "")


def sentence_clean(c: Column) -> Column:
    """drop fillers and speaker noise, tidy punctuation, start with a capital."""
    out = J.replace(squash(c), L.FILLERS, "")
    # of white space only spaces are left: of a run one stays, and none before a mark
    out = F.regexp_replace(F.trim(strip_speaker_noise(out)), r" +(?=[ ,.;:!?])", "")
    return let(
        strip_edges(out, EDGE_V1),
        lambda s: F.when(F.substring(s, 1, 1).between("a", "z"), capital_first(s)).otherwise(s),
    )


# ---- deadlines and owners ----------------------------------------------------------------
def deadline_chunk(c: Column) -> Column:
    """F08, chunk dialect."""
    return F.coalesce(F.trim(first_of(c, L.CHUNK_DEADLINES)), F.lit(L.CHUNK_NO_DEADLINE))


def deadline_v3(c: Column) -> Column:
    """F08, third-engine dialect."""

    def body(t: Column) -> Column:
        low = F.lower(t)
        found = F.coalesce(
            first_group(t, r"(?i)\bby\s+([A-Z][A-Za-z]+|\w+day|tomorrow|today|next week|end of week)\b"),
            first_group(t, r"(?i)\bbefore\s+([A-Z][A-Za-z]+|\w+day|launch|demo|next week)\b"),
            F.when(low.rlike(J.ahead(r"\btoday\b")), "today"),
            F.when(low.rlike(J.ahead(r"\btomorrow\b")), "tomorrow"),
            F.when(low.rlike(J.ahead(r"\bnext week\b")), "next week"),
            F.when(low.contains("today"), "today"),
            F.lit(L.V3_NO_DEADLINE),
        )
        return F.when(low.rlike("(?=[bnt])(?:by|before|today|tomorrow|next week)"), found).otherwise(L.V3_NO_DEADLINE)

    return let(clean(c), body)


def deadline_slot(c: Column) -> Column:
    """F08, slot dialect: null when none."""
    return first_of(c, L.SLOT_DUE)


def deadline_local(c: Column) -> Column:
    """F08, local dialect: the day or span alone."""
    return F.coalesce(
        first_group(c, r"(?i)\bby\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 1),
        first_group(
            c,
            r"(?i)\b(tomorrow|next week|next month|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
            1,
        ),
    )


def deadline_point(c: Column) -> Column:
    return first_group(c, f"(?i){L.DEADLINE}")


SPEAKER_CHUNK = r"^(Speaker\s+[A-Z]|[A-Z][A-Za-z0-9_-]+):\s*(.+)$"
SPEAKER_V3 = r"^([A-Z][A-Za-z .'-]{1,40})\s*:\s*(.+)$"
# the same without steps back over the name, which never help: no ':' is part of it
SPEAKER_V3_ONCE = SPEAKER_V3.replace("{1,40}", "{1,40}+")


def clean_action(c: Column) -> Column:
    return F.regexp_replace(squash(c), r"[ .;]+$", "")


def owner_action_chunk(statement: Column) -> Column:
    """F10, chunk dialect: struct(owner, action) by speaker, first person, name or nobody."""

    def body(parts: Column) -> Column:
        speaker, text = parts["speaker"], parts["body"]
        first = F.regexp_extract(text, r"(?i)\b(?:i will|i'll|i can|i should)\s+(.+)", 1)
        named = (
            r"(?i)\b([A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)?|Speaker\s+[A-Z])\s+"
            r"(will|should|needs to|need to|must|has to|have to|can)\s+(.+)"
        )
        name, task = F.regexp_extract(text, named, 1), F.regexp_extract(text, named, 3)
        nobody = F.regexp_extract(
            text, r"(?i)\b(?:we need to|we should|need to|needs to|action item:?|follow up to)\s+(.+)", 1
        )
        said_by = F.when(speaker != "", speaker).otherwise("Unassigned")
        owner = (
            F.when(first != "", said_by)
            .when(
                task != "",
                F.when(F.lower(F.trim(name)).isin(*L.GENERIC_SUBJECTS), "Unassigned").otherwise(
                    F.trim(name)
                ),
            )
            .when(nobody != "", "Unassigned")
            .otherwise(said_by)
        )
        action = (
            F.when(first != "", first)
            .when(task != "", task)
            .when(nobody != "", nobody)
            .otherwise(text)
        )
        return F.struct(owner.alias("owner"), clean_action(action).alias("action"))

    spoken = F.regexp_extract(statement, SPEAKER_CHUNK, 1)
    parts = F.struct(
        F.trim(spoken).alias("speaker"),
        F.trim(
            F.when(spoken != "", F.regexp_extract(statement, SPEAKER_CHUNK, 2)).otherwise(statement)
        ).alias("body"),
    )
    return let(parts, body)


def owner_v3(c: Column) -> Column:
    """F10, third-engine dialect: a display name, 'Team' or 'Unassigned'."""
    value = F.trim(F.regexp_replace(clean(c), r"(?i)^(owner|assignee)\s*:\s*", ""))

    def named(s: Column) -> Column:
        low = F.lower(s)
        return (
            F.when(low.isin("", *L.V3_GENERIC_OWNERS, *L.V3_NOT_OWNERS), "Unassigned")
            .when(low.isin("team", "the team"), "Team")
            .otherwise(capital_first(s))
        )

    return let(value, named)


def owner_slot(c: Column) -> Column:
    return F.coalesce(*[first_group(c, p, 1) for p in L.SLOT_OWNERS])


def owner_local(c: Column) -> Column:
    return F.coalesce(
        first_group(c, r"\b([A-Z][a-z]+)\s+will\s+", 1),
        first_group(c, r"\b([A-Z][a-z]+)\s+to\s+", 1),
        first_group(c, r"\bowner[:\-]\s*([A-Z][a-z]+)\b", 1),
        F.when(F.lower(c).rlike(J.ahead(r"\bteam\s+will\b")), "Team"),
    )


def owner_signal(c: Column) -> Column:
    name = first_group(c, L.SIGNAL_NAME, 1)
    return F.when(~F.lower(name).isin(*L.SIGNAL_NOT_NAMES), F.trim(name))


# ---- scores ------------------------------------------------------------------------------
def when1(test: Column, points: float) -> Column:
    return F.when(test, F.lit(points)).otherwise(F.lit(0 if isinstance(points, int) else 0.0))


def topic(c: Column) -> Column:
    """First topic whose patterns match, else 'general'."""

    low = F.lower(c)
    # one search for all of them tells the texts that have none
    out = F.when(~low.rlike(J.any_word_start(p for patterns in L.TOPICS.values() for p in patterns)), "general")
    for name, patterns in L.TOPICS.items():
        out = out.when(low.rlike(J.ahead(L.any_of(patterns))), name)
    return out.otherwise("general")


def key_point_score(c: Column) -> Column:
    """F18."""

    def body(s: Column) -> Column:
        text, low, n, about = s["text"], s["low"], s["n"], s["topic"]
        commas = F.length(text) - F.length(F.replace(text, F.lit(",")))
        return (
            F.when(n.between(8, 28), 3).when(n.between(6, 35), 1).otherwise(-2)
            + when1(commas > 3, -2)
            + when1(low.rlike(J.any_text(L.NARRATIVE)), -1)
            + when1(low.rlike(J.ahead(L.any_of(L.OBJECTIVE))), -5)
            + when1(
                low.rlike(J.ahead(r"\b(decide|plan|pilot|demo|summary|action items|landing page|outreach|runtime|timeout|risk)\b")),
                2,
            )
            + F.when(about.isin("status", "pilot", "risk", "decision"), 2)
            .when(about.isin("demo", "quality"), 1)
            .otherwise(0)
            + when1(
                text.rlike(J.ahead(r"^(Team|[A-Z][a-z]+)\s+(will|should|needs?\s+to)\b"))
                & ~about.isin("decision", "risk"),
                -3,
            )
            + when1(low.rlike(J.ahead(r"\baction item clean up\b|\bdeeper summarization tuning\b")), -2)
        )

    return let(
        F.struct(
            c.alias("text"),
            F.lower(c).alias("low"),
            word_count(c).alias("n"),
            topic(c).alias("topic"),
        ),
        body,
    )


def action_score(c: Column) -> Column:
    """F19."""

    def body(s: Column) -> Column:
        text, low, n = s["text"], s["low"], s["n"]
        return (
            when1(low.rlike(J.ahead(L.any_of(L.COMMITMENTS))), 2)
            + when1(low.rlike(J.any_text(L.TASK_VERBS)), 2)
            + when1(low.rlike(J.ahead(L.DEADLINE)), 1)
            + when1(low.rlike(J.ahead(r"^(i|we|team)\b")), 1)
            + when1(text.rlike(J.ahead(r"^[A-Z][a-z]+\s+(will|should|needs?\s+to)\b")), 3)
            + when1(low.rlike(J.any_text(L.NARRATIVE)), -3)
            + when1(low.rlike(J.ahead(r"\b(was|were|had|found|said|looked|remarked)\b")), -1)
            + when1((n < 4) | (n > 24), -1)
        )

    return let(
        F.struct(c.alias("text"), F.lower(c).alias("low"), word_count(c).alias("n")), body
    )


def action_confidence(c: Column) -> Column:
    """F21, integer dialect for a finished action line."""
    low, n = F.lower(c), word_count(c)
    return (
        when1(c.rlike(J.ahead(L.STRONG_ACTION)), 2)
        + when1(c.rlike(J.ahead(r"^(team|speaker|[A-Z][a-z]+)\s*-\s*")), 1)
        + when1(low.rlike(J.ahead(L.DEADLINE)), 1)
        + when1(low.rlike(J.ahead(L.WEAK_ACTION)), -2)
        + when1((n < 4) | (n > 26), -1)
    )


def confidence_label(owner: Column, statement: Column) -> Column:
    """F21, chunk dialect: high, medium or low."""
    owned = owner != "Unassigned"
    return (
        F.when(owned & has_any(statement, (" will ", " should ", " needs to ")), "high")
        .when(owned, "medium")
        .otherwise("low")
    )


# ---- action lines ------------------------------------------------------------------------
def format_action_line(c: Column) -> Column:
    """F24, encode: 'Owner - task (due: x)' from a cleaned sentence."""

    def body(s: Column) -> Column:
        text, due = s["text"], s["due"]
        owner = F.when(F.lower(text).rlike(J.ahead(r"^i\b")), "Speaker").when(
            F.lower(text).rlike(J.ahead(r"^(we|team|let's)\b")), "Team"
        )
        task = F.trim(
            F.regexp_replace(
                text,
                r"(?i)^(let's|we should|we need to|we will|we'll|i will|i'll|please)\s+",
                "",
            )
        )
        cut = F.when(
            due.isNotNull(),
            F.regexp_replace(
                F.regexp_replace(task, F.concat(F.lit(r"(?i)\Q"), due, F.lit(r"\E")), F.lit("")),
                r"^[ ,.\-]+|[ ,.\-]+$",
                "",
            ),
        ).otherwise(task)
        low = F.concat(F.lower(F.substring(cut, 1, 1)), F.substring(cut, 2, 2147483647))
        bare = F.regexp_replace(low, r"[. ]+$", "")
        return F.trim(
            F.concat(
                F.coalesce(F.concat(owner, F.lit(" - ")), F.lit("")),
                bare,
                F.coalesce(F.concat(F.lit(" (due: "), due, F.lit(")")), F.lit("")),
            )
        )

    return let(F.struct(c.alias("text"), deadline_point(c).alias("due")), body)


def parse_action_line(c: Column) -> Column:
    """F24, decode: struct(owner, task, due) with null for a part that is missing."""
    line = r"^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$"
    text = F.trim(c)
    return F.struct(
        first_group(text, line, 1).alias("owner"),
        F.trim(F.regexp_extract(text, line, 2)).alias("task"),
        first_group(text, line, 3).alias("due"),
    )
