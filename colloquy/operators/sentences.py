"""Sentences, sections and chunks: every operator maps a text column to an array column.

Nothing here shuffles: the pieces of a transcript stay in its row until ``arrays.rows``
explodes them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions import lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import head, keep_first, let, no_blank, or_empty

BREAK = r"(?<=[.!?])\s+|\n+"
STOP_BREAK = r"(?<=[.!?])\s+"
HEADING = r"^[A-Z][A-Za-z]+:\s*Section\s+\d+\s*:\s*(.+)$"
WORD = r"(?U)\w+"
LONG_WORDS, VERY_LONG_WORDS = 7500, 15000


# ---- X01: sentence splitting ----------------------------------------------------------
def split_raw(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def sentences_signal(text: Column, min_words: int = 4) -> Column:
    """Squashed pieces of at least ``min_words`` words."""
    pieces = F.transform(split_raw(text), T.squash)
    return F.filter(pieces, lambda s: F.size(F.split(s, " ")) >= min_words)


def statements(text: Column) -> Column:
    return no_blank(
        F.transform(split_raw(text), lambda s: J.replace(s, r"^\s+|\s+$", ""))
    )


def sentences_slot(text: Column) -> Column:
    return no_blank(F.transform(split_raw(text), T.clean_slot))


def sentences_clean(text: Column) -> Column:
    """Pieces after ``sentence_clean``."""
    return no_blank(F.transform(split_raw(text), T.sentence_clean))


def sentences_local(text: Column) -> Column:
    """One line of text; bullets and spaced dashes end a sentence."""
    line = F.replace(
        F.replace(T.squash(F.coalesce(text, F.lit(""))), F.lit("•"), F.lit(". ")),
        F.lit(" - "),
        F.lit(". "),
    )
    return no_blank(F.transform(F.split(line, STOP_BREAK), lambda s: F.trim(s)))


def sentences_spoken(text: Column) -> Column:
    """Third-engine form: the speaker of a line is put before each of its sentences."""
    return keep_first(spoken_pieces(text), T.content_key)


def spoken_pieces(text: Column) -> Column:
    """``sentences_spoken`` before its dedupe."""

    def line_parts(line: Column) -> Column:
        def parts(s: Column) -> Column:
            pieces = no_blank(F.transform(F.split(s["body"], STOP_BREAK), T.clean))
            return F.transform(
                pieces,
                lambda p: F.when(
                    (s["prefix"] == "") | p.rlike(r"^[A-Z][A-Za-z .'-]{1,40}+\s*:"), p
                ).otherwise(F.concat(s["prefix"], p)),
            )

        def bound(m: Column) -> Column:
            spoken = m["speaker"] != ""
            prefix = F.when(spoken, F.concat(T.owner_v3(m["speaker"]), F.lit(": "))).otherwise("")
            body = F.when(spoken, T.clean(m["body"])).otherwise(line)
            return let(F.struct(prefix.alias("prefix"), body.alias("body")), parts)

        return let(
            F.struct(
                F.regexp_extract(line, T.SPEAKER_V3_ONCE, 1).alias("speaker"),
                F.regexp_extract(line, T.SPEAKER_V3_ONCE, 2).alias("body"),
            ),
            bound,
        )

    lines = no_blank(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), T.clean))
    return F.flatten(F.transform(lines, line_parts))


# ---- sections ------------------------------------------------------------------------
SECTION = "struct<idx:int,title:string,text:string,words:int>"


def lines_of(text: Column) -> Column:
    return F.split(J.replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), "\n")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sections(text: Column) -> Column:
    """Array of (idx, title, text, words); text before the first heading is left out.

    No heading gives one section holding the whole text, an empty text gives none.
    """

    def build(lines: Column) -> Column:
        marks = F.filter(
            F.transform(
                lines,
                lambda s, i: F.struct(
                    i.alias("at"), F.regexp_extract(s, f"(?i){HEADING}", 1).alias("title")
                ),
            ),
            lambda m: m["title"] != "",
        )

        def cut(found: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(found, i + 1)["at"], F.size(lines))
                body = F.trim(
                    F.array_join(F.slice(lines, m["at"] + 1, stop - m["at"]), "\n")
                )
                return F.struct(
                    (i + 1).alias("idx"),
                    F.regexp_replace(F.trim(m["title"]), r"\.+$", "").alias("title"),
                    body.alias("text"),
                    count_words(body).alias("words"),
                )

            whole = F.array_join(lines, "\n")
            alone = F.struct(
                F.lit(1).alias("idx"),
                F.lit("Full transcript").alias("title"),
                whole.alias("text"),
                count_words(whole).alias("words"),
            )
            return (
                F.when(F.size(found) > 0, F.transform(found, one))
                .when(whole != "", F.array(alone))
                .otherwise(F.array().cast(f"array<{SECTION}>"))
            )

        return let(marks, cut)

    return let(lines_of(text), build)


def begin_middle_end(items: Column) -> Column:
    """First, middle and last of more than three, else all."""

    def pick(a: Column) -> Column:
        n = F.size(a)
        middle = F.floor((n - 1) / 2).cast("int")
        return F.when(
            n > 3, F.array(F.get(a, F.lit(0)), F.get(a, middle), F.get(a, n - 1))
        ).otherwise(a)

    return let(items, pick)


def covered_sentences(text: Column) -> Column:
    """Sentences of the selected sections first, then all, each once."""
    def pieces(picked: Column) -> Column:
        part = F.array_join(F.transform(picked, lambda s: s["text"]), "\n")
        first = F.when(F.size(picked) >= 3, spoken_pieces(part)).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(first, spoken_pieces(text))

    # one dedupe over both lists keeps the same sentences as one per list and one more
    return keep_first(let(begin_middle_end(sections(text)), pieces), T.content_key)


# ---- chunks --------------------------------------------------------------------------
def word_chunks(text: Column, size: int = 900) -> Column:
    """Windows of ``size`` words with their bounds."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda at, i: F.struct(
                (i + 1).alias("chunk"),
                at.alias("start_word"),
                F.least(at + size, n).alias("end_word"),
                F.array_join(F.slice(w, at + 1, F.lit(size)), " ").alias("text"),
            ),
        )

    return let(T.words(F.coalesce(text, F.lit(""))), cut)


def budget_chunk_ids(lengths: Column, budget: int) -> Column:
    """Chunk number of each piece; a piece that would pass the budget opens a chunk.

    The fold carries two numbers and the first position of each chunk, which grows only when a
    chunk opens; the numbers of the pieces between are filled in afterwards.
    """
    state = "struct<used:bigint,at:int,starts:array<int>>"
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.lit(0).alias("at"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(s: Column, n: Column) -> Column:
        fits = (s["at"] > 0) & (s["used"] + n <= budget)
        return F.struct(
            (F.when(fits, s["used"]).otherwise(F.lit(0)) + n).cast("bigint").alias("used"),
            (s["at"] + 1).alias("at"),
            F.when(fits, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"]))).alias("starts"),
        ).cast(state)

    def filled(s: Column) -> Column:
        ends = F.concat(F.slice(s["starts"], 2, 2147483646), F.array(s["at"]))
        runs = F.zip_with(s["starts"], ends, lambda a, b: b - a)
        chunks = F.flatten(F.transform(runs, lambda n, chunk: F.array_repeat(chunk, n)))
        return F.when(s["at"] > 0, chunks).otherwise(F.array().cast("array<int>"))

    return let(F.aggregate(lengths, start.cast(state), step), filled)


def budget_chunks(pieces: Column, budget: int = 1800) -> Column:
    """Array of (chunk, item) for pieces packed in order into chunks of a character budget."""
    ids = budget_chunk_ids(F.transform(pieces, lambda s: F.length(s)), budget)
    return F.zip_with(
        ids, pieces, lambda i, s: F.struct((i + 1).alias("chunk"), s.alias("item"))
    )


def paragraph_chunks(text: Column, budget: int = 3500, shared: int = 300) -> Column:
    """Paragraphs packed to ``budget`` characters; a longer one is cut with an overlap."""
    paras = no_blank(
        F.transform(
            F.split(F.coalesce(text, F.lit("")), r"\n{2,}"),
            lambda p: J.replace(p, r"^\s+|\s+$", ""),
        )
    )
    state = "struct<done:array<string>,cur:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pieces(p: Column) -> Column:
        # the last window is the first one that reaches the end of the paragraph
        step = budget - shared
        n_cuts = F.greatest(
            F.lit(0), F.ceil((F.length(p) - budget) / F.lit(float(step)))
        ).cast("int")
        cuts = F.transform(
            F.sequence(F.lit(0), n_cuts),
            lambda i: F.regexp_replace(
                F.substring(p, i * step + 1, F.lit(budget)), r"^\s+|\s+$", ""
            ),
        )
        return no_blank(cuts)

    def flush(s: Column) -> Column:
        return F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["cur"] != "", F.concat(s["cur"], F.lit("\n\n"), p)).otherwise(p)
        fits = F.length(joined) <= budget
        whole = F.length(p) <= budget
        done = (
            F.when(fits, s["done"]).when(whole, flush(s)).otherwise(F.concat(flush(s), pieces(p)))
        )
        cur = F.when(fits, joined).when(whole, p).otherwise(F.lit(""))
        return F.struct(done.alias("done"), cur.alias("cur")).cast(state)

    return F.aggregate(paras, start.cast(state), step, flush)


def representative_indexes(n: Column) -> Column:
    """Up to nine positions: three first, three around the middle, three last."""
    last, middle = n - 1, F.floor(n / 2).cast("int")
    zero = F.lit(0)
    wanted = F.array(
        zero, F.lit(1), F.lit(2),
        F.greatest(zero, middle - 1), middle, F.least(last, middle + 1),
        F.greatest(zero, last - 2), F.greatest(zero, last - 1), last,
    )
    return F.sort_array(F.array_distinct(F.filter(wanted, lambda i: (i >= 0) & (i <= last))))


def priority_indexes(n: Column) -> Column:
    """The representative positions, then the rest in order."""
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return let(
        representative_indexes(n), lambda top: F.concat(top, F.array_except(every, top))
    )


# ---- statistics ----------------------------------------------------------------------
def transcript_stats(text: Column) -> list[Column]:
    """A09."""
    t = F.coalesce(text, F.lit(""))
    n = count_words(t)
    return [
        F.length(t).alias("characters"),
        n.alias("words"),
        F.size(F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "")).alias("lines"),
        (n >= LONG_WORDS).alias("is_long"),
        (n >= VERY_LONG_WORDS).alias("is_very_long"),
    ]


def section_metadata(text: Column, prefix: str = "section") -> list[Column]:
    """A10: counts, titles and word counts of all sections and of the covered ones."""
    found = sections(text)
    covered = begin_middle_end(found)
    return [
        F.size(found).alias("section_count"),
        F.transform(found, lambda s: s["title"]).alias("section_titles"),
        F.transform(found, lambda s: s["words"]).alias("section_word_counts"),
        (F.size(found) >= 3).alias("has_coverage"),
        F.transform(covered, lambda s: s["idx"]).alias("coverage_indices"),
    ]


def tokens_local(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit("[a-z0-9_-]+"), F.lit(0))


def content_tokens(sentence: Column) -> Column:
    """Tokens that count for word frequency: not a stop word, longer than two."""
    return F.filter(
        tokens_local(sentence), lambda w: (F.length(w) > 2) & ~w.isin(*L.LOCAL_STOP)
    )


def summary_words(points: Column, max_points: int = 4, max_words: int = 100) -> Column:
    """Sentences taken in order while the word budget lasts; the first overflow stops."""
    state = "struct<used:int,open:boolean,out:array<string>>"
    start = F.struct(
        F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out")
    )
    closed = F.transform(
        head(points, max_points),
        lambda p: F.concat(F.regexp_replace(p, r"\.+$", ""), F.lit(".")),
    )

    def step(s: Column, p: Column) -> Column:
        n = T.word_count(p)
        fits = s["open"] & (s["used"] + n <= max_words)
        return F.struct(
            F.when(fits, s["used"] + n).otherwise(s["used"]).alias("used"),
            fits.alias("open"),
            F.when(fits, F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out"),
        ).cast(state)

    return F.array_join(
        F.aggregate(or_empty(closed), start.cast(state), step, lambda s: s["out"]), " "
    )
