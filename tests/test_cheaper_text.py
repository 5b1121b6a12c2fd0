"""Shared text functions do less work per text and give what the plain spelling gives."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import no_blank
from colloquy.operators import commitments as K, points as P, recall as R

ODD = [
    None, "", " ", ".", "...", "The the THE a", "a  b\tc \n d", "uh and so, Priya,  you know , it works .",
    "Priya, Jordan, we will send it", "Alex, agreed.", "Decision 2: to will keep  the pilot , and the  demo !", "to uh will",
    "I would also us to confirm like this", "-- so  what ; next :", "(well), {this}: is [it]!", "café, “ok”", "x.\u0085", "go.  now.",
    "by Friday", "Send it before the launch today", "NEXT WEEK or by tomorrow", "next weeK", "baby steps", "today's",
    "The pilot demo has a timeout", "landing page", "pilots", "10 minute smoke test, json backup", "note quality cleanup was decided",
    "classes dresses going bringing goes", "we decided to keep the lane open?", "We decided to keep the lane open for all",
    "my thought is we will use email here", "by the end of the meeting the final demo plan will be ready",
]


@pytest.fixture(scope="module")
def same(spark):
    def check(new, old):
        df = spark.createDataFrame([(x,) for x in ODD], "s string")
        for r in df.select("s", new(F.col("s")).alias("new"), old(F.col("s")).alias("old")).collect():
            assert r["new"] == r["old"], r["s"]

    return check


def literals(words):
    return F.array(*[F.lit(w) for w in words])


def test_token_set(same, spark):
    def old(c):
        found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0)))
        return F.filter(F.array_except(found, literals(L.POINT_STOP)), lambda t: F.length(t) >= 3)

    same(T.point_tokens, old)
    # a set of the stop words is not built for every text
    assert "array_except" not in str(T.point_tokens(F.col("s")))


def test_stripped_tokens(same, spark):
    def old(c):
        bare = F.transform(
            F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,:;!?()\[\]{}]+|[.,:;!?()\[\]{}]+$", "")
        )
        return F.array_except(F.array_distinct(no_blank(bare)), literals(L.MERGE_STOP))

    same(T.stripped_tokens, old)
    assert "array_except" not in str(T.stripped_tokens(F.col("s")))


def test_task_tokens(same, spark):
    def old(c):
        return F.array_except(F.array_distinct(no_blank(F.split(c, " "))), literals(L.V3_TASK_STOP))

    same(K.task_tokens, old)
    assert "array_except" not in str(K.task_tokens(F.col("s")))


def test_sentence_clean(same):
    def noise(c):
        out = F.regexp_replace(c, r"(?i)^(?:and|but|so)\s+", "")
        out = F.regexp_replace(out, r"^(?:[A-Z][a-z]+,\s*){1,3}(?=[A-Z]?[a-z]+\s+(?:will|should|can|needs?\s+to|to))", "")
        out = F.regexp_replace(out, r"^(?:[A-Z][a-z]+,\s*)+", "")
        out = F.regexp_replace(out, r"(?i)^(?:[A-Z][a-z]+,\s*)?Decision\s+\d+[,\s:-]*", "")
        out = F.regexp_replace(out, r"(?i)\bto will\b", "will")
        out = F.regexp_replace(out, r"(?i)\bI would also us to confirm\b", "We should confirm")
        out = F.regexp_replace(out, r"(?i)\b[A-Z][a-z]+, agreed\.?$", "")
        return F.regexp_replace(out, r"^[ ,.\-]+|[ ,.\-]+$", "")

    def old(c):
        out = F.regexp_replace(T.squash(noise(F.regexp_replace(T.squash(c), L.FILLERS, ""))), r"\s+([,.;:!?])", "$1")
        out = T.strip_edges(out, T.EDGE_V1)
        return F.when(out.rlike("^[a-z]"), T.capital_first(out)).otherwise(out)

    same(T.strip_speaker_noise, noise)
    same(T.sentence_clean, old)


def test_deadline(same):
    def old(c):
        t = T.clean(c)
        low = F.lower(t)
        return F.coalesce(
            T.first_group(t, r"(?i)\bby\s+([A-Z][A-Za-z]+|\w+day|tomorrow|today|next week|end of week)\b"),
            T.first_group(t, r"(?i)\bbefore\s+([A-Z][A-Za-z]+|\w+day|launch|demo|next week)\b"),
            *[F.when(low.rlike(rf"\b{x}\b"), x) for x in ("today", "tomorrow", "next week")],
            F.when(low.contains("today"), "today"),
            F.lit(L.V3_NO_DEADLINE),
        )

    same(T.deadline_v3, old)
    # the text is cleaned once
    assert str(T.deadline_v3(F.col("s"))).count("btrim") == str(T.clean(F.col("s"))).count("btrim")


def test_topics(same):
    def first(c):
        out = F.lit("general")
        for name, patterns in reversed(L.TOPICS.items()):
            out = F.when(F.lower(c).rlike("|".join(patterns)), name).otherwise(out)
        return out

    def every(c):
        hits = [F.when(F.lower(c).rlike("|".join(p)), n) for n, p in L.LOCAL_TOPICS.items()]
        return F.filter(F.array(*hits), lambda t: t.isNotNull())

    same(T.topic, first)
    same(P.local_topics, every)


def test_word_starts_are_plain():
    assert J.any_word_start([r"\bab\b", r"\bac", r"\bd\b"]) == r"(?=[abcd])(?:\b(?:a(?:b\b|c)|d\b))".replace("abcd", "ad")
    for bad in ("ab", r"\ba?b", r"\bab|c", r"\b[ab]"):
        with pytest.raises(ValueError):
            J.any_word_start([bad])


def test_decisions(same):
    def old(c):
        t = T.clean(c)
        low = F.lower(t)
        marks = L.any_of(L.V3_DECISION) + (
            r"|\b(first pilot audience|target audience)\b.*\b(will be|is|are)\b|\b(demo|live demo)\b.*\b(will use|uses|use)\b"
            r"|\bbackup meeting\b.*\b(will keep|keep|processed)\b"
        )
        against = low.rlike(L.any_of(K.NO_DECISION)) | low.rlike(L.any_of(L.V3_WEAK)) | K.is_goal_like(t)
        return F.coalesce(~against & (F.length(t) >= 12) & ~low.endswith("?") & low.rlike(marks), F.lit(False))

    same(lambda c: F.coalesce(K.is_decision(c), F.lit(False)), old)
    # the word test comes before those for what speaks against it
    said = str(K.is_decision(F.col("s")))
    assert said.index("we decided") < said.index("we should leave with")


def test_soft_stem(same):
    def old(w):
        out, done = w, F.lit(False)
        for suffix in ("ing", "ed", "es", "s"):
            hit = w.endswith(suffix) & (F.length(w) > len(suffix) + 3)
            out = F.when(~done & hit, F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
            done = done | hit
        return out

    def each(f):
        return lambda c: F.transform(F.split(c, " "), f)

    same(each(lambda w: R.soft_stem(w)), each(old))
