"""First-engine items: scored sentences, diverse points, local actions, decisions and risks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import best_first, greedy_keep, head, keep_first, let, no_blank
from colloquy.operators import sentences as S

# ---- fixed values ---------------------------------------------------------------------------
DECISION_MARK = (
    r"\b(?:decided|agreed|finalized|approved|chose|chosen|will use|will proceed|will be used|use .* as|treat .* as)\b"
)
WEAK_DECISION = r"\b(?:maybe|might|could|perhaps|one option|possibly|consider)\b"
STRONG_HINTS = (
    "first pilot audience will be", "primary backup demo example", "backup demo example",
    "will be the primary backup", "will be used as", "will be", "treat ", "use meeting ",
    "pilot audience",
)
DECISION_TOPIC = ("backup", "pilot", "artifact", "stress test", "positioning")
AGENDA_STARTS = (
    "by the end of the meeting", "the purpose of today's meeting", "purpose of today's meeting",
    "let me summarize the agenda",
)
BAD_DUE = r"(?i)^(?:before\s+(?:any|the)|before|by|next|tomorrow|tonight)$"
BAD_TASK = (
    "i would also us to confirm", "by the end of the meeting", "purpose of today's meeting",
    "the purpose of today's meeting", "small list of action items", "decision on which use case",
    "concrete owners for the follow-up actions", "first pilot audience will be",
    "pilot audience will be",
)
RISK_WORDS = ("risk", "blocker", "issue", "challenge", "concern", "timeout", "error", "stress test")
LOCAL_DECISION = (
    "decision confirmed", "confirmed decision", "we decided", "agreed to", "it was decided",
    "we will proceed with", "approved", "we chose", "is a stress test",
    "not the default live demo", "first pilot audience",
    "will lead with a practical positioning message", "preferred flow", "backup demo artifact",
)
LOCAL_NO_DECISION = (
    "by the end of the meeting", "let's capture decisions explicitly",
    "the landing page should lead with", "decision on which use case we will lead",
)
LOCAL_RISK = (
    r"\brisk(?:s)?\b", r"\bblocker(?:s)?\b", r"\bdependency\b", r"\bdependencies\b",
    r"\bmay\s+(?:delay|fail|miss|confuse|reduce|create|increase|block|break|lose|think|look)\b",
    r"\bcould\s+(?:delay|fail|miss|confuse|reduce|create|increase|block|break|lose)\b",
    r"\bmight\s+(?:delay|fail|miss|confuse|reduce|create|increase|block|break|lose)\b",
    r"\bnot clear\b", r"\bunclear\b", r"\bquality issue(?:s)?\b",
    r"\bprocessing issue(?:s)?\b", r"\bsupport burden\b", r"\bpartial transcript\b",
)
LOCAL_RISK_TEXT = (
    "raw media path", "runtime", "timeout", "sequencing", "stress test", "timing logs",
)
RISK_AGENDA = (
    "review risks", "risks and action items", "risks questions and owners",
    "capture risks separately", "decisions risks questions", "confirm proposal scope",
)
RISK_LANGUAGE = r"\b(?:may|could|might|unclear|not clear|risk of|blocker|delay|fail|miss|confuse|failure)\b"
LOCAL_WEAK_STARTS = (
    "the main purpose", "i'd like us to", "something like", "that will allow", "we can check",
    "identify decisions and action items", "ideally, the flow is", "on the product side",
    "we already saw", "by the end of the meeting", "that means", "i would also", "decision 1",
)
LOCAL_STRONG = (
    r"\bneed to\b", r"\bneeds to\b", r"\bshould\b", r"\bmust\b", r"\blet'?s\b",
    r"\baction item\b", r"\baction items\b", r"\bnext step\b", r"\bnext steps\b",
    r"\bfollow up\b", r"\bto do\b", r"\bowner\b", L.LOCAL_BY_DAY, r"\bwill\b",
)
LOCAL_VERBS = (
    "send", "share", "prepare", "review", "update", "draft", "schedule", "check", "follow",
    "create", "fix", "test", "confirm", "deliver", "finalize", "upload", "document",
    "investigate", "call", "verify", "complete", "move", "deploy", "implement", "add", "remove",
    "refactor", "improve", "validate", "publish", "release", "run", "keep", "record", "preserve",
    "begin", "start", "save", "package",
)
POINT_STARTS = ("speaker one", "speaker two", "speaker:", "good morning")
NEXT_VERBS = (
    "prepare", "finalize", "keep", "create", "send", "share", "review", "confirm", "draft",
    "update", "schedule", "test", "validate", "package", "record", "process", "upload",
    "publish", "follow up", "align", "document",
)
NEXT_BAD_STARTS = (
    "i think", "i agree", "we should also", "if ", "because ", "and ", "but ", "so ",
    "another thing", "yeah ", "okay ", "right ", "well ",
)
NEXT_BAD_ENDS = ("and", "or", "because", "so", "also")
OUTCOME_DEFAULT = "The team aligned on the main priorities and next steps."
PURPOSE_DEFAULT = "The meeting focused on reviewing progress and aligning next steps"


# ---- F17, W08: sentence score and ranking within a chunk ----------------------------------------
def sentence_score(sentence: Column, chunk_tokens: Column, source: Column | None = None) -> Column:
    """word frequencies within the chunk, cues, a day, a colon and the source."""
    words = F.aggregate(
        S.content_tokens(sentence),
        F.lit(0),
        lambda acc, w: acc + F.size(chunk_tokens) - F.size(F.array_remove(chunk_tokens, w)),
    )

    def body(s: Column) -> Column:
        low = s["low"]
        cues = sum((T.when1(low.rlike(p), 8) for p in L.LOCAL_CUES), F.lit(0))
        return (
            s["words"]
            + cues
            + T.when1(low.rlike(J.ahead(L.LOCAL_BY_DAY)), 6)
            + T.when1(low.contains(":"), 1)
            + (F.lit(2) if source is None else F.when(source == "transcript", 2).otherwise(1))
        )

    return let(F.struct(F.lower(sentence).alias("low"), words.alias("words")), body)


def chunk_lists(packed: Column, tagged: bool = False) -> Column:
    """(chunk, item) structs to an array of (chunk, items) in chunk order; ``tagged`` ones keep ``slide``, too."""

    def cut(p: Column) -> Column:
        # chunks are runs of neighbours: each is a slice from its first position to the next one's
        first = F.transform(p, lambda c, i: F.when((i == 0) | (F.get(p, i - 1)["chunk"] != c["chunk"]), i + 1))
        return let(
            F.concat(F.array_compact(first), F.array(F.size(p) + 1)),
            lambda edges: F.transform(
                F.slice(edges, F.lit(1), F.size(edges) - 1),
                lambda a, k: F.struct(
                    F.get(p, a - 1)["chunk"].alias("chunk"),
                    F.transform(F.slice(p, a, F.get(edges, k + 1) - a), lambda c: c["item"]).alias("items"),
                    *([F.transform(F.slice(p, a, F.get(edges, k + 1) - a), lambda c: c["slide"]).alias("slide")] if tagged else []),
                ),
            ),
        )

    return let(packed, cut)


def ranked_in_chunks(packed: Column, limit: int = 5, tagged: bool = False) -> Column:
    """Per chunk the best sentences by score, ties in text order; of ``tagged`` ones slides score one less."""

    def scored(c: Column, tokens: Column) -> Column:
        if not tagged:
            return F.transform(c["items"], lambda s: F.struct(sentence_score(s, tokens).alias("score"), s.alias("s")))
        source = lambda t: F.when(t, "slide").otherwise("transcript")
        return F.zip_with(
            c["items"], c["slide"], lambda s, t: F.struct(sentence_score(s, tokens, source(t)).alias("score"), s.alias("s"))
        )

    def of_chunk(c: Column) -> Column:
        return let(
            F.flatten(F.transform(c["items"], S.content_tokens)),
            lambda tokens: F.transform(
                best_first(
                    scored(c, tokens),
                    lambda x: x["score"],
                    limit,
                ),
                lambda x, i: F.struct(
                    c["chunk"].alias("chunk"), (i + 1).alias("rank"), x["score"].alias("score"), x["s"].alias("s")
                ),
            ),
        )

    return F.flatten(F.transform(chunk_lists(packed, tagged), of_chunk))


# ---- W11: diverse picks ---------------------------------------------------------------------------
def local_topics(c: Column) -> Column:
    low = F.lower(c)
    every = F.array(*[F.when(low.rlike(J.ahead(L.any_of(p))), n) for n, p in L.LOCAL_TOPICS.items()])
    # one search for all of them tells the texts that have none
    found = low.rlike(J.any_word_start(p for patterns in L.LOCAL_TOPICS.values() for p in patterns))
    return F.when(~found, F.array().cast("array<string>")).otherwise(F.filter(every, lambda t: t.isNotNull()))


def diverse_points(points: Column, limit: int = 12) -> Column:
    """First unused point of each topic in topic order, then the rest in order."""
    unique = keep_first(points, T.compact_key)
    tagged = F.transform(
        unique, lambda p, i: F.struct(i.alias("i"), local_topics(p).alias("topics"), p.alias("p"))
    )

    def pick(a: Column) -> Column:
        def step(used: Column, name: Column) -> Column:
            fresh = F.filter(
                a, lambda x: F.array_contains(x["topics"], name) & ~F.array_contains(used, x["i"])
            )
            return F.when(
                F.size(fresh) > 0, F.concat(used, F.array(F.get(fresh, F.lit(0))["i"]))
            ).otherwise(used)

        names = F.array(*[F.lit(n) for n in L.LOCAL_TOPICS])
        used = F.aggregate(names, F.array().cast("array<int>"), step)
        order = let(
            used, lambda u: F.concat(u, F.array_except(F.transform(a, lambda x: x["i"]), u))
        )
        return F.transform(head(order, limit), lambda i: F.get(a, i)["p"])

    return let(tagged, pick)


def is_objective(c: Column) -> Column:
    return F.lower(c).rlike(J.ahead(L.any_of(L.OBJECTIVE)))


def is_agenda(c: Column) -> Column:
    return is_objective(c) | F.lower(c).rlike(J.ahead(L.starts(AGENDA_STARTS)))


def similar_points(a: Column, b: Column) -> Column:
    return T.overlap(a, b) >= 0.7


def dedupe_texts(items: Column, limit: int) -> Column:
    """Keep a text unless 0.7 of the smaller token set is shared with a kept one."""
    return greedy_keep(items, T.point_tokens, similar_points, "string", "array<string>", limit)


def build_key_points(sents: Column, limit: int = 6) -> Column:
    """W11, scored dialect: one point per topic in topic order, then by score, none alike."""
    ddl = "struct<s:string,topic:string,tokens:array<string>,stage:string>"
    usable = F.filter(
        sents, lambda s: (s != "") & T.word_count(s).between(6, 35) & ~is_objective(s)
    )
    ranked = F.transform(
        best_first(usable, T.key_point_score),
        lambda s: F.struct(
            s.alias("s"), T.topic(s).alias("topic"), T.point_tokens(s).alias("tokens")
        ),
    )

    def fold(a: Column) -> Column:
        queue = F.concat(
            *[_staged(F.filter(a, _topic_is(t)), t, ddl) for t in L.TOPICS], _staged(a, "fill", ddl)
        )

        def step(kept: Column, x: Column) -> Column:
            blocked = (
                (F.size(kept) >= limit)
                | ((x["stage"] != "fill") & F.exists(kept, lambda k: k["stage"] == x["stage"]))
                | F.exists(kept, lambda k: similar_points(x["tokens"], k["tokens"]))
            )
            return F.when(blocked, kept).otherwise(F.concat(kept, F.array(x))).cast(f"array<{ddl}>")

        return F.transform(
            F.aggregate(queue, F.array().cast(f"array<{ddl}>"), step), lambda k: k["s"]
        )

    return let(ranked, fold)


def _topic_is(topic: str):
    return lambda x: x["topic"] == topic


def _staged(items: Column, stage: str, ddl: str) -> Column:
    return F.transform(
        items,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["topic"].alias("topic"),
            x["tokens"].alias("tokens"),
            F.lit(stage).alias("stage"),
        ).cast(ddl),
    )


def summary_order(points: Column) -> Column:
    """Points with the first of each topic moved to the front, in summary topic order."""
    tagged = F.transform(points, lambda p, i: F.struct(i.alias("i"), T.topic(p).alias("t"), p.alias("p")))

    def build(a: Column) -> Column:
        firsts = F.transform(
            F.array(*[F.lit(t) for t in L.SUMMARY_TOPIC_ORDER]),
            lambda t: F.get(F.filter(a, lambda x: x["t"] == t), F.lit(0))["i"],
        )
        lead = F.filter(firsts, lambda i: i.isNotNull())
        return let(
            lead,
            lambda l: F.transform(
                F.concat(l, F.array_except(F.transform(a, lambda x: x["i"]), l)),
                lambda i: F.get(a, i)["p"],
            ),
        )

    return let(tagged, build)


def build_summary(points: Column, max_points: int = 4, max_words: int = 100) -> Column:
    """W15 over the topic-led order of distinct points."""
    return S.summary_words(summary_order(F.array_distinct(points)), max_points, max_words)


# ---- F19, F21, F22: action objects -------------------------------------------------------------------
def action_lines(sents: Column, limit: int = 7) -> Column:
    """Cleaned sentences that score 4 or more, as action lines, none alike."""
    good = F.filter(sents, lambda s: T.action_score(s) >= 4)
    return dedupe_texts(F.transform(good, T.format_action_line), limit)


def priority(task: Column, due: Column) -> Column:
    """F22."""
    low = F.lower(task)
    high = due.isNotNull() | low.rlike(J.ahead("urgent|asap|finalize|launch|deliver|publish"))
    return F.when(high, "high").otherwise("medium")


def is_valid_task(task: Column) -> Column:
    return (
        (task != "")
        & ~is_agenda(task)
        & ~F.lower(task).rlike(J.any_text(BAD_TASK))
        & T.word_count(task).between(4, 18)
    )


OBJECT = "struct<owner:string,task:string,due:string,priority:string,confidence:double>"


def action_objects(lines: Column, limit: int = 7) -> Column:
    """action lines as objects with confidence and priority; weak ones dropped."""

    def parse(line: Column) -> Column:
        has_owner = line.contains(" - ")
        owner = F.when(has_owner, F.trim(F.substring_index(line, " - ", 1))).otherwise("Unassigned")
        rest = F.trim(
            F.when(has_owner, F.regexp_replace(line, r"^.*? - ", "")).otherwise(line)
        )
        due = J.replace(
            F.regexp_extract(rest, r"(?i)\(due:\s*([^)]+)\)$", 1), r"^[ .,\-]+|[ .,\-]+$", ""
        )
        good_due = lambda d: (d != "") & ~d.rlike(BAD_DUE) & (T.word_count(d) <= 5)
        task = T.sentence_clean(F.regexp_replace(rest, r"(?i)\s*\(due:\s*([^)]+)\)$", ""))
        return F.struct(
            F.when(owner == "", "Unassigned").otherwise(owner).alias("owner"),
            T.capital_first(C.apply(task, C.POINT_TASK)).alias("task"),
            let(due, lambda d: F.when(good_due(d), d)).alias("due"),
            T.action_confidence(line).alias("score"),
        )

    def build(p: Column) -> Column:
        owner = F.when(
            p["owner"].isin("Unassigned", "Speaker") & F.lower(p["task"]).startswith("team "), "Team"
        ).otherwise(p["owner"])

        def settle(s: Column) -> Column:
            own, task, due = s["owner"], s["task"], s["due"]
            bare = F.when(
                (own == "Team") & F.lower(task).startswith("team "), F.trim(F.substring(task, F.lit(5), F.length(task)))
            ).otherwise(task)
            confidence = (
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.45) + F.lit(0.1) * s["score"]))
                - F.when(own.isin("Unassigned", "Speaker"), 0.15).otherwise(0.0)
                - F.when(due.isNull(), 0.05).otherwise(0.0)
            )
            return F.struct(
                own.alias("owner"),
                bare.alias("task"),
                due.alias("due"),
                priority(bare, due).alias("priority"),
                confidence.alias("confidence"),
            ).cast(OBJECT)

        return let(
            F.struct(owner.alias("owner"), p["task"].alias("task"), p["due"].alias("due"), p["score"].alias("score")),
            settle,
        )

    built = F.transform(F.transform(lines, parse), build)
    sure = F.filter(built, lambda o: is_valid_task(o["task"]) & (o["confidence"] >= 0.60))
    return greedy_keep(
        sure,
        lambda o: T.point_tokens(
            F.concat_ws(" | ", o["owner"], o["task"], F.coalesce(o["due"], F.lit("")))
        ),
        similar_points,
        OBJECT,
        "array<string>",
        limit,
    )


# ---- F20: decisions ------------------------------------------------------------------------------------
def decision_score(c: Column) -> Column:
    low, n = F.lower(c), T.word_count(c)
    return F.when(is_agenda(c), F.lit(-5)).otherwise(
        T.when1(low.rlike(J.ahead(DECISION_MARK)), 3)
        + T.when1(low.rlike(J.any_text(STRONG_HINTS)), 2)
        + T.when1(low.rlike(J.any_text(DECISION_TOPIC)), 1)
        + T.when1(low.rlike(J.ahead(WEAK_DECISION)), -3)
        + T.when1((n < 5) | (n > 26), -1)
    )


def looks_decided(c: Column) -> Column:
    low = F.lower(c)
    return (
        ~is_agenda(c)
        & ~low.rlike(J.ahead(WEAK_DECISION))
        & (low.rlike(J.ahead(DECISION_MARK)) | low.rlike(J.any_text(STRONG_HINTS)))
    )


def clean_decision(c: Column) -> Column:
    out = J.replace(C.apply(T.sentence_clean(c), C.DECISION_POINT), r"^[ .]+|[ .]+$", "")
    closed = let(out, lambda s: F.when(s == "", "").otherwise(F.concat(s, F.lit("."))))
    return F.regexp_replace(closed, r"(?i)^Team will keep\s+", "")


def build_decisions(sents: Column, limit: int = 5) -> Column:
    good = F.filter(sents, lambda s: looks_decided(s) & (decision_score(s) >= 2))
    kept = dedupe_texts(no_blank(F.transform(good, clean_decision)), limit)
    scored = F.transform(
        kept,
        lambda d: F.struct(
            d.alias("text"),
            F.round(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * decision_score(d))), 2
            ).alias("confidence"),
        ),
    )
    return F.filter(scored, lambda d: d["confidence"] >= 0.70)


# ---- X19, X20 ---------------------------------------------------------------------------------------------
LOCAL_ACTION = "struct<owner:string,task:string,due:string,confidence:double>"


def local_clean(c: Column) -> Column:
    return C.apply(c, C.LOCAL_SENTENCE)


def looks_like_action(c: Column) -> Column:
    low = F.lower(F.trim(c))
    tokens = S.tokens_local(c)
    return ~low.rlike(J.ahead(L.starts(LOCAL_WEAK_STARTS))) & (
        low.rlike(J.ahead(L.any_of(LOCAL_STRONG)))
        | (
            F.arrays_overlap(tokens, F.array(*[F.lit(v) for v in LOCAL_VERBS]))
            & F.arrays_overlap(tokens, F.array(F.lit("we"), F.lit("i"), F.lit("team")))
        )
    )


def local_actions(sents: Column, limit: int = 8, weak=LOCAL_WEAK_STARTS) -> Column:
    """Action sentences with owner, due and additive confidence; best first, deduped."""

    def make(s: Column) -> Column:
        def build(p: Column) -> Column:
            low = p["low"]
            confidence = (
                F.lit(0.35)
                + F.when(p["owner"].isNotNull(), 0.25).otherwise(0.0)
                + F.when(p["due"].isNotNull(), 0.20).otherwise(0.0)
                + F.when(
                    low.rlike(J.ahead(r"\b(action item|action items|next step|next steps|follow up)\b")), 0.20
                ).otherwise(0.0)
                + F.when(low.rlike(J.ahead(r"\bwill\b|\bshould\b|\bneeds to\b|\bneed to\b")), 0.10).otherwise(0.0)
                + F.lit(0.05)
            )
            return F.struct(
                p["owner"].alias("owner"),
                p["task"].alias("task"),
                p["due"].alias("due"),
                F.round(F.least(confidence, F.lit(0.95)), 2).alias("confidence"),
            ).cast(LOCAL_ACTION)

        return let(
            F.struct(
                T.owner_local(s).alias("owner"),
                local_clean(C.apply(s, C.LOCAL_TASK)).alias("task"),
                T.deadline_local(s).alias("due"),
                F.lower(s).alias("low"),
            ),
            build,
        )

    made = F.transform(F.filter(sents, looks_like_action), make)
    clear = F.filter(
        made, lambda a: ~F.lower(a["task"]).rlike(J.ahead("the main purpose|i'd like us to leave this meeting|identify decisions and action items"))
    )
    # an empty key is one key like any other here
    return keep_first(
        best_first(clear, lambda a: a["confidence"]),
        lambda a: F.concat(F.lit("k"), T.compact_key(a["task"])),
        limit,
    )


def local_decisions(sents: Column, limit: int = 5) -> Column:
    """X20."""
    hits = F.filter(
        sents, lambda s: T.has_any(s, LOCAL_DECISION) & ~T.has_any(s, LOCAL_NO_DECISION)
    )
    return keep_first(F.transform(hits, local_clean), T.compact_key, limit)


def is_local_risk(c: Column) -> Column:
    def test(low: Column) -> Column:
        explicit = low.rlike(J.ahead(RISK_LANGUAGE))
        filler = low.rlike(J.any_text(RISK_AGENDA)) | low.rlike(J.ahead(r"\bsection reviewed\b|\breviewed upload reliability\b"))
        return ~(filler & ~explicit) & (
            low.rlike(J.any_text(LOCAL_RISK_TEXT)) | low.rlike(J.ahead(L.any_of(LOCAL_RISK)))
        )

    return let(F.lower(c), test)


def local_risks(sents: Column, limit: int = 5) -> Column:
    return keep_first(
        F.transform(F.filter(sents, is_local_risk), local_clean), T.compact_key, limit
    )


# ---- publishable forms ----------------------------------------------------------------------------------------
def is_publishable_point(c: Column) -> Column:
    low = F.lower(c)
    return (
        (c != "")
        & ~low.rlike(J.ahead(L.starts(POINT_STARTS)))
        & ~low.rlike(J.ahead("good morning everyone|thanks for joining"))
        & (T.word_count(c) >= 5)
    )


def publishable_points(points: Column, limit: int = 8) -> Column:
    """X28 tail: cleaned points that can be shown, first of each spelling."""
    good = F.filter(F.transform(points, local_clean), is_publishable_point)
    return keep_first(good, lambda p: F.regexp_replace(F.lower(p), r"\.+$", ""), limit)


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark)))


def looks_like_chunk(c: Column, max_chars: int = 260) -> Column:
    low = F.lower(T.squash(c))
    return (
        (F.length(low) > max_chars)
        | low.rlike(J.ahead("speaker one|speaker two|decision one|decision two"))
        | (count_of(low, ",") > 7)
        | (count_of(low, ";") > 3)
    )


def slot_text(c: Column, max_chars: int = 240) -> Column:
    """A slot text that can be shown, else ''."""
    return let(
        F.regexp_replace(F.trim(local_clean(F.coalesce(c, F.lit("")))), r"\.+$", ""),
        lambda t: F.when(
            (t != "")
            & ~looks_like_chunk(t, max_chars)
            & ~F.lower(t).rlike(J.ahead("^(speaker one|speaker two|key outcomes: speaker)"))
            & (T.word_count(t) >= 5),
            t,
        ).otherwise(""),
    )


def slots_alike(a: Column, b: Column) -> Column:
    stop = L.LOCAL_STOP
    ta, tb = T.token_set(a, "[a-z0-9]+", stop, 4), T.token_set(b, "[a-z0-9]+", stop, 4)
    return T.overlap(ta, tb) >= 0.65


def outcome_from_decisions(decisions: Column) -> Column:
    two = F.array_join(
        F.transform(head(decisions, 2), lambda d: F.regexp_replace(d, r"\.+$", "")), "; "
    )
    return F.when(
        F.size(decisions) > 0,
        F.concat(F.lit("The team aligned on the main decisions: "), two, F.lit(".")),
    ).otherwise(OUTCOME_DEFAULT)


def bad_outcome(outcome: Column, purpose: Column) -> Column:
    o, p = T.compact_key(outcome), T.compact_key(purpose)
    return (
        (F.trim(outcome) == "")
        | F.lower(F.trim(outcome)).startswith("the meeting resulted in")
        | (o == p)
        | ((purpose != "") & F.contains(o, p))
    )


def compose_outcome(decisions: Column, points: Column, purpose: Column, found: Column) -> Column:
    """The found outcome when good, else key outcomes from decisions or points."""
    made = keep_first(
        F.transform(decisions, lambda d: F.regexp_replace(F.trim(local_clean(d)), r"\.+$", "")),
        T.compact_key,
    )
    other = F.filter(
        F.transform(points, lambda p: F.regexp_replace(F.trim(p), r"\.+$", "")),
        lambda p: T.compact_key(p) != T.compact_key(purpose),
    )

    def choose(m: Column) -> Column:
        return (
            F.when((found != "") & ~bad_outcome(found, purpose), F.regexp_replace(F.trim(found), r"\.+$", ""))
            .when(F.size(m) > 0, F.concat(F.lit("Key outcomes: "), F.array_join(head(m, 3), "; ")))
            .when(F.size(other) > 0, F.concat(F.lit("Key outcomes: "), F.array_join(head(other, 2), "; ")))
            .otherwise("")
        )

    return let(made, choose)


def publishable_risks(risks: Column, limit: int = 3) -> Column:
    """W10, risk dialect: 0.7 of the smaller word set; the more specific text takes the place."""
    ddl = "struct<x:string,tokens:array<string>,rank:int,len:int>"
    stop = L.LOCAL_STOP + ("there", "that", "with", "from", "this", "could", "would", "might", "early")
    specific = (
        "too early", "because", "if ", "unless", "timeout", "memory", "transcript", "expectation",
        "quality", "support",
    )

    def tidy(r: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(slot_text(r, 260), r"\s+,", ","), r",\s+or\s+", " or ")
        return F.regexp_replace(T.squash(out), r"^[ .]+|[ .]+$", "")

    def features(r: Column) -> Column:
        rank = sum((T.when1(F.lower(r).contains(p), 1) for p in specific), F.lit(0))
        return F.struct(
            r.alias("x"),
            T.token_set(r, "[a-z0-9]+", stop, 4).alias("tokens"),
            rank.alias("rank"),
            F.length(r).alias("len"),
        ).cast(ddl)

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(
            F.transform(kept, lambda k: T.overlap(x["tokens"], k["tokens"]) >= 0.70), F.lit(True)
        )

        def place(p: Column) -> Column:
            better = lambda k: (x["rank"] > k["rank"]) | ((x["rank"] == k["rank"]) & (x["len"] > k["len"]))
            return (
                F.when(F.size(kept) >= limit, kept)
                .when(p == 0, F.concat(kept, F.array(x)))
                .otherwise(
                    F.transform(
                        kept, lambda k, i: F.when((i + 1 == p) & better(k), x).otherwise(k)
                    )
                )
            )

        return let(at, place).cast(f"array<{ddl}>")

    good = no_blank(F.transform(risks, tidy))
    folded = F.aggregate(F.transform(good, features), F.array().cast(f"array<{ddl}>"), step)
    return F.transform(folded, lambda k: k["x"])


def steps_from_actions(tasks: Column, limit: int | Column = 3) -> Column:
    """L05, first-engine dialect: tasks that read as a next step."""
    tidy = F.transform(
        tasks,
        lambda t: F.regexp_replace(
            T.squash(F.regexp_replace(local_clean(t), r"^\s*[-*•]+\s*", "")), r"^[ ,;:\-]+|[ ,;:\-]+$", ""
        ),
    )

    def ok(t: Column) -> Column:
        low = F.lower(t)
        w = T.words(low)
        return (
            (t != "")
            & ~low.rlike(J.ahead(r"^\s*speaker(\s+\w+)?\b"))
            & ~t.rlike(J.ahead(r"^\s*[A-Z][a-z]+:\s*"))
            & ~low.rlike(J.ahead(L.starts(NEXT_BAD_STARTS)))
            & ~t.contains("...")
            & F.size(w).between(4, 18)
            & ~F.element_at(w, -1).isin(*NEXT_BAD_ENDS)
            & low.rlike(J.ahead(L.starts(NEXT_VERBS)))
        )

    kept = keep_first(F.filter(tidy, ok), T.spaced_key, limit)
    return F.transform(
        kept, lambda t: F.concat(T.capital_first(F.regexp_replace(t, r"\.+$", "")), F.lit("."))
    )


# ---- W16, W20 ---------------------------------------------------------------------------------------------------
def action_limit(n_words: Column) -> Column:
    """More room in longer meetings."""
    return (
        F.when(n_words >= 15000, 20).when(n_words >= 7500, 15).when(n_words >= 3500, 12).otherwise(8)
    )


def step_limit(n_words: Column) -> Column:
    return F.when(n_words >= 15000, 8).when(n_words >= 7500, 6).when(n_words >= 3500, 5).otherwise(3)


LONG_CHUNKS, LONG_CHARS = 40, 75_000


def is_long(packed: Column, sents: Column, chunks: int = LONG_CHUNKS, chars: int = LONG_CHARS) -> Column:
    """Many chunks or many characters."""
    n_chunks = F.coalesce(F.array_max(F.transform(packed, lambda c: c["chunk"])), F.lit(0))
    n_chars = F.aggregate(
        sents, F.lit(0).cast("bigint"), lambda acc, s: acc + F.length(s)
    )
    return (n_chunks >= chunks) | (n_chars >= chars)
