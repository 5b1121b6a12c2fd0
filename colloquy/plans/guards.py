"""Final guards, routing, critics and gates over notes records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import greedy_keep, head, keep_first, let, no_blank
from colloquy.operators import hints as H, recall as R

# ---- fixed values ---------------------------------------------------------------------------
ENGINE_MODES = ("v1", "v2", "v3", "shadow")
TEXT_FIXES = {
    "I'd us to": "I'd like us to",
    "I’d us to": "I’d like us to",
    "reviewrecommended": "review recommended",
    "tomake": "to make",
}
PUBLISH_VERBS = L.V3_PRECISION_VERBS
PUBLISH_CONTEXT = (
    "i'd like us to", "i’d like us to", "i'd us to", "i’d us to", "i would like us to",
    "we'd like to", "we would like to", "the main purpose", "the purpose", "today's purpose",
    "the team aligned", "team aligned", "if we say", "if we position", "that's ", "that is ",
    "this week's priority is", "this weeks priority is", "the priority is",
    "even if you already know", "we can ", "we need to ", "we should ", "we will ",
)
COPULA = r"\b(will be|will use|will remain|will include|is to|is|are|aligned|designed)\b"
GENERIC_SUMMARIES = (
    "the meeting aligned on the main priorities and next steps",
    "the team discussed the meeting and next steps", "the team aligned on the main priorities",
    "meeting notes", "summary",
)
CRITIC_MESSAGES = {
    "purpose_present": "Purpose is missing.",
    "summary_specific": "Summary appears too generic.",
    "actions_present": "Action items are missing or too few.",
    "decisions_present": "Decision language exists but no decisions were extracted.",
    "owners_not_generic": "Action item owner appears generic or guessed.",
    "deadlines_present": "Deadline language exists but an action item is missing a deadline.",
    "questions_not_in_points": "Open questions appear mixed into key points.",
    "emails_not_suspicious": "Possible suspicious email or domain text detected.",
    "not_transcript_like": "Notes appear transcript-like.",
}
CRITIC_BLOCKING = (
    "purpose_present", "actions_present", "decisions_present", "owners_not_generic",
    "questions_not_in_points", "emails_not_suspicious", "not_transcript_like",
)
ACTION_TALK = r"(?i)\b(?:action item|assigned action|I accept .{0,40}action|I will|will .{0,80}\bby\b|please)\b"
DECISION_TALK = r"(?i)\b(?:decision|agreed|decided|confirmed decision|decision confirmed)\b"
DEADLINE_TALK = (
    r"(?i)\b(?:by|before|after|due|deadline|tomorrow|monday|tuesday|wednesday|thursday|friday|next week|end of week)\b"
)
NO_ACTIONS = (
    r"\bno (?:assigned )?(?:actions?|action items?|tasks?|next steps?)\b",
    r"\bnot assigning (?:implementation work|work|tasks?|action items?)\b",
    r"\bcontains? no assigned actions?\b",
)
SUSPICIOUS = (
    r"(?i)\b[\w.+-]+\s+(?:at|\[at\])\s+[\w.-]+\.[\w.-]+|\b[\w.+-]+@[\w.-]+\.(?:con|cmo|comm|aii|ioo)\b|\b(?:vercell|go\s+daddy)\b"
)
TRANSCRIPT_LIKE = r"(?i)\b(?:speaker\s+\d+|[A-Z][A-Za-z]+\s+says?,)"
SUMMARY_SIGNALS = ("summary", "purpose", "outcome", "overview", "key points", "next steps")
BAD_MARKDOWN = ("traceback", "exception", "undefined", "null null", "none none", "[object object]")
SAFETY_SIGNALS = (
    "no clear meeting structure", "not a meeting", "no clear decisions", "no clear action items",
    "insufficient meeting structure", "meeting structure was detected", "unclear meeting",
)
V2_LEAKS = (
    "we decided", "the team decided", "the team aligned on", "the client demo will use",
    "key action owners are", "today we need to confirm", "today confirm proposal scope",
)
V2_POINT_LEAKS = (
    "key action owners are", "we decided", "the team decided", "the team aligned on",
    "today we need to confirm",
)
GENERIC_TEAMS = ("team", "product", "engineering", "leadership", "operations", "sales", "client", "qa")
RISK_SIGNALS = (
    r"\bdelay\b", r"\bmay miss\b", r"\bmiss some details\b", r"\breview(?:ed)? before sharing\b",
    r"\breview recommended\b", r"\breliability\b", r"\btrust gap\b", r"\bblocked?\b",
    r"\bblocker\b", r"\bdependency\b", r"\bdepends on\b", r"\bwaiting on\b", r"\bnot confirmed\b",
    r"\bpricing\b.*\b(confirm|approval|review|delay|change)\b", r"\bover.?promis",
    r"\bexpectation", r"\bunclear\b",
    r"\bclient\b.*\b(delay|confidence|expectation|follow.?up)\b",
    r"\blong recordings?\b.*\b(review|miss|caution|reliability)\b",
)
BAD_RISKS = (r"\bupload meeting recording\b", r"\bwait for processing\b", r"\breview summary\b", r"\bcopy or export\b", r"\brisks and action items\b")
ACTION_SIGNALS = (
    r"\bconfirm\b", r"\bupdate\b", r"\bsend\b", r"\bdraft\b", r"\bcreate\b", r"\bclean\b",
    r"\bremove\b", r"\bupload\b", r"\bfollow up\b", r"\bfollow-up\b", r"\bschedule\b",
    r"\bprepare\b", r"\bfinal review\b", r"\bdry run\b", r"\bsay\b", r"\bneed(?:s)?\s+to\b",
    r"\bgo to\b",
)
BAD_ACTIONS = (
    r"\btoday (we )?need to confirm\b", r"\bthe purpose is to confirm\b", r"\bthe goal today is\b",
    r"\bfor example\b.*\bshould become\b", r"\bif we send\b", r"\bclient can renew\b",
    r"\breview risks blockers dependencies and uncertainties\b",
)
BAD_DECISIONS = (
    r"^s\b", r"^risks questions and owners$", r"\bdiscussion should not become a decision\b",
    r"\bfor example\b.*\bshould become\b", r"\brisk extraction should look for\b",
    r"\brepeated actions and vague actions\b", r"\bnot as a separate document\b",
)
READABILITY: C.Steps = (
    (r"(?i)\breviewrecommended\b", "review recommended"),
    (r"(?i)\btomake\b", "to make"),
    (r"(?i)\bside up\b", "signup"),
    (r"(?i)\bpay pal\b", "PayPal"),
    (r"\s+([,.;:!?])", "$1"),
    (r"\s+", " "),
    (r"^ +| +$", ""),
)
PRECISION_TASK: C.Steps = (
    (r"\s+", " "),
    (r"^[ ,.;:\-]+|[ ,.;:\-]+$", ""),
    (r"(?i)\s+The meeting aligned on the main priorities and next steps\.?$", ""),
    (r"(?i),?\s*outcome is .*?$", ""),
    (r"^[ ,.;:\-]+|[ ,.;:\-]+$", ""),
)
LONG_WORDS = ("3-hour", "3 hour", "three-hour", "three hour", "long recording", "long-recording")
POLISH_STOP = ("there", "that", "with", "from", "this", "could", "would", "might", "because", "support")


# ---- P21 --------------------------------------------------------------------------------------
def client_text(c: Column, fixes: dict[str, str] = TEXT_FIXES) -> Column:
    """Known defects replaced, no space before punctuation, single spaces."""
    out = F.coalesce(c, F.lit(""))
    for old, new in fixes.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return T.squash(F.regexp_replace(out, r"[ \t]+([,.;:!?])", "$1"))


def sanitize(records: DataFrame, fixes: dict[str, str] = TEXT_FIXES) -> DataFrame:
    """P21 over the text and list fields of a record."""
    single = {c: client_text(F.col(c), fixes) for c in ("summary", "purpose", "outcome")}
    lists = {
        c: keep_first(
            F.transform(F.col(c), lambda x: F.regexp_replace(client_text(x, fixes), r"^[ .]+|[ .]+$", "")), T.spaced_key
        )
        for c in ("key_points", "decisions")
    }
    return records.withColumns({**single, **lists})


# ---- P20 ----------------------------------------------------------------------------------------
def publish_task(c: Column) -> Column:
    out = F.regexp_replace(F.trim(c), r"^\s*[-*]?\s*\[[ xX]\]\s*", "")
    out = F.regexp_replace(out, r"(?i)\s+_?\(status:.*$", "")
    return client_text(F.regexp_replace(out, r"^[ \-–—]+|[ \-–—]+$", ""))


def is_publishable_task(task: Column) -> Column:
    low, verbs = F.lower(task), "|".join(PUBLISH_VERBS)
    context = low.rlike(J.ahead(L.starts(PUBLISH_CONTEXT))) | (
        low.rlike(J.ahead(r"^(?:the|this|that|it|there)\b")) & low.rlike(J.ahead(COPULA))
    )
    return (
        (low != "")
        & ~context
        & low.rlike(J.ahead(rf"^(?:also\s+)?(?:please\s+)?(?:{verbs})\b|^(?:i\s+will|i'll)\s+(?:{verbs})\b"
            rf"|^[a-z][a-z .'-]{{1,50}}\s+(?:will|should|needs to|need to|must|has to)\s+(?:{verbs})\b"))
    )


def publishable_actions(lines: Column, model_version: Column) -> Column:
    """P20: visible actions of third-engine notes as (owner, task); others pass through."""
    owner_line = r"^([A-Z][A-Za-z .'-]{1,60}?)\s*(?:—|-|:)\s*(.+)$"

    def parse(line: Column) -> Column:
        return let(
            publish_task(line),
            lambda t: F.struct(
                F.when(F.regexp_extract(t, owner_line, 1) != "", F.trim(F.regexp_extract(t, owner_line, 1)))
                .otherwise("Team")
                .alias("owner"),
                F.when(F.regexp_extract(t, owner_line, 2) != "", publish_task(F.regexp_extract(t, owner_line, 2)))
                .otherwise(t)
                .alias("task"),
            ),
        )

    parsed = F.transform(lines, parse)
    good = keep_first(
        F.filter(parsed, lambda a: is_publishable_task(a["task"])),
        lambda a: F.trim(F.regexp_replace(F.lower(a["task"]), r"(?U)\W+", " ")),
    )
    third = F.lower(F.coalesce(model_version, F.lit(""))).contains("v3")
    return F.when(third, good).otherwise(parsed)


# ---- P22, P23, P25 ----------------------------------------------------------------------------------
def engine_mode(global_mode: Column, email: Column, allowed: tuple[str, ...]) -> Column:
    """An explicit global mode wins, else allow-listed mails get v2, else v1."""
    mode = F.lower(F.trim(F.coalesce(global_mode, F.lit(""))))
    known = F.when(mode.isin(*ENGINE_MODES), mode).otherwise("v1")
    listed = F.lower(F.trim(F.coalesce(email, F.lit("")))).isin(*[a.strip().lower() for a in allowed])
    return F.when(known.isin("shadow", "v2", "v3"), known).when(listed, "v2").otherwise("v1")


def use_engine_output(selected: Column, mode: Column, fallback: Column) -> Column:
    """Third-engine output unless it fell back, else output of a v2 or v3 run."""
    return ((selected == "v3") & ~fallback) | F.coalesce(mode, F.lit("")).isin("v2", "v3")


def lineage(model_version: Column, mode: Column, applied: Column, fallback: Column) -> Column:
    """P25: engine suffix on the model version, once."""
    base = F.trim(F.coalesce(model_version, F.lit("")))
    suffix = F.when(fallback, "+qev2-fallback").when(applied, "+qev2")
    named = F.when(base == "", "unknown").otherwise(base)
    marked = F.when(named.rlike(J.ahead(r"\+qev2$|\+qev2-fallback$")), named).otherwise(F.concat(named, suffix))
    plain = F.nullif(base, F.lit(""))
    return F.when((mode == "v2") & suffix.isNotNull(), marked).otherwise(plain)


# ---- Q02 ---------------------------------------------------------------------------------------------
def critic(records: DataFrame, actions: str = "actions", blob: str = "blob") -> DataFrame:
    """Q02: nine checks of a notes record against its transcript.

    ``actions`` holds structs with owner and deadline; ``blob`` is the text of the notes.
    """
    c = F.col
    talk, notes = F.coalesce(c("text"), F.lit("")), F.coalesce(c(blob), F.lit(""))
    summary_key, talk_key = T.spaced_key(F.coalesce(c("summary"), F.lit(""))), T.spaced_key(talk)
    n = F.size(c(actions))
    checks = {
        "purpose_present": F.trim(F.coalesce(c("purpose"), F.lit(""))) != "",
        "summary_specific": (summary_key != "")
        & ~summary_key.isin(*GENERIC_SUMMARIES)
        & (T.word_count(summary_key) >= 6),
        "actions_present": (n > 0) | ~talk.rlike(J.ahead(ACTION_TALK)) | talk_key.rlike(J.ahead(L.any_of(NO_ACTIONS))),
        "decisions_present": ~(talk.rlike(J.ahead(DECISION_TALK)) & (F.size("decisions") == 0)),
        "owners_not_generic": ~F.exists(
            c(actions),
            lambda a: T.spaced_key(F.coalesce(a["owner"], F.lit(""))).isin(
                "someone", "unassigned", "unknown", "tbd", "owner"
            ),
        ),
        "deadlines_present": ~(
            talk.rlike(J.ahead(DEADLINE_TALK))
            & F.exists(c(actions), lambda a: F.trim(F.coalesce(a["deadline"], F.lit(""))) == "")
        ),
        "questions_not_in_points": ~F.exists(
            "key_points",
            lambda p: F.lower(p).rlike(J.ahead(r"\bopen question\b")) | (p.contains("?") & F.lower(p).rlike(J.ahead(r"\bquestion\b"))),
        ),
        "emails_not_suspicious": ~notes.rlike(J.ahead(SUSPICIOUS)),
        "not_transcript_like": ~notes.rlike(J.ahead(TRANSCRIPT_LIKE)),
    }
    out = records.select("doc_id", *[v.alias(k) for k, v in checks.items()])

    def texts(names) -> Column:
        found = F.array(*[F.when(~c(k), F.lit(CRITIC_MESSAGES[k])) for k in names])
        return F.filter(found, lambda w: w.isNotNull())

    return out.withColumn("warnings", texts(CRITIC_MESSAGES)).withColumn(
        "passed", F.size(texts(CRITIC_BLOCKING)) == 0
    )


# ---- Q03, Q04 -------------------------------------------------------------------------------------------
def client_gate(records: DataFrame, must_mention: str = "priorit") -> DataFrame:
    """Q03: 100 minus fixed penalties; passes at 95 with every list clean and long enough.

    ``actions`` holds (owner, task) structs.
    """
    c = F.col

    def low(x: Column) -> Column:
        return F.lower(T.squash(F.coalesce(x, F.lit(""))))

    bad_summary = F.exists(F.array("summary", "purpose", "outcome"), lambda x: low(x).rlike(J.ahead("i'd us|i’d us")))
    bad_decisions = F.exists("decisions", lambda d: low(d).rlike(J.ahead("^(and )?action items$|^and action")))
    bad_actions = F.exists(
        "actions",
        lambda a: low(a["owner"]).rlike(J.ahead("^i also think|^i think"))
        | (F.length(low(a["task"])) > 220)
        | ((a["owner"] == "Team") & a["task"].contains(":"))
        | low(a["task"]).rlike(J.ahead("the purpose of today's meeting|^s ")),
    )
    bad_steps = F.exists("next_steps", lambda s: low(s).startswith("s "))
    bad_points = F.exists("key_points", lambda p: low(p).rlike(J.ahead("control.reach|s keep|i'd us|i’d us")))
    keys = F.transform(
        "actions",
        lambda a: F.concat(low(a["owner"]), F.lit(":"), T.spaced_key(T.squash(a["task"]))),
    )
    repeated = F.size(keys) > F.size(F.array_distinct(keys))
    topical = F.exists("actions", lambda a: low(a["task"]).contains(must_mention))
    few_d, few_a, few_s = F.size("decisions") < 3, F.size("actions") < 3, F.size("next_steps") < 3
    penalties = [
        (bad_summary, 25), (few_d, 15), (few_a, 20), (few_s, 15), (~topical, 15), (bad_decisions, 15),
        (bad_actions, 20), (bad_steps, 15), (bad_points, 10), (repeated, 10),
    ]
    score = F.greatest(
        F.lit(0), F.lit(100) - sum((F.when(t, n).otherwise(0) for t, n in penalties), F.lit(0))
    )
    clean = ~(
        bad_summary | few_d | few_a | few_s | ~topical | bad_decisions | bad_actions | bad_steps | bad_points | repeated
    )
    return records.select(
        "doc_id",
        score.alias("score"),
        F.size("decisions").alias("decision_count"),
        F.size("actions").alias("action_count"),
        F.size("next_steps").alias("next_step_count"),
        topical.alias("has_priority_action"),
        repeated.alias("has_duplicates"),
        ((score >= 95) & clean).alias("passed"),
    )


def notes_score(records: DataFrame) -> DataFrame:
    """Q04: 0-100 by summary, counts, owners, duplicates and Markdown; a rule apart for non-meetings.

    Needs blob, markdown, non_meeting, decisions and actions (owner, task, due) columns.
    """
    c = F.col
    n, d = F.size("actions"), F.size("decisions")
    keys = F.transform("actions", lambda a: T.spaced_key(a["task"]))
    dup = F.size(F.filter(keys, lambda k: k != "")) - F.size(F.array_distinct(F.filter(keys, lambda k: k != "")))
    owned = F.size(F.filter("actions", lambda a: F.trim(F.coalesce(a["owner"], F.lit(""))) != ""))
    dated = F.size(F.filter("actions", lambda a: F.trim(F.coalesce(a["due"], F.lit(""))) != ""))
    low = F.lower(c("blob"))
    summary_ok = F.exists(F.split(c("blob"), "\n"), lambda s: T.word_count(s) >= 8) & low.rlike(J.any_text(SUMMARY_SIGNALS))
    md = F.lower(c("markdown"))
    markdown_ok = (F.length(F.trim(c("markdown"))) >= 100) & ~md.rlike(J.any_text(BAD_MARKDOWN))
    safety = F.concat_ws(" ", low, md).rlike(J.any_text(SAFETY_SIGNALS))
    rate = F.when(n > 0, owned / n).otherwise(0.0)
    few_a, few_d = n <= 1, d <= 1
    story = (
        F.when(summary_ok, 20).otherwise(8)
        + F.when(few_a, 25).otherwise(0)
        + F.when(few_d, 25).otherwise(0)
        + F.when(safety, 20).otherwise(8)
        + F.when(markdown_ok, 10).otherwise(0)
    )
    meeting = (
        F.when(summary_ok, 15).otherwise(5)
        + F.when(n >= 1, 20).otherwise(0)
        + F.when(d >= 1, 15).otherwise(0)
        + F.when(rate >= 0.5, 15).otherwise(F.floor(rate * 15))
        + F.when(dup == 0, 10).otherwise(3)
        + F.when(markdown_ok, 10).otherwise(0)
        + F.when(dated > 0, 5).otherwise(2)
        + F.lit(10)
    )
    score = F.least(F.lit(100), F.when(c("non_meeting"), story).otherwise(meeting))
    ok = F.when(c("non_meeting"), (story >= 85) & few_a & few_d).otherwise(
        (meeting >= 85) & (n >= 1) & (d >= 1) & markdown_ok
    )
    return records.select(
        "doc_id",
        score.cast("long").alias("score"),
        F.when(ok, "PASS").otherwise("REVIEW").alias("status"),
        summary_ok.alias("summary_ok"),
        markdown_ok.alias("markdown_ok"),
        safety.alias("safety_signal"),
        dup.alias("duplicate_actions"),
    )


# ---- Q01 override ----------------------------------------------------------------------------------------
def safety_override(records: DataFrame, non_meeting: Column) -> DataFrame:
    """Q01: notes of a non-meeting lose their items and say so."""
    empty = F.array().cast("array<string>")
    out = records.withColumn("non_meeting", non_meeting)
    flag = F.col("non_meeting")
    lists = {
        c: F.when(flag, empty).otherwise(F.col(c))
        for c in ("key_points", "decisions", "risks", "next_steps", "action_items")
    }
    return out.withColumns(
        {
            "summary": F.when(flag, H.SAFE_SUMMARY).otherwise(F.col("summary")),
            "purpose": F.when(flag, "").otherwise(F.col("purpose")),
            "outcome": F.when(flag, H.SAFE_OUTCOME).otherwise(F.col("outcome")),
            **lists,
        }
    )


# ---- Q10 -----------------------------------------------------------------------------------------------------
def consistency_key(c: Column) -> Column:
    out = R.norm_words(c)
    out = F.regexp_replace(F.regexp_replace(out, r"\bplease\b", ""), r"\bthe\b", "")
    return T.squash(out)


def readable(c: Column) -> Column:
    return C.apply(F.coalesce(c, F.lit("")), READABILITY)


def clean_risks(risks: Column, limit: int = 5) -> Column:
    tidy = F.transform(risks, lambda r: F.regexp_replace(readable(r), r"\.+$", ""))
    good = F.filter(
        tidy,
        lambda r: let(
            R.norm_words(r), lambda k: (k != "") & ~k.rlike(J.ahead(L.any_of(BAD_RISKS))) & k.rlike(J.ahead(L.any_of(RISK_SIGNALS)))
        ),
    )
    return keep_first(good, consistency_key, limit)


def clean_decisions(decisions: Column) -> Column:
    tidy = F.transform(decisions, lambda d: J.replace(readable(d), r"^[ .]+|[ .]+$", ""))
    good = F.filter(
        tidy, lambda d: let(R.norm_words(d), lambda k: (d != "") & ~k.rlike(J.ahead(L.any_of(BAD_DECISIONS))))
    )
    return keep_first(good, R.norm_words)


CONSISTENT = "struct<owner:string,task:string>"
OWNER_FORMS = (
    r"^action item for ([A-Z][a-zA-Z]+)[,:\-]\s*(.+)$",
    r"^([A-Z][a-zA-Z]+)\s+-\s+(.+)$",
    r"^([A-Z][a-zA-Z]+),\s*please\s+(?:also\s+)?(.+)$",
    r"^([A-Z][a-zA-Z]+)\s+(?:will|to|should|owns?)\s+(.+)$",
    r"^([A-Z][a-zA-Z]+)\s+needs?\s+to\s+(.+)$",
)


def consistent_actions(lines: Column, texts: Column, hints: Column) -> Column:
    """Stored action lines and action-like texts with owners filled, deduped by key and owner."""

    def split_owner(t: Column) -> Column:
        owner = F.coalesce(*[T.first_group(t, p, 1) for p in OWNER_FORMS])
        task = F.coalesce(*[T.first_group(t, p, 2) for p in OWNER_FORMS], t)
        return F.struct(
            owner.alias("owner"), F.regexp_replace(task, r"(?i)^also\s+", "").alias("task")
        )

    def make(t: Column) -> Column:
        return let(
            let(readable(t), split_owner),
            lambda s: F.struct(
                R.infer_owner(s["owner"], s["task"], hints).alias("owner"),
                T.capital_first(J.replace(s["task"], r"^[ .]+|[ .]+$", "")).alias("task"),
            ).cast(CONSISTENT),
        )

    def candidate(t: Column) -> Column:
        lead = r"(?i)^(?:i will|we will|we should|please also|please)\s+"
        return let(
            let(readable(t), split_owner),
            lambda s: let(
                F.regexp_replace(F.regexp_replace(s["task"], lead, ""), r"^[ \-.]+|[ \-.]+$", ""),
                lambda task: F.when(
                    (F.length(task) >= 8)
                    & ~R.norm_words(task).rlike(J.ahead(L.any_of(BAD_ACTIONS)))
                    & R.norm_words(task).rlike(J.ahead(L.any_of(ACTION_SIGNALS))),
                    F.struct(
                        R.infer_owner(s["owner"], s["task"], hints).alias("owner"),
                        T.capital_first(task).alias("task"),
                    ).cast(CONSISTENT),
                ),
            ),
        )

    found = F.filter(F.transform(texts, candidate), lambda a: a.isNotNull())
    every = F.filter(
        F.concat(F.transform(lines, make), found),
        lambda a: (a["task"] != "") & ~R.norm_words(a["task"]).rlike(J.ahead(L.any_of(BAD_ACTIONS))),
    )
    return keep_first(every, lambda a: consistency_key(a["task"]))


def consistency(records: DataFrame, inferred: tuple[R.PhraseRule, ...] = ()) -> DataFrame:
    """Q10: clean text, clean and infer risks, fill owners, rebuild actions and next steps."""
    c = F.col
    lists = ("key_points", "decisions", "next_steps", "risks", "action_items")
    out = records.withColumns(
        {x: readable(c(x)) for x in ("summary", "purpose", "outcome")}
        | {x: F.transform(c(x), readable) for x in lists}
    )
    all_text = F.concat_ws(" ", "summary", "purpose", "outcome", *[F.array_join(c(x), " ") for x in lists[:3]], F.array_join("action_items", " "))
    extra = F.transform(R.phrase_items(all_text, inferred), lambda x: x["text"]) if inferred else F.array().cast("array<string>")
    texts = F.concat(no_blank(F.array("summary", "purpose", "outcome")), c("next_steps"), c("key_points"), c("decisions"))
    hints = R.owner_hints(F.concat(c("key_points"), c("decisions"), c("next_steps")))
    out = out.withColumn("new_risks", clean_risks(F.concat(c("risks"), extra))).withColumn(
        "actions", let(hints, lambda h: consistent_actions(c("action_items"), texts, h))
    )
    return out.withColumns(
        {
            "risks": c("new_risks"),
            "decisions": clean_decisions(c("decisions")),
            "next_steps": F.transform(
                head(c("actions"), 5), lambda a: F.concat(F.regexp_replace(a["task"], r"\.+$", ""), F.lit("."))
            ),
        }
    ).drop("new_risks")


# ---- Q11 --------------------------------------------------------------------------------------------------------
def polish_risks(risks: Column, limit: int = 5, threshold: float = 0.70) -> Column:
    """Risks by word overlap of the smaller set; the longer text takes the place."""
    ddl = "struct<x:string,tokens:array<string>>"

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(
            F.transform(kept, lambda k: T.overlap(x["tokens"], k["tokens"]) >= threshold), F.lit(True)
        )
        return let(
            at,
            lambda p: F.when(F.size(kept) >= limit, kept)
            .when(p == 0, F.concat(kept, F.array(x)))
            .otherwise(
                F.transform(
                    kept,
                    lambda k, i: F.when((i + 1 == p) & (F.length(x["x"]) > F.length(k["x"])), x).otherwise(k),
                )
            ),
        ).cast(f"array<{ddl}>")

    tidy = no_blank(F.transform(risks, lambda r: F.regexp_replace(T.squash(r), r"^[ .]+|[ .]+$", "")))
    packed = F.transform(
        tidy, lambda r: F.struct(r.alias("x"), T.token_set(r, "[a-z0-9]+", POLISH_STOP, 4).alias("tokens")).cast(ddl)
    )
    return F.transform(F.aggregate(packed, F.array().cast(f"array<{ddl}>"), step), lambda k: k["x"])


def polish_points(points: Column) -> Column:
    return no_blank(F.transform(head(points, 8), lambda p: F.regexp_replace(T.squash(p), r"^[ .]+|[ .]+$", "")))


def points_with_rules(points: Column, said: Column, rules: tuple[R.PhraseRule, ...], most: int = 6) -> Column:
    """Key points, and while there are fewer than ``most``, those of the rules that ``said`` meets."""

    def joined(s: Column) -> Column:
        new = F.filter(s["e"], lambda e: ~F.exists(s["p"], lambda p: T.compact_key(p) == T.compact_key(e)))
        return F.concat(s["p"], head(new, F.greatest(F.lit(0), F.lit(most) - F.size(s["p"]))))

    extra = F.transform(R.phrase_items(said, rules), lambda x: x["text"])
    return let(F.struct(polish_points(points).alias("p"), extra.alias("e")), joined)


def long_polish(
    records: DataFrame, rules: tuple[R.PhraseRule, ...], min_chars: int = 75_000
) -> DataFrame:
    """Q11: long transcripts only: risks merged and topical key points added up to six."""
    c = F.col
    talk = F.coalesce(c("text"), F.lit(""))
    is_long = (F.length(talk) >= min_chars) | F.lower(talk).rlike(J.any_text(LONG_WORDS))
    points = points_with_rules(c("key_points"), talk, rules)
    return records.withColumn("is_long", is_long).withColumns(
        {
            "risks": F.when(is_long, polish_risks(c("risks"))).otherwise(c("risks")),
            "key_points": F.when(is_long, head(points, 8)).otherwise(c("key_points")),
        }
    )


# ---- Q12 ------------------------------------------------------------------------------------------------------------
def overlay(records: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Q12: an outside rewrite is taken list by list only at equal length, text only within bounds."""
    lists = ("key_points", "decisions", "risks")
    texts = {"summary": (40, 1800), "purpose": (12, 900), "outcome": (12, 900)}
    new = rewrites.select("doc_id", *[F.col(x).alias(f"n_{x}") for x in (*lists, *texts)])
    out = records.join(new, "doc_id", "left")

    def same(x: str) -> Column:
        fits = (F.size(x) > 0) & (F.size(f"n_{x}") == F.size(x))
        return F.when(F.coalesce(fits, F.lit(False)), F.col(f"n_{x}")).otherwise(F.col(x))

    def within(x: str, low: int, high: int) -> Column:
        t = T.squash(F.coalesce(F.col(f"n_{x}"), F.lit("")))
        return F.when(F.length(t).between(low, high), t).otherwise(F.col(x))

    picked = {x: same(x) for x in lists} | {x: within(x, *b) for x, b in texts.items()}
    changed = F.lit(False)
    for x, v in picked.items():
        changed = changed | ~v.eqNullSafe(F.col(x))
    return out.withColumn("changed", changed).withColumns(picked).drop(*[f"n_{x}" for x in picked])


# ---- Q13 --------------------------------------------------------------------------------------------------------------
V2_ENDS: C.Steps = ((r"\s+", " "), (r"^[ .:\-]+|[ .:\-]+$", ""))
V2_TASK_CUT = r"(?i)\.\s+(?:Priya|Jordan|Morgan|Alex|Team|We|Decision\s+\d+|Final recap)\b.*$"


def v2_cleanup(records: DataFrame) -> DataFrame:
    """Q13: action leaks out of key points and decisions, tasks cut, actions re-keyed."""
    c = F.col

    def tidy(items: Column) -> Column:
        return no_blank(F.transform(items, lambda x: C.apply(x, V2_ENDS)))

    points = F.filter(tidy(c("key_points")), lambda p: ~F.lower(p).rlike(J.ahead(L.starts(V2_POINT_LEAKS))))
    decisions = F.filter(
        tidy(c("decisions")),
        lambda d: ~F.lower(d).rlike(J.ahead(r"^(?:we should|i will)|^(?:we|i)\s+(?:will|should)\b.*\b(?:remove|upload|clean|send|draft|check|request|escalate)\b")),
    )
    tasks = F.transform(
        c("actions"),
        lambda a: F.struct(
            F.when(F.coalesce(a["owner"], F.lit("")) != "", a["owner"]).otherwise("Team").alias("owner"),
            C.apply(F.regexp_replace(C.apply(a["task"], V2_ENDS), V2_TASK_CUT, ""), V2_ENDS).alias("task"),
        ),
    )
    kept = F.filter(tasks, lambda a: (a["task"] != "") & ~F.lower(a["task"]).rlike(J.ahead(L.starts(V2_LEAKS))))
    return records.withColumns(
        {
            "key_points": keep_first(points, T.spaced_key),
            "decisions": keep_first(decisions, T.spaced_key),
            "actions": keep_first(kept, lambda a: T.spaced_key(a["task"])),
        }
    )


# ---- Q14 ---------------------------------------------------------------------------------------------------------------
def near_duplicate(a: Column, b: Column) -> Column:
    """Equal, one long key inside the other, or 0.78 of the larger of two sets of five or more."""
    ta, tb = a["tokens"], b["tokens"]
    big = F.greatest(F.size(ta), F.size(tb))
    close = (F.size(ta) >= 5) & (F.size(tb) >= 5) & (
        F.size(F.array_intersect(ta, tb)) / big >= 0.78
    )
    inside = ((F.length(a["k"]) >= 24) & F.contains(b["k"], a["k"])) | (
        (F.length(b["k"]) >= 24) & F.contains(a["k"], b["k"])
    )
    return (a["k"] == b["k"]) | inside | close


def precise_decisions(decisions: Column, limit: int = 5) -> Column:
    """W10 of the larger set, decision keys."""
    edge = r"^[ ,.;:\-]+|[ ,.;:\-]+$"
    tail = r"(?i)\s+The meeting aligned on the main priorities and next steps\.?$"
    tidy = F.transform(
        decisions,
        lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(T.squash(d), edge, ""), tail, ""), edge, ""),
    )
    usable = F.filter(tidy, lambda d: (d != "") & (R.precision_decision_key(d) != ""))
    return greedy_keep(
        usable,
        lambda d: let(
            R.precision_decision_key(d),
            lambda k: F.struct(k.alias("k"), F.array_distinct(F.split(k, " ")).alias("tokens")),
        ),
        near_duplicate,
        "string",
        "struct<k:string,tokens:array<string>>",
        limit,
    )


def precise_actions(actions: Column, limit: int = 7) -> Column:
    """A16, precision dialect: per task key the first, unless a named owner beats a generic one."""
    tidy = F.transform(
        actions,
        lambda a: F.struct(
            F.when(F.coalesce(a["owner"], F.lit("")) != "", a["owner"]).otherwise("Team").alias("owner"),
            C.apply(a["task"], PRECISION_TASK).alias("task"),
        ),
    )
    keyed = F.filter(
        F.transform(
            tidy,
            lambda a: F.struct(
                R.precision_task_key(a["task"]).alias("k"),
                T.spaced_key(a["owner"]).isin(*GENERIC_TEAMS).alias("generic"),
                a.alias("a"),
            ),
        ),
        lambda s: (s["k"] != "") & (s["a"]["task"] != ""),
    )

    def build(rows: Column) -> Column:
        def of_key(k: Column) -> Column:
            same = F.filter(rows, lambda s: s["k"] == k)
            # a generic first owner gives way to the first named one
            named = F.get(F.filter(same, lambda s: ~s["generic"]), F.lit(0))
            first = F.get(same, F.lit(0))
            return F.when(first["generic"] & named.isNotNull(), named["a"]).otherwise(first["a"])

        return F.transform(F.array_distinct(rows["k"]), of_key)

    return head(let(keyed, build), limit)


def precision_cleanup(records: DataFrame) -> DataFrame:
    """Q14: decisions capped at 5, actions at 7, an empty outcome filled from the decisions."""
    c = F.col
    out = records.withColumn("decisions", precise_decisions(c("decisions"))).withColumn(
        "actions", precise_actions(c("actions"))
    )
    two = F.array_join(F.transform(head(c("decisions"), 2), lambda d: F.regexp_replace(d, r"\.+$", "")), "; ")
    return out.withColumn(
        "outcome",
        F.when(
            (F.trim(F.coalesce(c("outcome"), F.lit(""))) == "") & (F.size("decisions") > 0),
            F.concat(F.lit("The team aligned on: "), two, F.lit(".")),
        ).otherwise(c("outcome")),
    )


# ---- A26, J13 ------------------------------------------------------------------------------------------------------------
def extraction_gap(records: DataFrame) -> DataFrame:
    """Sizes per case and what still needs a fix; plain items and objects both count."""

    def count(*names: str) -> Column:
        sizes = [F.greatest(F.coalesce(F.size(n), F.lit(0)), F.lit(0)) for n in names if n in records.columns]
        return sum(sizes[1:], sizes[0])

    decisions, actions = count("decisions", "decision_objects"), count("action_items", "action_item_objects")
    return records.select(
        "doc_id",
        F.length("summary").alias("summary_len"),
        F.length("purpose").alias("purpose_len"),
        F.length("outcome").alias("outcome_len"),
        F.size("key_points").alias("key_points"),
        decisions.alias("decisions"),
        actions.alias("actions"),
        (decisions == 0).alias("needs_decision_fix"),
        (actions == 0).alias("needs_action_fix"),
    )


def gap_totals(gaps: DataFrame) -> DataFrame:
    """One row with the number of cases, and of those that need a fix."""
    return gaps.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("needs_decision_fix").alias("decision_gaps"),
        F.count_if("needs_action_fix").alias("action_gaps"),
    )


def notes_metrics(records: DataFrame, actions: str) -> DataFrame:
    return records.select(
        "doc_id",
        (F.trim(F.coalesce("purpose", F.lit(""))) != "").cast("int").alias("purpose_present"),
        F.size(actions).alias("action_count"),
        F.size("decisions").alias("decision_count"),
        F.size("next_steps").alias("next_step_count"),
        F.size("risks").alias("risk_count"),
        F.size("open_questions").alias("open_question_count"),
    )


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric, v1, v2 and delta per case, in long form."""
    names = [x for x in before.columns if x != "doc_id"]
    joined = before.alias("a").join(after.alias("b"), "doc_id")
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(f"a.{n}").cast("long").alias("v1"), F.col(f"b.{n}").cast("long").alias("v2"))
            for n in names
        ]
    )
    out = joined.select("doc_id", F.explode(cells).alias("m")).select("doc_id", "m.*")
    return out.withColumn("delta", F.col("v2") - F.col("v1"))
