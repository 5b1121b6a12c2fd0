"""Quality-pass sentences, candidates by hints, the non-meeting test and the canonical family."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import head, keep_first, let, let_all, no_blank
from colloquy.operators import sentences as S

# ---- fixed values: hint patterns ---------------------------------------------------------------
ACTION_HINTS = (
    r"\b(need to|needs to|should|must|follow up|next step|action item|owner|deadline|due|please|we will|we'll|i will|i'll|"
    r"you will|team will|prepare|finalize|create|send|share|review|update|schedule|draft|test|run|validate|document|fix|"
    r"clean up|package|confirm|record|ship|deploy|keep|move)\b"
)
VERB_HINTS = (
    r"\b(prepare|finalize|create|send|share|review|update|schedule|draft|test|run|validate|document|fix|clean up|package|"
    r"confirm|record|ship|deploy|keep|move)\b"
)
FUTURE_HINTS = (
    r"\b(we need to|we should|we must|we will|we'll|i will|i'll|you should|next step|action item|owner|deadline|due|"
    r"before .* demo|by friday|by monday|by tuesday|by wednesday|by thursday|this week|next week)\b"
)
OWNER_HINTS = r"\b(owner|owners|assigned to|i will|i'll|you will|team will|we will|we'll)\b"
VALUE_HINTS = (
    r"\b(teams want|users want|already valuable|is valuable|a clear summary|shareable notes|after a meeting|"
    r"value proposition|pilot readiness)\b"
)
NOISE_HINTS = r"\b(already valuable|teams want|after a meeting|model tends to preserve|framing language|already much cleaner than before)\b"
EXCLUDE_HINTS = r"\b(pilot audience focused|users with clear pain|short meetings|practical positioning message|broad platform pitch)\b"
DECISION_HINTS = (
    r"\b(we decided|decided to|we agreed|agreed to|the decision is|the plan is|we will use|we'll use|we are going with|"
    r"we're going with|let's use|lead with|treat .* as|use .* as the)\b"
)
RISK_HINTS = r"\b(risk|issue|concern|watch carefully|blocker|problem|timing|slow|latency|failure|hallucination|safety|degrade|contamination)\b"
INFRA_HINTS = (
    r"\b(worker|database|storage|redis|postgres|backend|frontend|raw media path|upload|file attached|job status|queue|queued|"
    r"processing flow|healthz)\b"
)
BUSINESS_HINTS = (
    r"\b(product|demo|pilot|outreach|workflow|quality|meeting|baseline|summary|decision|action|launch|customer|client|"
    r"positioning|benchmark|pass|landing page)\b"
)
DUE_HINTS = r"\b(today|tomorrow|this week|next week|by friday|by monday|by tuesday|by wednesday|by thursday|by the end of|before .* demo|after .* test)\b"
COMPOUND_HINTS = (
    r"\b(landing page and outreach message|pilot outreach package|review and finalize|prepare and share|create and send|"
    r"review and confirm)\b"
)
PAST_HINTS = r"\b(stabilized|finished|completed|shipped|launched|improved|resolved|fixed)\b"
IMPERATIVES = (
    "prepare", "finalize", "create", "send", "share", "review", "update", "schedule", "draft",
    "test", "run", "validate", "document", "fix", "clean", "package", "confirm", "record",
    "ship", "deploy", "use", "lead", "treat", "keep", "move",
)
SPEAKER_NOISE: C.Steps = (
    (r"^(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?[,:\-]\s+)+", ""),
    (r"^\s+|\s+$", ""),
    (r"(?i)\bdecision\s+(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b[:,]?\s*", ""),
    (r"^\s+|\s+$", ""),
)
ACTION_CLEAN: C.Steps = (
    (r"(?i)^action item[:\-\s]+", ""),
    (r"(?i)^next step[:\-\s]+", ""),
    (r"(?i)^we need to\s+", ""),
    (r"(?i)^we should\s+", ""),
    (r"(?i)^let's\s+", ""),
    (r"(?i)^lets\s+", ""),
    (r"(?i)^please\s+", ""),
    (r"(?i)^i will\s+", ""),
    (r"(?i)^i'll\s+", ""),
    (r"(?i)^we will\s+", ""),
    (r"(?i)^we'll\s+", ""),
    (r"(?i)^team will\s+", ""),
    (r"(?i)\bwe should\b", ""),
    (r"(?i)\bwe need to\b", ""),
    (r"(?i)\bwe have to\b", ""),
    (r"(?i)\bit would be good to\b", ""),
    (r"\s+", " "),
    (r"^[ ,.\-]+|[ ,.\-]+$", ""),
)
DECISION_CLEAN: C.Steps = (
    (r"(?i)^we decided to\s+", ""),
    (r"(?i)^decided to\s+", ""),
    (r"(?i)^we agreed to\s+", ""),
    (r"(?i)^agreed to\s+", ""),
    (r"(?i)^the decision is(?: that)?\s+", ""),
    (r"(?i)^the plan is(?: to)?\s+", ""),
    (r"(?i)^we will use\s+", ""),
    (r"(?i)^we'll use\s+", ""),
    (r"(?i)^let's use\s+", ""),
    (r"(?i)^we are going with\s+", ""),
    (r"(?i)^we're going with\s+", ""),
    (r"\s+", " "),
    (r"^[ ,.\-]+|[ ,.\-]+$", ""),
)
MEETING_MARKS = (
    "meeting", "agenda", "action item", "action items", "next steps", "follow-up", "follow up",
    "decision", "decisions", "owner", "owners", "demo", "pilot", "roadmap", "sync", "standup",
    "client call", "weekly call",
)
STORY_MARKS = (
    "sherlock holmes", "said holmes", "mr holmes", "watson", "armchair", "gentleman", "red hair",
    "fiery red hair", "adventure", "chronicle", "client, flushing", "cried our client",
    "scene of action", "autumn of last year",
)
ACTION_LANGUAGE = r"\b(?:we need to|we should|please|can you|by friday|owner|due date|next step|action item)\b"
DECISION_LANGUAGE = r"\b(?:we decided|decision is|decision one|agreed to|aligned on|approved)\b"
SAFE_SUMMARY = "This appears to be non-meeting audio, so no business decisions or action items were extracted."
SAFE_OUTCOME = "No clear meeting structure was detected."


def strip_noise(c: Column) -> Column:
    return C.apply(F.trim(c), SPEAKER_NOISE)


def noise_key(c: Column) -> Column:
    low = J.replace(F.lower(strip_noise(c)), r"\b(the|a|an)\b", " ")
    return T.squash(F.regexp_replace(low, J.NOT_ALNUM_WHITE, " "))


def quality_sentences(text: Column) -> Column:
    """X01, quality-pass form: also cut after ':' and ';', short pieces dropped, deduped."""
    pieces = F.split(T.squash(F.coalesce(text, F.lit(""))), r"(?<=[.?!:;])\s+")
    tidy = F.transform(pieces, lambda s: J.replace(s, r"^[ \-]+|[ \-]+$", ""))
    long = F.filter(tidy, lambda s: F.length(s) >= 18)
    return keep_first(F.transform(long, strip_noise), noise_key)


# ---- Q01 -----------------------------------------------------------------------------------------
def marks_found(low: Column, marks: tuple[str, ...]) -> Column:
    """How many of the marks occur in the lower-cased text."""
    return sum((T.when1(F.contains(low, F.lit(m)), 1) for m in marks), F.lit(0))


def non_meeting(text: Column, n_sentences: Column, stories=STORY_MARKS, many: int = 12) -> Column:
    """Q01: a told story, or many sentences without any business structure."""

    def test(s: Column) -> Column:
        low = s["low"]
        story = (marks_found(low, stories) >= 3) & (marks_found(low, MEETING_MARKS) <= 2)
        plain = (
            (s["n"] >= many)
            & (marks_found(low, MEETING_MARKS) == 0)
            & ~low.rlike(J.ahead(ACTION_LANGUAGE))
            & ~low.rlike(J.ahead(DECISION_LANGUAGE))
        )
        return (low != "") & (story | plain)

    return let(
        F.struct(F.lower(T.squash(F.coalesce(text, F.lit("")))).alias("low"), n_sentences.alias("n")), test
    )


# ---- X23, X28: candidates ------------------------------------------------------------------------------
def starts_imperative(c: Column) -> Column:
    first = F.lower(F.substring_index(F.regexp_replace(c, r"^[^A-Za-z]+", ""), " ", 1))
    return first.isin(*IMPERATIVES)


def is_action_candidate(c: Column) -> Column:
    def test(low: Column, future: Column, due: Column, owner: Column) -> Column:
        shaped = future | due | owner | (starts_imperative(c) & low.rlike(J.ahead(VERB_HINTS)))
        return (
            shaped
            & ~(low.rlike(J.ahead(VALUE_HINTS)) & ~(due | owner | future))
            & ~low.rlike(J.ahead(INFRA_HINTS))
            & ~(low.rlike(J.ahead(RISK_HINTS)) & ~future)
            & ~(low.rlike(J.ahead(PAST_HINTS)) & ~(future | due | owner))
            & ~(low.rlike(J.ahead(EXCLUDE_HINTS)) & ~(due | owner))
        )

    hints = (FUTURE_HINTS, DUE_HINTS, OWNER_HINTS)
    return let(F.lower(c), lambda low: let_all([low, *[low.rlike(J.ahead(h)) for h in hints]], test))


SCORED = "struct<score:int,text:string>"


def _by_score(found: Column) -> Column:
    ranked = F.sort_array(
        F.transform(
            found,
            lambda x: F.struct((-x["score"]).alias("n"), x["text"].alias("text"), x["score"].alias("score")),
        )
    )
    return F.transform(
        ranked, lambda x: F.struct(x["score"].alias("score"), x["text"].alias("text")).cast(SCORED)
    )


def action_candidates(sents: Column, key) -> Column:
    """Scored action candidates, best first, ties by text."""

    def score(low: Column, s: Column) -> Column:
        return (
            T.when1(low.rlike(J.ahead(ACTION_HINTS)), 2)
            + T.when1(low.rlike(J.ahead(DUE_HINTS)), 3)
            + T.when1(low.rlike(J.ahead(OWNER_HINTS)), 2)
            + T.when1(starts_imperative(s), 2)
            + T.when1(low.rlike(J.ahead(VERB_HINTS)), 1)
            + T.when1(low.rlike(J.ahead(COMPOUND_HINTS)), 2)
            + T.when1(low.rlike(J.ahead(r"\b(outreach|landing page|pilot)\b")), 1)
        )

    def of_sentence(s: Column) -> Column:
        low = F.lower(s)
        pieces = no_blank(
            F.transform(F.split(s, " and "), lambda p: J.replace(p, r"^[ ,.\-]+|[ ,.\-]+$", ""))
        )
        splits = (
            ~low.rlike(J.ahead(DUE_HINTS))
            & ~low.rlike(J.ahead(COMPOUND_HINTS))
            & s.contains(" and ")
            & F.size(pieces).between(2, 3)
        )
        parts = F.filter(F.when(splits, pieces).otherwise(F.array(s)), is_action_candidate)
        return let(
            score(low, s),
            lambda n: F.transform(
                parts,
                lambda p: F.struct(
                    n.alias("score"),
                    T.capital_first(C.apply(strip_noise(p), ACTION_CLEAN)).alias("text"),
                ).cast(SCORED),
            ),
        )

    good = F.filter(sents, lambda s: ~F.lower(s).rlike(J.ahead(DECISION_HINTS)) & is_action_candidate(s))
    made = F.flatten(F.transform(good, of_sentence))
    return _by_score(
        keep_first(F.filter(made, lambda x: F.length(x["text"]) >= 12), lambda x: key(x["text"]))
    )


def decision_candidates(sents: Column) -> Column:
    def score(s: Column) -> Column:
        low = F.lower(s)
        return (
            T.when1(low.rlike(J.ahead(DECISION_HINTS)), 4)
            + T.when1(low.rlike(J.ahead(r"\b(use .* as the|lead with|treat .* as|going with)\b")), 2)
            + T.when1(low.rlike(J.ahead(ACTION_HINTS)) & low.rlike(J.ahead(DUE_HINTS)), -1)
        )

    made = F.transform(
        F.filter(sents, lambda s: ~F.lower(s).rlike(J.ahead(INFRA_HINTS))),
        lambda s: F.struct(
            score(s).alias("score"),
            T.capital_first(C.apply(strip_noise(s), DECISION_CLEAN)).alias("text"),
        ).cast(SCORED),
    )
    good = F.filter(made, lambda x: (x["score"] > 0) & (F.length(x["text"]) >= 12))
    return _by_score(keep_first(good, lambda x: noise_key(x["text"])))


def key_point_candidates(sents: Column) -> Column:
    """Sentences of no other kind with a business signal, by score then text."""

    def score(low: Column) -> Column:
        return T.when1(low.rlike(J.ahead(BUSINESS_HINTS)), 2) + T.when1(
            low.rlike(J.ahead(r"\b(improved|baseline|workflow|quality|demo|pilot|customer|summary)\b")), 1
        )

    def plain(s: Column) -> Column:
        low = F.lower(s)
        kinds = (RISK_HINTS, INFRA_HINTS, ACTION_HINTS, DECISION_HINTS, VALUE_HINTS, NOISE_HINTS)
        return ~low.rlike(J.ahead("|".join(kinds))) & T.word_count(s).between(8, 35)

    made = F.transform(
        F.filter(sents, plain),
        lambda s: F.struct(
            score(F.lower(s)).alias("score"),
            strip_noise(F.regexp_replace(s, r"^[ ,.\-]+|[ ,.\-]+$", "")).alias("text"),
        ).cast(SCORED),
    )
    return _by_score(
        keep_first(F.filter(made, lambda x: x["score"] > 0), lambda x: noise_key(x["text"]))
    )


def fill_with(existing: Column, candidates: Column, key, limit: int) -> Column:
    """Existing items first, then candidates by rank, first of each key, capped."""
    texts = F.transform(candidates, lambda x: x["text"])
    return keep_first(
        F.concat(F.transform(existing, lambda s: F.trim(s)), texts), key, limit
    )


# ---- X22: the canonical family --------------------------------------------------------------------------
# fixed values
CANON_PURPOSE = (
    r"^the purpose of this meeting is\b", r"^the main purpose of (?:today'?s|this) meeting is\b",
    r"^the main purpose is\b", r"^purpose:", r"^today(?:,)? we need to\b", r"^we are here to\b",
    r"^the meeting is to\b",
)
CANON_OUTCOME = (
    r"^by the end of the meeting\b", r"^the goal is to leave with\b", r"^we should leave with\b",
    r"^i(?:'d| would) like us to leave (?:this )?meeting with\b",
    r"^i want us to leave (?:this )?meeting with\b", r"^outcome:",
)
CANON_NEXT = ("next step", "next steps", "we will next", "after this")
CANON_DECISION = (
    "we agreed", "we decided", "decision:", "final decision", "the decision is",
    "the best first audience is", "for the pilot, i suggest", "let's separate two things clearly",
)
CANON_NO_DECISION = (
    "let's talk about", "we should discuss", "create a brand new meeting", "upload the audio",
    "monitor the worker logs", "review the markdown notes", "check the summary",
)
CANON_VERBS = (
    "prepare", "finalize", "update", "review", "benchmark", "create", "send", "share", "test",
    "compare", "fix", "lock", "package", "keep", "confirm", "draft", "record",
)
CANON_NO_ACTION = (
    "if the live run feels slow", "one risk is", "the risk is", "let's talk about",
    "we should decide", "by the end of the meeting", "the purpose of this meeting", "we agreed",
    "we decided",
)
CANON_TEAMS = ("team", "marketing", "engineering", "product", "design")
CANON_DUE = (
    r"\bby\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"\bthis week\b",
    r"\bnext week\b", r"\btomorrow\b", r"\btoday\b",
)
CANON_SPLIT: C.Steps = (
    (r"\b[Ss]peaker\s+(?:One|Two|Three)\s*[,:]", ". "),
    (r"\b[Dd]ecision\s+(?:one|two|three|four|1|2|3|4)\s*,", ". "),
    (r"\b[Ff]irst\s*,", ". First, "),
    (r"\b[Ss]econd\s*,", ". Second, "),
    (r"\b[Tt]hird\s*,", ". Third, "),
    (r"\b[Tt]eam will\b", ". Team will"),
    (r"\b[Tt]eam should\b", ". Team should"),
    (r"\b[Mm]arketing should\b", ". Marketing should"),
    (r"\b[Ee]ngineering should\b", ". Engineering should"),
    (r"\b[Pp]roduct should\b", ". Product should"),
    (r"\b[Dd]esign should\b", ". Design should"),
    (r"\b[Tt]he next step is to\b", ". The next step is to"),
    (r"\b[Ii]mmediate next steps\b", ". Immediate next steps"),
    (r"\.\s*\.", ". "),
    (r"\s+", " "),
    (r"^ +| +$", ""),
)
CANON_SENTENCE: C.Steps = (
    (r"^\s+|\s+$", ""),
    (r"\b[Ss]peaker\s+(?:One|Two|Three)\s*,?\s*", ""),
    (r"(?i)^(yes|yeah|okay|ok|right|exactly|perfect|sounds good)\s*,\s*", ""),
    (r"\s+", " "),
    (r"\s+,", ","),
    (r",\s*\.", "."),
    (r"\.{2,}", "."),
    (r"^[ ,]+|[ ,]+$", ""),
)
CANON_ACTION = "struct<text:string,owner:string,due:string,confidence:double>"


def canon_sentence(c: Column) -> Column:
    def close(out: Column) -> Column:
        closed = F.when(out.rlike(r"[.!?]$"), out).otherwise(F.concat(out, F.lit(".")))
        capital = let(closed, lambda s: F.when(s.rlike("^[a-z]"), T.capital_first(s)).otherwise(s))
        return F.when(out == "", "").otherwise(capital)

    return let(C.apply(c, CANON_SENTENCE), close)


def canon_sentences(text: Column) -> Column:
    body = C.apply(F.coalesce(text, F.lit("")), CANON_SPLIT)
    return no_blank(F.transform(F.split(body, S.BREAK), canon_sentence))


def _messy(s: Column) -> Column:
    low, n = F.lower(s), T.word_count(s)
    commas = F.length(s) - F.length(F.replace(s, F.lit(",")))
    return (n > 50) | ((commas >= 5) & (n > 35))


def canon_decisions(sents: Column, limit: int = 5) -> Column:
    good = F.filter(
        sents,
        lambda s: ~_messy(s)
        & (T.word_count(s) <= 40)
        & ~T.has_any(s, CANON_NO_DECISION)
        & T.has_any(s, CANON_DECISION),
    )
    return keep_first(good, lambda s: F.lower(s), limit)


def canon_risks(sents: Column, limit: int = 5) -> Column:
    good = F.filter(
        sents,
        lambda s: F.lower(s).rlike(J.ahead("one risk|the risk|^risk:|one issue|^concern:|watch carefully")) & ~_messy(s),
    )
    return keep_first(good, lambda s: F.lower(s), limit)


def canon_actions(sents: Column, limit: int = 6) -> Column:
    teams = "|".join(CANON_TEAMS)
    verbs = "|".join(CANON_VERBS)

    def good(s: Column) -> Column:
        low = F.lower(s)
        return (
            ~_messy(s)
            & (T.word_count(s) <= 35)
            & ~T.has_any(s, CANON_NO_ACTION)
            & ~low.startswith("if ")
            & low.rlike(J.ahead(rf"^(?:{teams})\b.*\b(will|should|need to|needs to)\b|^(?:{verbs}) |^we (?:should|will) (?:{verbs}) "
                rf"| we (?:should|will|need to) (?:{verbs}) | let's (?:{verbs}) "))
        )

    def make(s: Column) -> Column:
        rule = r"(?i)^(Team|Marketing|Engineering|Product|Design)\s+(?:should|will)\s+(.+)$"
        owner = F.regexp_extract(s, rule, 1)
        task = F.when(owner != "", F.regexp_extract(s, rule, 2)).otherwise(s)
        return F.struct(
            canon_sentence(task).alias("text"),
            F.when(owner != "", F.initcap(owner)).alias("owner"),
            F.coalesce(*[T.first_group(F.lower(s), p) for p in CANON_DUE]).alias("due"),
            F.when(owner != "", F.lit(0.90)).otherwise(F.lit(0.78)).alias("confidence"),
        ).cast(CANON_ACTION)

    return keep_first(F.transform(F.filter(sents, good), make), lambda a: F.lower(a["text"]), limit)


def canon_next(sents: Column, limit: int = 5) -> Column:
    return keep_first(
        F.filter(sents, lambda s: F.lower(s).rlike(J.ahead(L.starts(CANON_NEXT)))),
        lambda s: F.lower(T.squash(s)),
        limit,
    )


def canon_points(purpose: Column, outcome: Column, decisions: Column, risks: Column, steps: Column, actions: Column) -> Column:
    texts = F.concat(
        no_blank(F.array(purpose, outcome)),
        head(decisions, 2),
        head(risks, 2),
        head(steps, 2),
        F.transform(head(actions, 2), lambda a: a["text"]),
    )
    return keep_first(texts, lambda s: F.lower(T.squash(s)), 8)
