"""Recall of actions from explicit forms, and the rules that merge, rank and fill them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import head, keep_first, let, no_blank
from colloquy.operators import sentences as S

# ---- fixed values ------------------------------------------------------------------------------
SPEAKERS = ("Priya", "Jordan", "Morgan", "Alex")
RECAP_TRIPLE = r"(?i)recap action:\s*([^.]+)\.\s*owner:\s*([^.]+)\.\s*deadline:\s*([^.]+)\."
MARKER = r"(?i)\baction item for\s+"
MARKER_HEAD = r"(?s)^([A-Z][A-Za-z]+)[.,:;\-]?\s+(.*)$"
MARKER_STOP = r"(?is)\b(?:another decision|decision:|risk:).*$"
MARKER_VERBS = (
    "send", "confirm", "draft", "clean", "upload", "run", "check", "update", "schedule",
    "finish", "complete", "obtain", "circulate", "prepare", "create", "verify", "review", "add",
    "package", "keep",
)
COMMIT_VERBS = (
    "upload", "send", "finish", "complete", "obtain", "circulate", "prepare", "confirm", "run",
    "verify", "create", "review", "collect", "update", "draft", "clean", "schedule", "add",
    "package", "keep",
)
COMPOUND_VERBS = (
    "update", "review", "document", "write", "create", "verify", "confirm", "prepare", "send",
    "schedule", "draft", "finalize", "test", "check", "add", "fix",
)
BODY_STOP = (
    r"(?i)\b(?:ownership and deadline confirmed|ownership confirmed|both details should|confirmed,|the record must|"
    r"the notes must|no participant should|decision confirmed|risk confirmed|open question|there is also|"
    r"one unresolved question|before closing|this risk|i accept the first action|i accept first action|"
    r"i accept the second action|i accept second action|this action is intentionally unassigned|no deadline is assigned)\b.*$"
)
RECAP_ARM = r"(?i)Recap action:\s*(.*?)\.?\s*Owner:\s*([A-Za-z]+)\.?\s*Deadline:\s*([^.]*)"
EXPLICIT_ARM = r"(?i)Explicit action:\s*(.*)$"
ACCEPT_ARM = r"(?i)\bI accept\s+(?:the\s+)?(?:first|second|third)?\s*action[,.]?\s*I will\s+(.*)$"
BAD_TASK = (
    "transcript i will", "today confirm proposal scope", "risks and action items",
    "if we send the proposal", "the purpose of this meeting", "the goal today is to confirm",
    "action item for", "main priorities and next steps", "renew summary",
    "confirm score, pricing", "use explicit confirmation language",
)
DUE = (
    r"\bby\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?\s+tomorrow\b",
    r"\bby\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\bby\s+tomorrow\s+morning\b", r"\btomorrow\s+afternoon\b", r"\btomorrow\s+morning\b",
    r"\btoday\b", r"\bby\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)\b",
)
TASK_STEPS: C.Steps = (
    (r"\s+", " "),
    (r"^[ \-–—:;,.\"']+|[ \-–—:;,.\"']+$", ""),
    (r"^\[[ xX]\]\s*", ""),
    (r"^\*\*[^*]+\*\*\s*[—-]\s*", ""),
    (r"(?i)^(?:transcript\s+)?(?:i|we)\s+will\s+", ""),
    (r"(?i)^(?:i|we)\s+should\s+", ""),
    (r"(?i)^(Team|Priya|Jordan|Morgan|Alex)\s*[:\-—]\s*", ""),
    (r"^[ \-–—:;,.\"']+|[ \-–—:;,.\"']+$", ""),
)
VAGUE = (
    "if we send the proposal", "today confirm proposal scope", "risks and action items",
    "the demo should show the workflow", "wait for processing", "review summary",
    "copy or export", "do something with", "or not", "different options", "kind of do",
    "maybe do", "perhaps do", "something around", "help if you drop it", "if you drop it",
    "drop it", "whatever",
)
POLICY = (
    "not be interpreted as an assignment", "not become invented decisions",
    "be assigned during this meeting", "be retained", "risk number", "current estimate ranges",
    "be summarized before final approval", "separate confirmed risks", "unresolved questions",
    "use explicit confirmation language",
)
POLICY_STARTS = ("be limited to", "remain outside", "not promise", "not be ")
FINAL_START = ("let’s close with concrete actions", "let's close with concrete actions")
FINAL_STOP = (
    "that captures the essentials", "thank you everyone", "i’ll send a short written recap",
    "i'll send a short written recap", "direction is clear",
)
GENERIC_OWNERS = ("team", "unassigned", "we", "someone", "everyone", "")
GOOD_TASK = COMPOUND_VERBS + ("keep", "publish", "share", "collect", "upload", "run", "clean", "package", "save")


# ---- X13 ------------------------------------------------------------------------------------------
def recap_triples(text: Column) -> Column:
    """'Recap action: a. Owner: o. Deadline: d.' as (owner, action, deadline)."""

    def group(i: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(RECAP_TRIPLE), F.lit(i)), T.squash)

    rows = F.zip_with(
        group(1),
        F.zip_with(group(2), group(3), lambda o, d: F.struct(o.alias("o"), d.alias("d"))),
        lambda a, od: F.struct(
            F.when(F.lower(od["o"]) == "unassigned", "Unassigned").otherwise(od["o"]).alias("owner"),
            a.alias("action"),
            F.when(~F.lower(od["d"]).isin("no deadline", "none"), od["d"]).alias("deadline"),
        ),
    )
    return F.filter(rows, lambda r: r["action"] != "")


# ---- X17, X18 --------------------------------------------------------------------------------------
def split_compound(task: Column, verbs=COMPOUND_VERBS, joints: str = r"\s+(?:and|;|,)\s+") -> Column:
    """One task per verb that follows a joint."""
    parts = F.split(T.squash(task), rf"(?i){joints}(?=(?:{'|'.join(verbs)})\b)")
    return no_blank(F.transform(parts, lambda p: J.replace(p, r"^[ .]+|[ .]+$", "")))


def split_turns(text: Column) -> Column:
    """Split before an embedded 'Name: I will' turn."""
    parts = F.split(
        T.squash(text),
        r"\s+(?=[A-Z][A-Za-z]+:\s+(?:I|We|Team)\s+(?:will|should|need|needs)\b)",
    )
    return no_blank(F.transform(parts, lambda p: F.trim(p)))


# ---- X14, X15 ----------------------------------------------------------------------------------------
RECALLED = "struct<owner:string,task:string,due:string,confidence:double>"


def recall_owner(c: Column) -> Column:
    value = J.replace(T.squash(c), r"^[ \-–—:;,.\"']+|[ \-–—:;,.\"']+$", "")
    return let(
        value, lambda v: F.when(F.lower(v).isin("", "we", "i"), "Team").otherwise(T.capital_first(v))
    )


def recall_task(c: Column) -> Column:
    return T.capital_first(C.apply(c, TASK_STEPS))


def is_bad_task(task: Column) -> Column:
    return F.lower(task).rlike(J.any_text(BAD_TASK)) | (T.word_count(task) < 3)


def _recalled(owner: Column, task: Column, confidence: float) -> Column:
    return F.struct(
        owner.alias("owner"),
        task.alias("task"),
        T.first_of(task, DUE).alias("due"),
        F.lit(confidence).alias("confidence"),
    ).cast(RECALLED)


def owner_markers(text: Column, confidence: float = 0.84) -> Column:
    """X14: 'Action item for X ...' up to the next marker, body split into tasks."""
    bodies = F.slice(F.split(T.squash(text), MARKER), 2, 2147483646)

    def of_body(b: Column) -> Column:
        owner = recall_owner(F.regexp_extract(b, MARKER_HEAD, 1))
        body = F.regexp_replace(
            F.regexp_replace(F.regexp_extract(b, MARKER_HEAD, 2), MARKER_STOP, ""),
            r"(?i)^(?:i|we)\s+will\s+",
            "",
        )
        tasks = F.transform(
            split_compound(body, MARKER_VERBS, r",?\s+and\s+"), recall_task
        )
        return let(
            owner,
            lambda o: F.transform(
                F.filter(tasks, lambda t: (t != "") & ~is_bad_task(t)),
                lambda t: _recalled(o, t, confidence),
            ),
        )

    marked = F.filter(bodies, lambda b: b.rlike(J.ahead(MARKER_HEAD)))
    return F.flatten(F.transform(marked, of_body))


def commit_body(c: Column) -> Column:
    out = F.regexp_replace(T.squash(c), BODY_STOP, "")
    out = F.regexp_replace(
        out, r"(?i)^(?:i accept\s+(?:the\s+)?(?:first|second|third)?\s*action,?\s*)?(?:i|we)\s+will\s+", ""
    )
    out = F.regexp_replace(out, r"(?i)\bi accept ownership.*$", "")
    return F.regexp_replace(out, r"(?i)\.\s+by\s+", " by ")


def speaker_turns(text: Column, speakers=SPEAKERS) -> Column:
    """The squashed text cut before each known speaker: (speaker or '', words)."""
    names = "|".join(speakers)
    parts = no_blank(F.split(T.squash(text), rf"\s(?=(?:{names}):\s)"))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, rf"^({names}):\s", 1).alias("speaker"),
            F.regexp_replace(p, rf"^(?:{names}):\s", "").alias("words"),
        ),
    )


def explicit_commitments(text: Column, speakers=SPEAKERS) -> Column:
    """Recap, explicit, accept and 'I will' forms of each turn, arm by arm."""
    will_arm = rf"(?i)\bI will\s+((?:{'|'.join(COMMIT_VERBS)})\b.*)$"

    def item(owner: Column, body: Column, confidence: float) -> Column:
        def keep(task: Column) -> Column:
            good = (
                (task != "")
                & ~is_bad_task(task)
                & F.lower(task).rlike(J.ahead(rf"^(?:{'|'.join(COMMIT_VERBS)})\b"))
            )
            return F.when(good, _recalled(recall_owner(owner), task, confidence))

        return let(recall_task(commit_body(body)), keep)

    def said(t: Column) -> Column:
        return F.when(t["speaker"] != "", t["speaker"]).otherwise("Team")

    def recap(t: Column) -> Column:
        body = F.regexp_extract(t["words"], RECAP_ARM, 1)
        due = T.squash(F.regexp_extract(t["words"], RECAP_ARM, 3))
        dated = F.when(
            (due != "") & ~F.lower(due).isin("no deadline", "no deadline stated"),
            F.concat(body, F.lit(" by "), due),
        ).otherwise(body)
        return F.when(body != "", item(F.regexp_extract(t["words"], RECAP_ARM, 2), dated, 0.9))

    def explicit(t: Column) -> Column:
        body = F.regexp_extract(t["words"], EXPLICIT_ARM, 1)
        owner = F.when(F.lower(body).contains("intentionally unassigned"), "Unassigned").otherwise(said(t))
        return F.when(body != "", item(owner, body, 0.9))

    def accept(t: Column) -> Column:
        body = F.regexp_extract(t["words"], ACCEPT_ARM, 1)
        return F.when(body != "", item(said(t), body, 0.9))

    def will(t: Column) -> Column:
        body = F.regexp_extract(t["words"], will_arm, 1)
        return F.when(body != "", item(said(t), body, 0.84))

    return let(
        speaker_turns(text, speakers),
        lambda turns: F.filter(
            F.concat(*[F.transform(turns, arm) for arm in (recap, explicit, accept, will)]),
            lambda x: x.isNotNull(),
        ),
    )


# ---- A16, L04 ------------------------------------------------------------------------------------------
def named_owner_wins(items: Column) -> Column:
    """Per task key a named owner beats 'Team', then higher confidence, then first."""
    keyed = F.transform(
        items, lambda x: F.struct(T.spaced_key(x["task"]).alias("k"), x.alias("x"))
    )

    def build(a: Column) -> Column:
        def of_key(k: Column) -> Column:
            same = F.transform(F.filter(a, lambda s: s["k"] == k), lambda s: s["x"])

            def step(best: Column, x: Column) -> Column:
                better = ((x["owner"] != "Team") & (best["owner"] == "Team")) | (
                    x["confidence"] > best["confidence"]
                )
                return F.when(better, x).otherwise(best)

            return let(
                same,
                lambda g: F.aggregate(F.slice(g, 2, 2147483646), F.get(g, F.lit(0)), step),
            )

        return F.transform(F.array_distinct(a["k"]), of_key)

    return let(keyed, build)


def rank_sort(items: Column, ranking: tuple[str, ...], limit: int = 10) -> Column:
    """By the place of the first phrase the task holds, else 99, then by text."""

    def rank(task: Column) -> Column:
        low, out = F.lower(task), F.lit(99)
        for i, phrase in reversed(list(enumerate(ranking))):
            out = F.when(F.contains(low, F.lit(phrase)), F.lit(i)).otherwise(out)
        return out

    keyed = F.transform(
        items,
        lambda x, i: F.struct(
            rank(x["task"]).alias("r"), F.lower(x["task"]).alias("t"), i.alias("i"), x.alias("x")
        ),
    )
    return head(F.transform(F.sort_array(keyed), lambda s: s["x"]), limit)


# ---- P17 ---------------------------------------------------------------------------------------------------
def is_low_precision(task: Column) -> Column:
    """Vague or conditional tasks, and policy statements that read like tasks."""
    low = F.lower(T.squash(task))
    return (
        (low == "")
        | low.rlike(J.ahead(L.starts(("if ", "maybe ", "perhaps "))))
        | low.rlike(J.any_text(VAGUE + POLICY))
        | low.rlike(J.ahead(L.starts(POLICY_STARTS)))
    )


# ---- W13, X16 -------------------------------------------------------------------------------------------------
def between_markers(sents: Column, start=FINAL_START, stop=FINAL_STOP) -> Column:
    """Sentences after the first start phrase and before the first stop phrase after it."""

    def first_at(a: Column, phrases) -> Column:
        hits = F.transform(a, lambda s: F.lower(s).rlike(J.any_text(phrases)))
        return F.array_position(hits, F.lit(True)).cast("int")

    def cut(a: Column) -> Column:
        return let(
            first_at(a, start),
            lambda p: F.when(
                p > 0,
                let(
                    F.slice(a, p + 1, F.size(a)),
                    lambda rest: let(
                        first_at(rest, stop),
                        lambda q: F.when(q > 0, F.slice(rest, F.lit(1), q - 1)).otherwise(rest),
                    ),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )

    return let(sents, cut)


FINAL = "struct<owner:string,task:string,due:string>"


def is_final_task(task: Column) -> Column:
    low = F.lower(task)
    return T.word_count(task).between(4, 18) & low.rlike(J.ahead(rf"^(?:{'|'.join(GOOD_TASK)})\b"))


def final_actions(sents: Column, limit: int = 8) -> Column:
    """X16: 'Name will do' and 'next step is to do' of closing sentences."""
    will = r"\b([A-Z][a-z]+)\s+will\s+(?:also\s+)?(.+)$"
    step = r"(?i)\bnext step is to (.+)$"

    def of_sentence(s: Column) -> Column:
        due = T.deadline_local(s)
        own = F.transform(
            split_compound(F.regexp_extract(s, will, 2)),
            lambda t: F.struct(F.regexp_extract(s, will, 1).alias("owner"), t.alias("task"), due.alias("due")).cast(FINAL),
        )
        none = F.lit(None).cast("string")
        nxt = F.transform(
            F.filter(F.array(F.regexp_extract(s, step, 1)), lambda t: t != ""),
            lambda t: F.struct(none.alias("owner"), t.alias("task"), due.alias("due")).cast(FINAL),
        )
        return F.concat(own, nxt)

    made = F.transform(
        F.flatten(F.transform(F.transform(sents, T.squash), of_sentence)),
        lambda x: x.withField("task", C.apply(x["task"], C.LOCAL_SENTENCE)),
    )
    return keep_first(
        F.filter(made, lambda x: is_final_task(x["task"])), lambda x: T.compact_key(x["task"]), limit
    )


# ---- J14, J15, J16, J17, J19 --------------------------------------------------------------------------------------
def restore_metadata(finals: Column, candidates: Column) -> Column:
    """Each final action takes chunk and context of the first candidate with its key."""
    known = F.transform(
        candidates, lambda c: F.struct(T.spaced_key(c["action"]).alias("k"), c.alias("c"))
    )

    def build(a: Column) -> Column:
        def one(f: Column) -> Column:
            return let(
                T.spaced_key(f["task"]),
                lambda k: let(
                    F.get(F.filter(a, lambda s: s["k"] == k), F.lit(0)),
                    lambda hit: f.withField("source_chunk", hit["c"]["source_chunk"]).withField(
                        "reason_context", hit["c"]["reason_context"]
                    ),
                ),
            )

        return F.transform(finals, one)

    return let(known, build)


@dataclass(frozen=True)
class BackedRule:
    """Add ``task`` when a decision holds one of ``decided`` and no action one of ``covered``."""

    decided: tuple[str, ...]
    covered: tuple[str, ...]
    task: str
    owner: str = "Team"


def decision_backed(decisions: Column, tasks: Column, rules: tuple[BackedRule, ...]) -> Column:
    """Tasks that a decision states and no action covers, put first."""
    stated = F.lower(F.array_join(decisions, " "))
    done = F.lower(F.array_join(tasks, " "))

    def added(d: Column, a: Column) -> Column:
        new = [
            F.when(d.rlike(J.any_text(r.decided)) & ~a.rlike(J.any_text(r.covered)), F.lit(r.task))
            for r in rules
        ]
        return F.filter(F.array(*new), lambda t: t.isNotNull())

    extra = let(F.struct(stated.alias("d"), done.alias("a")), lambda s: added(s["d"], s["a"]))
    return F.concat(extra, tasks)


def recall_backfill(markers: Column, stored: Column, recalled: Column, chunked: Column, enough: int = 3) -> Column:
    """Recall arms join only while there are too few; many markers replace all."""

    def build(s: Column) -> Column:
        few = F.size(s["m"]) + F.size(s["i"]) < enough
        r = F.when(few, s["r"]).otherwise(F.slice(s["r"], 1, 0))
        c = F.when(
            F.size(s["m"]) + F.size(s["i"]) + F.size(r) < enough, s["c"]
        ).otherwise(F.slice(s["c"], 1, 0))
        return F.when(F.size(s["m"]) >= enough, s["m"]).otherwise(F.concat(s["m"], s["i"], r, c))

    return let(
        F.struct(markers.alias("m"), stored.alias("i"), recalled.alias("r"), chunked.alias("c")), build
    )


def norm_words(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return T.squash(
        F.regexp_replace(F.regexp_replace(low, r"[_*`#>\[\]()]+", " "), J.NOT_ALNUM_WHITE[:-1] + "%:-]", " ")
    )


def owner_hints(texts: Column) -> Column:
    """J17: 'Priya for pricing, Jordan for demo' as (owner, keyword) in text order."""

    def of_text(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(t, r"\.+$", ""), r",\s+and\s+([A-Z][a-zA-Z]+)\s+for\b", ", $1 for")
        blocks = F.split(body, r",\s+(?=[A-Z][a-zA-Z]+\s+for\b)")
        pattern = r"\b([A-Z][a-zA-Z]+)\s+for\s+([^.;]+)$"

        def of_block(b: Column) -> Column:
            owner = F.regexp_extract(b, pattern, 1)
            words = no_blank(
                F.transform(
                    F.split(F.regexp_extract(b, pattern, 2), r"\s*,\s*|\s+and\s+"), norm_words
                )
            )
            return F.transform(
                words, lambda w: F.struct(owner.alias("owner"), w.alias("keyword"))
            )

        return F.flatten(F.transform(blocks, of_block))

    hinted = F.filter(texts, lambda t: F.lower(t).contains(" for "))
    return F.flatten(F.transform(hinted, of_text))


def infer_owner(owner: Column, task: Column, hints: Column) -> Column:
    """A named owner stays; a generic one takes the first hint whose keyword the task holds."""
    hit = let(
        norm_words(task), lambda t: F.get(F.filter(hints, lambda h: F.contains(t, h["keyword"])), F.lit(0))["owner"]
    )
    generic = F.lower(F.trim(F.coalesce(owner, F.lit("")))).isin(*GENERIC_OWNERS)
    fallback = F.when(F.coalesce(owner, F.lit("")) != "", owner).otherwise("Team")
    return F.when(generic, F.coalesce(hit, fallback)).otherwise(owner)


@dataclass(frozen=True)
class PhraseRule:
    """Emit ``output`` of ``kind`` when all and any terms occur within the word bounds."""

    kind: str
    output: str
    all_terms: tuple[str, ...] = ()
    any_terms: tuple[str, ...] = ()
    min_words: int = 0
    max_words: int = 1_000_000_000


def phrase_items(text: Column, rules: tuple[PhraseRule, ...]) -> Column:
    """Rows of the rules that fire, in rule order."""

    def fire(s: Column) -> Column:
        made = []
        for r in rules:
            test = s["n"].between(r.min_words, r.max_words)
            for term in r.all_terms:
                test = test & F.contains(s["low"], F.lit(term))
            if r.any_terms:
                test = test & s["low"].rlike(J.ahead(L.any_text(r.any_terms)))
            made.append(F.when(test, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.output).alias("text"))))
        return F.filter(F.array(*made), lambda x: x.isNotNull())

    clean = F.lower(T.squash(F.coalesce(text, F.lit(""))))
    return let(
        F.struct(clean.alias("low"), T.word_count(clean).alias("n")), fire
    )


# ---- F03 dialects not in functions.text ----------------------------------------------------------------------------
def article_key(c: Column) -> Column:
    """Speaker noise and articles out, letters and digits kept."""
    low = J.replace(F.lower(T.strip_speaker_noise(c)), r"\b(the|a|an)\b", " ")
    return T.squash(F.regexp_replace(low, J.NOT_ALNUM_WHITE, " "))


def soft_stem(w: Column) -> Column:
    out = None
    for suffix in ("ing", "ed", "es", "s"):
        hit = w.endswith(suffix) & (F.length(w) > len(suffix) + 3)
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(w)


def stem_key(c: Column) -> Column:
    """Due marks and small words out, light stemming."""
    low = F.regexp_replace(F.lower(T.strip_speaker_noise(c)), r"\(due:\s*([^)]+)\)", "")
    words = no_blank(F.split(T.squash(F.regexp_replace(low, J.NOT_ALNUM_WHITE, " ")), " "))
    kept = F.filter(words, lambda w: ~w.isin("a", "an", "the", "is", "as"))
    return F.array_join(F.transform(kept, soft_stem), " ")


def action_key(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), r"\(due:\s*([^)]+)\)", "")
    return T.squash(
        J.replace(F.regexp_replace(low, J.NOT_ALNUM_WHITE, " "), r"\b(a|an|the|is|as)\b", " ")
    )


def precision_task_key(c: Column) -> Column:
    return T.spaced_key(C.apply(c, C.PRECISION_TASK_KEY))


def precision_decision_key(c: Column) -> Column:
    return T.squash(C.apply(T.spaced_key(c), C.PRECISION_DECISION_KEY))


# ---- X21 ---------------------------------------------------------------------------------------------------------------
# fixed values: the action line cleaner
DROP_LINE = (
    r"\blet'?s make that an action item\b", r"\bmake that an action item\b",
    r"\bthat should be an action item\b", r"\bwe should include\b", r"\bthat'?s helpful\b",
    r"\bsounds good\b", r"\bexactly\b", r"\bi think\b", r"\bi also think\b",
    r"\bthe main purpose\b",
)
LINE_HINTS = (
    "send", "review", "finalize", "prepare", "create", "run", "share", "update", "fix", "keep",
    "record", "confirm", "draft", "upload", "check", "test", "validate", "follow up",
    "follow-up", "reach out", "schedule", "complete", "deliver", "use", "watch", "build",
    "document", "verify", "fetch", "add", "package", "save",
)
LINE_BAD_STARTS = (
    "speaker one", "speaker two", "speaker 1", "speaker 2", "team - speaker", "i think",
    "i also think", "we should be careful", "it is important", "the main purpose",
)
LINE_SPLIT = (
    "prepare", "keep", "create", "run", "send", "share", "update", "fix", "record", "upload",
    "test", "draft", "schedule", "review", "finalize", "confirm", "validate", "verify",
    "document", "add", "package", "save",
)
LINE_KEEP = ("review and finalize", "check and confirm")
LINE_DUE = (
    r"(?i)\b(by|before|on)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|tomorrow|tonight|next week|next month)\b"
)
LINE_TASK: C.Steps = (
    (r"^(?:[A-Z][a-z]+,\s*)+", ""),
    (r"(?i)^(will|to)\s+", ""),
    (r"(?i)^also\s+", ""),
    (r"(?i)^we should\s+", ""),
    (r"(?i)^should\s+", ""),
    (r"(?i)^we need to\s+", ""),
    (r"(?i)^need to\s+", ""),
    (r"(?i)^include\s+", "prepare "),
    (r"(?i)^reviewed and finalized\b", "review and finalize"),
    (r"(?i)^reviewed\b", "review"),
    (r"(?i)^finalized\b", "finalize"),
    (r"(?i)\s+so that\s+.+$", ""),
    (r"(?i)\s+because\s+.+$", ""),
    (r"(?i)\s+though\s+.+$", ""),
    (r"(?i)\s+without interruption\.?$", ""),
    (r"^[ .,\-]+|[ .,\-]+$", ""),
)
LINE_NORMAL: C.Steps = (
    (r"\s*[—–]\s*", " - "),
    (r"\s+-\s+", " - "),
    (r"\s+", " "),
    (r"^[ \-]+|[ \-]+$", ""),
)


def clean_lines(lines: Column) -> Column:
    """Action lines normalized, rewritten, split, gated and deduped."""

    def of_line(raw: Column) -> Column:
        text = C.apply(raw, LINE_NORMAL)

        def bound(s: Column) -> Column:
            due = s["due"]
            # a due phrase cuts the text at its place
            bare = F.when(
                due != "",
                F.regexp_replace(F.get(F.split(s["text"], LINE_DUE, 2), F.lit(0)), r"^[ ,.\-]+|[ ,.\-]+$", ""),
            ).otherwise(s["text"])
            will = r"^([A-Z][a-zA-Z]+)\s+will\s+(.+)$"
            owner = F.when(bare.contains(" - "), F.trim(F.substring_index(bare, " - ", 1))).otherwise(
                F.regexp_extract(bare, will, 1)
            )
            task = (
                F.when(bare.contains(" - "), F.trim(F.regexp_replace(bare, r"^.*? - ", "")))
                .when(bare.rlike(will), F.regexp_extract(bare, will, 2))
                .otherwise(bare)
            )
            return let(
                F.struct(
                    F.when(owner == "", "Team")
                    .when(F.lower(owner).isin("we", "team"), "Team")
                    .otherwise(owner)
                    .alias("owner"),
                    C.apply(task, LINE_TASK).alias("task"),
                    due.alias("due"),
                ),
                emit,
            )

        def emit(p: Column) -> Column:
            low = F.lower(p["task"])
            n = T.word_count(p["task"])
            usable = (
                n.between(3, 22)
                & ~low.rlike(J.ahead(L.starts(LINE_BAD_STARTS)))
                & (low.contains(" will ") | low.rlike(J.any_text(LINE_HINTS)))
            )
            parts = F.split(p["task"], r"\s+and\s+", 2)
            split = (
                ~low.rlike(J.any_text(LINE_KEEP))
                & (F.size(parts) == 2)
                & F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).rlike(J.ahead(rf"^(?:{'|'.join(LINE_SPLIT)}) "))
            )
            tasks = F.when(split, parts).otherwise(F.array(p["task"]))
            made = F.transform(
                no_blank(F.transform(tasks, lambda t: F.trim(t))),
                lambda t: F.concat(
                    p["owner"], F.lit(" - "), t,
                    F.when(p["due"] != "", F.concat(F.lit(" (due: "), p["due"], F.lit(")"))).otherwise(""),
                ),
            )
            return F.when(usable, made).otherwise(F.array().cast("array<string>"))

        return let(
            F.struct(text.alias("text"), F.regexp_extract(text, LINE_DUE, 0).alias("due")), bound
        )

    kept = F.filter(lines, lambda l: ~F.lower(l).rlike(J.ahead(L.any_of(DROP_LINE))))
    made = F.flatten(F.transform(kept, of_line))
    good = F.filter(
        made,
        lambda m: ~F.lower(m).rlike(J.any_text(LINE_BAD_STARTS))
        & ~F.lower(m).rlike(J.ahead("speaker | sounds good| exactly"))
        & F.lower(F.regexp_replace(m, r"^.*? - ", "")).rlike(J.any_text(LINE_HINTS)),
    )

    def key(m: Column) -> Column:
        low = F.regexp_replace(F.lower(m), r"\(due:[^)]+\)", "")
        return T.squash(F.regexp_replace(low, J.NOT_ALNUM_SPACE_RUN, ""))

    return keep_first(good, key)
