"""Third-engine items: actions, decisions, risks, questions and slots from spoken sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import head, keep_first, let, let_all, no_blank

ACTION = "struct<owner:string,task:string,deadline:string,confidence:double,evidence:string>"
DECISION = "struct<text:string,evidence:string>"

# fixed values: patterns of the third engine
TEAM_OWNERS = ("Team",)
INVALID_STARTS = ("this risk", "the team is deciding", "from the customer perspective")
PREFIX = r"^([A-Z][A-Za-z .'-]{1,40}|Team|Unassigned)\s*[:\-–—]\s*(.+)$"
MODAL = r"^([A-Z][A-Za-z .'-]{1,40})\s+(?:will|needs to|need to|should|must|has to)\s+(.+)$"
RECAP = r"(?i)^.*?\brecap action\s*:\s*"
EXPLICIT = r"(?i)^.*?\bexplicit action\s*:\s*"
EXPLICIT_TAIL = r"(?i)\b(I accept|This action is intentionally|No deadline is assigned)\b.*$"
NUMBERED = rf"(?i)\bDecision\s+(?:{L.COUNT_WORDS})\s*:\s*"
NO_DECISION = (
    r"\b(no speaker is volunteering|no deadline will be established|no action owner|no owners|no deadlines)\b",
    r"^(so\s+)?for the pilot,\s*i suggest\b|^my thought is\b|^speaker\s+\d+\b|^that will allow us\b",
    r"^the second is\b",
    r"^if the live run feels slow\b",
    r"^team will\b",
    r"\bwill be (reviewed|finalized|updated|prepared|created)\b",
)
GOAL_INTRO = r"by the end of the meeting|we should leave with"
GOAL_PAYLOAD = r"final demo plan|small list of action items|decision on which use case"
CONTEXT_COPULA = r"\b(will be|will use|will remain|will include|is to|is|are|aligned|designed)\b"
OUTCOME = r"\b(aligned|agreed|decided|finalized|confirmed)\b"


def has_verb(c: Column) -> Column:
    return F.lower(c).rlike(J.ahead(L.any_word(L.V3_VERBS)))


def has_language(c: Column) -> Column:
    return F.lower(c).rlike(J.ahead(L.V3_LANGUAGE))


def is_invalid(t: Column) -> Column:
    """Text (already clean) that cannot be an action."""
    low = F.lower(t)
    return (
        (F.length(t) < 12)
        | low.rlike(J.ahead(L.any_of(L.V3_WEAK + L.V3_PURPOSE + L.V3_INVALID_PHRASES)))
        | low.rlike(J.ahead(L.starts(INVALID_STARTS)))
        | (low.rlike(J.ahead(L.any_of(L.V3_DECISION))) & ~has_verb(t))
    )


def parse(raw: Column) -> Column:
    """X05 core: struct(owner, task, deadline) of one cleaned action text.

    Structured forms (recap, explicit, a speaker prefix) come first, then 'Owner - task'
    and 'Owner will task'.
    """

    def structured(s: Column) -> Column:
        body = s["body"]
        recap = F.lower(body).rlike(J.ahead(r"\brecap action\s*:"))
        explicit = F.lower(body).rlike(J.ahead(r"\bexplicit action\s*:"))

        def parts(p: Column) -> Column:
            tail = p["tail"]
            owner_text, due_text = p["owner_text"], p["due_text"]
            owner = (
                F.when(p["recap"] & (owner_text != ""), owner_text)
                .when(
                    p["explicit"] & F.lower(body).rlike(J.ahead(r"\bintentionally unassigned\b")),
                    "Unassigned",
                )
                .otherwise(s["speaker"])
            )
            task = (
                F.when(p["recap"], F.regexp_replace(tail, r"(?i)\bOwner\s*:.*$", ""))
                .when(p["explicit"], F.regexp_replace(tail, EXPLICIT_TAIL, ""))
                .otherwise(tail)
            )
            due = F.when(
                p["recap"] & (due_text != "") & (F.lower(due_text) != "no deadline"), due_text
            )
            return F.struct(owner.alias("owner"), T.clean(task).alias("task"), due.alias("due"))

        tail = (
            F.when(recap, F.regexp_replace(body, RECAP, ""))
            .when(explicit, F.regexp_replace(body, EXPLICIT, ""))
            .otherwise(body)
        )
        def labelled(m: Column) -> Column:
            def label(name: str) -> Column:
                pattern = rf"(?i)\b{name}\s*:\s*([^\.]+)"
                return F.when(
                    m["recap"], T.clean(F.regexp_extract(m["tail"], pattern, 1))
                ).otherwise("")

            return let(
                F.struct(
                    m["tail"].alias("tail"),
                    m["recap"].alias("recap"),
                    m["explicit"].alias("explicit"),
                    label("Owner").alias("owner_text"),
                    label("Deadline").alias("due_text"),
                ),
                parts,
            )

        return let(
            F.struct(tail.alias("tail"), recap.alias("recap"), (explicit & ~recap).alias("explicit")),
            labelled,
        )

    def choose(st: Column) -> Column:
        def pick(m: Column) -> Column:
            named = st["task"] != raw
            owner = (
                F.when(named, st["owner"])
                .when(m["pre"] != "", m["pre"])
                .otherwise(m["modal"])
            )
            task = (
                F.when(named, st["task"])
                .when(m["pre"] != "", T.clean(F.regexp_extract(raw, PREFIX, 2)))
                .when(m["modal"] != "", T.clean(F.regexp_extract(raw, MODAL, 2)))
                .otherwise(raw)
            )
            return F.struct(
                T.owner_v3(owner).alias("owner"),
                task.alias("task"),
                F.when(named, st["due"]).alias("due"),
            )

        return let(
            F.struct(
                F.regexp_extract(raw, PREFIX, 1).alias("pre"),
                F.regexp_extract(raw, MODAL, 1).alias("modal"),
            ),
            pick,
        )

    def team(st: Column) -> Column:
        rule = rf"(?i)^({'|'.join(TEAM_OWNERS)})\s+will\s+(.+)$"
        who = F.regexp_extract(st["task"], rule, 1)
        return F.struct(
            F.when(who != "", F.initcap(who)).otherwise(st["owner"]).alias("owner"),
            F.when(who != "", T.clean(F.regexp_extract(st["task"], rule, 2)))
            .otherwise(T.clean(st["task"]))
            .alias("task"),
            st["due"].alias("due"),
        )

    speaker = F.regexp_extract(raw, T.SPEAKER_V3_ONCE, 1)
    split = F.struct(
        speaker.alias("speaker"),
        F.when(speaker != "", T.clean(F.regexp_extract(raw, T.SPEAKER_V3_ONCE, 2)))
        .otherwise(raw)
        .alias("body"),
    )
    return let(let(let(split, structured), choose), team)


def normalize_actions(texts: Column, evidence_is_text: bool = True) -> Column:
    """Valid action structs of an array of texts, in order."""

    def one(raw: Column) -> Column:
        def build(p: Column) -> Column:
            good = (
                ~F.lower(p["owner"]).isin(*L.V3_INVALID_OWNERS)
                & has_verb(p["task"])
                & ~is_invalid(p["task"])
            )
            made = F.struct(
                p["owner"].alias("owner"),
                p["task"].alias("task"),
                F.coalesce(p["due"], T.deadline_v3(p["task"])).alias("deadline"),
                F.when(p["owner"] != "Unassigned", F.lit(0.82)).otherwise(F.lit(0.68)).alias("confidence"),
                raw.alias("evidence"),
            ).cast(ACTION)
            return F.when(good, made)

        return F.when(~is_invalid(raw), let(parse(raw), build))

    cleaned = F.transform(texts, T.clean)
    return F.filter(F.transform(cleaned, one), lambda x: x.isNotNull())


def extract_actions(sents: Column) -> Column:
    return normalize_actions(F.filter(sents, has_language))


def task_tokens(task_key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(task_key, " "), lambda w: ~w.isin("", *L.V3_TASK_STOP)))


def overlapping(a: Column, b: Column) -> Column:
    """same owner and equal, contained or largely shared task tokens."""
    shared = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    small = F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    close = (small >= 3) & ((shared == small) | ((shared >= 4) & (shared / small >= 0.75)))
    return (
        (a["owner_key"] == b["owner_key"])
        & (a["key"] != "")
        & (b["key"] != "")
        & ((a["key"] == b["key"]) | close)
    )


FEATURES = f"struct<a:{ACTION},owner_key:string,key:string,tokens:array<string>,weight:int>"


def features(a: Column) -> Column:
    n = T.word_count(a["task"])
    rich = (
        F.when(a["owner"] != "Unassigned", 3).otherwise(0)
        + F.when(a["deadline"] != L.V3_NO_DEADLINE, 2).otherwise(0)
        + F.when(a["evidence"] != "", 2).otherwise(0)
        + F.when(n >= 5, 1).otherwise(0)
    )
    return let(
        T.content_key(a["task"]),
        lambda k: F.struct(
            a.alias("a"),
            F.lower(T.clean(a["owner"])).alias("owner_key"),
            k.alias("key"),
            task_tokens(k).alias("tokens"),
            (rich + n).cast("int").alias("weight"),
        ),
    ).cast(FEATURES)


def dedupe_actions(actions: Column) -> Column:
    """Keep the first of overlapping actions, or the richer one in its place."""

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda e: overlapping(e, x)), F.lit(True))
        return let(
            at,
            lambda p: F.when(p == 0, F.concat(acc, F.array(x))).otherwise(
                F.transform(
                    acc,
                    lambda e, i: F.when((i + 1 == p) & (x["weight"] > e["weight"]), x).otherwise(e),
                )
            ),
        ).cast(f"array<{FEATURES}>")

    folded = F.aggregate(
        F.transform(actions, features), F.array().cast(f"array<{FEATURES}>"), step
    )
    return F.transform(folded, lambda s: s["a"])


def has_action_shape(t: Column) -> Column:
    """A strong action verb anywhere: it covers the imperative, 'I will' and 'Name will' forms."""
    low = F.regexp_replace(F.lower(t), r"^(?:recap action|explicit action|action)\s*:\s*", "")
    return low.rlike(J.ahead(L.any_word(L.V3_PRECISION_VERBS)))


def is_goal_like(c: Column) -> Column:
    low = F.lower(T.squash(c))
    return low.rlike(J.ahead(GOAL_INTRO)) & low.rlike(J.ahead(GOAL_PAYLOAD))


def is_decision(c: Column) -> Column:
    def test(t: Column) -> Column:
        low = F.lower(t)
        # few texts pass the word test; only those are searched for what speaks against it
        return (
            (F.length(t) >= 12)
            & ~low.endswith("?")
            & low.rlike(J.ahead(L.any_of(L.V3_DECISION)
                + r"|\b(first pilot audience|target audience)\b.*\b(will be|is|are)\b"
                + r"|\b(demo|live demo)\b.*\b(will use|uses|use)\b"
                + r"|\bbackup meeting\b.*\b(will keep|keep|processed)\b"))
            & ~low.rlike(J.ahead(L.any_of(NO_DECISION)))
            & ~low.rlike(J.ahead(L.any_of(L.V3_WEAK)))
            & ~is_goal_like(t)
        )

    return let(T.clean(c), test)


def is_context(t: Column, shaped: Column | None = None) -> Column:
    low = F.lower(t)
    shaped = has_action_shape(t) if shaped is None else shaped
    return (
        low.rlike(J.ahead(L.starts(L.V3_CONTEXT_STARTS)))
        | (low.rlike(J.ahead(r"^(?:the|this|that|it|there)\b")) & low.rlike(J.ahead(CONTEXT_COPULA)))
        | (~shaped & is_decision(t))
    )


def is_high_precision(task: Column, evidence: Column | None = None) -> Column:
    """An action shape and no context, purpose or decision text."""

    def test(t: Column) -> Column:
        marked = (
            F.lit(False)
            if evidence is None
            else ~is_invalid(t)
            & F.lower(evidence).rlike(J.ahead(r"\b(?:recap action|explicit action|action)\s*:"))
            & has_verb(t)
        )
        return let(has_action_shape(t), lambda shaped: (t != "") & ~is_context(t, shaped) & (shaped | marked))

    return let(T.clean(task), test)


def v3_actions(sents: Column, existing: Column | None = None) -> Column:
    """Existing and extracted actions, deduped, then the high-precision ones."""
    found = extract_actions(sents)
    if existing is not None:
        found = F.concat(normalize_actions(existing), found)
    return F.filter(
        dedupe_actions(found), lambda a: is_high_precision(a["task"], a["evidence"])
    )


def decision_text(c: Column) -> Column:
    """F14, third-engine dialect."""

    def body(t: Column) -> Column:
        spoken = F.regexp_extract(t, T.SPEAKER_V3_ONCE, 2)
        return C.apply(F.when(spoken != "", T.clean(spoken)).otherwise(t), C.V3_DECISION)

    return let(T.clean(c), body)


def decisions_of(texts: Column) -> Column:
    """Numbered items are split out, each text cleaned and tested."""

    def of_sentence(s: Column) -> Column:
        def parts(p: Column) -> Column:
            # a text without a numbered mark stays whole; else the part before it is dropped
            numbered = F.size(p) > 1
            return F.when(
                numbered, no_blank(F.transform(F.slice(p, 2, 2147483646), T.clean))
            ).otherwise(F.array(s))

        texts = let(F.split(T.clean(s), NUMBERED), parts)
        return F.transform(
            texts, lambda t: F.struct(decision_text(t).alias("text"), s.alias("evidence"))
        )

    every = F.flatten(F.transform(texts, of_sentence))
    return F.filter(every, lambda d: is_decision(d["text"]))


def v3_decisions(sents: Column, existing: Column | None = None) -> Column:
    found = decisions_of(sents)
    if existing is not None:
        own = F.transform(
            existing,
            lambda t: let(
                decision_text(t), lambda d: F.struct(d.alias("text"), d.alias("evidence"))
            ),
        )
        found = F.concat(F.filter(own, lambda d: is_decision(d["text"])), found)
    return keep_first(found, lambda d: T.content_key(d["text"]))


def is_risk(c: Column) -> Column:
    def test(t: Column) -> Column:
        low = F.lower(t)
        return (
            (F.length(t) >= 12)
            & ~low.endswith("?")
            & (
                low.rlike(J.ahead(L.V3_RISK_STRONG))
                | (low.rlike(J.ahead(L.any_of(L.V3_RISK))) & ~is_decision(t))
            )
        )

    return let(T.clean(c), test)


def v3_risks(sents: Column, limit: int = 8) -> Column:
    """X07."""
    return keep_first(F.filter(sents, is_risk), T.content_key, limit)


def v3_questions(sents: Column, limit: int = 8) -> Column:
    """X08."""
    asks = F.filter(
        sents, lambda s: s.endswith("?") | F.lower(s).rlike(J.ahead(L.V3_QUESTION_START))
    )
    return keep_first(asks, T.content_key, limit)


def first_where(sents: Column, test) -> Column:
    return F.get(F.filter(sents, test), F.lit(0))


def infer_purpose(sents: Column, existing: Column) -> Column:
    """The given purpose, else the first purpose sentence, else one that aligns."""
    return F.coalesce(
        F.nullif(T.clean(existing), F.lit("")),
        first_where(sents, lambda s: T.matches_any(s, L.V3_PURPOSE)),
        first_where(sents, lambda s: F.lower(s).rlike(J.ahead("confirm|finalize|align"))),
        F.lit(""),
    )


def infer_outcome(sents: Column, existing: Column) -> Column:
    return F.coalesce(
        F.nullif(T.clean(existing), F.lit("")),
        first_where(sents, lambda s: F.lower(s).rlike(J.ahead(OUTCOME))),
        F.lit(""),
    )


def merge_texts(lists: list[Column], limit: int) -> Column:
    """Lists in priority order, cleaned, first of each key, capped."""
    return keep_first(F.transform(F.concat(*lists), T.clean), T.content_key, limit)


def next_steps(actions: Column, existing: Column, limit: int = 5) -> Column:
    """Existing high-precision steps, then 'Owner: task' of the actions."""
    kept = F.filter(F.transform(existing, T.clean), is_high_precision)
    made = F.transform(
        F.filter(actions, lambda a: a["task"] != ""),
        lambda a: F.when(
            a["owner"] != "Unassigned", F.concat_ws(": ", a["owner"], a["task"])
        ).otherwise(a["task"]),
    )
    return keep_first(F.concat(kept, made), T.content_key, limit)


def section_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(T.clean(c)), r"(?U)\W+", " "))


def separate_points(
    points: Column, purpose: Column, outcome: Column, decisions: Column, actions: Column, limit: int = 6
) -> Column:
    """Key points that repeat no purpose, outcome, decision or action."""
    others = F.filter(
        F.transform(F.concat(F.array(purpose, outcome), decisions, actions), section_key),
        lambda k: k != "",
    )
    tidy = no_blank(F.transform(points, T.clean))

    def fresh(keys: Column) -> Column:
        def ok(p: Column) -> Column:
            return let(
                section_key(p),
                lambda k: ~F.exists(
                    keys,
                    lambda o: (k != "")
                    & (
                        (o == k)
                        | (
                            (F.length(k) >= 24)
                            & (F.length(o) >= 24)
                            & (F.contains(o, k) | F.contains(k, o))
                        )
                    ),
                ),
            )

        return F.filter(
            tidy, lambda p: ~F.lower(p).rlike(J.ahead(L.starts(L.V3_OVERLAP_STARTS))) & ok(p)
        )

    return keep_first(let(others, fresh), T.content_key, limit)


def quality_metadata(actions: Column, decisions: Column, risks: Column, questions: Column) -> Column:
    """Counts, warnings and the pass flag of a finished set of notes."""
    generic = F.size(F.filter(actions, lambda a: a["owner"].isin("Team", "Unassigned")))
    undated = F.size(
        F.filter(
            actions, lambda a: F.coalesce(a["deadline"], F.lit("")).isin("", L.V3_NO_DEADLINE)
        )
    )

    def build(g: Column, u: Column, n: Column, d: Column, r: Column, q: Column) -> Column:
        warnings = F.filter(
            F.array(
                F.when(g > 0, "Some action items have Team or Unassigned owners."),
                F.when(u > 0, "Some action items do not include explicit deadlines."),
                F.when(n == 0, "No action items detected."),
                F.when(d == 0, "No decisions detected."),
            ),
            lambda w: w.isNotNull(),
        )
        return F.struct(
            n.alias("action_count"),
            d.alias("decision_count"),
            r.alias("risk_count"),
            q.alias("open_question_count"),
            g.alias("generic_owner_count"),
            u.alias("missing_deadline_count"),
            warnings.alias("warnings"),
            ((n > 0) | (d > 0)).alias("passed"),
        )

    return let_all(
        [generic, undated, F.size(actions), F.size(decisions), F.size(risks), F.size(questions)],
        build,
    )
