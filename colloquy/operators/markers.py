"""Second-engine items: pattern tables over the whole text, and their merges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import greedy_keep, head, keep_first, let, no_blank

# ---- fixed values: marker patterns of the second engine ------------------------------------
ACTION_PATTERNS = (
    r"\b([A-Z][A-Za-z]+)\s*:\s*[^\n]*?\bI\s+will\s+([^.\n]+\bby\b[^.\n]+)",
    r"\b([A-Z][A-Za-z]+)\s*:\s*(?:[^.\n]*\baction[^.\n]*\.\s*)?I\s+will\s+([^.\n]+\bby\b[^.\n]+)",
    r"\b([A-Z][A-Za-z]+)\s*:\s*I\s+accept\s+[^.\n]*action[^.\n]*\.\s*I\s+will\s+([^.\n]+(?:\.\s*by\s+[^.\n]+)?)",
    r"\bAction(?:\s+item)?\s+for\s+([A-Z][A-Za-z]+)\s*[:,]\s*([^.\n]+)",
    r"\b([A-Z][A-Za-z]+)\s*,\s*please\s+([^.\n]+)",
    r"\b([A-Z][A-Za-z]+)\s+will\s+([^.\n]+)",
    r"\bassign(?:ed)?\s+to\s+([A-Z][A-Za-z]+)\s*[:,]\s*([^.\n]+)",
)
DECISION_PATTERNS = (
    r"(?i)\b(?:confirmed\s+decision|decision\s+confirmed)\s*\.\s*([^\n?]+)",
    None,  # numbered decisions, split per line
    r"(?i)\b(?:confirmed\s+decision|decision\s+confirmed|decision)\s*(?:for\s+[^:.\n]+)?\s*[:\-]\s*([^\n?]+)",
    r"(?i)\bwe\s+agreed\s+to\s+([^\n?]+)",
    r"(?i)\bwe\s+decided\s+to\s+([^\n?]+)",
    r"(?i)\bthe\s+team\s+decided\s+to\s+([^\n?]+)",
)
NUMBERED_DECISION = r"(?i)\bdecision\s+(?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s*[:\-]\s*"
RISK_PATTERNS = (
    r"(?i)\b(?:open|known|confirmed|explicit)?\s*(?:risk|risks)\s+number\s+\d+\s*[:\-]\s*([^.\n]+)",
    r"(?i)\b(?:open|known|confirmed|explicit)?\s*(?:risk|risks)\s*[:\-]\s*([^.\n]+)",
    r"(?i)\b(?:open|known|confirmed|explicit)?\s*(?:blocker|blockers)\s*[:\-]\s*([^.\n]+)",
    r"(?i)\b(longer\s+files\s+may\s+run\s+into\s+[^.\n]+)",
    r"(?i)\b(if\s+a\s+meeting\s+is\s+processed\s+before\s+[^.\n]+)",
    r"(?i)\b(?:main|primary|biggest)\s+risk\s+is\s+that\s+([^.\n]+)",
    r"(?i)\b(?:main|primary|biggest)\s+one\s+we\s+have\s+observed\s+is\s+([^.\n]+)",
    r"(?i)\banother\s+issue\s+is\s+([^.\n]+)",
    r"(?i)\bdo\s+not\s+([^.\n]+?\bbecause\b[^.\n]+)",
)
QUESTION_PATTERNS = (
    r"(?i)\bunresolved questions?\s+number\s+\d+\s*[:\-]\s*([^.\n?]+(?:\?)?)",
    r"(?i)\bopen questions?\s+number\s+\d+\s*[:\-]\s*([^.\n?]+(?:\?)?)",
    r"(?i)\bopen questions?\s*(?:remains?|is|are)?\s*[:\-]\s*([^.\n?]+(?:\?)?)",
    r"(?i)\bunresolved questions?\s*(?:remains?|is|are)?\s*[:\-]\s*([^.\n?]+(?:\?)?)",
    r"(?i)\bquestion remains?\s*[:\-]\s*([^.\n?]+(?:\?)?)",
    r"(?i)\bstill\s+do\s+not\s+know\s+(whether\s+[^.\n?]+(?:\?)?)",
    r"(?i)\b(?:we|the team)\s+still\s+need(?:s)?\s+to\s+(?:confirm|decide|know)\s+([^.\n?]+(?:\?)?)",
)
QUESTION_BLOCK = r"(?i)\b(?:open|unresolved)\s+questions?\s*[:\-]\s*((?:\s*[-*]\s*[^\n?]+\?\s*)+)"
QUESTION_MARKERS = (
    "open question", "unresolved question", "question remains", "still need to confirm",
    "still need to decide", "still need to know",
)
RHETORICAL = (
    r"\bdoes that make sense\b", r"\bcan you hear me\b", r"\bany questions\b", r"\bright\b",
    r"\bokay\b", r"\byou know\b", r"\bwhat do you think\b", r"\balready answered\b",
    r"\banswered\b", r"\bresolved\b", r"\bconfirmed\b", r"\bdecided\b", r"\bclosed\b",
)
ANSWER_MARKERS = (
    "decision confirmed", "confirmed decision", "we agreed", "we decided", "the team decided",
    "final answer",
)
QUESTION_TERMS_STOP = ("should", "whether", "question", "open", "what", "when", "where")
ANSWER_SPAN = 800
RESOLVED_RISK = (
    r"\bno risks?\b", r"\bnot a risk\b", r"\bno longer a risk\b", r"\bno blockers?\b",
    r"\bunblocked\b", r"\bresolved\b", r"\bmitigated\b", r"\bclosed\b", r"\bfixed\b",
    r"\balready handled\b", r"^risks?$", r"^blockers?$", r"\breview risks?\b",
    r"\bdiscuss risks?\b", r"\brisk review\b", r"\brisks? and (?:action items|owners|questions)\b",
    r"\brisk register\b",
)
ACTION_LIKE_RISK = r"\b[A-Z]?[a-z]+\s+will\s+\w+|\baction\s+for\b|\bplease\s+\w+"
NON_DECISION = (
    r"\bmaybe\b", r"\bwe discussed\b", r"\bdiscussed in this meeting\b", r"\bone option is\b",
    r"\boption is\b", r"\bshould we\b", r"\bshould the\b", r"\bno decision\b",
    r"\bdecision yet\b", r"\bneed to decide\b", r"\bstill need to decide\b",
    r"\bopen question\b", r"\bunresolved question\b", r"\bnot decided\b", r"\btentative\b",
    r"\bproposal\b", r"\bpossibility\b", r"\bis confirmed\b", r"\bwas confirmed\b",
    r"^(?:the\s+)?(?:backend|product|demo|demonstration|system|service|checklist|review)\s+(?:is|are|was|were)\s+(?:ready|healthy|complete|completed)\b",
    r"\bworks?\b", r"\bowns?\b", r"\bwill monitor\b", r"\bfinish with exact decisions\b",
    r"\bfinish with a marked decision\b",
    r"\bseparate confirmed decisions from general discussion\b",
)
BLOCKED_OWNERS = (
    "action", "decision", "discussion", "it", "open", "risk", "that", "the", "this", "we",
    "actions", "audience", "client", "contractors", "deadline", "email", "file", "on", "output",
    "pilot", "planning", "recordings", "release", "reporting", "seventeen",
)
GENERIC_TASK = (
    r"^follow up$", r"^check\b", r"^review\b", r"^make sure\b", r"^check it$",
    r"^discuss this$", r"^review later$", r"\bfollow up on\b",
    r"\blisten for concrete actions\b", r"\bmake sure the notes separate\b",
    r"\bmost important action items should include\b", r"\bcapture risks separately\b",
    r"\bcontains clear decisions\b", r"\bdecisions discussed in this meeting\b",
    r"\bfinish with exact decisions\b", r"\bfinish with a marked decision\b",
    r"\bthis recording is part of\b",
)
DELIVERABLE = (
    r"\b(?:write|draft|prepare|create|update|add|remove|submit|send|verify|confirm)\b",
    r"\b(?:template|macro|tracker|copy|page|link|note|warning|checklist|submission|logs?)\b",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
DAYS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth",
    "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth",
    "seventeenth", "eighteenth", "nineteenth", "twentieth", "twenty-first", "twenty-second",
    "twenty-third", "twenty-fourth", "twenty-fifth", "twenty-sixth", "twenty-seventh",
    "twenty-eighth", "twenty-ninth", "thirtieth", "thirty-first",
)
HOURS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve",
)
SPOKEN = (
    rf"(?i)\b(noon|midnight|(?:{'|'.join(HOURS)}|\d{{1,2}})\s*(?:am|pm))\s+on\s+({'|'.join(MONTHS)})\s+"
    r"([a-z-]+(?:\s+[a-z-]+)?)(?:,\s*twenty\s+twenty[- ]six)?\b"
)
SPOKEN_BY = (
    rf"(?i)\bby\s+(?:noon|midnight|(?:{'|'.join(HOURS)}|\d{{1,2}})\s*(?:am|pm))\s+on\s+(?:{'|'.join(MONTHS)})\s+"
    r"[a-z-]+(?:\s+[a-z-]+)?(?:,\s*twenty\s+twenty[- ]six)?"
)
DUE_PATTERNS = (
    r"(?i)\b(?:due date is|due dates? remain|due by|due)\s+([^.;,\n]+)",
    r"(?i)\b(?:by|before|after|until)\s+([^.;,\n]+)",
)
PURPOSE_PATTERNS = (
    r"(?i)\b(?:today we need to|we need to|the goal is to|goal is to)\s+([^.\n]+)",
    r"(?i)\b(?:the purpose is to|purpose is to)\s+([^.\n]+)",
    r"(?i)\b(?:confirm|review|align on)\s+([^.\n]+)",
)
SPEAKER_SAYS = r"(?i)^([A-Z][A-Za-z]+)\s+says?,\s*(.+)$"
META_POINT = (
    r"\bthis recording is part of\b", r"\bfinish with exact decisions risks questions and owners\b",
    r"\bseparate confirmed decisions from general discussion\b",
    r"\bmost important action items should include\b", r"\blisten for concrete actions\b",
    r"\bwhat a user will expect after a real meeting\b",
)
ACTION_POINT = r"\b(?:will|please|action for|action item for)\b"
ENTITY_VARIANTS = {
    "PayPal": (r"\bpay\s+pal\b", r"\bpay-pal\b"),
    "Square": (r"\bsqare\b", r"\bsquire\s+checkout\b"),
    "Render": (r"\brendr\b",),
    "Vercel": (r"\bvercell\b",),
    "GoDaddy": (r"\bgo\s+daddy\b", r"\bgodady\b"),
    "BetaList": (r"\bbeta\s+list\b",),
    "Indie Hackers": (r"\bindiehackers\b", r"\bindy\s+hackers\b"),
    "Product Hunt": (r"\bproducthunt\b", r"\bproduct\s+hunter\b"),
    "GitHub": (r"\bgit\s+hub\b",),
    "Markdown": (r"\bmark\s+down\b",),
    "Starter": (r"\bstater\s+plan\b",),
    "Pro Pilot": (r"\bpro\s+pilate\b", r"\bpropilot\b"),
}


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(J.ahead(pattern)), F.lit(group))


def ends_stopped(c: Column, stop: str = ".") -> Column:
    """Capital first letter and a final mark; '' stays ''."""
    def of(s: Column) -> Column:
        closed = F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(stop)))
        return F.when(s == "", "").otherwise(T.capital_first(closed))

    return let(c, of)


# ---- F09: spoken date and time -----------------------------------------------------------------
def _index_map(names: tuple[str, ...]) -> Column:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))])


def spoken_datetime(c: Column, year: int = 2026) -> Column:
    """'five pm on June eighteenth' to 'yyyy-MM-dd HH:mm'; other text comes back tidied."""
    tidy = F.regexp_replace(T.squash(c), r"^[ .,]+|[ .,]+$", "")

    def build(s: Column) -> Column:
        clock = F.replace(F.lower(s["clock"]), F.lit(" "))
        month = _index_map(MONTHS)[F.lower(s["month"])]
        day = _index_map(DAYS)[F.regexp_replace(F.lower(s["day"]), r"^(twenty|thirty) ", "$1-")]
        spoken_hour = F.regexp_replace(clock, "(am|pm)$", "")
        hour = F.coalesce(
            F.when(spoken_hour.rlike(J.ahead(r"^\d+$")), spoken_hour.cast("int")),
            _index_map(HOURS)[spoken_hour],
            F.lit(0),
        )
        hour24 = (
            F.when(clock == "noon", 12)
            .when(clock == "midnight", 0)
            .when(clock.endswith("pm") & (hour != 12), hour + 12)
            .when(clock.endswith("am") & (hour == 12), 0)
            .otherwise(hour)
        )
        stamp = F.format_string("%d-%02d-%02d %02d:00", F.lit(year), month, day, hour24)
        return F.when(month.isNotNull() & day.isNotNull(), stamp).otherwise(s["text"])

    parts = let(
        tidy,
        lambda t: F.struct(
            t.alias("text"),
            F.regexp_extract(t, SPOKEN, 1).alias("clock"),
            F.regexp_extract(t, SPOKEN, 2).alias("month"),
            F.regexp_extract(t, SPOKEN, 3).alias("day"),
        ),
    )
    return let(parts, build)


def _without_first(text: Column, pattern: str) -> Column:
    rest = F.array_join(F.split(text, pattern, 2), "")
    return F.regexp_replace(rest, r"^[ ,.;]+|[ ,.;]+$", "")


def split_deadline(task: Column) -> Column:
    """F08, second-engine dialect: struct(task without its deadline, deadline or '')."""

    def pick(s: Column) -> Column:
        spoken = spoken_datetime(F.regexp_replace(s["spoken"], r"(?i)^\s*by\s+", ""))
        due = F.transform(
            F.array(s["d1"], s["d2"]),
            lambda d: J.replace(T.squash(d), r"^[ .]+|[ .]+$", ""),
        )
        d1, d2 = due[0], due[1]
        return F.struct(
            F.when(s["spoken"] != "", _without_first(s["t"], SPOKEN_BY))
            .when(d1 != "", _without_first(s["t"], DUE_PATTERNS[0]))
            .when(d2 != "", _without_first(s["t"], DUE_PATTERNS[1]))
            .otherwise(s["t"])
            .alias("task"),
            F.when(s["spoken"] != "", spoken).when(d1 != "", d1).otherwise(d2).alias("deadline"),
        )

    return let(
        F.struct(
            task.alias("t"),
            F.regexp_extract(task, SPOKEN_BY, 0).alias("spoken"),
            F.regexp_extract(task, DUE_PATTERNS[0], 1).alias("d1"),
            F.regexp_extract(task, DUE_PATTERNS[1], 1).alias("d2"),
        ),
        pick,
    )


# ---- X09: actions --------------------------------------------------------------------------------
ACTION = "struct<owner:string,task:string,deadline:string,priority:string>"


def clean_owner(c: Column) -> Column:
    return let(
        C.apply(T.squash(c), C.ENDS),
        lambda name: F.when(F.lower(name).isin(*BLOCKED_OWNERS), "").otherwise(name),
    )


def clean_task(c: Column) -> Column:
    """F12, second-engine dialect."""
    return T.capital_first(C.apply(c, C.V2_TASK))


def is_generic_task(task: Column) -> Column:
    return let(
        T.spaced_key(task),
        lambda k: (k == "") | (k.rlike(J.ahead(L.any_of(GENERIC_TASK))) & ~k.rlike(J.ahead(L.any_of(DELIVERABLE)))),
    )


def marked_actions(text: Column, patterns=ACTION_PATTERNS) -> Column:
    """(owner, task, deadline) by pattern, then by place in the text."""
    def found(p: str) -> Column:
        # most patterns match nowhere in a text
        tasks = lambda owners: F.when(F.size(owners) == 0, owners).otherwise(all_of(text, p, 2))
        return let(
            all_of(text, p, 1),
            lambda owners: F.zip_with(
                owners, tasks(owners), lambda o, t: F.struct(o.alias("owner"), t.alias("task"))
            ),
        )

    pairs = F.concat(*[found(p) for p in patterns])

    def made(x: Column) -> Column:
        return let(
            F.struct(clean_owner(x["owner"]).alias("owner"), split_deadline(x["task"]).alias("sd")),
            lambda s: F.struct(
                s["owner"].alias("owner"),
                clean_task(s["sd"]["task"]).alias("task"),
                s["sd"]["deadline"].alias("deadline"),
                F.lit("medium").alias("priority"),
            ),
        )

    return F.filter(
        F.transform(pairs, made),
        lambda a: (a["owner"] != "") & (a["task"] != "") & ~is_generic_task(a["task"]),
    )


def task_key(task: Column) -> Column:
    return T.squash(F.regexp_replace(T.spaced_key(task), r"\b(?:a|an|the)\b", " "))


FEATURES = f"struct<a:{ACTION},key:string,weight:int>"


def merge_actions(actions: Column) -> Column:
    """One action per task key, keys holding one another count as one; the richer stays."""

    def features(a: Column) -> Column:
        weight = (
            F.when(a["owner"] != "", 4).otherwise(0)
            + F.when(a["deadline"] != "", 3).otherwise(0)
            + F.when(a["priority"] != "", 1).otherwise(0)
            + F.least(F.size(no_blank(F.split(T.spaced_key(a["task"]), " "))), F.lit(8))
        )
        return F.struct(
            a.alias("a"), task_key(a["task"]).alias("key"), weight.cast("int").alias("weight")
        ).cast(FEATURES)

    def step(acc: Column, x: Column) -> Column:
        same = F.transform(
            acc, lambda e: F.contains(e["key"], x["key"]) | F.contains(x["key"], e["key"])
        )
        return let(
            F.array_position(same, F.lit(True)),
            lambda p: F.when(p == 0, F.concat(acc, F.array(x))).otherwise(
                F.transform(
                    acc,
                    lambda e, i: F.when((i + 1 == p) & (x["weight"] > e["weight"]), x).otherwise(e),
                )
            ),
        ).cast(f"array<{FEATURES}>")

    usable = F.filter(F.transform(actions, features), lambda f: f["key"] != "")
    folded = F.aggregate(usable, F.array().cast(f"array<{FEATURES}>"), step)
    return F.transform(folded, lambda f: f["a"])


def fix_owners(actions: Column, context: Column, fixes: dict[str, str]) -> Column:
    """a misspelt owner is corrected only where the right name occurs in the context."""
    if not fixes:
        return actions

    def fix(a: Column) -> Column:
        owner = a["owner"]
        for wrong, right in fixes.items():
            owner = F.when(
                (F.lower(a["owner"]) == wrong.lower())
                & F.contains(T.spaced_key(context), F.lit(right.lower())),
                right,
            ).otherwise(owner)
        return a.withField("owner", owner)

    return F.transform(actions, fix)


# ---- X10: decisions ------------------------------------------------------------------------------
def decision_text(c: Column) -> Column:
    return ends_stopped(C.apply(c, C.V2_DECISION))


def is_non_decision(c: Column) -> Column:
    return let(T.spaced_key(c), lambda k: (k == "") | k.rlike(J.ahead(L.any_of(NON_DECISION))))


def numbered_decisions(text: Column) -> Column:
    """Per line the text after each numbered mark, up to the next mark."""
    return F.flatten(
        F.transform(
            F.split(text, "\n"), lambda line: F.slice(F.split(line, NUMBERED_DECISION), 2, 2147483646)
        )
    )


def marked_decisions(text: Column) -> Column:
    """Candidates by pattern, then place."""
    raw = F.concat(
        *[numbered_decisions(text) if p is None else all_of(text, p) for p in DECISION_PATTERNS]
    )
    return F.filter(
        F.transform(raw, decision_text), lambda d: (d != "") & ~is_non_decision(d)
    )


def merge_decisions(texts: Column) -> Column:
    """W10, containment dialect: drop a text whose key holds, or lies in, a kept one."""
    cleaned = F.filter(
        F.transform(texts, decision_text), lambda d: (d != "") & ~is_non_decision(d)
    )
    return greedy_keep(
        cleaned,
        task_key,
        lambda a, b: F.contains(a, b) | F.contains(b, a),
        "string",
        "string",
    )


# ---- X11: risks ----------------------------------------------------------------------------------
def risk_text(c: Column) -> Column:
    """F15."""
    return ends_stopped(C.apply(c, C.V2_RISK))


def is_void_risk(c: Column) -> Column:
    return (
        let(T.spaced_key(c), lambda k: (k == "") | k.rlike(J.ahead(L.any_of(RESOLVED_RISK))))
        | c.rlike(J.ahead(ACTION_LIKE_RISK))
    )


def marked_risks(text: Column) -> Column:
    raw = F.concat(*[all_of(text, p) for p in RISK_PATTERNS])
    return F.filter(F.transform(raw, risk_text), lambda r: (r != "") & ~is_void_risk(r))


def merge_risks(texts: Column) -> Column:
    cleaned = F.filter(F.transform(texts, risk_text), lambda r: (r != "") & ~is_void_risk(r))
    return keep_first(
        cleaned, lambda r: F.regexp_replace(T.spaced_key(r), r"\btime out\b", "timeout")
    )


# ---- X12, J12: questions -------------------------------------------------------------------------
def question_text(c: Column) -> Column:
    """F16."""
    def of(bare: Column) -> Column:
        asked = F.when(bare.endswith("?"), bare).otherwise(F.concat(bare, F.lit("?")))
        return F.when(bare == "", "").otherwise(T.capital_first(asked))

    return let(C.apply(c, C.V2_QUESTION), of)


def is_rhetorical(c: Column) -> Column:
    return let(T.spaced_key(c), lambda k: (k == "") | k.rlike(J.ahead(L.any_of(RHETORICAL))))


def answered_later(question: Column, source_key: Column) -> Column:
    """A decision marker and two long shared terms within the span after the question."""

    def test(q: Column) -> Column:
        def span(p: Column) -> Column:
            answer = F.substring(
                source_key, (p + F.length(q)).cast("int"), F.lit(ANSWER_SPAN)
            )
            terms = F.filter(
                F.array_except(
                    F.array_distinct(F.split(q, " ")),
                    F.array(*[F.lit(w) for w in QUESTION_TERMS_STOP]),
                ),
                lambda w: F.length(w) > 3,
            )
            shared = F.size(F.array_intersect(terms, F.split(answer, " ")))
            return (p > 0) & answer.rlike(J.any_text(ANSWER_MARKERS)) & (shared >= 2)

        return (q != "") & let(F.call_function("locate", q, source_key), span)

    return let(T.spaced_key(question), test)


def marked_questions(text: Column) -> Column:
    """Pattern matches, the bullet block, marked sentences; answered ones dropped."""
    block = F.regexp_extract(text, QUESTION_BLOCK, 1)
    bullets = F.transform(
        no_blank(F.split(block, "\n")), lambda s: F.regexp_replace(s, r"^\s*[-*]\s*", "")
    )
    sents = F.filter(
        F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)),
        lambda s: s.contains("?") & T.has_any(s, QUESTION_MARKERS),
    )
    raw = F.concat(*[all_of(text, p) for p in QUESTION_PATTERNS], bullets, sents)
    asked = F.filter(
        F.transform(raw, question_text), lambda q: (q != "") & ~is_rhetorical(q)
    )
    return let(
        T.spaced_key(text), lambda src: F.filter(asked, lambda q: ~answered_later(q, src))
    )


def merge_questions(texts: Column) -> Column:
    asked = F.filter(F.transform(texts, question_text), lambda q: (q != "") & ~is_rhetorical(q))
    return keep_first(asked, T.spaced_key)


# ---- slots, key points, warnings -----------------------------------------------------------------
def infer_purpose(text: Column) -> Column:
    found = F.coalesce(*[T.first_group(text, p, 1) for p in PURPOSE_PATTERNS])
    aim = J.replace(J.replace(found, r"^[ .]+|[ .]+$", ""), r"(?i)\band\s+the\s+", "and ")
    return let(aim, lambda a: F.when(a != "", stop_sentence(F.concat(F.lit("Confirm "), a))).otherwise(""))


def stop_sentence(c: Column) -> Column:
    return let(
        J.replace(T.squash(c), r"^[ .]+|[ .]+$", ""),
        lambda bare: F.when(bare == "", "").otherwise(F.concat(T.capital_first(bare), F.lit("."))),
    )


def sync_steps(existing: Column, actions: Column, limit: int = 5) -> Column:
    """L05, second-engine dialect."""

    def of_action(a: Column) -> Column:
        own = F.concat(F.lit(r"(?i)^\Q"), a["owner"], F.lit(r"\E\s*[-:]\s*"))
        task = F.when(
            a["owner"] != "", F.regexp_replace(a["task"], own, F.lit(""))
        ).otherwise(a["task"])
        return stop_sentence(task)

    return keep_first(
        F.concat(F.transform(existing, stop_sentence), F.transform(actions, of_action)),
        T.spaced_key,
        limit,
    )


def point_body(c: Column) -> Column:
    return let(F.regexp_extract(c, SPEAKER_SAYS, 2), lambda said: F.when(said != "", said).otherwise(c))


def clean_points(points: Column) -> Column:
    """P19, second-engine dialect: struct(points, questions moved out of them)."""

    def question_of(p: Column) -> Column:
        def of(body: Column) -> Column:
            return let(
                F.trim(C.apply(body, C.QUESTION_LEAD)),
                lambda bare: F.when((bare != body) & bare.contains("?"), bare),
            )

        return let(point_body(p), of)

    asked = F.filter(F.transform(points, question_of), lambda q: q.isNotNull())
    rest = F.filter(points, lambda p: question_of(p).isNull())
    tidy = F.transform(
        rest, lambda p: T.capital_first(C.apply(point_body(p), C.KEY_POINT))
    )
    kept = F.filter(
        tidy,
        lambda p: let(
            T.spaced_key(p),
            lambda k: (k != "") & ~k.rlike(J.ahead(L.any_of(META_POINT))) & ~k.rlike(J.ahead(ACTION_POINT)),
        ),
    )
    return F.struct(
        keep_first(kept, T.spaced_key).alias("points"), merge_questions(asked).alias("questions")
    )


def entity_warnings(text: Column, variants: dict[str, tuple[str, ...]] = ENTITY_VARIANTS) -> Column:
    """For each known entity the first variant found in the text, as a warning."""

    def warn(name: str, patterns: tuple[str, ...]) -> Column:
        hit = F.coalesce(*[T.first_group(text, f"(?i){p}") for p in patterns])
        # a null hit makes the whole text null
        return F.concat(
            F.lit("Possible known entity rewrite: '"), hit, F.lit(f"' may refer to '{name}'.")
        )

    found = [warn(name, patterns) for name, patterns in variants.items()]
    return F.filter(F.array(*found), lambda w: w.isNotNull())
