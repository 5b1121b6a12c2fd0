"""Word lists and patterns the text operators read.

Every list is data: an operator takes it as an argument with one of these as default, and
folds it into one literal pattern when the plan is built.  All of them are small and of
fixed size.
"""

from __future__ import annotations

import re

# ---- fixed values: cue lists of the signal extractor -----------------------------------
SIGNAL_DECISION = (
    "agreed to", "agreed that", "approved", "confirmed", "decided", "decision", "final decision",
    "keep", "limit", "use", "we will", "will use", "will keep", "will limit", "will not", "do not",
    "do n't",
)
SIGNAL_ACTION = (
    "action", "action item", "assign", "assigned", "circulate", "complete", "confirm", "document",
    "follow up", "prepare", "review", "run", "send", "share", "upload", "verify", "will",
    "needs to", "need to", "owner",
)
SIGNAL_RISK = (
    "risk", "risks", "concern", "concerns", "blocker", "blocked", "blocking", "delay", "delays",
    "delayed", "dependency", "dependencies", "scope creep", "over-promising", "overpromising",
    "unrealistic", "stale", "unprepared", "pricing confirmation", "pricing delay", "miss",
    "missed", "missing", "failure", "failed", "unstable", "low confidence", "quality issue",
    "accuracy issue", "compliance", "privacy", "security", "may delay", "may reduce",
    "may create", "might delay", "could delay", "could reduce", "could create", "without",
    "unless",
)
SIGNAL_NO_RISK = ("no risks", "no risk", "(none)")
SIGNAL_NAME = r"\b(Priya|Jordan|Alex|Morgan|Sam|Taylor|Casey|Riley|Avery|Speaker\s+[A-Z]|[A-Z][a-z]+)\b"
SIGNAL_NOT_NAMES = ("action", "decision", "risk", "meeting", "summary")
SIGNAL_DATE = (
    r"\b20\d{2}-\d{2}-\d{2}(?:\s+\d{2}:\d{2})?\b|"
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}\b"
)
SIGNAL_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it",
    "of", "on", "or", "that", "the", "their", "this", "to", "use", "with", "will", "we",
)

# ---- fixed values: chunk action extractor ----------------------------------------------
CHUNK_MARKERS = (
    " will ", " should ", " need to ", " needs to ", " must ", " has to ", " have to ",
    " action item", " follow up", " prepare ", " review ", " provide ", " create ", " send ",
    " confirm ", " update ", " investigate ", " validate ", " finalize ", " document ", " share ",
    " test ", " resolve ",
)
CHUNK_DEADLINES = (
    r"\bby\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\bby\s+(?:today|tomorrow|next week|next month|end of week|eod)\b",
    r"\bbefore\s+[^,.!?;]+",
    r"\bnext\s+(?:week|month|quarter)\b",
    r"\btomorrow\b",
    r"\btoday\b",
    r"\bthis\s+(?:week|month|quarter)\b",
)
CHUNK_NO_DEADLINE = "No deadline stated"
GENERIC_SUBJECTS = ("we", "they", "someone", "somebody", "everyone", "team")
MERGE_STOP = (
    "a", "an", "and", "as", "by", "for", "from", "in", "into", "of", "or", "the", "to", "with",
)
SCORE_STOP = ("a", "an", "and", "as", "for", "from", "in", "into", "of", "or", "the", "to", "with")

# ---- fixed values: slot extractor --------------------------------------------------------
SLOT_PURPOSE = ("purpose", "goal", "objective", "today we need", "this meeting is", "we are here to")
SLOT_DECISION = (
    "decide", "decided", "agreed", "agreement", "approved", "chosen", "we will use", "we'll use",
)
SLOT_RISK = ("risk", "blocker", "concern", "issue", "dependency", "challenge", "delay")
SLOT_NEXT = ("next step", "next steps", "follow up", "follow-up", "moving forward", "after this")
SLOT_STARTERS = (
    "review ", "prepare ", "finalize ", "update ", "create ", "share ", "send ", "schedule ",
    "confirm ", "test ", "fix ", "draft ",
)
SLOT_TASK = (
    " should ", " will ", " need to ", " needs to ", " follow up ", " follow-up ", " please ",
    " can you ", " could you ",
)
SLOT_OWNERS = (
    r"^([A-Z][a-z]+(?: [A-Z][a-z]+)?)\s+(?:will|should|needs to|need to)\b",
    r"^(Team|Engineering|Product|Marketing|Sales|Design)\s+(?:will|should|needs to|need to)\b",
)
SLOT_DUE = (
    r"\bby (monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\bby (tomorrow|today|next week|this week|end of week|eow)\b",
    r"\b(on|by) \d{1,2}/\d{1,2}(?:/\d{2,4})?\b",
    r"\b(on|by) [A-Z][a-z]+ \d{1,2}(?:, \d{4})?\b",
)

# ---- fixed values: third engine ----------------------------------------------------------
V3_VERBS = (
    "create", "prepare", "send", "share", "update", "review", "run", "test", "finalize",
    "publish", "submit", "schedule", "document", "fix", "implement", "confirm", "draft", "write",
    "collect", "follow up", "set up", "clean", "add", "upload", "finish", "complete", "verify",
    "circulate",
)
V3_WEAK = (
    r"\bi['’]?d like us to leave\b", r"\bmain purpose\b", r"\bthe purpose of\b",
    r"\bthe goal is\b", r"\bgoal of\b", r"\bthis meeting is about\b", r"\bagenda\b",
    r"\btoday we(?:'|’)ll discuss\b", r"\bwe are here to\b", r"\bif we say\b",
    r"\bshould consider\b", r"\bmaybe\b", r"\bpossibly\b", r"\bthink about\b",
)
V3_DECISION = (
    r"\bdecision confirmed\b", r"\brecap decision\b", r"\bwe decided\b", r"\bwe agreed\b",
    r"\bthe decision is\b", r"\bthe plan is\b", r"\bwill be\b", r"\bwill use\b",
    r"\buse email\b", r"\bwill remain\b", r"\bremains\b",
    r"\bwill improve\b", r"\bwill lead with\b", r"\bleading with\b",
    r"\bpractical positioning\b", r"\bwill support\b", r"\bwill include\b", r"\bwill follow\b",
    r"\bwill focus on\b", r"\blimit\b", r"\ballow\b", r"\bretain\b", r"\bkeep\b",
    r"\bdo not announce\b", r"\breview pilot quality\b",
)
V3_RISK = (
    r"\brisk\b", r"\bconcern\b", r"\bconcerns\b", r"\bblocker\b", r"\bblocked\b",
    r"\bdependency\b", r"\bissue\b", r"\bcareful\b", r"\bmay\b", r"\bmight\b", r"\bcould\b",
)
V3_RISK_STRONG = r"\b(if we say|be careful|risk|concern|blocked|blocker|dependency|issue)\b"
V3_PURPOSE = (
    r"\bi['’]?d like us to leave\b", r"\bmain purpose\b", r"\bthe purpose of\b",
    r"\bthe goal is\b", r"\bgoal of\b", r"\bobjective\b",
)
V3_GENERIC_OWNERS = ("we", "i", "everyone", "somebody", "someone", "people")
V3_NOT_OWNERS = (
    "no", "june", "the", "then", "explicit action", "recap action", "decision one",
    "decision two", "decision three", "decision four", "decision five", "decision six",
)
V3_INVALID_OWNERS = (
    "this risk", "the team is deciding how customers", "the team", "customer", "the customer",
    "june", "no", "explicit action", "recap action", "the", "then", "decision one",
    "decision two", "decision three", "decision four", "decision five", "decision six",
)
V3_INVALID_PHRASES = (
    r"\bthis is the\b", r"\bwe can begin\b", r"\bworking recommendation\b",
    r"\bfrom the customer perspective\b", r"\bshould be monitored\b",
    r"\bdoes not create an additional action\b", r"\bthe team is deciding\b",
    r"\bcustomer should see\b", r"\bno new owner\b", r"\bno speaker accepts work\b",
    r"\bi also confirm that\b", r"\bno speaker is volunteering\b",
    r"\bno deadline will be established\b", r"\bi accept ownership and will complete it\b",
    r"\bwe can create a meeting\b", r"\bthen we upload\b", r"\bmy preference is to do both\b",
    r"\bi would also like us to confirm\b", r"\bwe should also preface\b",
    r"^decision\s+(one|two|three|four|five|six)\s*:",
)
V3_LANGUAGE = (
    r"\b(will|needs to|need to|should|must|has to|have to|follow up|action item|explicit action|recap action)\b"
)
V3_KEY_STOP = (
    "the", "a", "an", "to", "and", "or", "of", "for", "with", "by", "on", "in", "at", "today", "tomorrow",
)
V3_TASK_STOP = (
    "a", "an", "and", "as", "at", "by", "for", "has", "in", "of", "so", "that", "the", "to", "with",
)
V3_PRECISION_VERBS = (
    "add", "assign", "call", "check", "circulate", "complete", "confirm", "contact", "create",
    "deliver", "deploy", "document", "draft", "email", "finish", "finalize", "fix", "follow up",
    "keep", "package", "prepare", "publish", "redeploy", "review", "run", "save", "schedule",
    "send", "share", "test", "update", "upload", "validate", "verify", "write",
)
V3_CONTEXT_STARTS = (
    "i'd like us to", "i would like us to", "we'd like to", "we would like to",
    "the main purpose", "the purpose", "today's purpose", "the team aligned", "team aligned",
    "if we say", "if we position", "that's ", "that is ", "this week's priority is",
    "this weeks priority is", "the priority is", "we can ", "we need to ", "we should ", "we will ",
)
V3_OVERLAP_STARTS = (
    "i'd like us to", "i’d like us to", "i would like us to", "we'd like to",
    "we would like to", "the main purpose", "the purpose", "today's purpose",
    "the team aligned", "team aligned", "if we say", "if we position", "this week's priority is",
    "this weeks priority is", "the priority is",
)
V3_QUESTION_START = r"^(do|does|did|should|could|would|what|which|who|when|where|why|how)\b"
V3_NO_DEADLINE = "Not specified"
COUNT_WORDS = "one|two|three|four|five|six|seven|eight"

# ---- fixed values: sentence cleaning, scores and topics ----------------------------------
FILLERS = r"(?i)\b(?:uh|um|you know|like|sort of|kind of|basically|actually)\b"
DEADLINE = (
    r"\b(by\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|tonight|eod|end of day|end of week|next week)"
    r"|before\s+\w+|next\s+(?:week|month)|tomorrow|tonight)\b"
)
TASK_VERBS = (
    "review", "finalize", "prepare", "send", "share", "confirm", "update", "schedule", "draft",
    "create", "ship", "deliver", "test", "keep", "clean", "fix", "follow", "followup",
    "follow-up", "reach", "outreach", "publish", "launch",
)
POINT_STOP = (
    "the", "a", "an", "and", "or", "but", "to", "of", "for", "on", "in", "at", "with", "from",
    "by", "is", "are", "was", "were", "be", "been", "it", "this", "that", "we", "i", "you", "he",
    "she", "they", "them", "our", "his", "her", "their", "as", "if", "into", "about", "just",
    "very",
)
NARRATIVE = (
    "said", "remarked", "replied", "asked", "looked", "found", "went", "gentleman", "chair",
    "story", "narrative", "autumn", "holmes",
)
OBJECTIVE = (
    r"\bby the end of the meeting\b", r"\bpurpose of today'?s meeting\b",
    r"\blet me summarize the agenda\b", r"\bi would also like us to confirm\b",
    r"\bi would also us to confirm\b",
)
TOPICS = {
    "status": (
        r"\bproduct status\b", r"\bworks end to end\b", r"\bsmoke test\b", r"\b10 minute\b",
        r"\b10-minute\b", r"\bstrongest realistic example\b",
        r"\bbetter summary, key points, and action items\b",
    ),
    "pilot": (
        r"\bpilot\b", r"\blanding page\b", r"\boutreach\b", r"\bconsultants?\b",
        r"\bsmall agencies?\b", r"\bagencies?\b", r"\bstartup teams?\b", r"\bfounders?\b",
        r"\bdelivery teams?\b", r"\bpositioning\b", r"\btime saved after meetings\b",
        r"\bsave follow-up time\b", r"\breduce missed action items\b", r"\bshareable notes\b",
        r"\blightweight workflow\b", r"\bmachine readable\b", r"\bhuman readable\b",
    ),
    "risk": (
        r"\bruntime\b", r"\btimeout\b", r"\braw media path\b", r"\bsequencing\b",
        r"\bstage timing logs\b", r"\bstress test\b", r"\bworker can throw an error\b",
    ),
    "demo": (
        r"\bdemo\b", r"\blive\b", r"\bbackup\b", r"\bjson\b", r"\bmarkdown\b",
        r"\bworker logs\b", r"\bprocessed meeting\b", r"\bprimary demo artifact\b",
    ),
    "decision": (
        r"\bdecision\b", r"\bdecided\b", r"\bagreed\b", r"\bwill be used as a stress test\b",
        r"\bbest backup demo example\b", r"\bfirst pilot audience\b",
    ),
    "quality": (
        r"\baction item clean\b", r"\bcleanup\b", r"\bsummarization tuning\b",
        r"\bdeeper summarization\b", r"\bslightly repetitive\b", r"\bnote quality\b",
    ),
}
SUMMARY_TOPIC_ORDER = ("status", "pilot", "demo", "risk", "decision", "general", "quality")
COMMITMENTS = (
    r"\blet'?s\b", r"\bwe should\b", r"\bwe need to\b", r"\bwe will\b", r"\bwe'll\b",
    r"\bi will\b", r"\bi'll\b", r"\bplease\b", r"\baction item\b",
)
STRONG_ACTION = r"(?i)\b(?:review|finalize|prepare|send|share|confirm|update|schedule|draft|create|ship|deliver|test|keep|clean|fix|publish|launch)\b"
WEAK_ACTION = r"\b(?:discuss|talk about|mention|noted|consider|check the summary|look at|think about)\b"

# ---- fixed values: local summary ---------------------------------------------------------
LOCAL_STOP = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "for", "is", "are", "was",
    "were", "it", "that", "this", "with", "as", "at", "by", "we", "you", "they", "he", "she",
    "i", "our", "their", "be", "from", "will", "would", "should", "could", "can", "have", "has",
    "had", "not", "if", "then", "than", "so", "do", "does", "did", "done",
)
LOCAL_CUES = (
    r"\bdecided\b", r"\bdecision\b", r"\baction item\b", r"\baction items\b", r"\bnext step\b",
    r"\bnext steps\b", r"\bowner\b", r"\bdue\b", r"\bdeadline\b", r"\bwe need to\b",
    r"\blet'?s\b", r"\bshould\b", r"\bwill\b", r"\bgoing to\b", r"\bfollow up\b", r"\bagreed\b",
)
LOCAL_BY_DAY = r"\bby (monday|tuesday|wednesday|thursday|friday|tomorrow|next week|next month)\b"
LOCAL_TOPICS = {
    "status": (
        r"\bproduct status\b", r"\bworks end to end\b", r"\bsmoke test\b", r"\brealistic\b",
    ),
    "demo": (
        r"\bdemo\b", r"\blive\b", r"\bbackup\b", r"\bjson\b", r"\bmarkdown\b",
        r"\bworker logs\b", r"\brunbook\b", r"\bcommand checklist\b",
    ),
    "pilot": TOPICS["pilot"],
    "risk": (
        r"\brisk\b", r"\bruntime\b", r"\btimeout\b", r"\braw media path\b", r"\bsequencing\b",
        r"\btiming logs\b", r"\bstress test\b",
    ),
    "quality": (
        r"\bnote quality\b", r"\bcleanup\b", r"\baction item\b", r"\bsummarization tuning\b",
        r"\bdeeper summarization\b",
    ),
    "decision": (
        r"\bdecision\b", r"\bdecided\b", r"\bagreed\b", r"\bwe chose\b",
        r"\bfirst pilot audience\b", r"\bprimary backup demo example\b",
        r"\bmain proof of quality\b", r"\bstress test\b",
    ),
}

# ---- fixed values: noise normalization ---------------------------------------------------
ACRONYMS = {
    "l_c_d_": "LCD", "t_v_": "TV", "d_v_d_": "DVD", "m_p_e_g_": "MPEG", "x_m_l_": "XML",
    "l_s_a_": "LSA", "u_i_": "UI", "u_x_": "UX", "a_p_i_": "API",
}
NOISE_PHRASES = {
    "remote-controller": "remote control", "remote controller": "remote control",
    "touch screen": "touchscreen", "two digit": "two-digit", "one digit": "one-digit",
    "follow up": "follow-up", "stand by": "standby",
}
SPACED_ACRONYMS = {
    r"\bl\s*c\s*d\b": "LCD", r"\bt\s*v\b": "TV", r"\bd\s*v\s*d\b": "DVD",
    r"\bm\s*p\s*e\s*g\b": "MPEG", r"\bx\s*m\s*l\b": "XML", r"\bl\s*s\s*a\b": "LSA",
}
NOISE = (
    r"\[(?:inaudible|unintelligible|crosstalk|music|noise|silence)\]",
    r"\((?:inaudible|unintelligible|crosstalk|music|noise|silence)\)",
    r"\b(?:um+|uh+|erm+|hmm+)\b",
)


def any_of(patterns: tuple[str, ...] | list[str]) -> str:
    """One alternation of several patterns.

    A leading word boundary common to many of them is tested once per position instead of
    once per pattern.
    """
    bounded = [p[2:] for p in patterns if p.startswith(r"\b") and not _top_level_bar(p)]
    rest = [f"(?:{p})" for p in patterns if not p.startswith(r"\b") or _top_level_bar(p)]
    if bounded:
        rest.insert(0, r"\b(?:" + "|".join(bounded) + ")")
    return "|".join(rest)


def _top_level_bar(pattern: str) -> bool:
    depth = 0
    for i, ch in enumerate(pattern):
        if i and pattern[i - 1] == "\\":
            continue
        depth += ch in "(["
        depth -= ch in ")]"
        if ch == "|" and depth == 0:
            return True
    return False


def any_text(cues: tuple[str, ...] | list[str]) -> str:
    """One alternation of several literal cues."""
    return "|".join(re.escape(c).replace("\\ ", " ").replace("\\'", "'") for c in cues)


def shortest(cues: tuple[str, ...] | list[str]) -> list[str]:
    """Cues that hold no other cue: enough for a test of containment."""
    return [c for i, c in enumerate(cues) if not any(o in c and (o != c or j < i) for j, o in enumerate(cues))]


def any_word(words: tuple[str, ...] | list[str]) -> str:
    return r"\b(?:" + any_text(words) + r")\b"


def starts(prefixes: tuple[str, ...] | list[str]) -> str:
    return "^(?:" + any_text(prefixes) + ")"
