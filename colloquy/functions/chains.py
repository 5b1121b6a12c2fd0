"""Cleaning rules as ordered (pattern, replacement) tables, applied with ``apply``.

A table can be replaced by the caller.  Patterns avoid look-around, so the same table also
reads in engines with linear-time expressions; replacements write groups as ``$1``.
"""

from __future__ import annotations

from pyspark.sql import Column

from colloquy.functions import patterns as J

Steps = tuple[tuple[str, str], ...]


def apply(c: Column, steps: Steps) -> Column:
    for pattern, replacement in steps:
        c = J.replace(c, pattern, replacement)
    return c


# ---- fixed values: cleaning patterns -----------------------------------------------------
SPACES: Steps = ((r"\s+", " "),)
ENDS: Steps = ((r"^[ .:\-]+|[ .:\-]+$", ""),)

SIGNAL_DECISION: Steps = (
    (r"^[ \-•\t]+|[ \-•\t]+$", ""),
    (r"(?i)^(decision|decisions|we decided|the team decided)\s*[:\-]\s*", ""),
    (r"^\s+|\s+$", ""),
)
SIGNAL_RISK: Steps = (
    (r"^[ \-•\t]+|[ \-•\t]+$", ""),
    (r"(?i)^(risk|risks|concern|concerns)\s*[:\-]\s*", ""),
    (r"^\s+|\s+$", ""),
)
V3_DECISION: Steps = (
    (
        r"(?i)^[A-Z][A-Za-z .'-]{1,40},\s*(?:decision\s*)?(?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s*[,.)\-]\s*",
        "",
    ),
    (r"^\s+|\s+$", ""),
    (r"(?i)^(?:one|two|three|four|five|six|seven|eight|nine|ten)\s*[,.)\-]\s*", ""),
    (r"^\s+|\s+$", ""),
    (r"(?i)^(decision confirmed|recap decision|decision|decided)\s*\d*\s*[:.,\-]?\s*", ""),
    (r"^\s+|\s+$", ""),
    (r"^\d+\s*[,.)\-]\s*", ""),
    (r"^\s+|\s+$", ""),
    (r"(?i)\s*This\s*decision\s*has\s*no\s*action\s*owner.*$", ""),
    (r"\s+", " "),
    (r"^[ \-–—•\t]+|[ \-–—•\t]+$", ""),
    (r"\.+$", ""),
)
V2_QUESTION: Steps = (
    (r"\s+", " "),
    (r"^[ .:\-]+|[ .:\-]+$", ""),
    (r"(?i)^(?:open|unresolved)\s+questions?\s*(?:remains?|is|are)?\s*[:\-]?\s*", ""),
    (r"(?i)^question\s+remains?\s*[:\-]?\s*", ""),
    (r"(?i)^(?:we|the team)\s+still\s+need(?:s)?\s+to\s+(?:confirm|decide|know)\s+", ""),
)
V2_RISK: Steps = (
    (r"\s+", " "),
    (r"^[ .:\-]+|[ .:\-]+$", ""),
    (r"(?i)\btime\s+out\b", "timeout"),
    (r"(?i)^(?:open|known|confirmed|explicit)?\s*(?:risk|risks|blocker|blockers)\s*[:\-]?\s*", ""),
    (r"(?i)^(?:there\s+is\s+a\s+)?risk\s+(?:that|is)\s+", ""),
    (r"(?i)^(?:the\s+)?blocker\s+(?:is|was)\s+", ""),
)
V2_TASK: Steps = (
    (r"\s+", " "),
    (r"^[ .:\-]+|[ .:\-]+$", ""),
    (r"(?i)^(?:I\s+will|will|please|can\s+you|we\s+need\s+to|the\s+next\s+step\s+is)\s+", ""),
    (r"^[ .:\-]+|[ .:\-]+$", ""),
)
V2_DECISION: Steps = (
    (r"\s+", " "),
    (r"^[ .:\-]+|[ .:\-]+$", ""),
    (
        r"(?i)\bdecision\s+(?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s*[:\-].*$",
        "",
    ),
    (r"(?i)\bthis\s+decision\s+has\b.*$", ""),
    (r"(?i)^(?:we|the\s+team)\s+(?:will|agreed\s+to|decided\s+to)\s+", ""),
    (r"(?i)^to\s+", ""),
    (r"^[ .:\-]+|[ .:\-]+$", ""),
)
DECISION_POINT: Steps = (
    (r"(?i)^(?:so|and|but)\s+", ""),
    (r"(?i)^(?:i think|we think)\s+", ""),
)
LOCAL_SENTENCE: Steps = (
    (r"^\s+|\s+$", ""),
    (r"^[A-Z][a-z]+,\s*", ""),
    (r"(?i)^Decision\s+\d+[,:\-]\s*", ""),
    (r"(?i)^[A-Z][a-z]+,\s*Decision\s+\d+[,:\-]\s*", ""),
    (r"(?i)\bto\s+will\b", "to"),
    (r"(?i)\bI would also us to\b", "I would also like us to"),
    (r"\s+", " "),
    (r"^[ .]+|[ .]+$", ""),
)
LOCAL_TASK: Steps = (
    (r"^\s+|\s+$", ""),
    (r"^[A-Z][a-z]+,\s+", ""),
    (r"(?i)^(We|I|Team)\s+will\s+", ""),
    (r"(?i)^(We|I|Team)\s+(should|need to|needs to)\s+", ""),
    (r"(?i)^(something like[,:\s]+)", ""),
    (r"(?i)^(that\s+[—\-:]\s*)", ""),
    (r"(?i)^will\s+", ""),
    (r"^[ .]+|[ .]+$", ""),
)
POINT_TASK: Steps = (
    (
        r"(?i)^(?:i would also us to confirm|i would also like us to confirm|i would like us to confirm|we should|we need to|we will|we'll|let's|please)\s+",
        "",
    ),
    (r"(?i)^(?:team will keep|team will|speaker will|we will|we should|i will)\s+", ""),
    (r"(?i)^(?:to\s+)", ""),
    (r"^[ .,\-]+|[ .,\-]+$", ""),
)
PRECISION_TASK_KEY: Steps = (
    (r"(?i)\bthe meeting aligned on the main priorities and next steps\b.*$", ""),
    (r"(?i)\boutcome is a .*?$", ""),
    (r"^\s*[A-Za-z][A-Za-z\s]{0,40}\s*[:\-]\s*", ""),
    (r"(?i)\b(before|by)\s+(friday|monday|tuesday|wednesday|thursday)\b", ""),
)
PRECISION_DECISION_KEY: Steps = (
    (r"\bdecision\s+(one|two|three|four|\d+)\b", ""),
    (r"\bfinal\s+decision\b", ""),
    (
        r"^(we\s+will|we\s+are\s+going\s+to|that\s+we\s+will|is\s+that\s+we\s+will)\s+",
        "",
    ),
    (r"\bthe meeting aligned on the main priorities and next steps\b.*$", ""),
    (r"\boutcome is\b.*$", ""),
)
EXACT_ACTION: Steps = (
    (r"^\s*[-*]\s*", ""),
    (r"^\[[ xX]\]\s*", ""),
    (r"^\*\*[^*]{1,80}\*\*\s*[—–:\-]\s+", ""),
    (r"^[a-z0-9][a-z0-9 ._'()/&]{0,80}\s*[—–:\-]\s+", ""),
    (r"[^a-z0-9]+", " "),
)
QUESTION_LEAD: Steps = ((r"(?i)^(?:open|unresolved)\s+question\s*,?\s*", ""),)
KEY_POINT: Steps = (
    (r"\s+", " "),
    (r"^[ .]+|[ .]+$", ""),
    (r"(?i)^I\s+want\s+to\s+make\s+sure\s+", ""),
    (r"(?i)^I\s+will\s+", ""),
    (r"^[ .]+|[ .]+$", ""),
)
DUE_MARK: Steps = ((r"(?i)\(due:\s*([^)]+)\)", ""),)
