"""Spellings of a pattern that match the same text and are quicker to search for in Java.

The word lists of ``lexicons`` are spelled once for both engines; what is rewritten here is read by Spark only.
"""

from __future__ import annotations

import re
import string
import warnings
from functools import cache

from pyspark.sql import Column, functions as F

from colloquy.functions.arrays import let

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    from re import _constants as K, _parser as parser

MOST = 40
# letters and digits one by one: Java looks single characters up in a table, and walks through ranges
ALNUM = string.ascii_lowercase + string.digits
NOT_ALNUM = f"[^{ALNUM}]"
NOT_ALNUM_RUN = f"{NOT_ALNUM}+"
NOT_ALNUM_SPACE_RUN = f"[^{ALNUM} ]+"
NOT_ALNUM_WHITE = rf"[^{ALNUM} \t\n\x0B\f\r]"


def _first(items, fold: bool) -> tuple[set[str], bool] | None:
    """Characters a match can begin with, and whether it can be empty; None if that is not known."""
    chars: set[str] = set()
    for op, arg in items:
        if op is K.AT:
            continue
        if op is K.ASSERT:
            continue
        if op is K.LITERAL:
            found, empty = {chr(arg)}, False
        elif op is K.IN:
            found, empty = set(), False
            for kind, value in arg:
                if kind is K.LITERAL:
                    found.add(chr(value))
                elif kind is K.RANGE and value[1] < 128:
                    found |= {chr(i) for i in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is K.BRANCH:
            found, empty = set(), False
            for arm in arg[1]:
                got = _first(arm, fold)
                if got is None:
                    return None
                found |= got[0]
                empty |= got[1]
        elif op is K.SUBPATTERN and not arg[1] and not arg[2]:
            got = _first(arg[3], fold)
            if got is None:
                return None
            found, empty = got
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            got = _first(arg[2], fold)
            if got is None:
                return None
            found, empty = got[0], got[1] or arg[0] == 0
        else:
            return None
        if any(ord(c) > 127 for c in found):
            return None
        chars |= {x for c in found for x in (c.lower(), c.upper())} if fold else found
        if not empty:
            return chars, False
    return chars, True


@cache
def ahead(pattern: str) -> str:
    """The pattern behind a test of one character: places where no match can begin are passed quickly.

    Groups keep their numbers.  A pattern that is tied to the start of the text, that can begin with
    very many characters, or that is not understood comes back as it is.
    """
    flags, body = re.match(r"((?:\(\?[is]+\))?)(.*)", pattern, re.S).groups()
    if body.startswith("^") and not _bars(body) or "(?U" in pattern:
        return pattern
    try:
        got = _first(parser.parse(body), "i" in flags)
    except (re.error, OverflowError):
        return pattern
    if got is None or got[1] or not got[0] or len(got[0]) > MOST:
        return pattern
    listed = "".join(f"\\x{ord(c):02x}" if not c.isalnum() else c for c in sorted(got[0]))
    return f"{flags}(?=[{listed}])(?:{body})"


def _bars(body: str) -> bool:
    return len(parser.parse(body)) == 1 and parser.parse(body)[0][0] is K.BRANCH


def any_text(cues) -> str:
    """Holds one of the literal cues: those with the same first letter share its test."""
    heads: dict[str, list[str]] = {}
    for c in dict.fromkeys(cues):
        heads.setdefault(c[0], []).append(c[1:])
    quoted = lambda x: re.escape(x).replace("\\ ", " ").replace("\\'", "'")
    arms = [quoted(h) + ("(?:" + "|".join(map(quoted, t)) + ")" if len(t) > 1 else quoted(t[0])) for h, t in heads.items()]
    return ahead("|".join(arms))


def any_word_start(patterns) -> str:
    r"""One alternation of patterns that begin with ``\b`` and a letter or digit: those with the same one share its test."""
    heads: dict[str, list[str]] = {}
    for p in dict.fromkeys(patterns):
        if not re.match(r"\\b[a-z0-9][^?*+{]", p) or not _one_arm(p):
            raise ValueError(f"not a plain word start: {p}")
        heads.setdefault(p[2], []).append(p[3:])
    arms = [h + ("(?:" + "|".join(t) + ")" if len(t) > 1 else t[0]) for h, t in heads.items()]
    return ahead(r"\b(?:" + "|".join(arms) + ")")


def _one_arm(pattern: str) -> bool:
    return all(op is not K.BRANCH for op, _ in parser.parse(pattern))


# ---- replacements ------------------------------------------------------------------------
WHITE = " \t\n\x0b\f\r"
LINE_ENDS = "\n\r\u0085\u2028\u2029"
# white space that is not a single space
LOOSE = r"\s(?:\s+|(?<=[^ ]))"


@cache
def _end_chars(pattern: str) -> str | None:
    """The characters of a pattern '^[..]+|[..]+$', else None."""
    got = re.fullmatch(r"\^(\[[^\]^][^\]]*\]|\\s)\+\|(.+)\+\$", pattern)
    if got is None or got[1] != got[2]:
        return None
    if got[1] == r"\s":
        return WHITE
    found = ""
    for kind, value in parser.parse(got[1])[0][1] if parser.parse(got[1])[0][0] is K.IN else [parser.parse(got[1])[0]]:
        if kind is K.LITERAL:
            found += chr(value)
        elif kind is K.CATEGORY and value is K.CATEGORY_SPACE:
            found += WHITE
        else:
            return None
    return found


def replace(c: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace``; characters at the ends and runs of white space are not searched for one by one."""
    chars = _end_chars(pattern) if replacement == "" else None
    if chars is not None:
        # '$' also matches before a line end that closes the text
        closing = [x for x in LINE_ENDS if x not in chars]
        return let(
            c,
            lambda s: F.when(F.substring(s, -1, 1).isin(*closing), F.regexp_replace(s, pattern, "")).otherwise(
                F.btrim(s, F.lit(chars))
            ),
        )
    if (pattern, replacement) == (r"\s+", " "):
        return F.regexp_replace(c, LOOSE, " ")
    return F.regexp_replace(c, ahead(pattern), replacement)
