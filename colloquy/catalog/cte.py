"""Building blocks of the oracle statements: named sub-queries and their dependencies."""

from __future__ import annotations

import re

from colloquy.sources.standins import GIVEN, STANDINS, standin_sql

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Register a sub-query other statements may select from."""
    if name in CTES or name in STANDINS or name in GIVEN:
        raise ValueError(f"name taken: {name}")
    CTES[name] = sql


def _names(sql: str) -> list[str]:
    known = set(CTES) | set(STANDINS)
    return [w for w in dict.fromkeys(re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", sql)) if w in known]


def oracle(body: str, instead: dict[str, str] | None = None) -> str:
    """``body`` with a WITH clause holding every named sub-query it reaches.

    ``instead`` puts other tables in the place of named ones.
    """
    done: dict[str, str] = {}

    def visit(sql: str) -> None:
        for name in _names(sql):
            if name in done:
                continue
            text = (instead or {}).get(name) or (CTES[name] if name in CTES else standin_sql(name))
            if name in CTES:
                visit(text)
            done[name] = text

    visit(body)
    if not done:
        return body
    return "with " + ",\n".join(f"{n} as ({t})" for n, t in done.items()) + "\n" + body
