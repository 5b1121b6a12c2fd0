"""Q11 with purpose and outcome, on joined meetings at the default limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import CTES, cte, oracle
from colloquy.catalog.q_guards import Q11_RULES
from colloquy.catalog.q_long_meetings import JOINED, joined_talk
from colloquy.catalog.q_second import ordlist
from colloquy.catalog.q_text import has, lit, sq
from colloquy.catalog.q_third import list_rows, pipe
from colloquy.functions import lexicons as L
from colloquy.plans import guards as G, long_polish as Q
from colloquy.plans.records import notes_records
from colloquy.sources.standins import standin, standin_sql

PURPOSE = Q.SlotRule(
    generic=Q.PURPOSE.generic + ("order 1",),
    specific=Q.PURPOSE.specific + ("purpose of this meeting",),
    default=Q.PURPOSE.default,
    choices=(
        ((("supplier portal", "order file"), ("lane 7", "lane 9")), "Review the order files, the supplier portal and the lanes."),
        ((("pilot",),), "Review the pilot and what it needs."),
    ),
)
OUTCOME = Q.SlotRule(
    generic=Q.OUTCOME.generic,
    specific=Q.OUTCOME.specific,
    default=Q.OUTCOME.default,
    choices=(
        ((("no such words",),), "Never said."),
        ((("lane",), ("approved", "agreed")), "The team aligned on the lanes and who keeps them."),
    ),
)


def meeting_records(spark, sf):
    """Joined meetings, with the notes of the record of the same number, if there is one."""
    notes = standin(spark, sf, "records").drop("text")
    return notes_records(joined_talk(spark, sf).join(notes, "doc_id", "left"))


FIELDS = "summary, purpose, outcome, key_points, decisions, risks as raw_risks, next_steps"
MEETINGS = f"""select j.doc_id, j.text, {", ".join("n." + f for f in FIELDS.split(", "))}, regexp_replace(regexp_replace(n.risks, '\\s+,', ',', 'g'), ',\\s+or\\s+', ' or ', 'g') as risks
    from ({JOINED}) j left join ({standin_sql('records')}) n on n.doc_id = j.doc_id"""


def spoken(column: str, most: int = 1_000_000) -> str:
    table = "(select doc_id, raw_risks as risks, next_steps, key_points, decisions from records)"
    return f"(select doc_id, string_agg(s, ' ' order by ord) as v from ({list_rows(column, table)}) w where ord <= {most} group by doc_id)"


cte(
    "q11_evidence",
    f"""select r.doc_id, lower({sq("concat_ws(' ', coalesce(r.text, ''), coalesce(r.summary, ''), coalesce(r.purpose, ''), coalesce(r.outcome, ''), coalesce(a.v, ''), coalesce(b.v, ''), coalesce(c.v, ''), coalesce(d.v, ''))")}) as low
    from records r left join {spoken('risks')} a on a.doc_id = r.doc_id left join {spoken('next_steps')} b on b.doc_id = r.doc_id
    left join {spoken('key_points', Q.SEEN)} c on c.doc_id = r.doc_id left join {spoken('decisions', Q.SEEN)} d on d.doc_id = r.doc_id""",
)


def slot_sql(column: str, rule: Q.SlotRule) -> str:
    now = sq(f"coalesce(r.{column}, '')")
    made = " ".join(f"when {' and '.join(has('e.low', terms) for terms in groups)} then {lit(text)}" for groups, text in rule.choices)
    return f"case when not g.is_long then r.{column} when {has(now, rule.specific)} and not {has(now, rule.generic)} then {now} {made} else {lit(rule.default)} end"


cte(
    "q11_slots",
    f"""select r.doc_id, {slot_sql('purpose', PURPOSE)} as purpose, {slot_sql('outcome', OUTCOME)} as outcome
    from records r join q11_long g on g.doc_id = r.doc_id join q11_evidence e on e.doc_id = r.doc_id""",
)


@query(
    "q11_long_polish_slots",
    oracle(
        f"""select r.doc_id, g.is_long, s.purpose, s.outcome, case when g.is_long then trim(concat_ws(' ', s.purpose, s.outcome)) else r.summary end as summary,
        case when g.is_long then coalesce(k.v, '') else coalesce(r.raw_risks, '') end as risks, case when g.is_long then coalesce(p.v, '') else coalesce(r.key_points, '') end as key_points
        from records r join q11_long g on g.doc_id = r.doc_id join q11_slots s on s.doc_id = r.doc_id
        left join ({ordlist('q11_risks', 'pos')}) k on k.doc_id = r.doc_id left join ({ordlist('q11_points', 'ord')}) p on p.doc_id = r.doc_id""",
        {
            "records": MEETINGS,
            "q11_long": f"select doc_id, length(coalesce(text, '')) >= {Q.LONG_CHARS} or regexp_matches(lower(coalesce(text, '')), {lit(L.any_text(G.LONG_WORDS))}) as is_long from records",
            "rule_low": "select doc_id, low from q11_evidence",
            "q11_added": CTES["q11_added"],
        },
    ),
)
def q11_slots(spark, sf):
    out = Q.polished(meeting_records(spark, sf), Q11_RULES, PURPOSE, OUTCOME)
    return out.select(
        "doc_id", "is_long", "purpose", "outcome", "summary", *[pipe(F.col(x)).alias(x) for x in ("risks", "key_points")]
    )
