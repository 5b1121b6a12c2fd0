"""Third-engine extractors and the whole engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_signals import deduped, first_sql, steps_sql, v3_due
from colloquy.catalog.q_text import (
    _talk, cleaned, content_key, edges, has, like_any, lit, owner_v3_sql, overlap_sql, sq, stop_list, wc,
)
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import kinds, rows
from colloquy.operators import commitments as K, sentences as S
from colloquy.plans.records import notes_records
from colloquy.plans.third import third_engine
from colloquy.sources.standins import standin

SP = lit(T.SPEAKER_V3)


def verb(x: str) -> str:
    return f"regexp_matches(lower({x}), {lit(L.any_word(L.V3_VERBS))})"


def shape(x: str) -> str:
    return f"regexp_matches(regexp_replace(lower({x}), '^(?:recap action|explicit action|action)\\s*:\\s*', ''), {lit(L.any_word(L.V3_PRECISION_VERBS))})"


def invalid(x: str) -> str:
    return (
        f"(length({x}) < 12 or {like_any(x, L.V3_WEAK + L.V3_PURPOSE + L.V3_INVALID_PHRASES)} or "
        f"regexp_matches(lower({x}), {lit(L.starts(K.INVALID_STARTS))}) or ({like_any(x, L.V3_DECISION)} and not {verb(x)}))"
    )


def decision_test(x: str) -> str:
    t = cleaned(x)
    return (
        f"(length({t}) >= 12 and not (regexp_matches(lower({t}), {lit(K.GOAL_INTRO)}) and regexp_matches(lower({t}), {lit(K.GOAL_PAYLOAD)})) "
        f"and not ends_with({t}, '?') and not {like_any(t, K.NO_DECISION)} and not {like_any(t, L.V3_WEAK)} and ({like_any(t, L.V3_DECISION)} "
        f"or regexp_matches(lower({t}), '\\b(first pilot audience|target audience)\\b.*\\b(will be|is|are)\\b') "
        f"or regexp_matches(lower({t}), '\\b(demo|live demo)\\b.*\\b(will use|uses|use)\\b') or regexp_matches(lower({t}), '\\bbackup meeting\\b.*\\b(will keep|keep|processed)\\b')))"
    )


def context_test(x: str) -> str:
    return (
        f"(regexp_matches(lower({x}), {lit(L.starts(L.V3_CONTEXT_STARTS))}) or (regexp_matches(lower({x}), '^(?:the|this|that|it|there)\\b') "
        f"and regexp_matches(lower({x}), {lit(K.CONTEXT_COPULA)})) or (not {shape(x)} and {decision_test(x)}))"
    )


def precise(x: str) -> str:
    return f"({x} <> '' and not {context_test(x)} and {shape(x)})"


def actions_from(source: str) -> str:
    """Valid action rows of (doc_id, ord, s) where s is a cleaned text."""
    bad_owners = ", ".join(f"'{o}'" for o in L.V3_INVALID_OWNERS)
    return f"""select doc_id, ord, owner, task, coalesce(due, {v3_due('task')}) as deadline, case when owner <> 'Unassigned' then 0.82 else 0.68 end as confidence, s as evidence from (
      select doc_id, ord, s, due, case when regexp_matches(task, '(?i)^Team\\s+will\\s+.+$') then 'Team' else owner end as owner,
        {cleaned("case when regexp_matches(task, '(?i)^Team\\s+will\\s+.+$') then regexp_extract(task, '(?i)^Team\\s+will\\s+(.+)$', 1) else task end")} as task from (
        select doc_id, ord, s, case when st <> s then sdue end as due, {owner_v3_sql(f"case when st <> s then so when regexp_extract(s, {lit(K.PREFIX)}, 1) <> '' then regexp_extract(s, {lit(K.PREFIX)}, 1) else regexp_extract(s, {lit(K.MODAL)}, 1) end")} as owner,
          case when st <> s then st when regexp_extract(s, {lit(K.PREFIX)}, 1) <> '' then {cleaned(f"regexp_extract(s, {lit(K.PREFIX)}, 2)")}
               when regexp_extract(s, {lit(K.MODAL)}, 1) <> '' then {cleaned(f"regexp_extract(s, {lit(K.MODAL)}, 2)")} else s end as task from (
          select *, case when recap and ot <> '' then ot when expl and regexp_matches(lower(body), '\\bintentionally unassigned\\b') then 'Unassigned' else sp end as so,
            case when recap and dt <> '' and lower(dt) <> 'no deadline' then dt end as sdue,
            {cleaned(f"case when recap then regexp_replace(tail, '(?i)\\bOwner\\s*:.*$', '') when expl then regexp_replace(tail, {lit(K.EXPLICIT_TAIL)}, '') else tail end")} as st from (
            select *, {cleaned("regexp_extract(tail, '(?i)\\bOwner\\s*:\\s*([^\\.]+)', 1)")} as ot, {cleaned("regexp_extract(tail, '(?i)\\bDeadline\\s*:\\s*([^\\.]+)', 1)")} as dt from (
              select *, case when recap then regexp_replace(body, {lit(K.RECAP)}, '') when expl then regexp_replace(body, {lit(K.EXPLICIT)}, '') else body end as tail from (
                select *, regexp_matches(lower(body), '\\brecap action\\s*:') as recap, regexp_matches(lower(body), '\\bexplicit action\\s*:') and not regexp_matches(lower(body), '\\brecap action\\s*:') as expl from (
                  select *, regexp_extract(s, {SP}, 1) as sp, case when regexp_extract(s, {SP}, 1) <> '' then {cleaned(f'regexp_extract(s, {SP}, 2)')} else s end as body from ({source}) a0 where not {invalid('s')}
                ) a1) a2) a3) a4) a5) a6) a7
      where lower(owner) not in ({bad_owners}) and not {invalid('task')} and {verb('task')}"""


def _overlap(e: str, x: str) -> str:
    small = f"least(len({e}.tok), len({x}.tok))"
    shared = f"len(list_intersect({e}.tok, {x}.tok))"
    return f"{e}.ok = {x}.ok and {e}.k <> '' and {x}.k <> '' and ({e}.k = {x}.k or ({small} >= 3 and ({shared} = {small} or ({shared} >= 4 and {shared} / {small} >= 0.75))))"


def folded_actions(source: str) -> str:
    """The order-dependent dedupe over (doc_id, ord, owner, task, ...) rows."""
    return f"""select doc_id, unnest(m) as a, generate_subscripts(m, 1) as i from (
      select doc_id, list_reduce(list_transform(l, lambda s: [s]), lambda acc, y: case when len(list_filter(acc, lambda e: {_overlap('e', 'y[1]')})) = 0 then list_concat(acc, y)
        else list_transform(acc, lambda e, i: case when i = list_position(list_transform(acc, lambda g: {_overlap('g', 'y[1]')}), true) and y[1].w > e.w then y[1] else e end) end) as m from (
        select doc_id, list({{'owner': owner, 'task': task, 'deadline': deadline, 'confidence': confidence, 'evidence': evidence, 'ok': lower({cleaned('owner')}), 'k': k,
          'tok': list_filter(list_distinct(string_split(k, ' ')), lambda w: w <> '' and not list_contains({stop_list(L.V3_TASK_STOP)}, w)),
          'w': n + case when owner <> 'Unassigned' then 3 else 0 end + case when deadline <> 'Not specified' then 2 else 0 end + case when evidence <> '' then 2 else 0 end + case when n >= 5 then 1 else 0 end}} order by ord) as l
        from (select *, {content_key('task')} as k, {wc('task')} as n from ({source}) b0) b1 group by doc_id) b2) b3"""


cte(
    "v3_found",
    actions_from(
        f"select doc_id, pos as ord, {cleaned('s')} as s from spoken_sents where regexp_matches(lower(s), {lit(L.V3_LANGUAGE)})"
    ),
)
cte("v3_folded", folded_actions("select * from v3_found"))
cte(
    "v3_actions",
    f"select doc_id, row_number() over (partition by doc_id order by i) as pos, a.owner as owner, a.task as task, a.deadline as deadline, a.confidence as confidence, a.evidence as evidence from v3_folded where {precise('a.task')}",
)


def _spoken():
    return S.sentences_spoken(F.col("text"))


def _action_rows(df, items):
    out = rows(df, items, ["doc_id"], "a")
    return out.select("doc_id", "pos", "a.owner", "a.task", "a.deadline", "a.confidence", "a.evidence")


@query("x05_v3_actions", oracle("select * from v3_actions"))
def x05(spark, sf):
    return _action_rows(_talk(spark, sf), K.v3_actions(_spoken()))


@query(
    "f07_action_overlap_rule",
    oracle(
        "select doc_id, row_number() over (partition by doc_id order by i) as pos, a.owner as owner, a.task as task, a.deadline as deadline, a.confidence as confidence, a.evidence as evidence from v3_folded"
    ),
)
def f07(spark, sf):
    return _action_rows(_talk(spark, sf), K.dedupe_actions(K.extract_actions(_spoken())))


@query(
    "p16_high_precision_filter",
    oracle(
        f"select doc_id, pos, s as sentence, {precise('s')} as keep, {context_test('s')} as is_context, {invalid('s')} as is_invalid from (select doc_id, pos, {cleaned('s')} as s from statement_sents) t"
    ),
)
def p16(spark, sf):
    sents = F.transform(S.statements(F.col("text")), T.clean)
    out = rows(_talk(spark, sf), sents, ["doc_id"], "sentence")
    s = F.col("sentence")
    return out.select(
        "doc_id", "pos", "sentence", K.is_high_precision(s).alias("keep"), K.is_context(s).alias("is_context"), K.is_invalid(s).alias("is_invalid")
    )


def decision_text_sql(x: str) -> str:
    t = cleaned(x)
    body = f"case when regexp_extract({t}, {SP}, 2) <> '' then {cleaned(f'regexp_extract({t}, {SP}, 2)')} else {t} end"
    return steps_sql(body, C.V3_DECISION)


def decisions_from(source: str) -> str:
    """Decision rows of (doc_id, ord, s): numbered items split out."""
    return f"""select doc_id, ord, sub, {decision_text_sql('part')} as text, s as evidence from (
      select doc_id, ord, s, generate_subscripts(ps, 1) as sub, unnest(ps) as part from (
        select doc_id, ord, s, case when len(q) > 1 then list_filter(list_transform(q[2:], lambda p: {cleaned('p')}), lambda p: p <> '') else [s] end as ps from (
          select *, string_split_regex({cleaned('s')}, {lit(K.NUMBERED)}) as q from ({source}) d0) d1) d2) d3"""


cte(
    "v3_decided",
    f"select doc_id, ord * 1000 + sub as ord, text, evidence from ({decisions_from('select doc_id, pos as ord, s from spoken_sents')}) t where {decision_test('text')}",
)
cte("v3_decisions", deduped("select doc_id, ord, text as s, evidence from v3_decided", content_key("s"), 1000000, "s, evidence"))


@query("x06_v3_decisions", oracle("select doc_id, pos, s as text, evidence from v3_decisions"))
def x06(spark, sf):
    out = rows(_talk(spark, sf), K.v3_decisions(_spoken()), ["doc_id"], "d")
    return out.select("doc_id", "pos", "d.text", "d.evidence")


@query(
    "f14_decision_clean",
    oracle(f"select doc_id, pos, {decision_text_sql('s')} as text from statement_sents"),
)
def f14(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    return out.select("doc_id", "pos", K.decision_text(F.col("s")).alias("text"))


RISK_TEST = f"length(s) >= 12 and not ends_with(s, '?') and (regexp_matches(lower(s), {lit(L.V3_RISK_STRONG)}) or ({like_any('s', L.V3_RISK)} and not {decision_test('s')}))"
QUESTION_TEST = f"ends_with(s, '?') or regexp_matches(lower(s), {lit(L.V3_QUESTION_START)})"
cte("v3_risks", deduped(f"select doc_id, pos as ord, s from spoken_sents where {RISK_TEST}", content_key("s"), 8))
cte("v3_questions", deduped(f"select doc_id, pos as ord, s from spoken_sents where {QUESTION_TEST}", content_key("s"), 8))


@query("x07_v3_risks", oracle("select doc_id, pos, s as sentence from v3_risks"))
def x07(spark, sf):
    return rows(_talk(spark, sf), K.v3_risks(_spoken()), ["doc_id"], "sentence")


@query("x08_v3_questions", oracle("select doc_id, pos, s as sentence from v3_questions"))
def x08(spark, sf):
    return rows(_talk(spark, sf), K.v3_questions(_spoken()), ["doc_id"], "sentence")


# ---- the whole engine over stored records -------------------------------------------------------
def list_rows(column: str, table: str = "records") -> str:
    """(doc_id, ord, s) rows of a '|' separated field."""
    return f"select doc_id, generate_subscripts(l, 1) as ord, unnest(l) as s from (select doc_id, list_filter(string_split(coalesce({column}, ''), '|'), lambda x: x <> '') as l from {table}) u"


cte(
    "q9_actions",
    f"""select doc_id, row_number() over (partition by doc_id order by i) as pos, a.owner as owner, a.task as task, a.deadline as deadline, a.confidence as confidence from ({folded_actions(
        "select * from (" + actions_from(f"select doc_id, ord, {cleaned('s')} as s from ({list_rows('action_items')}) w")
        + ") e1 union all select * from (" + actions_from(f"select doc_id, 1000 + pos as ord, {cleaned('s')} as s from covered_sents where regexp_matches(lower(s), {lit(L.V3_LANGUAGE)})") + ") e2"
    )}) t where {precise('a.task')}""",
)
cte(
    "q9_decisions",
    deduped(
        f"""select doc_id, ord, s from (select doc_id, ord, {decision_text_sql('s')} as s from ({list_rows('decisions')}) w
        union all select doc_id, 1000000 + ord * 1000 + sub, text from ({decisions_from('select doc_id, pos as ord, s from covered_sents')}) x) y where {decision_test('s')}""",
        content_key("s"),
        1000000,
    ),
)
cte("q9_found_risks", deduped(f"select doc_id, pos as ord, s from covered_sents where {RISK_TEST}", content_key("s"), 8))
cte("q9_found_questions", deduped(f"select doc_id, pos as ord, s from covered_sents where {QUESTION_TEST}", content_key("s"), 8))


def merged(existing: str, found: str) -> str:
    return deduped(
        f"select doc_id, ord, {cleaned('s')} as s from ({list_rows(existing)} union all select doc_id, 1000 + pos, s from {found}) w",
        content_key("s"),
        8,
    )


cte("q9_risks", merged("risks", "q9_found_risks"))
cte("q9_questions", merged("open_questions", "q9_found_questions"))
cte(
    "q9_slots",
    f"""select r.doc_id, coalesce(nullif({cleaned('r.purpose')}, ''), p1, p2, '') as purpose, coalesce(nullif({cleaned('r.outcome')}, ''), o1, '') as outcome from records r left join (
    select doc_id, arg_min(s, pos) filter ({like_any('s', L.V3_PURPOSE)}) as p1, arg_min(s, pos) filter (regexp_matches(lower(s), 'confirm|finalize|align')) as p2,
    arg_min(s, pos) filter (regexp_matches(lower(s), {lit(K.OUTCOME)})) as o1 from covered_sents group by doc_id) c on c.doc_id = r.doc_id""",
)
cte(
    "q9_steps",
    deduped(
        f"""select doc_id, ord, s from (select doc_id, ord, {cleaned('s')} as s from ({list_rows('next_steps')}) w) v where {precise('s')}
        union all select doc_id, 1000 + pos, case when owner <> 'Unassigned' then owner || ': ' || task else task end from q9_actions""",
        content_key("s"),
        5,
    ),
)


def section_key_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({cleaned(x)}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g'))"


cte(
    "q9_others",
    f"""select distinct doc_id, {section_key_sql('s')} as o from (select doc_id, purpose as s from q9_slots union all select doc_id, outcome from q9_slots union all select doc_id, s from q9_decisions union all select doc_id, task from q9_actions) t where {section_key_sql('s')} <> ''""",
)
cte(
    "q9_points",
    deduped(
        f"""select p.doc_id, p.ord, p.s from (select doc_id, ord, {cleaned('s')} as s, {section_key_sql('s')} as k0 from ({list_rows('key_points')}) w) p where s <> '' and not regexp_matches(lower(s), {lit(L.starts(L.V3_OVERLAP_STARTS))})
        and not exists (select 1 from q9_others o where o.doc_id = p.doc_id and k0 <> '' and (o = k0 or (length(k0) >= 24 and length(o) >= 24 and (contains(o, k0) or contains(k0, o)))))""",
        content_key("s"),
        6,
    ),
)


def agg(table: str, expr: str = "s") -> str:
    return f"select doc_id, string_agg({expr}, '|' order by pos) as v, count(*) as n from {table} group by doc_id"


Q9_SQL = f"""select r.doc_id, s.purpose, s.outcome, coalesce(a.v, '') as actions, coalesce(d.v, '') as decisions, coalesce(k.v, '') as risks, coalesce(q.v, '') as open_questions, coalesce(n.v, '') as next_steps, coalesce(p.v, '') as key_points,
    coalesce(a.n, 0) as action_count, coalesce(d.n, 0) as decision_count, coalesce(k.n, 0) as risk_count, coalesce(q.n, 0) as open_question_count, coalesce(a.g, 0) as generic_owner_count, coalesce(a.u, 0) as missing_deadline_count,
    coalesce(a.n, 0) > 0 or coalesce(d.n, 0) > 0 as passed,
    concat_ws('|', case when a.g > 0 then 'Some action items have Team or Unassigned owners.' end, case when a.u > 0 then 'Some action items do not include explicit deadlines.' end,
      case when a.n is null then 'No action items detected.' end, case when d.n is null then 'No decisions detected.' end) as warnings
    from records r join q9_slots s on s.doc_id = r.doc_id
    left join (select doc_id, string_agg(owner || '/' || task || '/' || deadline, '|' order by pos) as v, count(*) as n, count(*) filter (owner in ('Team', 'Unassigned')) as g, count(*) filter (deadline = 'Not specified') as u from q9_actions group by doc_id) a on a.doc_id = r.doc_id
    left join ({agg('q9_decisions')}) d on d.doc_id = r.doc_id left join ({agg('q9_risks')}) k on k.doc_id = r.doc_id left join ({agg('q9_questions')}) q on q.doc_id = r.doc_id
    left join ({agg('q9_steps')}) n on n.doc_id = r.doc_id left join ({agg('q9_points')}) p on p.doc_id = r.doc_id"""


def _third(spark, sf):
    return third_engine(notes_records(standin(spark, sf, "records")))


def pipe(c):
    return F.array_join(c, "|")


@query("q09_engine_v3", oracle(f"select doc_id, purpose, outcome, actions, decisions, risks, open_questions, next_steps, key_points from ({Q9_SQL}) t"))
def q09(spark, sf):
    acts = F.transform("actions", lambda a: F.concat_ws("/", a["owner"], a["task"], a["deadline"]))
    return _third(spark, sf).select(
        "doc_id", "purpose", "outcome", pipe(acts).alias("actions"),
        *[pipe(F.col(c)).alias(c) for c in ("decisions", "risks", "open_questions", "next_steps", "key_points")],
    )


@query("w17_first_match_slot", oracle("select doc_id, purpose, outcome from q9_slots"))
def w17(spark, sf):
    r = standin(spark, sf, "records").withColumn("sents", S.covered_sentences(F.col("text")))
    return r.select(
        "doc_id", K.infer_purpose(F.col("sents"), F.col("purpose")).alias("purpose"), K.infer_outcome(F.col("sents"), F.col("outcome")).alias("outcome")
    )


@query("l05_next_steps_from_actions", oracle("select doc_id, pos, s as step from q9_steps"))
def l05(spark, sf):
    r = notes_records(standin(spark, sf, "records")).withColumn("sents", S.covered_sentences(F.col("text")))
    acts = K.v3_actions(F.col("sents"), F.col("action_items"))
    return rows(r, K.next_steps(acts, F.col("next_steps")), ["doc_id"], "step")


@query("u01_existing_union_extracted", oracle("select doc_id, 'risk' as kind, pos, s as text from q9_risks union all select doc_id, 'question', pos, s from q9_questions"))
def u01(spark, sf):
    r = notes_records(standin(spark, sf, "records")).withColumn("sents", S.covered_sentences(F.col("text")))
    risks = K.merge_texts([F.col("risks"), K.v3_risks(F.col("sents"))], 8)
    asks = K.merge_texts([F.col("open_questions"), K.v3_questions(F.col("sents"))], 8)
    return kinds(r, {"risk": risks, "question": asks})


@query("j10_section_overlap_anti", oracle("select doc_id, pos, s as key_point from q9_points"))
def j10(spark, sf):
    return rows(_third(spark, sf), F.col("key_points"), ["doc_id"], "key_point")


@query(
    "a27_metadata_quality",
    oracle(
        f"select doc_id, action_count, decision_count, risk_count, open_question_count, generic_owner_count, missing_deadline_count, passed, warnings from ({Q9_SQL}) t"
    ),
)
def a27(spark, sf):
    out = _third(spark, sf).select("doc_id", "metadata.*")
    return out.withColumn("warnings", pipe(F.col("warnings")))
