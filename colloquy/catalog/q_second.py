"""Second-engine extractors and the whole engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_signals import deduped, steps_sql
from colloquy.catalog.q_text import _talk, has, like_any, lit, sq, stop_list
from colloquy.catalog.q_third import list_rows, pipe
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import rows
from colloquy.operators import markers as M, sentences as S
from colloquy.plans.records import notes_records
from colloquy.plans.second import second_engine, notes_text
from colloquy.sources.standins import standin


def cap(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


def spaced(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def key_like(x: str, patterns) -> str:
    return f"regexp_matches({x}, {lit(L.any_of(patterns))})"


def strip_dots(x: str, chars: str = " .") -> str:
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def matches(source: str, patterns, groups: int = 1) -> str:
    """(doc_id, ord, g1[, g2]) rows of every pattern's matches; ord follows pattern, then place."""
    parts = []
    for i, p in enumerate(patterns):
        cols = ", ".join(f"unnest(regexp_extract_all(text, {lit(p)}, {g})) as g{g}" for g in range(1, groups + 1))
        parts.append(
            f"select doc_id, {i * 100000} + row_number() over (partition by doc_id) as ord, * exclude (doc_id) from (select doc_id, {cols} from {source}) m{i}"
        )
    return " union all ".join(f"select doc_id, ord, {', '.join(f'g{g}' for g in range(1, groups + 1))} from ({p}) z" for p in parts)


# list positions must follow the text, so matches are numbered inside the list
def listed(source: str, patterns, groups: int = 1) -> str:
    parts = []
    for i, p in enumerate(patterns):
        gs = ", ".join(f"regexp_extract_all(text, {lit(p)}, {g}) as l{g}" for g in range(1, groups + 1))
        un = ", ".join(f"unnest(l{g}) as g{g}" for g in range(1, groups + 1))
        parts.append(f"select doc_id, {i * 100000} + generate_subscripts(l1, 1) as ord, {un} from (select doc_id, {gs} from {source}) m{i}")
    return " union all ".join(parts)


TALK = "(select doc_id, coalesce(text, '') as text from transcripts)"

# ---- F09 -------------------------------------------------------------------------------------


def _case(x: str, names, fmt="{}") -> str:
    arms = " ".join(f"when '{n}' then {i + 1}" for i, n in enumerate(names))
    return f"case {x} {arms} end"


def spoken_sql(x: str, year: int = 2026) -> str:
    t = strip_dots(sq(x), " .,")
    sp = lit(M.SPOKEN)
    clock = f"replace(lower(regexp_extract({t}, {sp}, 1)), ' ', '')"
    month = _case(f"lower(regexp_extract({t}, {sp}, 2))", M.MONTHS)
    day = _case(f"regexp_replace(lower(regexp_extract({t}, {sp}, 3)), '^(twenty|thirty) ', '\\1-')", M.DAYS)
    h = f"regexp_replace({clock}, '(am|pm)$', '')"
    hour = f"coalesce(try_cast({h} as int), {_case(h, M.HOURS)}, 0)"
    h24 = f"case when {clock} = 'noon' then 12 when {clock} = 'midnight' then 0 when ends_with({clock}, 'pm') and {hour} <> 12 then {hour} + 12 when ends_with({clock}, 'am') and {hour} = 12 then 0 else {hour} end"
    return f"case when {month} is not null and {day} is not null then '{year}-' || lpad(cast({month} as varchar), 2, '0') || '-' || lpad(cast({day} as varchar), 2, '0') || ' ' || lpad(cast({h24} as varchar), 2, '0') || ':00' else {t} end"


@query("f09_spoken_datetime", oracle(f"select doc_id, pos, {spoken_sql('s')} as value from statement_sents"))
def f09(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    return out.select("doc_id", "pos", M.spoken_datetime(F.col("s")).alias("value"))


# ---- X09, A15 -----------------------------------------------------------------------------------
def owner_sql(x: str) -> str:
    v = steps_sql(sq(x), C.ENDS)
    names = ", ".join(f"'{n}'" for n in M.BLOCKED_OWNERS)
    return f"case when lower({v}) in ({names}) then '' else {v} end"


def cut_first(x: str, p: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {lit(p)}, ''), '^[ ,.;]+|[ ,.;]+$', '', 'g')"


def marked_actions_sql(source: str) -> str:
    due = [strip_dots(sq(f"regexp_extract(g2, {lit(p)}, 1)")) for p in M.DUE_PATTERNS]
    return f"""select doc_id, ord, owner, task, deadline, 'medium' as priority from (
      select doc_id, ord, owner, {cap(steps_sql('t0', C.V2_TASK))} as task, deadline from (
        select doc_id, ord, {owner_sql('g1')} as owner, case when sp <> '' then {cut_first('g2', M.SPOKEN_BY)} when d1 <> '' then {cut_first('g2', M.DUE_PATTERNS[0])} when d2 <> '' then {cut_first('g2', M.DUE_PATTERNS[1])} else g2 end as t0,
          case when sp <> '' then {spoken_sql("regexp_replace(sp, '(?i)^\\s*by\\s+', '')")} when d1 <> '' then d1 else d2 end as deadline from (
          select *, regexp_extract(g2, {lit(M.SPOKEN_BY)}, 0) as sp, {due[0]} as d1, {due[1]} as d2 from ({listed(source, M.ACTION_PATTERNS, 2)}) m1) m2) m3) m4
      where owner <> '' and task <> '' and {spaced('task')} <> '' and not ({key_like(spaced('task'), M.GENERIC_TASK)} and not {key_like(spaced('task'), M.DELIVERABLE)})"""


cte("v2_actions", marked_actions_sql(TALK))


@query(
    "x09_v2_marker_actions",
    oracle("select doc_id, row_number() over (partition by doc_id order by ord) as pos, owner, task, deadline from v2_actions"),
)
def x09(spark, sf):
    out = rows(_talk(spark, sf), M.marked_actions(F.coalesce("text", F.lit(""))), ["doc_id"], "a")
    return out.select("doc_id", "pos", "a.owner", "a.task", "a.deadline")


def task_key_sql(x: str) -> str:
    return sq(f"regexp_replace({spaced(x)}, '\\b(?:a|an|the)\\b', ' ', 'g')")


def merged_actions_sql(source: str) -> str:
    same = "contains({e}.k, y[1].k) or contains(y[1].k, {e}.k)"
    return f"""select doc_id, generate_subscripts(m, 1) as ord, m.owner as owner, m.task as task, m.deadline as deadline, m.priority as priority from (
      select doc_id, ord0, unnest(m0) as m, m0 from (select doc_id, 0 as ord0, list_reduce(list_transform(l, lambda s: [s]), lambda acc, y: case when len(list_filter(acc, lambda e: {same.format(e='e')})) = 0 then list_concat(acc, y)
        else list_transform(acc, lambda e, i: case when i = list_position(list_transform(acc, lambda g: {same.format(e='g')}), true) and y[1].w > e.w then y[1] else e end) end) as m0 from (
        select doc_id, list({{'owner': owner, 'task': task, 'deadline': deadline, 'priority': priority, 'k': k,
          'w': case when owner <> '' then 4 else 0 end + case when deadline <> '' then 3 else 0 end + case when priority <> '' then 1 else 0 end + least(8, len(list_filter(string_split({spaced('task')}, ' '), lambda w: w <> '')))}} order by ord) as l
        from (select *, {task_key_sql('task')} as k from ({source}) b0) b1 where k <> '' group by doc_id) b2) b3) b4""".replace(
        "select doc_id, generate_subscripts(m, 1) as ord, m.owner as owner",
        "select doc_id, row_number() over (partition by doc_id order by i) as ord, m.owner as owner",
    ).replace("select doc_id, ord0, unnest(m0) as m, m0 from", "select doc_id, unnest(m0) as m, generate_subscripts(m0, 1) as i from")


cte("v2_merged", merged_actions_sql("select * from v2_actions"))


@query("a15_richest_by_key", oracle("select doc_id, ord as pos, owner, task, deadline from v2_merged"))
def a15(spark, sf):
    merged = M.merge_actions(M.marked_actions(F.coalesce("text", F.lit(""))))
    out = rows(_talk(spark, sf), merged, ["doc_id"], "a")
    return out.select("doc_id", "pos", "a.owner", "a.task", "a.deadline")


@query(
    "f11_owner_variant_fix",
    oracle(
        f"""select v.doc_id, ord as pos, case when lower(owner) = 'morgan' and contains({spaced("coalesce(t.text, '')")}, 'priya') then 'Priya' else owner end as owner, task from v2_merged v join transcripts t on t.doc_id = v.doc_id"""
    ),
)
def f11(spark, sf):
    text = F.coalesce("text", F.lit(""))
    fixed = M.fix_owners(M.merge_actions(M.marked_actions(text)), text, {"Morgan": "Priya"})
    return rows(_talk(spark, sf), fixed, ["doc_id"], "a").select("doc_id", "pos", "a.owner", "a.task")


@query(
    "f12_task_clean",
    oracle(
        f"select doc_id, pos, {cap(steps_sql('s', C.V2_TASK))} as v2_task, {steps_sql('s', C.LOCAL_TASK)} as local_task, {steps_sql('s', C.LOCAL_SENTENCE)} as local_sentence from statement_sents"
    ),
)
def f12(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    s = F.col("s")
    return out.select(
        "doc_id", "pos", M.clean_task(s).alias("v2_task"), C.apply(s, C.LOCAL_TASK).alias("local_task"), C.apply(s, C.LOCAL_SENTENCE).alias("local_sentence")
    )


# ---- X10 -------------------------------------------------------------------------------------------
def stopped(x: str) -> str:
    return f"case when {x} = '' then '' else {cap(x)} || case when regexp_matches({x}, '[.!?]$') then '' else '.' end end"


def decisions_sql(source: str) -> str:
    plain = [p for p in M.DECISION_PATTERNS if p]
    raw = []
    for i, p in enumerate(M.DECISION_PATTERNS):
        if p is None:
            raw.append(
                f"""select doc_id, {i * 100000} + ln * 100 + generate_subscripts(q, 1) as ord, unnest(q) as g1 from (select doc_id, ln, string_split_regex(line, {lit(M.NUMBERED_DECISION)})[2:] as q from (
                select doc_id, generate_subscripts(l, 1) as ln, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from {source}) n0) n1) n2"""
            )
        else:
            raw.append(f"select doc_id, {i * 100000} + generate_subscripts(l1, 1) as ord, unnest(l1) as g1 from (select doc_id, regexp_extract_all(text, {lit(p)}, 1) as l1 from {source}) m{i}")
    return decided_sql(" union all ".join(raw), "g1")


def decided_sql(source: str, col: str) -> str:
    return f"""select doc_id, ord, s from (select doc_id, ord, {stopped('d')} as s from (select doc_id, ord, {steps_sql(col, C.V2_DECISION)} as d from ({source}) e0) e1) e2 where s <> '' and {spaced('s')} <> '' and not {key_like(spaced('s'), M.NON_DECISION)}"""


def kept_decisions_sql(source: str) -> str:
    """Greedy containment dedupe of (doc_id, ord, s) rows."""
    return f"""select doc_id, row_number() over (partition by doc_id order by i) as ord, m.s as s from (select doc_id, unnest(m0) as m, generate_subscripts(m0, 1) as i from (
      select doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(list_filter(acc, lambda e: contains(e.k, y[1].k) or contains(y[1].k, e.k))) = 0 then list_concat(acc, y) else acc end) as m0 from (
        select doc_id, list({{'s': s, 'k': {task_key_sql('s')}}} order by ord) as l from ({decided_sql(source, 's')}) g0 group by doc_id) g1) g2) g3"""


cte("v2_decisions", decisions_sql(TALK))
cte("v2_kept_decisions", kept_decisions_sql("select * from v2_decisions"))


@query("x10_v2_marker_decisions", oracle("select doc_id, row_number() over (partition by doc_id order by ord) as pos, s as text from v2_decisions"))
def x10(spark, sf):
    return rows(_talk(spark, sf), M.marked_decisions(F.coalesce("text", F.lit(""))), ["doc_id"], "text")


@query("w10_containment_dedupe", oracle("select doc_id, ord as pos, s as text from v2_kept_decisions"))
def w10_containment(spark, sf):
    kept = M.merge_decisions(M.marked_decisions(F.coalesce("text", F.lit(""))))
    return rows(_talk(spark, sf), kept, ["doc_id"], "text")


# ---- X11 -------------------------------------------------------------------------------------------
def risk_ok(x: str) -> str:
    return f"{x} <> '' and {spaced(x)} <> '' and not {key_like(spaced(x), M.RESOLVED_RISK)} and not regexp_matches({x}, {lit(M.ACTION_LIKE_RISK)})"


def risks_sql(source: str) -> str:
    return risked_sql(listed(source, M.RISK_PATTERNS), "g1")


def risked_sql(source: str, col: str) -> str:
    return f"select doc_id, ord, s from (select doc_id, ord, {stopped('r')} as s from (select doc_id, ord, {steps_sql(col, C.V2_RISK)} as r from ({source}) f0) f1) f2 where {risk_ok('s')}"


RISK_KEY = f"regexp_replace({spaced('s')}, '\\btime out\\b', 'timeout', 'g')"
cte("v2_risks", risks_sql(TALK))


@query("x11_v2_marker_risks", oracle("select doc_id, row_number() over (partition by doc_id order by ord) as pos, s as text from v2_risks"))
def x11(spark, sf):
    return rows(_talk(spark, sf), M.marked_risks(F.coalesce("text", F.lit(""))), ["doc_id"], "text")


@query(
    "f15_risk_clean",
    oracle(f"select doc_id, pos, {stopped('r')} as text, not ({risk_ok(stopped('r'))}) as is_void from (select doc_id, pos, {steps_sql('s', C.V2_RISK)} as r from statement_sents) t"),
)
def f15(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    out = out.select("doc_id", "pos", M.risk_text(F.col("s")).alias("text"))
    return out.withColumn("is_void", M.is_void_risk(F.col("text")))


# ---- X12, J12 -----------------------------------------------------------------------------------------
def question_sql(x: str) -> str:
    return f"case when {x} = '' then '' else {cap(x)} || case when ends_with({x}, '?') then '' else '?' end end"


TERM_STOP = stop_list(M.QUESTION_TERMS_STOP)


def answered_sql(q: str, src: str) -> str:
    span = f"substr({src}, position({q} in {src}) + length({q}), 800)"
    return f"(position({q} in {src}) > 0 and regexp_matches({span}, {lit(L.any_text(M.ANSWER_MARKERS))}) and len(list_intersect(list_filter(list_distinct(string_split({q}, ' ')), lambda w: length(w) > 3 and not list_contains({TERM_STOP}, w)), string_split({span}, ' '))) >= 2)"


def asked_sql(source: str, col: str) -> str:
    return f"select doc_id, ord, s from (select doc_id, ord, {question_sql('q')} as s from (select doc_id, ord, {steps_sql(col, C.V2_QUESTION)} as q from ({source}) h0) h1) h2 where s <> '' and {spaced('s')} <> '' and not {key_like(spaced('s'), M.RHETORICAL)}"


def questions_sql(source: str) -> str:
    n = len(M.QUESTION_PATTERNS)
    raw = f"""{listed(source, M.QUESTION_PATTERNS)}
      union all select doc_id, {n * 100000} + generate_subscripts(l, 1), regexp_replace(unnest(l), '^\\s*[-*]\\s*', '') from (select doc_id, list_filter(string_split(regexp_extract(text, {lit(M.QUESTION_BLOCK)}, 1), chr(10)), lambda x: x <> '') as l from {source}) k0
      union all select doc_id, {(n + 1) * 100000} + ord, s from (select doc_id, generate_subscripts(l, 1) as ord, trim(unnest(l)) as s from (select doc_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as l from {source}) k1) k2 where contains(s, '?') and {has('s', M.QUESTION_MARKERS)}"""
    return f"""select a.doc_id, a.ord, a.s from ({asked_sql(raw, 'g1')}) a join (select doc_id, {spaced('text')} as src from {source}) b on b.doc_id = a.doc_id where not {answered_sql(spaced('a.s'), 'b.src')}"""


cte("v2_questions", questions_sql(TALK))


@query("x12_v2_marker_questions", oracle("select doc_id, row_number() over (partition by doc_id order by ord) as pos, s as text from v2_questions"))
def x12(spark, sf):
    return rows(_talk(spark, sf), M.marked_questions(F.coalesce("text", F.lit(""))), ["doc_id"], "text")


@query(
    "f16_question_clean",
    oracle(f"select doc_id, pos, {question_sql('q')} as text, {spaced(question_sql('q'))} = '' or {key_like(spaced(question_sql('q')), M.RHETORICAL)} as is_rhetorical from (select doc_id, pos, {steps_sql('s', C.V2_QUESTION)} as q from statement_sents) t"),
)
def f16(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    out = out.select("doc_id", "pos", M.question_text(F.col("s")).alias("text"))
    return out.withColumn("is_rhetorical", M.is_rhetorical(F.col("text")))


@query(
    "j12_answered_later",
    oracle(
        f"select s.doc_id, s.pos, s.s as sentence, {answered_sql(spaced('s.s'), 't.src')} as answered from signal_sents s join (select doc_id, {spaced('text')} as src from transcripts) t on t.doc_id = s.doc_id where ends_with(s.s, '?')"
    ),
)
def j12(spark, sf):
    from colloquy.functions.arrays import let

    sents = F.transform(S.sentences_signal(F.col("text")), lambda s, i: F.struct((i + 1).cast("long").alias("pos"), s.alias("sentence")))
    asked = F.filter(sents, lambda x: x["sentence"].endswith("?"))
    flagged = let(
        T.spaced_key(F.col("text")),
        lambda src: F.transform(
            asked, lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"), M.answered_later(x["sentence"], src).alias("answered"))
        ),
    )
    out = _talk(spark, sf).select("doc_id", F.explode_outer(flagged).alias("x"))
    return out.filter(F.col("x").isNotNull()).select("doc_id", "x.*")


# ---- records -----------------------------------------------------------------------------------------------
def blob_sql() -> str:
    parts = ", ".join(f"nullif({c}, '')" for c in ("summary", "purpose", "outcome"))
    lists = ", ".join(
        f"nullif(replace({c}, '|', chr(10)), '')" for c in ("risks", "next_steps", "open_questions", "key_points", "decisions", "action_items")
    )
    return f"concat_ws(chr(10), {parts}, {lists})"


cte("blobs", f"select doc_id, {blob_sql()} as text from records")
cte("talk_and_blob", "select doc_id, concat_ws(chr(10), coalesce(t.text, ''), b.text) as text from transcripts t join blobs b using (doc_id)")


def _entity_rows(source: str) -> str:
    arms = " union all ".join(
        f"select doc_id, {i} as ord, 'Possible known entity rewrite: ''' || coalesce({', '.join(f"nullif(regexp_extract(text, {lit('(?i)' + p)}), '')" for p in ps)}) || ''' may refer to ''{n}''.' as s from {source}"
        for i, (n, ps) in enumerate(M.ENTITY_VARIANTS.items())
    )
    return f"select * from ({arms}) w where s is not null"


cte("entity_hits", _entity_rows("talk_and_blob"))


@query("j11_entity_variant_scan", oracle("select doc_id, row_number() over (partition by doc_id order by ord) as pos, s as warning from entity_hits"))
def j11(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    text = F.concat_ws("\n", F.coalesce("text", F.lit("")), notes_text())
    return rows(r, M.entity_warnings(text), ["doc_id"], "warning")


POINTS = list_rows("key_points")
_BODY = f"case when regexp_extract(s, {lit(M.SPEAKER_SAYS)}, 2) <> '' then regexp_extract(s, {lit(M.SPEAKER_SAYS)}, 2) else s end"
cte(
    "v2_points",
    deduped(
        f"select doc_id, ord, {cap(steps_sql('b', C.KEY_POINT))} as s from (select doc_id, ord, {_BODY} as b from ({POINTS}) p0) p1 where not (trim({steps_sql('b', C.QUESTION_LEAD)}) <> b and contains(b, '?')) and not regexp_matches({spaced('b')}, {lit(M.ACTION_POINT)}) and not {key_like(spaced('b'), M.META_POINT)}",
        spaced("s"),
        1000000,
    ),
)


@query("p19_key_point_filter", oracle("select doc_id, pos, s as key_point from v2_points"))
def p19(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    return rows(r, M.clean_points(F.col("key_points"))["points"], ["doc_id"], "key_point")


cte("q8_stored", f"""select doc_id, ord, {owner_sql("coalesce(nullif(regexp_extract(trim(s), {0}, 1), ''), '')").replace('{0}', lit(r"^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$"))} as owner,
    trim(regexp_extract(trim(s), {lit(r"^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$")}, 2)) as task, regexp_extract(trim(s), {lit(r"^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$")}, 3) as deadline, '' as priority from ({list_rows('action_items')}) w""")
cte("blob_actions", marked_actions_sql("blobs"))
cte("q8_found_actions", merged_actions_sql("select * from v2_actions union all select doc_id, 10000000 + ord, owner, task, deadline, priority from blob_actions"))
cte("q8_actions", merged_actions_sql("select * from q8_stored union all select doc_id, 1000 + ord, owner, task, deadline, priority from q8_found_actions"))
cte("blob_decisions", decisions_sql("blobs"))
cte("q8_found_decisions", kept_decisions_sql("select * from v2_decisions union all select doc_id, 10000000 + ord, s from blob_decisions"))
cte("q8_decisions", kept_decisions_sql(f"select * from ({list_rows('decisions')}) w union all select doc_id, 1000 + ord, s from q8_found_decisions"))
cte("blob_risks", risks_sql("blobs"))
cte("q8_found_risks", deduped("select * from v2_risks union all select doc_id, 10000000 + ord, s from blob_risks", RISK_KEY, 1000000))
cte(
    "q8_risks",
    deduped(risked_sql(f"select * from ({list_rows('risks')}) w union all select doc_id, 1000 + pos, s from q8_found_risks", "s"), RISK_KEY, 1000000),
)
cte("blob_questions", questions_sql("blobs"))
cte("q8_found_questions", deduped("select * from v2_questions union all select doc_id, 10000000 + ord, s from blob_questions", spaced("s"), 1000000))
cte(
    "q8_questions",
    deduped(
        asked_sql(
            f"""select * from ({list_rows('open_questions')}) w union all select doc_id, 1000 + ord, trim({steps_sql('b', C.QUESTION_LEAD)}) from (select doc_id, ord, {_BODY} as b from ({POINTS}) p0) p1 where trim({steps_sql('b', C.QUESTION_LEAD)}) <> b and contains(b, '?')
            union all select doc_id, 2000 + pos, s from q8_found_questions""",
            "s",
        ),
        spaced("s"),
        1000000,
    ),
)


def stop_sentence_sql(x: str) -> str:
    b = strip_dots(sq(x))
    return f"case when {b} = '' then '' else {cap(b)} || '.' end"


cte(
    "q8_steps",
    deduped(
        f"""select doc_id, ord, {stop_sentence_sql('s')} as s from ({list_rows('next_steps')}) w
        union all select doc_id, 1000 + ord, {stop_sentence_sql("case when owner <> '' then regexp_replace(task, '(?i)^' || owner || '\\s*[-:]\\s*', '') else task end")} from q8_actions""",
        spaced("s"),
        5,
    ),
)


def purpose_sql(x: str) -> str:
    found = "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 1), '')" for p in M.PURPOSE_PATTERNS) + ")"
    aim = f"regexp_replace({strip_dots(found)}, '(?i)\\band\\s+the\\s+', 'and ', 'g')"
    conf = "'Confirm ' || " + aim
    return f"case when {aim} <> '' then {stop_sentence_sql(conf)} else '' end"


def ordlist(table: str, order: str = "ord", expr: str = "s") -> str:
    return f"select doc_id, string_agg({expr}, '|' order by {order}) as v from {table} group by doc_id"


Q8_SQL = f"""select r.doc_id, case when r.purpose <> '' then r.purpose else coalesce(nullif({purpose_sql("coalesce(r.text, '')")}, ''), {purpose_sql("coalesce(r.summary, '')")}) end as purpose,
    coalesce(a.v, '') as actions, coalesce(d.v, '') as decisions, coalesce(k.v, '') as risks, coalesce(q.v, '') as open_questions, coalesce(n.v, '') as next_steps, coalesce(p.v, '') as key_points, coalesce(e.v, '') as entity_warnings
    from records r left join ({ordlist('q8_actions', 'ord', "owner || '/' || task || '/' || deadline")}) a on a.doc_id = r.doc_id left join ({ordlist('q8_decisions')}) d on d.doc_id = r.doc_id
    left join ({ordlist('q8_risks', 'pos')}) k on k.doc_id = r.doc_id left join ({ordlist('q8_questions', 'pos')}) q on q.doc_id = r.doc_id left join ({ordlist('q8_steps', 'pos')}) n on n.doc_id = r.doc_id
    left join ({ordlist('v2_points', 'pos')}) p on p.doc_id = r.doc_id left join ({ordlist('entity_hits')}) e on e.doc_id = r.doc_id"""


@query("q08_engine_v2", oracle(Q8_SQL))
def q08(spark, sf):
    out = second_engine(notes_records(standin(spark, sf, "records")))
    acts = F.transform("actions", lambda a: F.concat_ws("/", a["owner"], a["task"], a["deadline"]))
    return out.select(
        "doc_id", "purpose", pipe(acts).alias("actions"),
        *[pipe(F.col(c)).alias(c) for c in ("decisions", "risks", "open_questions", "next_steps", "key_points", "entity_warnings")],
    )
