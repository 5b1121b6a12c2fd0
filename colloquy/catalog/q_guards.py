"""Guards, routing, critics, gates and polish over notes records."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_match import _cases, case_rows
from colloquy.catalog.q_second import blob_sql, cap, key_like, ordlist, spaced, strip_dots
from colloquy.catalog.q_signals import deduped, first_sql, steps_sql
from colloquy.catalog.q_text import _talk, cleaned, has, like_any, lit, overlap_sql, sq, token_list, wc
from colloquy.catalog.q_third import list_rows, pipe, section_key_sql
from colloquy.catalog.q_recall import norm_words_sql
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import kinds, rows
from colloquy.operators import hints as H, match as M, recall as R, render as N
from colloquy.plans import guards as G
from colloquy.plans.records import notes_records
from colloquy.plans.second import notes_text, second_engine
from colloquy.sources.standins import standin


def _records(spark, sf):
    return notes_records(standin(spark, sf, "records"))


def _parsed():
    return F.transform("action_items", T.parse_action_line)


def joined(column: str, expr: str = "s", table: str = "records") -> str:
    return f"(select doc_id, string_agg({expr}, '|' order by ord) as v, count(*) as n from ({list_rows(column, table)}) w group by doc_id)"


# ---- P21 --------------------------------------------------------------------------------------
def client_sql(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in G.TEXT_FIXES.items():
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return sq(f"regexp_replace({out}, '[ \\t]+([,.;:!?])', '\\1', 'g')")


def _clean_list(column: str) -> str:
    return deduped(f"select doc_id, ord, {strip_dots(client_sql('s'))} as s from ({list_rows(column)}) w", spaced("s"), 1000000)


cte("p21_points", _clean_list("key_points"))
cte("p21_decisions", _clean_list("decisions"))


@query(
    "p21_client_text_sanitize",
    oracle(
        f"""select r.doc_id, {client_sql('r.summary')} as summary, {client_sql('r.purpose')} as purpose, {client_sql('r.outcome')} as outcome, coalesce(p.v, '') as key_points, coalesce(d.v, '') as decisions
        from records r left join ({ordlist('p21_points', 'pos')}) p on p.doc_id = r.doc_id left join ({ordlist('p21_decisions', 'pos')}) d on d.doc_id = r.doc_id"""
    ),
)
def p21(spark, sf):
    out = G.sanitize(_records(spark, sf))
    return out.select("doc_id", "summary", "purpose", "outcome", pipe(F.col("key_points")).alias("key_points"), pipe(F.col("decisions")).alias("decisions"))


# ---- P20 ----------------------------------------------------------------------------------------
def publish_sql(x: str) -> str:
    o = f"regexp_replace(regexp_replace(trim({x}), '^\\s*[-*]?\\s*\\[[ xX]\\]\\s*', ''), '(?i)\\s+_?\\(status:.*$', '')"
    return client_sql(f"regexp_replace({o}, '^[ \\-–—]+|[ \\-–—]+$', '', 'g')")


_V = "|".join(G.PUBLISH_VERBS)
PUBLISHABLE = f"""(task <> '' and not regexp_matches(lower(task), {lit(L.starts(G.PUBLISH_CONTEXT))}) and not (regexp_matches(lower(task), '^(?:the|this|that|it|there)\\b') and regexp_matches(lower(task), {lit(G.COPULA)}))
    and regexp_matches(lower(task), {lit(rf"^(?:also\s+)?(?:please\s+)?(?:{_V})\b|^(?:i\s+will|i'll)\s+(?:{_V})\b|^[a-z][a-z .'-]{{1,50}}\s+(?:will|should|needs to|need to|must|has to)\s+(?:{_V})\b")}))"""
OWNER_LINE = lit(r"^([A-Z][A-Za-z .'-]{1,60}?)\s*(?:—|-|:)\s*(.+)$")
cte(
    "p20_parsed",
    f"""select doc_id, ord, case when regexp_extract(t, {OWNER_LINE}, 1) <> '' then trim(regexp_extract(t, {OWNER_LINE}, 1)) else 'Team' end as owner,
    case when regexp_extract(t, {OWNER_LINE}, 2) <> '' then {publish_sql(f'regexp_extract(t, {OWNER_LINE}, 2)')} else t end as task, v3 from (
    select w.doc_id, ord, {publish_sql('s')} as t, contains(lower(coalesce(r.model_version, '')), 'v3') as v3 from ({list_rows('action_items')}) w join records r on r.doc_id = w.doc_id) x""",
)
cte(
    "p20_out",
    f"""select doc_id, ord, owner, task from p20_parsed where not v3 union all select doc_id, ord, owner, task from (
    select *, row_number() over (partition by doc_id, trim(regexp_replace(lower(task), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g')) order by ord) as rn from p20_parsed where v3 and {PUBLISHABLE}) t where rn = 1""",
)


@query("p20_publishable_guard", oracle("select doc_id, row_number() over (partition by doc_id order by ord) as pos, owner, task from p20_out"))
def p20(spark, sf):
    r = _records(spark, sf)
    out = rows(r, G.publishable_actions(F.col("action_items"), F.col("model_version")), ["doc_id"], "a")
    return out.select("doc_id", "pos", "a.owner", "a.task")


# ---- P22, P23, P25 -----------------------------------------------------------------------------------
ALLOW = ("user3@example.com", "USER10@example.com ", "user77@example.com")
MODE_SQL = "case id % 5 when 0 then ' V2' when 1 then 'shadow' when 2 then 'v9' when 3 then 'v1' else null end"


@query(
    "p22_engine_routing",
    oracle(
        f"""select id, case when m in ('shadow', 'v2', 'v3') then m when lower(trim(email)) in ('user3@example.com', 'user10@example.com', 'user77@example.com') then 'v2' else 'v1' end as mode from (
        select id, email, lower(trim(coalesce({MODE_SQL}, ''))) as m from users) t"""
    ),
)
def p22(spark, sf):
    users = standin(spark, sf, "users").withColumn("global_mode", F.expr(MODE_SQL))
    return users.select("id", G.engine_mode(F.col("global_mode"), F.col("email"), ALLOW).alias("mode"))


SEL = "case doc_id % 3 when 0 then 'v3' when 1 then 'v2' else 'v1' end"
RUN = "case when doc_id % 4 = 3 then null else 'v' || cast(1 + doc_id % 3 as varchar(20)) end"


@query(
    "p23_fallback_selection",
    oracle(
        f"""select doc_id, applied, case when applied then 'engine' else 'original' end as source from (select doc_id, ({SEL} = 'v3' and doc_id % 7 <> 0) or coalesce({RUN}, '') in ('v2', 'v3') as applied from records) t"""
    ),
)
def p23(spark, sf):
    r = standin(spark, sf, "records").select("doc_id", F.expr(SEL).alias("sel"), F.expr(RUN).alias("run"))
    out = r.select("doc_id", G.use_engine_output(F.col("sel"), F.col("run"), F.col("doc_id") % 7 == 0).alias("applied"))
    return out.withColumn("source", F.when(F.col("applied"), "engine").otherwise("original"))


@query(
    "p25_lineage_stamp",
    oracle(
        """select doc_id, case when mode = 'v2' and (fb or ap) then case when regexp_matches(named, '\\+qev2$|\\+qev2-fallback$') then named else named || case when fb then '+qev2-fallback' else '+qev2' end end else nullif(base, '') end as model_version from (
        select doc_id, case doc_id % 3 when 0 then 'v1' else 'v2' end as mode, doc_id % 5 = 0 as fb, doc_id % 2 = 0 as ap, base, case when base = '' then 'unknown' else base end as named
        from (select doc_id, case when doc_id % 11 = 0 then '' when doc_id % 13 = 0 then 'llm+qev2' else trim(model_version) end as base from records) a) b"""
    ),
)
def p25(spark, sf):
    r = standin(spark, sf, "records").select("doc_id", "model_version")
    base = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, "llm+qev2").otherwise(F.col("model_version"))
    mode = F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2")
    return r.select("doc_id", G.lineage(base, mode, F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 == 0).alias("model_version"))


# ---- Q01, X23, X28 ------------------------------------------------------------------------------------
NOISE_KEY = sq(f"regexp_replace(regexp_replace(lower({steps_sql('trim(s)', H.SPEAKER_NOISE)}), '\\b(the|a|an)\\b', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g')")
cte(
    "quality_sents",
    deduped(
        f"""select doc_id, ord, {steps_sql('trim(s)', H.SPEAKER_NOISE)} as s from (select doc_id, generate_subscripts(l, 1) as ord, regexp_replace(unnest(l), '^[ \\-]+|[ \\-]+$', '', 'g') as s from (
        select doc_id, string_split(regexp_replace({sq("coalesce(text, '')")}, '([.?!:;])\\s+', '\\1' || chr(10), 'g'), chr(10)) as l from transcripts) a) b where length(s) >= 18""",
        NOISE_KEY,
        1000000,
    ),
)


@query("x01_quality_sentences", oracle("select doc_id, pos, s as sentence from quality_sents"))
def x01_quality(spark, sf):
    return rows(_talk(spark, sf), H.quality_sentences(F.col("text")), ["doc_id"], "sentence")


STORIES = ("holmes", "gentleman", "autumn", "river", "story of the chair", "visitor")


def marks_sql(x: str, marks) -> str:
    return " + ".join(f"case when contains({x}, {lit(m)}) then 1 else 0 end" for m in marks)


cte(
    "non_meeting",
    f"""select t.doc_id, low <> '' and (({marks_sql('low', STORIES)} >= 3 and {marks_sql('low', H.MEETING_MARKS)} <= 2) or (coalesce(q.n, 0) >= 5 and {marks_sql('low', H.MEETING_MARKS)} = 0
      and not regexp_matches(low, {lit(H.ACTION_LANGUAGE)}) and not regexp_matches(low, {lit(H.DECISION_LANGUAGE)}))) as flag
    from (select doc_id, lower({sq("coalesce(text, '')")}) as low from transcripts) t left join (select doc_id, count(*) as n from quality_sents group by 1) q on q.doc_id = t.doc_id""",
)


def _flag():
    return H.non_meeting(F.col("text"), F.size(H.quality_sentences(F.col("text"))), STORIES, 5)


@query("q01_non_meeting_classifier", oracle(f"""select r.doc_id, flag as non_meeting, case when flag then '{H.SAFE_SUMMARY}' else r.summary end as summary, case when flag then '{H.SAFE_OUTCOME}' else r.outcome end as outcome, case when flag then '' else r.key_points end as key_points from records r join non_meeting m on m.doc_id = r.doc_id"""))
def q01(spark, sf):
    out = G.safety_override(_records(spark, sf), _flag())
    return out.select("doc_id", "non_meeting", "summary", "outcome", pipe(F.col("key_points")).alias("key_points"))


def low(x: str, p: str) -> str:
    return f"regexp_matches(lower({x}), {lit(p)})"


def imperative_sql(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in H.IMPERATIVES)
    return f"lower(split_part(regexp_replace({x}, '^[^A-Za-z]+', ''), ' ', 1)) in ({words})"


def act_cand(x: str) -> str:
    fu, du, ow = low(x, H.FUTURE_HINTS), low(x, H.DUE_HINTS), low(x, H.OWNER_HINTS)
    return f"""(({fu} or {du} or {ow} or ({imperative_sql(x)} and {low(x, H.VERB_HINTS)})) and not ({low(x, H.VALUE_HINTS)} and not ({du} or {ow} or {fu})) and not {low(x, H.INFRA_HINTS)} and not ({low(x, H.RISK_HINTS)} and not {fu})
      and not ({low(x, H.PAST_HINTS)} and not ({fu} or {du} or {ow})) and not ({low(x, H.EXCLUDE_HINTS)} and not ({du} or {ow})))"""


def w(test: str, n: int) -> str:
    return f"case when {test} then {n} else 0 end"


from colloquy.catalog.q_recall import KEYS  # noqa: E402

_EDGE = "regexp_replace(p, '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g')"
cte(
    "act_candidates",
    f"""select doc_id, row_number() over (partition by doc_id order by score desc, s) as pos, score, s from (
    select *, row_number() over (partition by doc_id, k order by ord) as rn from (select *, {KEYS['stem']} as k from (
      select doc_id, ord, score, {cap(steps_sql(steps_sql('trim(part)', H.SPEAKER_NOISE), H.ACTION_CLEAN))} as s from (
        select doc_id, pos * 100 + generate_subscripts(parts, 1) as ord, score, unnest(parts) as part from (
          select doc_id, pos, {w(low('s', H.ACTION_HINTS), 2)} + {w(low('s', H.DUE_HINTS), 3)} + {w(low('s', H.OWNER_HINTS), 2)} + {w(imperative_sql('s'), 2)} + {w(low('s', H.VERB_HINTS), 1)} + {w(low('s', H.COMPOUND_HINTS), 2)} + {w(low('s', r'\b(outreach|landing page|pilot)\b'), 1)} as score,
            case when not {low('s', H.DUE_HINTS)} and not {low('s', H.COMPOUND_HINTS)} and contains(s, ' and ') and len(ps) between 2 and 3 then ps else [s] end as parts from (
            select *, list_filter(list_transform(string_split(s, ' and '), lambda p: {_EDGE}), lambda p: p <> '') as ps from quality_sents where not {low('s', H.DECISION_HINTS)} and {act_cand('s')}) c0) c1) c2 where {act_cand('part')}) c3 where length(s) >= 12) c4 where k <> '') c5 where rn = 1""",
)
cte(
    "dec_candidates",
    f"""select doc_id, row_number() over (partition by doc_id order by score desc, s) as pos, score, s from (select *, row_number() over (partition by doc_id, k order by ord) as rn from (select *, {NOISE_KEY} as k from (
      select doc_id, pos as ord, {w(low('s', H.DECISION_HINTS), 4)} + {w(low('s', r'\b(use .* as the|lead with|treat .* as|going with)\b'), 2)} + {w(low('s', H.ACTION_HINTS) + ' and ' + low('s', H.DUE_HINTS), -1)} as score,
        {cap(steps_sql(steps_sql('trim(s)', H.SPEAKER_NOISE), H.DECISION_CLEAN))} as s from quality_sents where not {low('s', H.INFRA_HINTS)}) d0 where score > 0 and length(s) >= 12) d1 where k <> '') d2 where rn = 1""",
)
KINDS = "|".join((H.RISK_HINTS, H.INFRA_HINTS, H.ACTION_HINTS, H.DECISION_HINTS, H.VALUE_HINTS, H.NOISE_HINTS))
cte(
    "point_candidates",
    f"""select doc_id, row_number() over (partition by doc_id order by score desc, s) as pos, score, s from (select *, row_number() over (partition by doc_id, k order by ord) as rn from (select *, {NOISE_KEY} as k from (
      select doc_id, pos as ord, {w(low('s', H.BUSINESS_HINTS), 2)} + {w(low('s', r'\b(improved|baseline|workflow|quality|demo|pilot|customer|summary)\b'), 1)} as score, {steps_sql("trim(regexp_replace(s, '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g'))", H.SPEAKER_NOISE)} as s
      from quality_sents where not {low('s', KINDS)} and {wc('s')} between 8 and 35) p0 where score > 0) p1 where k <> '') p2 where rn = 1""",
)
_C = "select doc_id, pos, score, s as text from "


def _cand_rows(spark, sf, pick):
    out = rows(_talk(spark, sf), pick(H.quality_sentences(F.col("text"))), ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.score", "x.text")


@query("x23_action_candidates", oracle(_C + "act_candidates"))
def x23_actions(spark, sf):
    return _cand_rows(spark, sf, lambda s: H.action_candidates(s, R.stem_key))


@query("x23_decision_candidates", oracle(_C + "dec_candidates"))
def x23_decisions(spark, sf):
    return _cand_rows(spark, sf, H.decision_candidates)


@query("x28_scored_candidates", oracle(_C + "point_candidates"))
def x28_scored(spark, sf):
    return _cand_rows(spark, sf, H.key_point_candidates)


@query(
    "x23_structured_fallback",
    oracle(
        "select doc_id, 'action' as kind, pos, s as text from ("
        + deduped(f"select doc_id, ord, trim(s) as s from ({list_rows('action_items')}) w union all select doc_id, 1000 + pos, s from act_candidates", KEYS["stem"], 8)
        + ") a union all select doc_id, 'decision', pos, s from ("
        + deduped(f"select doc_id, ord, trim(s) as s from ({list_rows('decisions')}) w union all select doc_id, 1000 + pos, s from dec_candidates", NOISE_KEY, 6)
        + ") d"
    ),
)
def x23(spark, sf):
    r = _records(spark, sf).withColumn("sents", H.quality_sentences(F.col("text")))
    acts = H.fill_with(F.col("action_items"), H.action_candidates(F.col("sents"), R.stem_key), R.stem_key, 8)
    decs = H.fill_with(F.col("decisions"), H.decision_candidates(F.col("sents")), H.noise_key, 6)
    return kinds(r, {"action": acts, "decision": decs})


# ---- X22 ----------------------------------------------------------------------------------------------
def canon_sql(x: str) -> str:
    o = steps_sql(x, H.CANON_SENTENCE)
    closed = f"({o} || case when regexp_matches({o}, '[.!?]$') then '' else '.' end)"
    return f"case when {o} = '' then '' when regexp_matches({o}, '^[a-z]') then {cap(closed)} else {closed} end"


cte(
    "canon_sents",
    f"""select doc_id, row_number() over (partition by doc_id order by ord) as pos, s from (select doc_id, ord, {canon_sql('s')} as s from (select doc_id, generate_subscripts(l, 1) as ord, unnest(l) as s from (
    select doc_id, string_split_regex(regexp_replace({steps_sql("coalesce(text, '')", H.CANON_SPLIT)}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as l from transcripts) a) b) c where s <> ''""",
)
MESSY = f"({wc('s')} > 50 or (length(s) - length(replace(s, ',', '')) >= 5 and {wc('s')} > 35))"
cte("canon_decisions", deduped(f"select doc_id, pos as ord, s from canon_sents where not {MESSY} and {wc('s')} <= 40 and not {has('s', H.CANON_NO_DECISION)} and {has('s', H.CANON_DECISION)}", "lower(s)", 5))
cte("canon_risks", deduped(f"select doc_id, pos as ord, s from canon_sents where not {MESSY} and regexp_matches(lower(s), 'one risk|the risk|^risk:|one issue|^concern:|watch carefully')", "lower(s)", 5))
_CT, _CV = "|".join(H.CANON_TEAMS), "|".join(H.CANON_VERBS)
_CR = "'(?i)^(Team|Marketing|Engineering|Product|Design)\\s+(?:should|will)\\s+(.+)$'"
cte(
    "canon_actions",
    deduped(
        f"""select doc_id, pos as ord, {canon_sql(f"case when regexp_extract(s, {_CR}, 1) <> '' then regexp_extract(s, {_CR}, 2) else s end")} as s, case when regexp_extract(s, {_CR}, 1) <> '' then {cap(f"lower(regexp_extract(s, {_CR}, 1))")} end as owner,
        coalesce({', '.join(first_sql('lower(s)', p) for p in H.CANON_DUE)}) as due from canon_sents where not {MESSY} and {wc('s')} <= 35 and not {has('s', H.CANON_NO_ACTION)} and lower(s) not like 'if %'
        and regexp_matches(lower(s), {lit(rf"^(?:{_CT})\b.*\b(will|should|need to|needs to)\b|^(?:{_CV}) |^we (?:should|will) (?:{_CV}) | we (?:should|will|need to) (?:{_CV}) | let's (?:{_CV}) ")})""",
        "lower(s)", 6, "s, owner, due",
    ),
)
cte("canon_next", deduped(f"select doc_id, pos as ord, s from canon_sents where regexp_matches(lower(s), {lit(L.starts(H.CANON_NEXT))})", f"lower({sq('s')})", 5))
cte(
    "canon_slots",
    f"select t.doc_id, coalesce(purpose, '') as purpose, coalesce(outcome, '') as outcome from transcripts t left join (select doc_id, arg_min(s, pos) filter ({like_any('s', H.CANON_PURPOSE)}) as purpose, arg_min(s, pos) filter ({like_any('s', H.CANON_OUTCOME)}) as outcome from canon_sents group by 1) c on c.doc_id = t.doc_id",
)
cte(
    "canon_points",
    deduped(
        """select doc_id, 0 as ord, purpose as s from canon_slots where purpose <> '' union all select doc_id, 1, outcome from canon_slots where outcome <> '' union all select doc_id, 10 + pos, s from canon_decisions where pos <= 2
        union all select doc_id, 20 + pos, s from canon_risks where pos <= 2 union all select doc_id, 30 + pos, s from canon_next where pos <= 2 union all select doc_id, 40 + pos, s from canon_actions where pos <= 2""",
        f"lower({sq('s')})", 8,
    ),
)


def _canonical(df):
    c = F.col
    out = df.withColumn("sents", H.canon_sentences(c("text")))
    first = lambda pats: F.coalesce(F.get(F.filter("sents", lambda s: T.matches_any(s, pats)), F.lit(0)), F.lit(""))
    out = out.withColumns(
        {
            "purpose": first(H.CANON_PURPOSE), "outcome": first(H.CANON_OUTCOME), "decisions": H.canon_decisions(c("sents")),
            "risks": H.canon_risks(c("sents")), "actions": H.canon_actions(c("sents")), "next_steps": H.canon_next(c("sents")),
        }
    )
    return out.withColumn("key_points", H.canon_points(c("purpose"), c("outcome"), c("decisions"), c("risks"), c("next_steps"), c("actions")))


@query(
    "x22_canonical_orchestration",
    oracle(
        f"""select s.doc_id, purpose, outcome, coalesce(d.v, '') as decisions, coalesce(r.v, '') as risks, coalesce(a.v, '') as actions, coalesce(n.v, '') as next_steps, coalesce(p.v, '') as key_points from canon_slots s
        left join ({ordlist('canon_decisions', 'pos')}) d on d.doc_id = s.doc_id left join ({ordlist('canon_risks', 'pos')}) r on r.doc_id = s.doc_id
        left join ({ordlist('canon_actions', 'pos', "concat_ws('/', owner, s, due)")}) a on a.doc_id = s.doc_id left join ({ordlist('canon_next', 'pos')}) n on n.doc_id = s.doc_id left join ({ordlist('canon_points', 'pos')}) p on p.doc_id = s.doc_id"""
    ),
)
def x22(spark, sf):
    out = _canonical(_talk(spark, sf))
    acts = F.transform("actions", lambda a: F.concat_ws("/", a["owner"], a["text"], a["due"]))
    return out.select("doc_id", "purpose", "outcome", pipe(acts).alias("actions"), *[pipe(F.col(x)).alias(x) for x in ("decisions", "risks", "next_steps", "key_points")])


# ---- Q02, J13 on the second engine -----------------------------------------------------------------------
cte(
    "q8_lists",
    "select r.doc_id, count(a.ord) as na, count(a.ord) filter (" + f"{spaced('a.owner')} in ('someone', 'unassigned', 'unknown', 'tbd', 'owner')" + ") as ng, count(a.ord) filter (trim(coalesce(a.deadline, '')) = '') as nd from records r left join q8_actions a on a.doc_id = r.doc_id group by 1",
)
cte(
    "critic_checks",
    f"""select r.doc_id, trim(coalesce(e.purpose, '')) <> '' as purpose_present, {spaced("coalesce(r.summary, '')")} <> '' and {spaced("coalesce(r.summary, '')")} not in ({", ".join(f"'{x}'" for x in G.GENERIC_SUMMARIES)}) and {wc(spaced("coalesce(r.summary, '')"))} >= 6 as summary_specific,
    l.na > 0 or not regexp_matches(t, {lit(G.ACTION_TALK)}) or {key_like(spaced('t'), G.NO_ACTIONS)} as actions_present, not (regexp_matches(t, {lit(G.DECISION_TALK)}) and e.decisions = '') as decisions_present,
    l.ng = 0 as owners_not_generic, not (regexp_matches(t, {lit(G.DEADLINE_TALK)}) and l.nd > 0) as deadlines_present, coalesce(p.bad, 0) = 0 as questions_not_in_points,
    not regexp_matches(b.text, {lit(G.SUSPICIOUS)}) as emails_not_suspicious, not regexp_matches(b.text, {lit(G.TRANSCRIPT_LIKE)}) as not_transcript_like
    from (select *, coalesce(text, '') as t from records) r join q8_all e on e.doc_id = r.doc_id join q8_lists l on l.doc_id = r.doc_id join blobs b on b.doc_id = r.doc_id
    left join (select doc_id, count(*) filter (regexp_matches(lower(s), '\\bopen question\\b') or (contains(s, '?') and regexp_matches(lower(s), '\\bquestion\\b'))) as bad from v2_points group by 1) p on p.doc_id = r.doc_id""",
)
from colloquy.catalog.q_second import Q8_SQL  # noqa: E402

cte("q8_all", Q8_SQL)
_CHECKS = list(G.CRITIC_MESSAGES)


@query(
    "q02_critic_v2",
    oracle(
        "select doc_id, " + ", ".join(_CHECKS) + ", concat_ws('|', " + ", ".join(f"case when not {k} then '{m}' end" for k, m in G.CRITIC_MESSAGES.items()) + ") as warnings, "
        + " and ".join(G.CRITIC_BLOCKING) + " as passed from critic_checks"
    ),
)
def q02(spark, sf):
    out = G.critic(second_engine(_records(spark, sf)))
    return out.withColumn("warnings", pipe(F.col("warnings")))


def _n(column: str) -> str:
    return f"len(list_filter(string_split(coalesce({column}, ''), '|'), lambda x: x <> ''))"


@query(
    "j13_version_comparison",
    oracle(
        f"""select doc_id, m.metric as metric, m.a as v1, m.b as v2, m.b - m.a as delta from (select r.doc_id, unnest([{{'metric': 'purpose_present', 'a': case when trim(r.purpose) <> '' then 1 else 0 end, 'b': case when trim(e.purpose) <> '' then 1 else 0 end}},
        {{'metric': 'action_count', 'a': {_n('r.action_items')}, 'b': l.na}}, {{'metric': 'decision_count', 'a': {_n('r.decisions')}, 'b': {_n('e.decisions')}}}, {{'metric': 'next_step_count', 'a': {_n('r.next_steps')}, 'b': {_n('e.next_steps')}}},
        {{'metric': 'risk_count', 'a': {_n('r.risks')}, 'b': {_n('e.risks')}}}, {{'metric': 'open_question_count', 'a': {_n('r.open_questions')}, 'b': {_n('e.open_questions')}}}]) as m
        from records r join q8_all e on e.doc_id = r.doc_id join q8_lists l on l.doc_id = r.doc_id) t"""
    ),
)
def j13(spark, sf):
    r = _records(spark, sf)
    after = second_engine(r)
    return G.compare_versions(G.notes_metrics(r, "action_items"), G.notes_metrics(after, "actions"))


# ---- Q03, Q04, A26 --------------------------------------------------------------------------------------------
def ex(column: str, test: str) -> str:
    return f"exists (select 1 from ({list_rows(column)}) w where w.doc_id = r.doc_id and {test})"


def has_any_line(test: str) -> str:
    return f"exists (select 1 from stored_lines a where a.doc_id = r.doc_id and {test})"


LS = f"lower({sq('s')})"
LT, LO = f"lower({sq('a.task')})", f"lower({sq('a.owner')})"
cte(
    "gate_flags",
    f"""select r.doc_id, regexp_matches(lower({sq('r.summary')}) || ' ' || lower({sq('r.purpose')}) || ' ' || lower({sq('r.outcome')}), 'i''d us|i’d us') as bs, {_n('r.decisions')} as nd, coalesce(l.n, 0) as na, {_n('r.next_steps')} as ns, coalesce(l.bad, 0) > 0 as ba, coalesce(l.topical, 0) > 0 as topical, coalesce(l.n, 0) > coalesce(l.k, 0) as rep,
    coalesce(d.bad, 0) > 0 as bd, coalesce(p.bad, 0) > 0 as bp, coalesce(s.bad, 0) > 0 as bst from records r
    left join (select doc_id, count(*) as n, count(distinct lower({sq('owner')}) || ':' || {spaced(sq('task'))}) as k, count(*) filter (contains(lower({sq('task')}), 'lane') or contains(lower({sq('task')}), 'order file 1')) as topical,
      count(*) filter (regexp_matches(lower({sq('owner')}), '^i also think|^i think') or length(lower({sq('task')})) > 220 or (owner = 'Team' and contains(task, ':')) or regexp_matches(lower({sq('task')}), 'the purpose of today''s meeting|^s ')) as bad from stored_lines group by 1) l on l.doc_id = r.doc_id
    left join (select doc_id, count(*) filter (regexp_matches({LS}, '^(and )?action items$|^and action')) as bad from ({list_rows('decisions')}) w group by 1) d on d.doc_id = r.doc_id
    left join (select doc_id, count(*) filter (regexp_matches({LS}, 'control.reach|s keep|i''d us|i’d us')) as bad from ({list_rows('key_points')}) w group by 1) p on p.doc_id = r.doc_id
    left join (select doc_id, count(*) filter ({LS} like 's %') as bad from ({list_rows('next_steps')}) w group by 1) s on s.doc_id = r.doc_id""".replace(
        " or contains(lower(" + sq("task") + "), 'order file 1')", ""
    ),
)


@query(
    "q03_client_facing_gate",
    oracle(
        """select doc_id, score, nd as decision_count, na as action_count, ns as next_step_count, topical as has_priority_action, rep as has_duplicates, score >= 95 and not (bs or nd < 3 or na < 3 or ns < 3 or not topical or bd or ba or bst or bp or rep) as passed from (
        select *, greatest(0, 100 - case when bs then 25 else 0 end - case when nd < 3 then 15 else 0 end - case when na < 3 then 20 else 0 end - case when ns < 3 then 15 else 0 end - case when not topical then 15 else 0 end
        - case when bd then 15 else 0 end - case when ba then 20 else 0 end - case when bst then 15 else 0 end - case when bp then 10 else 0 end - case when rep then 10 else 0 end) as score from gate_flags) t"""
    ),
)
def q03(spark, sf):
    r = _records(spark, sf).withColumn(
        "actions", F.transform(_parsed(), lambda a: F.struct(F.coalesce(a["owner"], F.lit("")).alias("owner"), a["task"].alias("task")))
    )
    return G.client_gate(r, "lane")


@query(
    "a26_extraction_gap",
    oracle(
        f"select doc_id, length(summary) as summary_len, length(purpose) as purpose_len, length(outcome) as outcome_len, {_n('key_points')} as key_points, {_n('decisions')} as decisions, {_n('action_items')} as actions, {_n('decisions')} = 0 as needs_decision_fix, {_n('action_items')} = 0 as needs_action_fix from records"
    ),
)
def a26(spark, sf):
    return G.extraction_gap(_records(spark, sf))


# every third record has its decisions as objects too, and every fourth its actions
_OBJECTS = f"{_n('decisions')} * case when doc_id % 3 = 0 then 2 else 1 end as d, {_n('action_items')} * case when doc_id % 4 = 0 then 2 else 1 end as a"


def _with_objects(spark, sf):
    none = F.array().cast("array<string>")
    return _records(spark, sf).withColumns(
        {
            "decision_objects": F.when(F.col("doc_id") % 3 == 0, F.col("decisions")).otherwise(none),
            "action_item_objects": F.when(F.col("doc_id") % 4 == 0, F.col("action_items")).otherwise(none),
        }
    )


@query("a26_extraction_gap_objects", oracle(f"select doc_id, d as decisions, a as actions, d = 0 as needs_decision_fix, a = 0 as needs_action_fix from (select doc_id, {_OBJECTS} from records) t"))
def a26_objects(spark, sf):
    gaps = G.extraction_gap(_with_objects(spark, sf))
    return gaps.select("doc_id", "decisions", "actions", "needs_decision_fix", "needs_action_fix")


@query("a26_extraction_gap_totals", oracle(f"select count(*) as cases, count(*) filter (d = 0) as decision_gaps, count(*) filter (a = 0) as action_gaps from (select doc_id, {_OBJECTS} from records) t"))
def a26_totals(spark, sf):
    return G.gap_totals(G.extraction_gap(_with_objects(spark, sf)))


# ---- X25 and Q04 ---------------------------------------------------------------------------------------------------
def section_sql(title: str, column: str, prefix: str = "- ", expr: str = "s") -> str:
    body = f"(select string_agg('{prefix}' || {expr}, chr(10) order by ord) from ({list_rows(column)}) w where w.doc_id = r.doc_id)"
    return f"'## {title}' || chr(10) || coalesce({body}, '- (none)') || chr(10) || chr(10)"


def section_join(title: str, alias: str) -> str:
    return f"'## {title}' || chr(10) || coalesce({alias}.v, '- (none)') || chr(10) || chr(10)"


def lines_of(column: str, alias: str) -> str:
    return f"left join (select doc_id, string_agg('- ' || s, chr(10) order by ord) as v from ({list_rows(column)}) w group by doc_id) {alias} on {alias}.doc_id = r.doc_id"


cte(
    "markdowns",
    f"""select r.doc_id, regexp_replace('# Order ' || cast(r.doc_id as varchar) || chr(10) || chr(10) || '## Purpose' || chr(10) || case when r.purpose <> '' then r.purpose else '(none)' end || chr(10) || chr(10)
    || '## Outcome' || chr(10) || case when r.outcome <> '' then r.outcome when r.summary <> '' then r.summary else '(none)' end || chr(10) || chr(10)
    || {section_join('Risks', 'k')} || {section_join('Next Steps', 'n')} || {section_join('Key Points', 'p')} || {section_join('Decisions', 'd')}
    || '## Action Items' || chr(10) || coalesce(a.v, '- (none)') || chr(10), '[ \\t]+([,.;:!?])', '\\1', 'g') as md from records r
    {lines_of('risks', 'k')} {lines_of('next_steps', 'n')} {lines_of('key_points', 'p')} {lines_of('decisions', 'd')}
    left join (select doc_id, string_agg('- [ ] **' || case when owner <> '' then owner else 'Unassigned' end || '** — ' || task || case when due <> '' then ' _(due: ' || due || ')_' else '' end, chr(10) order by ord) as v from stored_lines group by doc_id) a on a.doc_id = r.doc_id""",
)


def _markdown():
    return N.notes_markdown(F.concat(F.lit("Order "), F.col("doc_id").cast("string")))


@query("x25_notes_markdown", oracle("select doc_id, md as markdown from markdowns"))
def x25(spark, sf):
    return _records(spark, sf).select("doc_id", _markdown().alias("markdown"))


cte(
    "score_parts",
    f"""select r.doc_id, m.flag as story, coalesce(l.n, 0) as n, {_n('r.decisions')} as d, coalesce(l.owned, 0) as owned, coalesce(l.dated, 0) as dated, coalesce(l.ks, 0) - coalesce(l.kd, 0) as dup,
    coalesce(b.longs, 0) > 0 and {has('bl.text', G.SUMMARY_SIGNALS)} as summary_ok, length(trim(md.md)) >= 100 and not {has('md.md', G.BAD_MARKDOWN)} as markdown_ok, {has("bl.text || ' ' || md.md", G.SAFETY_SIGNALS)} as safety
    from records r join non_meeting m on m.doc_id = r.doc_id join blobs bl on bl.doc_id = r.doc_id join markdowns md on md.doc_id = r.doc_id
    left join (select doc_id, count(*) as n, count(*) filter (trim(owner) <> '') as owned, count(*) filter (trim(due) <> '') as dated, count(*) filter ({spaced('task')} <> '') as ks, count(distinct {spaced('task')}) filter ({spaced('task')} <> '') as kd from stored_lines group by 1) l on l.doc_id = r.doc_id
    left join (select doc_id, count(*) filter ({wc('s')} >= 8) as longs from (select doc_id, unnest(string_split(text, chr(10))) as s from blobs) x group by 1) b on b.doc_id = r.doc_id""",
)


@query(
    "q04_notes_score",
    oracle(
        """select doc_id, cast(least(100, sc) as bigint) as score, case when (story and sc >= 85 and n <= 1 and d <= 1) or (not story and sc >= 85 and n >= 1 and d >= 1 and markdown_ok) then 'PASS' else 'REVIEW' end as status, summary_ok, markdown_ok, safety as safety_signal, dup as duplicate_actions from (
        select *, case when story then case when summary_ok then 20 else 8 end + case when n <= 1 then 25 else 0 end + case when d <= 1 then 25 else 0 end + case when safety then 20 else 8 end + case when markdown_ok then 10 else 0 end
        else case when summary_ok then 15 else 5 end + case when n >= 1 then 20 else 0 end + case when d >= 1 then 15 else 0 end + case when n > 0 and owned / n >= 0.5 then 15 when n > 0 then floor(owned / n * 15) else 0 end + case when dup = 0 then 10 else 3 end
        + case when markdown_ok then 10 else 0 end + case when dated > 0 then 5 else 2 end + 10 end as sc from score_parts) t"""
    ),
)
def q04(spark, sf):
    r = _records(spark, sf).withColumns(
        {"blob": notes_text(), "markdown": _markdown(), "non_meeting": _flag(), "actions": _parsed()}
    )
    return G.notes_score(r)


# ---- Q06, X30 ---------------------------------------------------------------------------------------------------------
def _before_after(spark, sf):
    c = _cases(spark, sf)
    extra = F.filter("actual_decisions", lambda d: F.lower(d).contains("lane"))
    better = c.withColumn("actual_risks", F.concat("actual_risks", "actual_decisions")).withColumn("actual_decisions", extra)
    before, after = M.evaluate_cases(c), M.evaluate_cases(better)
    flags = c.select(
        "case_id", (F.size(extra) != F.size("actual_decisions")).alias("changed"), (F.col("case_id") % 10 != 3).alias("critic_passed")
    )
    return before, after.join(flags, "case_id")


from colloquy.catalog.q_match import text_match_sql, _W  # noqa: E402

LANE = f"select * from ({case_rows('actual_decisions')}) w where contains(lower(s), 'lane')"
cte("after_decisions", text_match_sql("adec", case_rows("expected_decisions"), LANE))
cte("after_risks", text_match_sql("arisk", case_rows("expected_risks"), f"select * from ({case_rows('actual_risks')}) w union all select case_id, 100 + ord, s from ({case_rows('actual_decisions')}) v"))
_SEC = {"decisions": "after_decisions", "actions": "m_actions", "risks": "after_risks", "context": "m_context"}
cte(
    "after_eval",
    "select c.case_id, " + ", ".join(f"coalesce({k}.r, 1.0) as {k}_recall" for k in _W)
    + ", case when " + " and ".join(f"{k}.t is null" for k in _W) + " then 1.0 else round((" + " + ".join(f"case when {k}.t is not null then {w_} * {k}.r else 0e0 end" for k, w_ in _W.items())
    + ") / (" + " + ".join(f"case when {k}.t is not null then {w_} else 0e0 end" for k, w_ in _W.items()) + "), 4) end as score from cases c "
    + " ".join(f"left join (select case_id, count(*) as t, round(count(*) filter (matched) / count(*), 4) as r from {t} group by 1) {k} on {k}.case_id = c.case_id" for k, t in _SEC.items()),
)
_GATE = {
    "output_generated": "coalesce(l.n, 0) <> coalesce(a0.n, 0)",
    "score_meets_threshold": "a.score >= 0.7",
    "overall_score_not_regressed": "b.score - a.score <= 0",
    **{f"{k}_recall_not_regressed": f"a.{k}_recall >= b.{k}_recall" for k in _W},
    "critic_passed": "a.case_id % 10 <> 3",
}
cte(
    "gate_rows",
    "select a.case_id, b.score as v1_score, a.score as v2_score, " + ", ".join(f"{v} as {k}" for k, v in _GATE.items())
    + f" from after_eval a join evaluated b on b.case_id = a.case_id left join (select case_id, count(*) as n from ({LANE}) x group by 1) l on l.case_id = a.case_id left join (select case_id, count(*) as n from ({case_rows('actual_decisions')}) y group by 1) a0 on a0.case_id = a.case_id",
)
_FAILED = "concat_ws(', ', " + ", ".join(f"case when not {k} then '{k}' end" for k in _GATE) + ")"


@query("q06_no_regression_gate", oracle(f"select case_id, v1_score, v2_score, {_FAILED} as failed_checks, {' and '.join(_GATE)} as passed from gate_rows"))
def q06(spark, sf):
    before, after = _before_after(spark, sf)
    out = M.gate_checks(before, after)
    return out.select("case_id", "v1_score", "v2_score", F.array_join("failed_checks", ", ").alias("failed_checks"), "passed")


@query(
    "x30_report_markdown",
    oracle(
        f"""select 1 as part, case_id, '| ' || cast(case_id as varchar) || ' | ' || cast(v1_score as varchar) || ' | ' || cast(v2_score as varchar) || ' | ' || case when {' and '.join(_GATE)} then 'PASS' else 'FAIL' end || ' | ' || case when {_FAILED} = '' then '-' else {_FAILED} end || ' |' as line from gate_rows
        union all select 0, 0, '# Regression gate' union all select 0, 1, '- Cases: ' || cast(count(*) as varchar) from gate_rows union all select 0, 2, '- Result: ' || case when bool_and({' and '.join(_GATE)}) then 'PASS' else 'FAIL' end from gate_rows
        union all select 0, 3, '| Case | v1 score | v2 score | Result | Failed checks |'"""
    ),
)
def x30(spark, sf):
    before, after = _before_after(spark, sf)
    return N.report_lines(M.gate_checks(before, after), "Regression gate")


# ---- Q10 ---------------------------------------------------------------------------------------------------------------
Q10_RULES = (
    R.PhraseRule("risk", "Supplier portal delay may hold up the pilot lane", ("portal",), ("lane",)),
    R.PhraseRule("risk", "Order review delay may miss the pilot date", ("order file 1",), ()),
)


def readable_sql(x: str) -> str:
    return steps_sql(f"coalesce({x}, '')", G.READABILITY)


def ckey(x: str) -> str:
    return sq(f"regexp_replace(regexp_replace({norm_words_sql(x)}, '\\bplease\\b', '', 'g'), '\\bthe\\b', '', 'g')")


cte(
    "q10_text",
    f"select doc_id, lower({sq('t')}) as low, {wc('lower(' + sq('t') + ')')} as n from (select doc_id, "
    + "concat_ws(' ', " + ", ".join(readable_sql(x) for x in ("summary", "purpose", "outcome")) + ", "
    + ", ".join(f"(select coalesce(string_agg({readable_sql('s')}, ' ' order by ord), '') from (select unnest(string_split({x}, '|')) as s, generate_subscripts(string_split({x}, '|'), 1) as ord) z where s <> '')" for x in ("key_points", "decisions", "next_steps", "action_items"))
    + ") as t from records) u",
)
_rule_arms = " union all ".join(
    f"select doc_id, {i} as ord, '{r.output}' as s from q10_text where " + " and ".join(["true"] + [f"contains(low, '{t}')" for t in r.all_terms] + ([f"regexp_matches(low, {lit(L.any_text(r.any_terms))})"] if r.any_terms else []))
    for i, r in enumerate(Q10_RULES)
)
cte(
    "q10_risks",
    deduped(
        f"""select * from (select doc_id, ord, regexp_replace({readable_sql('s')}, '\\.+$', '') as s from (select * from ({list_rows('risks')}) w union all select doc_id, 1000 + ord, s from ({_rule_arms}) v) x) y
        where {norm_words_sql('s')} <> '' and not {key_like(norm_words_sql('s'), G.BAD_RISKS)} and {key_like(norm_words_sql('s'), G.RISK_SIGNALS)}""",
        ckey("s"), 5,
    ),
)
cte(
    "q10_decisions",
    deduped(f"select * from (select doc_id, ord, {strip_dots(readable_sql('s'))} as s from ({list_rows('decisions')}) w) x where s <> '' and not {key_like(norm_words_sql('s'), G.BAD_DECISIONS)}", norm_words_sql("s"), 1000000),
)
HINT = lit(r"\b([A-Z][a-zA-Z]+)\s+for\s+([^.;]+)$")
cte(
    "q10_hints",
    f"""select doc_id, row_number() over (partition by doc_id order by ord, b, w) as ord, owner, keyword from (select doc_id, ord, b, generate_subscripts(l, 1) as w, owner, {norm_words_sql('unnest(l)')} as keyword from (
      select doc_id, ord, b, regexp_extract(block, {HINT}, 1) as owner, string_split_regex(regexp_extract(block, {HINT}, 2), '\\s*,\\s*|\\s+and\\s+') as l from (
        select doc_id, ord, generate_subscripts(q, 1) as b, unnest(q) as block from (select doc_id, ord, string_split(regexp_replace(regexp_replace(regexp_replace(s, '\\.+$', ''), ',\\s+and\\s+([A-Z][a-zA-Z]+)\\s+for\\b', ', \\1 for', 'g'), ',\\s+([A-Z][a-zA-Z]+\\s+for\\b)', chr(10) || '\\1', 'g'), chr(10)) as q
          from (select doc_id, ord, {readable_sql('s')} as s from ({list_rows('key_points')}) w union all select doc_id, 1000 + ord, {readable_sql('s')} from ({list_rows('decisions')}) w union all select doc_id, 2000 + ord, {readable_sql('s')} from ({list_rows('next_steps')}) w) z where contains(lower(s), ' for ')) h0) h1) h2) h3 where keyword <> ''""",
)
_own = "coalesce(" + ", ".join(first_sql("s", p, 1) for p in G.OWNER_FORMS) + ")"
_tsk = "regexp_replace(coalesce(" + ", ".join(first_sql("s", p, 2) for p in G.OWNER_FORMS) + ", s), '(?i)^also\\s+', '')"
cte(
    "q10_found",
    f"""select doc_id, ord, own, {strip_dots('task')} as task from (select doc_id, ord, {_own} as own, {_tsk} as task from (select doc_id, ord, {readable_sql(readable_sql('s'))} as s from ({list_rows('action_items')}) w) a) b
    union all select * from (select doc_id, ord, own, regexp_replace(regexp_replace(task, '(?i)^(?:i will|we will|we should|please also|please)\\s+', ''), '^[ \\-.]+|[ \\-.]+$', '', 'g') as task from (select doc_id, ord, {_own} as own, {_tsk} as task from (select doc_id, ord, {readable_sql(readable_sql('s'))} as s from (
      select doc_id, 1001 as ord, summary as s from records union all select doc_id, 1002, purpose from records union all select doc_id, 1003, outcome from records union all select doc_id, 2000 + ord, s from ({list_rows('next_steps')}) w union all select doc_id, 3000 + ord, s from ({list_rows('key_points')}) w union all select doc_id, 4000 + ord, s from ({list_rows('decisions')}) w) t0 where {readable_sql('s')} <> '') c) d) e
      where length(task) >= 8 and not {key_like(norm_words_sql('task'), G.BAD_ACTIONS)} and {key_like(norm_words_sql('task'), G.ACTION_SIGNALS)}""",
)
cte(
    "q10_actions",
    deduped(
        f"""select f.doc_id, f.ord, {cap('f.task')} as s, case when lower(trim(coalesce(own, ''))) in ('team', 'unassigned', 'we', 'someone', 'everyone', '') then coalesce(h.owner, case when coalesce(own, '') <> '' then own else 'Team' end) else own end as owner from q10_found f
        left join (select f.doc_id, f.ord, arg_min(h.owner, h.ord) as owner from q10_found f join q10_hints h on h.doc_id = f.doc_id and contains({norm_words_sql('f.task')}, h.keyword) group by 1, 2) h on h.doc_id = f.doc_id and h.ord = f.ord
        where f.task <> '' and not {key_like(norm_words_sql('f.task'), G.BAD_ACTIONS)}""",
        ckey("s"), 1000000, "s, owner",
    ),
)


@query(
    "q10_consistency_pass",
    oracle(
        f"""select r.doc_id, coalesce(k.v, '') as risks, coalesce(d.v, '') as decisions, coalesce(a.v, '') as actions, coalesce(n.v, '') as next_steps from records r left join ({ordlist('q10_risks', 'pos')}) k on k.doc_id = r.doc_id left join ({ordlist('q10_decisions', 'pos')}) d on d.doc_id = r.doc_id
        left join ({ordlist('q10_actions', 'pos', "owner || '/' || s")}) a on a.doc_id = r.doc_id left join (select doc_id, string_agg(regexp_replace(s, '\\.+$', '') || '.', '|' order by pos) as v from q10_actions where pos <= 5 group by doc_id) n on n.doc_id = r.doc_id"""
    ),
)
def q10(spark, sf):
    out = G.consistency(_records(spark, sf), Q10_RULES)
    acts = F.transform("actions", lambda a: F.concat_ws("/", a["owner"], a["task"]))
    return out.select("doc_id", pipe(acts).alias("actions"), *[pipe(F.col(x)).alias(x) for x in ("risks", "decisions", "next_steps")])


# ---- Q11 ---------------------------------------------------------------------------------------------------------------
Q11_RULES = (
    R.PhraseRule("point", "The meeting reviewed order files and their owners.", ("order file",)),
    R.PhraseRule("point", "The supplier portal needs a clear check.", ("portal",)),
    R.PhraseRule("point", "Lane plans were part of the pilot talk.", ("lane", "pilot")),
)
MIN_CHARS = 900
TRIM = strip_dots(sq("s"))
cte("q11_long", f"select doc_id, length(coalesce(text, '')) >= {MIN_CHARS} or regexp_matches(lower(coalesce(text, '')), {lit(L.any_text(G.LONG_WORDS))}) as is_long from records")
cte(
    "q11_risks",
    f"""select doc_id, i as pos, m.s as s from (select doc_id, unnest(m0) as m, generate_subscripts(m0, 1) as i from (select doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(acc) >= 5 then acc when len(list_filter(acc, lambda e: {overlap_sql('y[1].tok', 'e.tok')} >= 0.7)) = 0 then list_concat(acc, y)
      else list_transform(acc, lambda e, i: case when i = list_position(list_transform(acc, lambda g: {overlap_sql('y[1].tok', 'g.tok')} >= 0.7), true) and length(y[1].s) > length(e.s) then y[1] else e end) end) as m0 from (
      select doc_id, list({{'s': s, 'tok': {token_list('s', '[a-z0-9]+', G.POLISH_STOP, 4)}}} order by ord) as l from (select doc_id, ord, {TRIM} as s from ({list_rows('risks')}) w) a where s <> '' group by doc_id) b) c) d""",
)
cte("q11_kept", f"select doc_id, row_number() over (partition by doc_id order by ord) as pos, s from (select doc_id, ord, {TRIM} as s from ({list_rows('key_points')}) w where ord <= 8) a where s <> ''")
cte("rule_low", f"select doc_id, lower({sq("coalesce(text, '')")}) as low from records")
_arms11 = " union all ".join(
    f"select doc_id, {i} as ord, '{r.output}' as s from rule_low where " + " and ".join(f"contains(low, '{t}')" for t in r.all_terms) for i, r in enumerate(Q11_RULES)
)
_COMP = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
cte(
    "q11_added",
    f"""select a.doc_id, row_number() over (partition by a.doc_id order by ord) as pos, a.s from ({_arms11}) a left join (select doc_id, list({_COMP.format('s')}) as ks from q11_kept group by 1) k on k.doc_id = a.doc_id where k.ks is null or not list_contains(k.ks, {_COMP.format('a.s')})""",
)
cte(
    "q11_points",
    "select doc_id, pos as ord, s from q11_kept union all select a.doc_id, 100 + a.pos, a.s from q11_added a left join (select doc_id, count(*) as n from q11_kept group by 1) k on k.doc_id = a.doc_id where a.pos <= greatest(0, 6 - coalesce(k.n, 0))",
)


@query(
    "q11_long_document_polish",
    oracle(
        f"""select r.doc_id, is_long, case when is_long then coalesce(k.v, '') else r.risks end as risks, case when is_long then coalesce(p.v, '') else r.key_points end as key_points from records r join q11_long g on g.doc_id = r.doc_id
        left join ({ordlist('q11_risks', 'pos')}) k on k.doc_id = r.doc_id left join ({ordlist('q11_points', 'ord')}) p on p.doc_id = r.doc_id"""
    ),
)
def q11(spark, sf):
    out = G.long_polish(_records(spark, sf), Q11_RULES, MIN_CHARS)
    return out.select("doc_id", "is_long", pipe(F.col("risks")).alias("risks"), pipe(F.col("key_points")).alias("key_points"))


# ---- Q12 ----------------------------------------------------------------------------------------------------------------
REWRITES = """select o_orderkey as doc_id,
    case when o_orderkey % 2 = 0 then concat('Lane ', cast(o_orderkey % 20 as varchar(20)), ' is ready.|The team keeps it open.|Ready for the pilot.|Thanks.', case when o_orderkey % 3 = 0 then '|Batch risk.' else '' end) else 'One line only.' end as key_points,
    case when o_orderkey % 4 = 1 then 'a|b|c' when o_orderkey % 5 = 0 then 'Keep the lane open|Use mail for support' else '' end as decisions,
    case when o_orderkey % 6 = 1 then 'Batch may slip|Portal may miss the check' else '' end as risks,
    case when o_orderkey % 3 = 0 then 'Too short.' else concat('The team reviewed order ', cast(o_orderkey as varchar(20)), ' and agreed on the next lane steps.') end as summary,
    case when o_orderkey % 2 = 0 then 'Review the order and the lane.' else '' end as purpose, 'ok' as outcome from {orders} where o_orderkey % 9 > 0"""
cte("rewrites", REWRITES.format(orders="orders"))


def _take(x: str) -> str:
    return f"case when w.doc_id is not null and {_n(f'r.{x}')} > 0 and {_n(f'w.{x}')} = {_n(f'r.{x}')} then w.{x} else r.{x} end"


def _within(x: str, lo: int, hi: int) -> str:
    t = sq(f"coalesce(w.{x}, '')")
    return f"case when length({t}) between {lo} and {hi} then {t} else r.{x} end"


cte("overlaid", f"select r.doc_id, {_take('key_points')} as key_points, {_take('decisions')} as decisions, {_take('risks')} as risks, {_within('summary', 40, 1800)} as summary, {_within('purpose', 12, 900)} as purpose, {_within('outcome', 12, 900)} as outcome from records r left join rewrites w on w.doc_id = r.doc_id")


@query(
    "q12_guarded_text_overlay",
    oracle(
        "select o.*, not (o.key_points = r.key_points and o.decisions = r.decisions and o.risks = r.risks and o.summary = r.summary and o.purpose = r.purpose and o.outcome = r.outcome) as changed from overlaid o join records r on r.doc_id = o.doc_id"
    ),
)
def q12(spark, sf):
    from colloquy.plans.records import as_list
    from colloquy.sources.standins import given

    new = spark.sql(REWRITES, orders=given(spark, sf, "orders"))
    new = new.withColumns({x: as_list(F.col(x)) for x in ("key_points", "decisions", "risks")})
    out = G.overlay(_records(spark, sf), new)
    return out.select("doc_id", "summary", "purpose", "outcome", "changed", *[pipe(F.col(x)).alias(x) for x in ("key_points", "decisions", "risks")])


# ---- Q13, Q14 ------------------------------------------------------------------------------------------------------------
V2T = lambda x: steps_sql(x, G.V2_ENDS)
cte("q13_points", deduped(f"select * from (select doc_id, ord, {V2T('s')} as s from ({list_rows('key_points')}) w) x where s <> '' and not regexp_matches(lower(s), {lit(L.starts(G.V2_POINT_LEAKS))})", spaced("s"), 1000000))
cte(
    "q13_decisions",
    deduped(
        f"select * from (select doc_id, ord, {V2T('s')} as s from ({list_rows('decisions')}) w) x where s <> '' and not regexp_matches(lower(s), '^(?:we should|i will)|^(?:we|i)\\s+(?:will|should)\\b.*\\b(?:remove|upload|clean|send|draft|check|request|escalate)\\b')",
        spaced("s"), 1000000,
    ),
)
cte(
    "q13_actions",
    deduped(
        f"select * from (select doc_id, ord, case when owner <> '' then owner else 'Team' end as owner, {V2T(f'regexp_replace({V2T('task')}, {lit(G.V2_TASK_CUT)}, {chr(39)}{chr(39)})')} as s from stored_lines) x where s <> '' and not regexp_matches(lower(s), {lit(L.starts(G.V2_LEAKS))})",
        spaced("s"), 1000000, "s, owner",
    ),
)


@query(
    "q13_v2_precision_cleanup",
    oracle(
        f"""select r.doc_id, coalesce(p.v, '') as key_points, coalesce(d.v, '') as decisions, coalesce(a.v, '') as actions from records r left join ({ordlist('q13_points', 'pos')}) p on p.doc_id = r.doc_id left join ({ordlist('q13_decisions', 'pos')}) d on d.doc_id = r.doc_id left join ({ordlist('q13_actions', 'pos', "owner || '/' || s")}) a on a.doc_id = r.doc_id"""
    ),
)
def q13(spark, sf):
    out = G.v2_cleanup(_records(spark, sf).withColumn("actions", _parsed()))
    acts = F.transform("actions", lambda a: F.concat_ws("/", a["owner"], a["task"]))
    return out.select("doc_id", pipe(acts).alias("actions"), pipe(F.col("key_points")).alias("key_points"), pipe(F.col("decisions")).alias("decisions"))


PK = sq(steps_sql(spaced("s"), C.PRECISION_DECISION_KEY))
_E = "^[ ,.;:\\-]+|[ ,.;:\\-]+$"
_DT = f"regexp_replace(regexp_replace(regexp_replace({sq('s')}, '{_E}', '', 'g'), '(?i)\\s+The meeting aligned on the main priorities and next steps\\.?$', ''), '{_E}', '', 'g')"
_ND = "(e.k = y[1].k or (length(y[1].k) >= 24 and contains(e.k, y[1].k)) or (length(e.k) >= 24 and contains(y[1].k, e.k)) or (len(e.tok) >= 5 and len(y[1].tok) >= 5 and len(list_intersect(e.tok, y[1].tok)) / greatest(len(e.tok), len(y[1].tok)) >= 0.78))"
Q14_IN = f"select doc_id, ord, s from ({list_rows('decisions')}) w union all select doc_id, 100 + pos, s from local_decisions"
cte(
    "q14_decisions",
    f"""select doc_id, i as pos, m.s as s from (select doc_id, unnest(m0) as m, generate_subscripts(m0, 1) as i from (select doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(acc) >= 5 or len(list_filter(acc, lambda e: {_ND})) > 0 then acc else list_concat(acc, y) end) as m0 from (
      select doc_id, list({{'s': s, 'k': k, 'tok': list_distinct(string_split(k, ' '))}} order by ord) as l from (select *, {PK} as k from (select doc_id, ord, {_DT} as s from ({Q14_IN}) a) b where s <> '') c where k <> '' group by doc_id) d) e0) f""",
)
TK = spaced(steps_sql("s", C.PRECISION_TASK_KEY))
cte(
    "q14_actions",
    f"""select doc_id, row_number() over (partition by doc_id order by o) as pos, case when fg and nown is not null then nown else fown end as owner, case when fg and nown is not null then ntask else ftask end as task from (
    select doc_id, k, min(ord) as o, arg_min(owner, ord) as fown, arg_min(s, ord) as ftask, arg_min(generic, ord) as fg, arg_min(owner, ord) filter (not generic) as nown, arg_min(s, ord) filter (not generic) as ntask from (
      select *, {TK} as k, {spaced('owner')} in ({", ".join(f"'{x}'" for x in G.GENERIC_TEAMS)}) as generic from (select doc_id, ord, case when owner <> '' then owner else 'Team' end as owner, {steps_sql('task', G.PRECISION_TASK)} as s from stored_lines) a where s <> '') b where k <> '' group by 1, 2) c qualify pos <= 7""",
)


@query(
    "q14_pilot_precision_cleanup",
    oracle(
        f"""select r.doc_id, coalesce(d.v, '') as decisions, coalesce(a.v, '') as actions, case when trim(r.outcome) = '' and d.v is not null then 'The team aligned on: ' || t.v || '.' else r.outcome end as outcome from records r left join ({ordlist('q14_decisions', 'pos')}) d on d.doc_id = r.doc_id
        left join (select doc_id, string_agg(regexp_replace(s, '\\.+$', ''), '; ' order by pos) as v from q14_decisions where pos <= 2 group by doc_id) t on t.doc_id = r.doc_id left join ({ordlist('q14_actions', 'pos', "owner || '/' || task")}) a on a.doc_id = r.doc_id"""
    ),
)
def q14(spark, sf):
    from colloquy.operators import points as P, sentences as S

    r = _records(spark, sf).withColumn("actions", _parsed())
    r = r.withColumn("decisions", F.concat("decisions", P.local_decisions(S.sentences_local(F.col("text")))))
    out = G.precision_cleanup(r)
    acts = F.transform("actions", lambda a: F.concat_ws("/", a["owner"], a["task"]))
    return out.select("doc_id", pipe(F.col("decisions")).alias("decisions"), pipe(acts).alias("actions"), "outcome")
