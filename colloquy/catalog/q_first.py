"""First-engine scores, picks, extractors and the whole engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_second import cap, ordlist, spaced
from colloquy.catalog.q_signals import deduped, first_sql, LOCAL_DUE, LOCAL_OWNER, steps_sql
from colloquy.catalog.q_text import (
    CHUNK_CHARS, _talk, clean_sentence_sql, edges, has, like_any, lit, overlap_sql, sq, stop_list, token_list, wc,
)
from colloquy.catalog.q_third import list_rows, pipe
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import rows
from colloquy.operators import points as P, sentences as S
from colloquy.plans import first as E
from colloquy.plans.records import notes_records
from colloquy.sources.standins import documents, standin


def low_has(x: str, pattern: str) -> str:
    return f"regexp_matches(lower({x}), {lit(pattern)})"


def pts(test: str, n: int) -> str:
    return f"case when {test} then {n} else 0 end"


def tokens_sql(x: str) -> str:
    return token_list(x, "[a-z0-9']+", L.POINT_STOP, 3)


# ---- F17, W08 --------------------------------------------------------------------------------
def score_cte(name: str, chunked: str) -> None:
    """Sentence scores of (doc_id, chunk, pos, s) rows."""
    cues = " + ".join(pts(low_has("s", p), 8) for p in L.LOCAL_CUES)
    cte(
        f"{name}_words",
        f"select doc_id, chunk, pos, w from (select doc_id, chunk, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9_-]+')) as w from {chunked}) t where length(w) > 2 and not list_contains({stop_list(L.LOCAL_STOP)}, w)",
    )
    cte(
        f"{name}_scored",
        f"""select c.doc_id, c.chunk, c.pos, c.s, cast(coalesce(f.v, 0) + {cues} + {pts(low_has('s', L.LOCAL_BY_DAY), 6)} + {pts("contains(s, ':')", 1)} + 2 as bigint) as score from {chunked} c left join (
        select a.doc_id, a.chunk, a.pos, sum(b.n) as v from {name}_words a join (select doc_id, chunk, w, count(*) as n from {name}_words group by all) b on a.doc_id = b.doc_id and a.chunk = b.chunk and a.w = b.w group by all) f
        on f.doc_id = c.doc_id and f.chunk = c.chunk and f.pos = c.pos""",
    )
    cte(
        f"{name}_ranked",
        f"select *, row_number() over (partition by doc_id, chunk order by score desc, pos) as rank from {name}_scored",
    )


score_cte("small", "talk_chunked")


def _ranked(limit):
    packed = S.budget_chunks(S.sentences_local(F.col("text")), CHUNK_CHARS)
    return P.ranked_in_chunks(packed, limit)


def _ranked_rows(spark, sf, limit):
    out = _talk(spark, sf).select("doc_id", F.explode_outer(_ranked(limit)).alias("r"))
    return out.filter(F.col("r").isNotNull()).select(
        "doc_id", "r.chunk", "r.rank", F.col("r.score").cast("long").alias("score"), F.col("r.s").alias("sentence")
    )


@query("f17_sentence_score", oracle("select doc_id, chunk, rank, score, s as sentence from small_ranked"))
def f17(spark, sf):
    return _ranked_rows(spark, sf, 2147483646)


@query("w08_top_k_per_group", oracle("select doc_id, chunk, rank, score, s as sentence from small_ranked where rank <= 5"))
def w08(spark, sf):
    return _ranked_rows(spark, sf, 5)


# ---- W11 ----------------------------------------------------------------------------------------
COMPACT = "regexp_replace(lower(s), '[^a-z0-9]+', '', 'g')"


def diverse_sql(source: str, limit: int) -> str:
    """(doc_id, ord, s) rows to the diverse pick, numbered by pos."""
    topics = "list_filter([" + ", ".join(
        f"case when {like_any('s', p)} then {i + 1} end" for i, p in enumerate(L.LOCAL_TOPICS.values())
    ) + "], lambda t: t is not null)"
    n = len(L.LOCAL_TOPICS)
    start = "[[0], " + ", ".join(f"[{i + 1}]" for i in range(n)) + "]"
    return f"""select doc_id, row_number() over (partition by doc_id order by k) as pos, s from (
      select doc_id, k, l[i].s as s from (select doc_id, l, unnest(o) as i, generate_subscripts(o, 1) as k from (
        select doc_id, l, list_concat(u, list_filter(list_transform(l, lambda x: x.i), lambda i: not list_contains(u, i))) as o from (
          select doc_id, l, list_filter(list_reduce({start}, lambda acc, y: case when len(list_filter(l, lambda x: list_contains(x.t, y[1]) and not list_contains(acc, x.i))) = 0 then acc
            else list_append(acc, list_filter(l, lambda x: list_contains(x.t, y[1]) and not list_contains(acc, x.i))[1].i) end), lambda i: i > 0) as u from (
            select doc_id, list({{'i': i, 's': s, 't': {topics}}} order by i) as l from (select doc_id, cast(pos as integer) as i, s from ({deduped(source, COMPACT, 1000000)}) d0) d1 group by doc_id) d2) d3) d4) d5 where k <= {limit}) d6"""


cte("small_points", "select doc_id, chunk * 100 + rank as ord, s from small_ranked where rank <= 5")
cte("small_diverse", diverse_sql("select * from small_points", 12))


@query("w11_topic_diverse_pick", oracle("select doc_id, pos, s as sentence from small_diverse"))
def w11(spark, sf):
    pick = P.diverse_points(F.transform(_ranked(5), lambda x: x["s"]), 12)
    return rows(_talk(spark, sf), pick, ["doc_id"], "sentence")


# ---- F18, F19, F20, F22 ----------------------------------------------------------------------------
TOPIC_SQL = "case " + " ".join(f"when {like_any('s', p)} then '{n}'" for n, p in L.TOPICS.items()) + " else 'general' end"
N_SQL = wc("s")


def point_score_sql() -> str:
    return f"""(case when n between 8 and 28 then 3 when n between 6 and 35 then 1 else -2 end + {pts("length(s) - length(replace(s, ',', '')) > 3", -2)} + {pts(low_has('s', L.any_text(L.NARRATIVE)), -1)} + {pts(like_any('s', L.OBJECTIVE), -5)}
      + {pts(low_has('s', r'\b(decide|plan|pilot|demo|summary|action items|landing page|outreach|runtime|timeout|risk)\b'), 2)} + case when topic in ('status', 'pilot', 'risk', 'decision') then 2 when topic in ('demo', 'quality') then 1 else 0 end
      + {pts("regexp_matches(s, '^(Team|[A-Z][a-z]+)\\s+(will|should|needs?\\s+to)\\b') and topic not in ('decision', 'risk')", -3)} + {pts(low_has('s', r'\baction item clean up\b|\bdeeper summarization tuning\b'), -2)})"""


def action_score_sql() -> str:
    return f"""({pts(like_any('s', L.COMMITMENTS), 2)} + {pts(low_has('s', L.any_text(L.TASK_VERBS)), 2)} + {pts(low_has('s', L.DEADLINE), 1)} + {pts("regexp_matches(lower(s), '^(i|we|team)\\b')", 1)}
      + {pts("regexp_matches(s, '^[A-Z][a-z]+\\s+(will|should|needs?\\s+to)\\b')", 3)} + {pts(low_has('s', L.any_text(L.NARRATIVE)), -3)} + {pts("regexp_matches(lower(s), '\\b(was|were|had|found|said|looked|remarked)\\b')", -1)} + {pts('n < 4 or n > 24', -1)})"""


AGENDA_SQL = f"({like_any('s', L.OBJECTIVE)} or {low_has('s', L.starts(P.AGENDA_STARTS))})"


def decision_score_sql() -> str:
    return f"""case when {AGENDA_SQL} then -5 else {pts(low_has('s', P.DECISION_MARK), 3)} + {pts(low_has('s', L.any_text(P.STRONG_HINTS)), 2)} + {pts(low_has('s', L.any_text(P.DECISION_TOPIC)), 1)} + {pts(low_has('s', P.WEAK_DECISION), -3)} + {pts('n < 5 or n > 26', -1)} end"""


def scored_cte(name: str, source: str) -> None:
    """Scores of (doc_id, pos, s) cleaned sentences."""
    cte(
        f"{name}_scores",
        f"select *, {point_score_sql()} as point_score, {action_score_sql()} as action_score, {decision_score_sql()} as decision_score from (select *, {N_SQL} as n, {TOPIC_SQL} as topic from {source}) t",
    )


scored_cte("clean", "clean_sents")
_SCORES = "select doc_id, pos, "


def _clean_rows(spark, sf):
    return rows(_talk(spark, sf), S.sentences_clean(F.col("text")), ["doc_id"], "s")


@query("f18_key_point_score", oracle(_SCORES + "topic, point_score from clean_scores"))
def f18(spark, sf):
    return _clean_rows(spark, sf).select(
        "doc_id", "pos", T.topic(F.col("s")).alias("topic"), T.key_point_score(F.col("s")).alias("point_score")
    )


@query("f19_action_score", oracle(_SCORES + "action_score, action_score >= 4 as keep from clean_scores"))
def f19(spark, sf):
    out = _clean_rows(spark, sf).select("doc_id", "pos", T.action_score(F.col("s")).alias("action_score"))
    return out.withColumn("keep", F.col("action_score") >= 4)


@query("f20_decision_score", oracle(_SCORES + "decision_score from clean_scores"))
def f20(spark, sf):
    return _clean_rows(spark, sf).select("doc_id", "pos", P.decision_score(F.col("s")).alias("decision_score"))


# ---- greedy folds --------------------------------------------------------------------------------------
def greedy_sql(source: str, fields: list[str], tokens: str, limit: int, stage: bool = False, threshold: float = 0.7) -> str:
    """Order-dependent similarity dedupe of rows with ``ord``; keeps ``fields`` in a struct m."""
    packed = ", ".join(f"'{f}': {f}" for f in fields) + f", 'tok': {tokens}" + (", 'stage': stage" if stage else "")
    alike = f"{overlap_sql('y[1].tok', 'e.tok')} >= {threshold}"
    staged = " or (y[1].stage <> 'fill' and len(list_filter(acc, lambda g: g.stage = y[1].stage)) > 0)" if stage else ""
    cols = ", ".join(f"m.{f} as {f}" for f in fields)
    return f"""select doc_id, row_number() over (partition by doc_id order by i) as pos, {cols} from (select doc_id, unnest(m0) as m, generate_subscripts(m0, 1) as i from (
      select doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(acc) >= {limit}{staged} or len(list_filter(acc, lambda e: {alike})) > 0 then acc else list_concat(acc, y) end) as m0 from (
        select doc_id, list({{{packed}}} order by ord) as l from ({source}) g0 group by doc_id) g1) g2) g3"""


cte("greedy_clean", greedy_sql("select doc_id, pos as ord, s from clean_sents", ["s"], tokens_sql("s"), 8))


@query("w10_greedy_similarity_dedupe", oracle("select doc_id, pos, s as sentence from greedy_clean"))
def w10(spark, sf):
    return rows(_talk(spark, sf), P.dedupe_texts(S.sentences_clean(F.col("text")), 8), ["doc_id"], "sentence")


def key_points_sql(scores: str, limit: int = 6) -> str:
    usable = f"select *, row_number() over (partition by doc_id order by point_score desc, pos) as rk from {scores} where n between 6 and 35 and not {like_any('s', L.OBJECTIVE)}"
    stages = " union all ".join(
        f"select doc_id, {i + 1} * 1000000 + rk as ord, s, '{t}' as stage from u where topic = '{t}'" for i, t in enumerate(L.TOPICS)
    )
    # the first dialect's unnamed stage holds the whole ranking
    src = f"with u as ({usable}) {stages} union all select doc_id, 100000000 + rk, s, 'fill' from u"
    return greedy_sql(src, ["s"], tokens_sql("s"), limit, stage=True)


cte("built_points", key_points_sql("clean_scores"))


@query("w11_scored_key_points", oracle("select doc_id, pos, s as sentence from built_points"))
def w11_scored(spark, sf):
    return rows(_talk(spark, sf), P.build_key_points(S.sentences_clean(F.col("text"))), ["doc_id"], "sentence")


def summary_sql(points: str) -> str:
    order = "case topic " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(L.SUMMARY_TOPIC_ORDER)) + " end"
    return f"""select doc_id, string_agg(c, ' ' order by rk) as summary from (
      select *, sum({wc('c')}) over (partition by doc_id order by rk) as used from (
        select doc_id, regexp_replace(s, '\\.+$', '') || '.' as c, row_number() over (partition by doc_id order by case when tr = 1 then {order} else 100 end, pos) as rk from (
          select *, row_number() over (partition by doc_id, topic order by pos) as tr from (select *, {TOPIC_SQL} as topic from ({points}) p0) p1) p2) p3 where rk <= 4) p4 where used <= 100 group by doc_id"""


@query("w15_word_budget_summary", oracle(summary_sql("select * from built_points")))
def w15(spark, sf):
    summary = P.build_summary(P.build_key_points(S.sentences_clean(F.col("text"))))
    made = rows(_talk(spark, sf), F.filter(F.array(summary), lambda s: s != ""), ["doc_id"], "summary")
    return made.drop("pos")


# ---- action lines and objects ---------------------------------------------------------------------------
PT_DUE = first_sql("s", "(?i)" + L.DEADLINE)


def action_lines_sql(scores: str, limit: int = 7) -> str:
    lead = "(?i)^(let''s|we should|we need to|we will|we''ll|i will|i''ll|please)\\s+"
    body = f"""select doc_id, pos as ord, trim(coalesce(owner || ' - ', '') || regexp_replace(lower(left(t2, 1)) || substr(t2, 2), '[. ]+$', '') || coalesce(' (due: ' || due || ')', '')) as s from (
      select *, case when due is not null then regexp_replace(regexp_replace(t1, '(?i)' || regexp_escape(due), '', 'g'), '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g') else t1 end as t2 from (
        select doc_id, pos, {PT_DUE} as due, trim(regexp_replace(s, '{lead}', '')) as t1, case when regexp_matches(lower(s), '^i\\b') then 'Speaker' when regexp_matches(lower(s), '^(we|team|let''s)\\b') then 'Team' end as owner from {scores} where action_score >= 4) a0) a1"""
    return greedy_sql(body, ["s"], tokens_sql("s"), limit)


cte("talk_lines_kept", action_lines_sql("clean_scores"))


T_LINE = r"^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$"


@query(
    "f24_action_line_codec",
    oracle(
        f"""select doc_id, pos, s as line, {first_sql('s', T_LINE, 1)} as owner, trim(regexp_extract(s, {lit(T_LINE)}, 2)) as task, {first_sql('s', T_LINE, 3)} as due from talk_lines_kept"""
    ),
)
def f24(spark, sf):
    out = rows(_talk(spark, sf), P.action_lines(S.sentences_clean(F.col("text"))), ["doc_id"], "line")
    out = out.withColumn("p", T.parse_action_line(F.col("line")))
    return out.select("doc_id", "pos", "line", "p.owner", "p.task", "p.due")


def line_confidence_sql(x: str) -> str:
    return f"({pts(f'regexp_matches({x}, {lit(L.STRONG_ACTION)})', 2)} + {pts(f"regexp_matches({x}, '^(team|speaker|[A-Z][a-z]+)\\s*-\\s*')", 1)} + {pts(low_has(x, L.DEADLINE), 1)} + {pts(low_has(x, L.WEAK_ACTION), -2)} + {pts(f'{wc(x)} < 4 or {wc(x)} > 26', -1)})"


def clean_one_sql(x: str) -> str:
    c = clean_sentence_sql(x)
    return f"case when regexp_matches({c}, '^[a-z]') then {cap(c)} else {c} end"


def objects_sql(lines: str, limit: int = 7) -> str:
    agenda = AGENDA_SQL.replace("lower(s)", "lower(task)")
    src = f"""select *, (greatest(0e0, least(1e0, 0.45e0 + 0.1e0 * score)) - case when owner in ('Unassigned', 'Speaker') then 0.15e0 else 0e0 end - case when due is null then 0.05e0 else 0e0 end) as confidence,
      case when due is not null or regexp_matches(lower(task), 'urgent|asap|finalize|launch|deliver|publish') then 'high' else 'medium' end as priority from (
      select doc_id, ord, score, due, case when owner in ('Unassigned', 'Speaker') and lower(t) like 'team %' then 'Team' else owner end as owner,
        case when (owner = 'Team' or owner in ('Unassigned', 'Speaker')) and lower(t) like 'team %' then trim(substr(t, 5)) else t end as task from (
        select doc_id, ord, score, owner, case when d <> '' and not regexp_matches(d, {lit(P.BAD_DUE)}) and {wc('d')} <= 5 then d end as due, {cap(steps_sql(clean_one_sql("regexp_replace(rest, '(?i)\\s*\\(due:\\s*([^)]+)\\)$', '')"), C.POINT_TASK))} as t from (
          select *, regexp_replace(regexp_extract(rest, '(?i)\\(due:\\s*([^)]+)\\)$', 1), '^[ .,\\-]+|[ .,\\-]+$', '', 'g') as d from (
            select doc_id, pos as ord, {line_confidence_sql('s')} as score, case when contains(s, ' - ') then case when trim(split_part(s, ' - ', 1)) = '' then 'Unassigned' else trim(split_part(s, ' - ', 1)) end else 'Unassigned' end as owner,
              trim(case when contains(s, ' - ') then regexp_replace(s, '^.*? - ', '') else s end) as rest from {lines}) o0) o1) o2) o3"""
    good = f"select * from ({src}) o4 where confidence >= 0.6e0 and task <> '' and not {agenda} and not {has('task', P.BAD_TASK)} and {wc('task')} between 4 and 18"
    return greedy_sql(good, ["owner", "task", "due", "priority", "confidence"], tokens_sql("concat_ws(' | ', owner, task, coalesce(due, ''))"), limit)


cte("talk_objects", objects_sql("talk_lines_kept"))
_OBJ = "select doc_id, pos, owner, task, due, round(confidence, 2) as confidence"


@query("f21_confidence", oracle(_OBJ + " from talk_objects"))
def f21(spark, sf):
    out = rows(_talk(spark, sf), P.action_objects(P.action_lines(S.sentences_clean(F.col("text")))), ["doc_id"], "o")
    return out.select("doc_id", "pos", "o.owner", "o.task", "o.due", F.round("o.confidence", 2).alias("confidence"))


@query("f22_priority", oracle("select doc_id, pos, task, due, priority from talk_objects"))
def f22(spark, sf):
    out = rows(_talk(spark, sf), P.action_objects(P.action_lines(S.sentences_clean(F.col("text")))), ["doc_id"], "o")
    return out.select("doc_id", "pos", "o.task", "o.due", "o.priority")


def decisions_built_sql(scores: str, limit: int = 5) -> str:
    tail = steps_sql(clean_one_sql("s"), C.DECISION_POINT)
    d = f"regexp_replace({tail}, '^[ .]+|[ .]+$', '', 'g')"
    src = f"""select doc_id, pos as ord, regexp_replace(case when d = '' then '' else d || '.' end, '(?i)^Team will keep\\s+', '') as s from (select doc_id, pos, {d} as d from {scores} where not {AGENDA_SQL} and not {low_has('s', P.WEAK_DECISION)}
      and ({low_has('s', P.DECISION_MARK)} or {low_has('s', L.any_text(P.STRONG_HINTS))}) and decision_score >= 2) x"""
    kept = greedy_sql(f"select * from ({src}) y where s <> ''", ["s"], tokens_sql("s"), limit)
    return f"select doc_id, row_number() over (partition by doc_id order by pos) as pos, s, confidence from (select doc_id, pos, s, round(greatest(0e0, least(1e0, 0.5e0 + 0.1e0 * ({decision_score_sql()}))), 2) as confidence from (select *, {N_SQL} as n from ({kept}) k0) k1) k2 where confidence >= 0.7e0"


cte("talk_built_decisions", decisions_built_sql("clean_scores"))


@query("f20_built_decisions", oracle("select doc_id, pos, s as text, confidence from talk_built_decisions"))
def f20_built(spark, sf):
    out = rows(_talk(spark, sf), P.build_decisions(S.sentences_clean(F.col("text"))), ["doc_id"], "d")
    return out.select("doc_id", "pos", "d.text", "d.confidence")


# ---- X19, X20 ------------------------------------------------------------------------------------------------
def local_actions_sql(source: str, limit: int = 8) -> str:
    toks = "regexp_extract_all(lower(s), '[a-z0-9_-]+')"
    acting = f"not {low_has('trim(s)', L.starts(P.LOCAL_WEAK_STARTS))} and ({like_any('s', P.LOCAL_STRONG)} or (list_has_any({toks}, {stop_list(P.LOCAL_VERBS)}) and list_has_any({toks}, ['we', 'i', 'team'])))"
    task = steps_sql(steps_sql("s", C.LOCAL_TASK), C.LOCAL_SENTENCE)
    conf = f"""round(least(0.95e0, 0.35e0 + case when owner is not null then 0.25e0 else 0e0 end + case when due is not null then 0.2e0 else 0e0 end + case when regexp_matches(lower(raw), '\\b(action item|action items|next step|next steps|follow up)\\b') then 0.2e0 else 0e0 end
      + case when regexp_matches(lower(raw), '\\bwill\\b|\\bshould\\b|\\bneeds to\\b|\\bneed to\\b') then 0.1e0 else 0e0 end + 0.05e0), 2)"""
    src = f"select doc_id, row_number() over (partition by doc_id order by confidence desc, pos) as ord, owner, task as s, due, confidence from (select *, {conf} as confidence from (select doc_id, pos, s as raw, {LOCAL_OWNER} as owner, {LOCAL_DUE} as due, {task} as task from {source} where {acting}) l0) l1 where not {low_has('task', "the main purpose|i'd like us to leave this meeting|identify decisions and action items")}"
    return deduped(src, f"'k' || {COMPACT}", limit, "owner, s as task, due, confidence")


cte("local_actions", local_actions_sql("local_sents"))


@query("x19_local_actions", oracle("select doc_id, pos, owner, task, due, confidence from local_actions"))
def x19(spark, sf):
    out = rows(_talk(spark, sf), P.local_actions(S.sentences_local(F.col("text"))), ["doc_id"], "a")
    return out.select("doc_id", "pos", "a.owner", "a.task", "a.due", "a.confidence")


def local_decisions_sql(source: str) -> str:
    return deduped(
        f"select doc_id, pos as ord, {steps_sql('s', C.LOCAL_SENTENCE)} as s from {source} where {has('s', P.LOCAL_DECISION)} and not {has('s', P.LOCAL_NO_DECISION)}",
        COMPACT, 5,
    )


def local_risks_sql(source: str) -> str:
    filler = f"({has('s', P.RISK_AGENDA)} or regexp_matches(lower(s), '\\bsection reviewed\\b|\\breviewed upload reliability\\b'))"
    return deduped(
        f"select doc_id, pos as ord, {steps_sql('s', C.LOCAL_SENTENCE)} as s from {source} where not ({filler} and not {low_has('s', P.RISK_LANGUAGE)}) and ({has('s', P.LOCAL_RISK_TEXT)} or {like_any('s', P.LOCAL_RISK)})",
        COMPACT, 5,
    )


cte("local_decisions", local_decisions_sql("local_sents"))
cte("local_risks", local_risks_sql("local_sents"))


@query(
    "x20_local_decisions_risks",
    oracle("select doc_id, 'decision' as kind, pos, s as text from local_decisions union all select doc_id, 'risk', pos, s from local_risks"),
)
def x20(spark, sf):
    from colloquy.operators.signals import kind_rows

    sents = S.sentences_local(F.col("text"))
    wrap = lambda a: F.transform(a, lambda s: F.struct(s.alias("text")))
    return kind_rows(_talk(spark, sf), ["doc_id"], {"decision": wrap(P.local_decisions(sents)), "risk": wrap(P.local_risks(sents))})


# ---- publishable text -----------------------------------------------------------------------------------------
def slot_text_sql(x: str, max_chars: int) -> str:
    t = f"regexp_replace(trim({steps_sql(x, C.LOCAL_SENTENCE)}), '\\.+$', '')"
    return f"""case when {t} <> '' and not (length({sq(t)}) > {max_chars} or regexp_matches(lower({t}), 'speaker one|speaker two|decision one|decision two') or length({t}) - length(replace({t}, ',', '')) > 7 or length({t}) - length(replace({t}, ';', '')) > 3)
      and not regexp_matches(lower({t}), '^(speaker one|speaker two|key outcomes: speaker)') and {wc(t)} >= 5 then {t} else '' end"""


def publishable_points_sql(source: str, limit: int) -> str:
    """(doc_id, ord, s) rows."""
    return deduped(
        f"select * from (select doc_id, ord, {steps_sql('s', C.LOCAL_SENTENCE)} as s from ({source}) z0) z1 where s <> '' and not {low_has('s', L.starts(P.POINT_STARTS))} and not regexp_matches(lower(s), 'good morning everyone|thanks for joining') and {wc('s')} >= 5",
        "regexp_replace(lower(s), '\\.+$', '')", limit,
    )


cte("shown_points", publishable_points_sql(list_rows("key_points"), 8))


@query("x28_key_point_candidates", oracle("select doc_id, pos, s as key_point from shown_points"))
def x28(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    return rows(r, P.publishable_points(F.col("key_points"), 8), ["doc_id"], "key_point")


def outcome_sql(decisions: str, points: str, base: str) -> str:
    """``base`` has doc_id, purpose, found; the others are (doc_id, ord, s) sources."""
    made = deduped(f"select doc_id, ord, regexp_replace(trim({steps_sql('s', C.LOCAL_SENTENCE)}), '\\.+$', '') as s from ({decisions}) o0", COMPACT, 3)
    comp = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
    o, p = comp.format("found"), comp.format("purpose")
    bad = f"(trim(found) = '' or lower(trim(found)) like 'the meeting resulted in%' or {o} = {p} or (purpose <> '' and contains({o}, {p})))"
    return f"""select b.doc_id, case when not {bad} then regexp_replace(trim(found), '\\.+$', '') when d.v is not null then 'Key outcomes: ' || d.v when k.v is not null then 'Key outcomes: ' || k.v else '' end as outcome from ({base}) b
      left join (select doc_id, string_agg(s, '; ' order by pos) as v from ({made}) o1 group by doc_id) d on d.doc_id = b.doc_id
      left join (select doc_id, string_agg(s, '; ' order by ord) as v from (select x.doc_id, x.ord, regexp_replace(trim(x.s), '\\.+$', '') as s, row_number() over (partition by x.doc_id order by x.ord) as rn from ({points}) x join ({base}) y on y.doc_id = x.doc_id
        where {comp.format("regexp_replace(trim(x.s), '\\.+$', '')")} <> {comp.format('y.purpose')}) o2 where rn <= 2 group by doc_id) k on k.doc_id = b.doc_id"""


X29_BASE = "select doc_id, purpose, outcome as found from records"
cte("x29_outcome", outcome_sql(list_rows("decisions"), list_rows("key_points"), X29_BASE))


def alike_sql(a: str, b: str) -> str:
    ta, tb = (token_list(x, "[a-z0-9]+", L.LOCAL_STOP, 4) for x in (a, b))
    return f"{overlap_sql(ta, tb)} >= 0.65"


@query(
    "x29_outcome_from_items",
    oracle(
        f"""select r.doc_id, case when {slot_text_sql('o.outcome', 260)} = '' or {alike_sql('o.outcome', 'r.purpose')} then case when d.v is null then '{P.OUTCOME_DEFAULT}' else 'The team aligned on the main decisions: ' || d.v || '.' end else {slot_text_sql('o.outcome', 260)} end as outcome
        from records r join x29_outcome o on o.doc_id = r.doc_id left join (select doc_id, string_agg(regexp_replace(s, '\\.+$', ''), '; ' order by ord) as v from ({list_rows('decisions')}) l where ord <= 2 group by doc_id) d on d.doc_id = r.doc_id"""
    ),
)
def x29(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    made = P.slot_text(
        P.compose_outcome(F.col("decisions"), F.col("key_points"), F.col("purpose"), F.col("outcome")), 260
    )
    out = r.withColumn("o", made)
    weak = (F.col("o") == "") | P.slots_alike(F.col("o"), F.col("purpose"))
    return out.select(
        "doc_id", F.when(weak, P.outcome_from_decisions(F.col("decisions"))).otherwise(F.col("o")).alias("outcome")
    )


def risk_fold_sql(source: str, limit: int = 3) -> str:
    """(doc_id, ord, s) rows to the publishable risks."""
    t0 = slot_text_sql("s", 260)
    t = f"regexp_replace({sq(f"regexp_replace(regexp_replace({t0}, '\\s+,', ',', 'g'), ',\\s+or\\s+', ' or ', 'g')")}, '^[ .]+|[ .]+$', '', 'g')"
    spec = ("too early", "because", "if ", "unless", "timeout", "memory", "transcript", "expectation", "quality", "support")
    stop = L.LOCAL_STOP + ("there", "that", "with", "from", "this", "could", "would", "might", "early")
    rank = " + ".join(pts(f"contains(lower(s), '{p}')", 1) for p in spec)
    alike = f"{overlap_sql('y[1].tok', '{0}.tok')} >= 0.7"
    return f"""select doc_id, row_number() over (partition by doc_id order by i) as pos, m.s as s from (select doc_id, unnest(m0) as m, generate_subscripts(m0, 1) as i from (
      select doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: case when len(acc) >= {limit} then acc when len(list_filter(acc, lambda e: {alike.format('e')})) = 0 then list_concat(acc, y)
        else list_transform(acc, lambda e, i: case when i = list_position(list_transform(acc, lambda g: {alike.format('g')}), true) and (y[1].rank > e.rank or (y[1].rank = e.rank and y[1].len > e.len)) then y[1] else e end) end) as m0 from (
        select doc_id, list({{'s': s, 'tok': {token_list('s', '[a-z0-9]+', stop, 4)}, 'rank': {rank}, 'len': length(s)}} order by ord) as l from (select doc_id, ord, {t} as s from ({source}) r0) r1 where s <> '' group by doc_id) r2) r3) r4"""


cte("risk_fold", risk_fold_sql("select doc_id, pos as ord, s from local_risks"))


@query("w10_risk_dedupe", oracle("select doc_id, pos, s as risk from risk_fold"))
def w10_risk(spark, sf):
    return rows(_talk(spark, sf), P.publishable_risks(P.local_risks(S.sentences_local(F.col("text")))), ["doc_id"], "risk")


def steps_pick_sql(source: str, limit: str) -> str:
    """(doc_id, ord, s) tasks to next steps."""
    t = f"regexp_replace({sq(f"regexp_replace({steps_sql('s', C.LOCAL_SENTENCE)}, '^\\s*[-*•]+\\s*', '')")}, '^[ ,;:\\-]+|[ ,;:\\-]+$', '', 'g')"
    ends = ", ".join(f"'{w}'" for w in P.NEXT_BAD_ENDS)
    ok = f"""s <> '' and not regexp_matches(lower(s), '^\\s*speaker(\\s+\\w+)?\\b') and not regexp_matches(s, '^\\s*[A-Z][a-z]+:\\s*') and not {low_has('s', L.starts(P.NEXT_BAD_STARTS))} and not contains(s, '...') and {wc('s')} between 4 and 18
      and string_split(lower(s), ' ')[-1] not in ({ends}) and {low_has('s', L.starts(P.NEXT_VERBS))}"""
    return f"select doc_id, pos, {cap("regexp_replace(s, '\\.+$', '')")} || '.' as s from ({deduped(f'select * from (select doc_id, ord, {t} as s from ({source}) n0) n1 where {ok}', spaced('s'), 1000000)}) n2 where pos <= {limit}"


cte("local_steps", steps_pick_sql("select doc_id, pos as ord, task as s from local_actions", "3"))


@query("l05_publishable_next_steps", oracle("select doc_id, pos, s as step from local_steps"))
def l05_publishable(spark, sf):
    acts = P.local_actions(S.sentences_local(F.col("text")))
    return rows(_talk(spark, sf), P.steps_from_actions(F.transform(acts, lambda a: a["task"])), ["doc_id"], "step")


# ---- W16, W20 ------------------------------------------------------------------------------------------------------
DOC_N = "len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''))"


@query(
    "w16_adaptive_limit",
    oracle(
        f"select doc_id, n as words, case when n >= 15000 then 20 when n >= 7500 then 15 when n >= 3500 then 12 else 8 end as action_limit, case when n >= 15000 then 8 when n >= 7500 then 6 when n >= 3500 then 5 else 3 end as step_limit from (select doc_id, {DOC_N} as n from documents) t"
    ),
)
def w16(spark, sf):
    out = documents(spark, sf).select("doc_id", F.size(T.words(F.col("text"))).alias("words"))
    return out.withColumn("action_limit", P.action_limit(F.col("words"))).withColumn("step_limit", P.step_limit(F.col("words")))


@query(
    "w20_long_document_gate",
    oracle(
        "select doc_id, max(chunk) as chunks, sum(length(s)) as characters, max(chunk) >= 5 or sum(length(s)) >= 9000 as is_long from doc_chunked group by 1"
    ),
)
def w20(spark, sf):
    """The gate with limits that fit the given documents; the defaults are 40 and 75 000."""
    out = documents(spark, sf).select("doc_id", S.sentences_local(F.col("text")).alias("sents"))
    out = out.withColumn("packed", S.budget_chunks(F.col("sents")))
    out = out.select(
        "doc_id",
        F.array_max(F.transform("packed", lambda c: c["chunk"])).alias("chunks"),
        F.aggregate("sents", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)).alias("characters"),
        P.is_long(F.col("packed"), F.col("sents"), 5, 9000).alias("is_long"),
    )
    return out.dropna(subset=["chunks"])


# ---- Q07 -------------------------------------------------------------------------------------------------------------
cte(
    "q7_fold",
    """select doc_id, list_reduce(list_prepend([0, 0, 0], list_transform(lens, lambda x: [x, 0, 0])), lambda acc, x:
      case when acc[3] = 0 or acc[1] + x[1] <= 1800 then list_concat([acc[1] + x[1], acc[2], acc[3] + 1], list_concat(acc[4:], [acc[2]]))
           else list_concat([x[1], acc[2] + 1, acc[3] + 1], list_concat(acc[4:], [acc[2] + 1])) end) as f
    from (select doc_id, list(length(s) order by pos) as lens from local_sents group by doc_id) t""",
)
cte("q7_chunked", "select s.doc_id, s.pos, s.s, f[3 + s.pos] + 1 as chunk from local_sents s join q7_fold d on d.doc_id = s.doc_id")
score_cte("q7", "q7_chunked")
cte("q7_selected", diverse_sql("select doc_id, chunk * 100 + rank as ord, s from q7_ranked where rank <= 5", 12))
cte("q7_clean", f"select doc_id, pos, s from (select doc_id, pos, {clean_one_sql('s')} as s from q7_selected) t where s <> ''")
scored_cte("q7_clean", "q7_clean")
cte("q7_built", key_points_sql("q7_clean_scores"))
cte("q7_second", diverse_sql("select doc_id, pos as ord, s from q7_built union all select doc_id, 100 + pos, s from q7_selected", 12))
cte("q7_points", publishable_points_sql("select doc_id, pos as ord, s from q7_second where lower(s) not like 'by the end of the meeting%'", 8))
cte("q7_lines", action_lines_sql("q7_clean_scores"))
cte("q7_objects", objects_sql("q7_lines"))
cte("q7_built_decisions", decisions_built_sql("q7_clean_scores"))


def merged_local(a: str, b: str, limit: int) -> str:
    return deduped(
        f"select doc_id, ord, {steps_sql('s', C.LOCAL_SENTENCE)} as s from (select doc_id, pos as ord, s from {a} union all select doc_id, 1000 + pos, s from {b}) w", COMPACT, limit
    )


cte("q7_decisions", merged_local("q7_built_decisions", "local_decisions", 5))
cte(
    "q7_slot_risks",
    greedy_sql(f"select doc_id, pos as ord, regexp_replace(s, '\\.+$', '') || '.' as s from q7_clean where {has('s', P.RISK_WORDS)} and not {AGENDA_SQL}", ["s"], tokens_sql("s"), 3),
)
cte("q7_raw_risks", merged_local("q7_slot_risks", "local_risks", 8))
cte("q7_risks", risk_fold_sql("select doc_id, pos as ord, s from q7_raw_risks"))
cte(
    "q7_purpose",
    f"""select t.doc_id, coalesce(nullif({slot_text_sql('p.s', 220)}, ''), '{P.PURPOSE_DEFAULT}') as purpose, '' as found from transcripts t left join (select doc_id, arg_min(s, pos) as s from local_sents
    where regexp_matches(lower(s), '\\bmeeting focused on\\b|\\bthe goal is\\b|\\btoday we need to\\b|\\bpurpose of this meeting\\b') group by doc_id) p on p.doc_id = t.doc_id""",
)
cte("q7_outcome", outcome_sql("select doc_id, pos as ord, s from q7_decisions", "select doc_id, pos as ord, s from q7_points", "select doc_id, purpose, found from q7_purpose"))
