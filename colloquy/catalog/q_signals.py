"""Cue signals, chunk actions and slot notes with their merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_text import (
    _talk, cleaned, edges, has, lit, overlap_sql, sorted_key, sq, stop_list, stripped, wc,
)
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import keep_first, rows
from colloquy.operators import sentences as S, signals as X


def steps_sql(x: str, steps) -> str:
    for pattern, replacement in steps:
        r = replacement.replace("$", "\\").replace("'", "''")
        x = f"regexp_replace({x}, {lit(pattern)}, '{r}', 'g')"
    return x


def first_sql(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, {lit(pattern)}, {group}), '')"


# ---- X02 ---------------------------------------------------------------------------------
def deduped(source: str, key: str, limit: int, cols: str = "s", group: str = "doc_id") -> str:
    """First row per (group, key) in order of ``ord``, numbered, capped at ``limit``."""
    return f"""select {group}, row_number() over (partition by {group} order by ord) as pos, {cols} from (
      select *, row_number() over (partition by {group}, k order by ord) as rn from (select *, {key} as k from ({source}) a) b where k <> '') c where rn = 1
      qualify pos <= {limit}"""


def cue_decisions_sql(cues=L.SIGNAL_DECISION) -> str:
    hits = f"select doc_id, pos as ord, {steps_sql('s', C.SIGNAL_DECISION)} as s from signal_sents where {has('s', cues)}"
    return deduped(hits, sorted_key("s"), 14)


def cue_risks_sql(cues=L.SIGNAL_RISK, none=L.SIGNAL_NO_RISK) -> str:
    hits = f"select doc_id, pos as ord, {steps_sql('s', C.SIGNAL_RISK)} as s from signal_sents where {has('s', cues)}"
    return deduped(hits + (f" and not {has('s', none)}" if none else ""), sorted_key("s"), 16)


_NAME = first_sql("s", L.SIGNAL_NAME, 1)


def cue_actions_sql(cues=L.SIGNAL_ACTION) -> str:
    return deduped(
        f"""select * from (select doc_id, pos as ord, s as raw, {edges('s', '[ \\-•\\t]+')} as s, case when lower({_NAME}) not in ({", ".join(f"'{n}'" for n in L.SIGNAL_NOT_NAMES)}) then {_NAME} end as owner,
        {first_sql('s', '(?i)' + L.SIGNAL_DATE)} as deadline from signal_sents where {has('s', cues)}) z where owner is not null or contains(lower(raw), 'action')""",
        sorted_key("concat_ws(' ', owner, s)"),
        14,
        "s, owner, deadline",
    )


cte("cue_decisions", cue_decisions_sql())
cte("cue_risks", cue_risks_sql())
cte("cue_actions", cue_actions_sql())
CUE_SQL = """select doc_id, 'decision' as kind, pos, s as text, cast(null as varchar) as owner, cast(null as varchar) as deadline from cue_decisions
    union all select doc_id, 'action', pos, s, owner, deadline from cue_actions union all select doc_id, 'risk', pos, s, null, null from cue_risks"""


@query("x02_cue_signals", oracle(CUE_SQL))
def x02(spark, sf):
    return X.cue_signals(_talk(spark, sf))


# ---- F08, F10 dialects -------------------------------------------------------------------
def _ordered(x: str, patterns) -> str:
    return "coalesce(" + ", ".join(first_sql(x, f"(?i){p}") for p in patterns) + ")"


CHUNK_DUE = f"coalesce(trim({_ordered('s', L.CHUNK_DEADLINES)}), 'No deadline stated')"
V3_DUE_PATTERNS = (
    r"(?i)\bby\s+([A-Z][A-Za-z]+|\w+day|tomorrow|today|next week|end of week)\b",
    r"(?i)\bbefore\s+([A-Z][A-Za-z]+|\w+day|launch|demo|next week)\b",
)


def v3_due(x: str) -> str:
    return f"""coalesce({first_sql(cleaned(x), V3_DUE_PATTERNS[0])}, {first_sql(cleaned(x), V3_DUE_PATTERNS[1])},
    case when regexp_matches(lower({x}), '\\btoday\\b') then 'today' when regexp_matches(lower({x}), '\\btomorrow\\b') then 'tomorrow'
    when regexp_matches(lower({cleaned(x)}), '\\bnext week\\b') then 'next week' when contains(lower({x}), 'today') then 'today' end, 'Not specified')"""


LOCAL_DUE = f"""coalesce({first_sql('s', '(?i)\\bby\\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\b', 1)},
    {first_sql('s', '(?i)\\b(tomorrow|next week|next month|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\b', 1)})"""


@query(
    "f08_deadline_extract",
    oracle(
        f"""select doc_id, pos, {CHUNK_DUE} as chunk_due, {v3_due('s')} as v3_due, {_ordered('s', L.SLOT_DUE)} as slot_due, {LOCAL_DUE} as local_due, {first_sql('s', '(?i)' + L.DEADLINE)} as point_due from statement_sents"""
    ),
)
def f08(spark, sf):
    s = F.col("s")
    return rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s").select(
        "doc_id",
        "pos",
        T.deadline_chunk(s).alias("chunk_due"),
        T.deadline_v3(s).alias("v3_due"),
        T.deadline_slot(s).alias("slot_due"),
        T.deadline_local(s).alias("local_due"),
        T.deadline_point(s).alias("point_due"),
    )


SP_CHUNK = T.SPEAKER_CHUNK
NAMED = r"(?i)\b([A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)?|Speaker\s+[A-Z])\s+(will|should|needs to|need to|must|has to|have to|can)\s+(.+)"
FIRST = r"(?i)\b(?:i will|i'll|i can|i should)\s+(.+)"
NOBODY = r"(?i)\b(?:we need to|we should|need to|needs to|action item:?|follow up to)\s+(.+)"


def owner_action_from(source: str, extra: str = "") -> str:
    generic = ", ".join(f"'{g}'" for g in L.GENERIC_SUBJECTS)
    return f"""select {extra} doc_id, pos, s, case when f1 <> '' then sb when task <> '' then case when lower(name) in ({generic}) then 'Unassigned' else name end when nb <> '' then 'Unassigned' else sb end as owner,
    regexp_replace({sq("case when f1 <> '' then f1 when task <> '' then task when nb <> '' then nb else body end")}, '[ .;]+$', '') as action from (
      select *, case when sp <> '' then sp else 'Unassigned' end as sb, regexp_extract(body, {lit(FIRST)}, 1) as f1, trim(regexp_extract(body, {lit(NAMED)}, 1)) as name,
        regexp_extract(body, {lit(NAMED)}, 3) as task, regexp_extract(body, {lit(NOBODY)}, 1) as nb from (
          select *, trim(regexp_extract(s, {lit(SP_CHUNK)}, 1)) as sp, trim(case when regexp_extract(s, {lit(SP_CHUNK)}, 1) <> '' then regexp_extract(s, {lit(SP_CHUNK)}, 2) else s end) as body from ({source}) a) b) c"""


SLOT_OWNER = "coalesce(" + ", ".join(first_sql("s", p, 1) for p in L.SLOT_OWNERS) + ")"
LOCAL_OWNER = f"""coalesce({first_sql('s', '\\b([A-Z][a-z]+)\\s+will\\s+', 1)}, {first_sql('s', '\\b([A-Z][a-z]+)\\s+to\\s+', 1)}, {first_sql('s', '\\bowner[:\\-]\\s*([A-Z][a-z]+)\\b', 1)},
    case when regexp_matches(lower(s), '\\bteam\\s+will\\b') then 'Team' end)"""


@query(
    "f10_owner_extract",
    oracle(
        f"""select doc_id, pos, owner as chunk_owner, action as chunk_action, {SLOT_OWNER} as slot_owner, {LOCAL_OWNER} as local_owner from ({owner_action_from('select * from statement_sents')}) x"""
    ),
)
def f10(spark, sf):
    s = F.col("s")
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s").withColumn(
        "oa", T.owner_action_chunk(s)
    )
    return out.select(
        "doc_id",
        "pos",
        F.col("oa.owner").alias("chunk_owner"),
        F.col("oa.action").alias("chunk_action"),
        T.owner_slot(s).alias("slot_owner"),
        T.owner_local(s).alias("local_owner"),
    )


# ---- X03, A12 ------------------------------------------------------------------------------
CHUNK_WORDS = 40
cte(
    "talk_word_chunks",
    f"""select doc_id, (i - 1) // {CHUNK_WORDS} + 1 as chunk, string_agg(w, ' ' order by i) as text from (
    select doc_id, unnest(l) as w, generate_subscripts(l, 1) as i from (select doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') as l from transcripts) x) y group by 1, 2""",
)
cte(
    "chunk_statements",
    """select doc_id, chunk, row_number() over (partition by doc_id order by chunk, ord) as pos, s from (
    select doc_id, chunk, generate_subscripts(l, 1) as ord, trim(unnest(l)) as s from (select doc_id, chunk, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as l from talk_word_chunks) a) b where s <> ''""",
)
cte(
    "chunk_found",
    f"""select *, {CHUNK_DUE} as deadline, case when owner <> 'Unassigned' and {has('s', (' will ', ' should ', ' needs to '))} then 'high' when owner <> 'Unassigned' then 'medium' else 'low' end as confidence
    from ({owner_action_from(f"select * from chunk_statements where {has("' ' || s || ' '", L.CHUNK_MARKERS)}", "chunk,")}) x where action <> ''""",
)


@query(
    "x03_chunk_actions",
    oracle(
        "select doc_id, row_number() over (partition by doc_id order by pos) as pos, action, owner, deadline, s as reason_context, chunk as source_chunk, confidence from chunk_found"
    ),
)
def x03(spark, sf):
    out = rows(_talk(spark, sf), X.chunk_candidates(F.col("text"), CHUNK_WORDS), ["doc_id"], "c")
    return out.select(
        "doc_id", "pos", "c.action", "c.owner", "c.deadline", "c.reason_context", "c.source_chunk", "c.confidence"
    )


def _same_sql(e: str, x: str) -> str:
    ov = overlap_sql(f"{e}.tokens", f"{x}.tokens")
    return f"""{e}.ok = {x}.ok and {e}.dk = {x}.dk and {e}.norm <> '' and {x}.norm <> '' and (contains({e}.norm, {x}.norm) or contains({x}.norm, {e}.norm) or {ov} >= 0.75)"""


def _merge_sql(e: str, x: str) -> str:
    better = f"len({x}.tokens) > len({e}.tokens)"

    def pick(f):
        return f"'{f}': case when {better} then {x}.{f} else {e}.{f} end"

    rank = "case lower({0}.confidence) when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 0 end"
    return (
        "{"
        + ", ".join(pick(f) for f in ("action", "owner", "deadline"))
        + f", 'ctx': case when length(trim({x}.ctx)) > length(trim({e}.ctx)) then {x}.ctx else {e}.ctx end"
        + f", 'chunk': least({e}.chunk, {x}.chunk)"
        + f", 'confidence': case when {rank.format(x)} > {rank.format(e)} then {x}.confidence else {e}.confidence end, "
        + ", ".join(pick(f) for f in ("ok", "dk", "norm", "tokens"))
        + "}"
    )


cte(
    "chunk_structs",
    f"""select doc_id, list({{'action': action, 'owner': owner, 'deadline': deadline, 'ctx': s, 'chunk': chunk, 'confidence': confidence,
      'ok': lower({sq('owner')}), 'dk': lower({sq('deadline')}), 'norm': lower({sq('action')}), 'tokens': {stripped('action')}}} order by chunk, pos) as l from chunk_found group by doc_id""",
)
cte(
    "chunk_merged",
    f"""select doc_id, list_reduce(list_transform(l, lambda s: [s]), lambda acc, y:
      case when len(list_filter(acc, lambda e: {_same_sql('e', 'y[1]')})) = 0 then list_concat(acc, y)
      else list_transform(acc, lambda e, i: case when i = list_position(list_transform(acc, lambda g: {_same_sql('g', 'y[1]')}), true) then {_merge_sql('e', 'y[1]')} else e end) end) as m from chunk_structs""",
)


@query(
    "a12_action_consolidate",
    oracle(
        """select doc_id, row_number() over (partition by doc_id order by c.chunk, i) as pos, c.action as action, c.owner as owner, c.deadline as deadline, c.ctx as reason_context, c.chunk as source_chunk, c.confidence as confidence
        from (select doc_id, unnest(m) as c, generate_subscripts(m, 1) as i from chunk_merged) t"""
    ),
)
def a12(spark, sf):
    merged = X.consolidate(X.chunk_candidates(F.col("text"), CHUNK_WORDS))
    out = rows(_talk(spark, sf), merged, ["doc_id"], "c")
    return out.select(
        "doc_id", "pos", "c.action", "c.owner", "c.deadline", "c.reason_context", "c.source_chunk", "c.confidence"
    )


# ---- X04 and merges ---------------------------------------------------------------------------
SLOT_BUDGET, SLOT_SHARED = 400, 60


def _slot_chunks():
    return S.paragraph_chunks(F.col("text"), SLOT_BUDGET, SLOT_SHARED)


cte(
    "slot_chunks",
    f"""select doc_id, i as chunk, s as text from (select doc_id, unnest(ps) as p from (select doc_id, list_filter([regexp_replace(text, '^\\s+|\\s+$', '', 'g')], lambda p: p <> '') as ps from transcripts) a) b,
    lateral (select i, regexp_replace(substr(p, cast(i * {SLOT_BUDGET - SLOT_SHARED} + 1 as bigint), {SLOT_BUDGET}), '^\\s+|\\s+$', '', 'g') as s from (select unnest(range(0, cast(greatest(0, ceil((length(p) - {SLOT_BUDGET}) / {float(SLOT_BUDGET - SLOT_SHARED)})) as bigint) + 1)) as i) r) q where s <> ''""",
)
cte(
    "slot_chunk_sents",
    f"""select doc_id, chunk, row_number() over (partition by doc_id order by chunk, ord) as pos, s, lower(s) as low from (
    select doc_id, chunk, generate_subscripts(l, 1) as ord, {sq(edges('unnest(l)', '[ \\-•\\t]+'))} as s from (
      select doc_id, chunk, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as l from slot_chunks) a) b where length(s) >= 12""",
)
cte(
    "slot_flags",
    f"""select *, {has('s', L.SLOT_DECISION)} as is_dec, {has('s', L.SLOT_RISK)} as is_risk, {has('s', L.SLOT_NEXT)} as is_next,
    not is_pur and not is_out and not {has('s', L.SLOT_DECISION)} and not contains(low, 'by the end of the meeting') and not contains(low, 'we should leave with') and
    (regexp_matches(s, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)? will\\b') or regexp_matches(low, {lit(L.starts(L.SLOT_STARTERS))}) or {has("' ' || s || ' '", L.SLOT_TASK)}) as is_act,
    {SLOT_OWNER} as owner, {_ordered('s', L.SLOT_DUE)} as due from (
      select *, not is_pur and regexp_matches(low, 'by the end|we should leave with|^confirmed|outcome|result') as is_out from (
        select *, {has('s', L.SLOT_PURPOSE)} and not contains(low, 'next step') as is_pur from slot_chunk_sents) a) b""",
)
cte(
    "slot_all",
    """select doc_id, 'decision' as kind, pos, s as text, cast(null as varchar) as owner, cast(null as varchar) as due, 0.82 as confidence, chunk from slot_flags where is_dec
    union all select doc_id, 'risk', pos, s, null, null, 0.78, chunk from slot_flags where is_risk
    union all select doc_id, 'next_step', pos, s, null, null, 1.0, chunk from slot_flags where is_next
    union all select doc_id, 'action', pos, s, owner, due, least(0.95, 0.7 + case when owner is not null then 0.1 else 0 end + case when due is not null then 0.1 else 0 end), chunk from slot_flags where is_act
    union all select * from (select doc_id, 'purpose', pos, s, null, null, 1.0, chunk from slot_flags where is_pur qualify row_number() over (partition by doc_id order by pos) = 1) p
    union all select * from (select doc_id, 'outcome', pos, s, null, null, 1.0, chunk from slot_flags where is_out qualify row_number() over (partition by doc_id order by pos) = 1) o
    union all select * from (select doc_id, 'key_point', pos, s, null, null, 1.0, chunk from slot_flags qualify row_number() over (partition by doc_id order by pos) <= 12) k""",
)


def _slots():
    return X.slot_items(_slot_chunks())


@query(
    "x04_slot_extract",
    oracle(
        "select doc_id, kind, row_number() over (partition by doc_id, kind order by pos) as pos, text, owner, due, round(confidence, 2) as confidence, chunk from slot_all"
    ),
)
def x04(spark, sf):
    kinds = ("purpose", "outcome", "decision", "risk", "next_step", "action", "key_point")
    docs = _talk(spark, sf).select("doc_id", _slots().alias("items"))
    out = X.kind_rows(
        docs, ["doc_id"], {k: F.transform(X.of_kind(F.col("items"), k), lambda x: x.dropFields("kind")) for k in kinds}
    )
    return out.withColumn("confidence", F.round("confidence", 2))


MERGE_KEY = "regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9 ]+', '', 'g'), '\\s+', ' ', 'g')"
cte(
    "slot_actions",
    f"""select doc_id, k, min(pos) as p, arg_min(text, pos) as text, arg_min(owner, pos) filter (owner is not null) as owner, arg_min(due, pos) filter (due is not null) as due,
    max(confidence) as confidence, array_to_string(list_sort(list(distinct chunk)), ',') as chunks from (select *, {MERGE_KEY} as k from slot_all where kind = 'action') t where k <> '' group by doc_id, k""",
)


@query(
    "a13_slot_merge",
    oracle(
        "select doc_id, row_number() over (partition by doc_id order by p) as pos, text, owner, due, round(confidence, 2) as confidence, chunks from slot_actions"
    ),
)
def a13(spark, sf):
    merged = X.merge_slot_actions(X.of_kind(_slots(), "action"))
    out = rows(_talk(spark, sf), merged, ["doc_id"], "x")
    return out.select(
        "doc_id", "pos", "x.text", "x.owner", "x.due", F.round("x.confidence", 2).alias("confidence"),
        F.array_join(F.col("x.chunks").cast("array<string>"), ",").alias("chunks"),
    )


@query(
    "a14_best_by_key",
    oracle(
        f"""select doc_id, kind, row_number() over (partition by doc_id, kind order by p) as pos, text, round(confidence, 2) as confidence from (
        select doc_id, kind, k, min(pos) as p, arg_max(text, confidence * 1000000 - pos) as text, max(confidence) as confidence from (select *, {MERGE_KEY} as k from slot_all where kind in ('decision', 'action')) t where k <> '' group by 1, 2, 3) u"""
    ),
)
def a14(spark, sf):
    docs = _talk(spark, sf).select("doc_id", _slots().alias("items"))

    def best(kind):
        kept = X.best_by_key(X.of_kind(F.col("items"), kind))
        return F.transform(kept, lambda x: F.struct(x["text"].alias("text"), F.round(x["confidence"], 2).alias("confidence")))

    return X.kind_rows(docs, ["doc_id"], {k: best(k) for k in ("decision", "action")})


@query(
    "l03_confidence_top_k",
    oracle(
        "select doc_id, row_number() over (partition by doc_id order by confidence desc, p) as pos, text, owner, due, round(confidence, 2) as confidence from slot_actions qualify pos <= 8"
    ),
)
def l03(spark, sf):
    merged = X.by_confidence(X.merge_slot_actions(X.of_kind(_slots(), "action")), 8)
    out = rows(_talk(spark, sf), merged, ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.text", "x.owner", "x.due", F.round("x.confidence", 2).alias("confidence"))


@query(
    "p18_action_validate",
    oracle(
        deduped(
            f"""select doc_id, p as ord, {edges(sq('text'), '[ \\-•]+')} as s, owner, confidence from slot_actions where confidence >= 0.65 and length({edges(sq('text'), '[ \\-•]+')}) >= 12
            and not {has('text', X.STATUS_HINTS + X.DECIDED_HINTS + X.FRAME_HINTS)} and not (lower(text) like 'we %' and owner is null)
            and (regexp_matches(lower({edges(sq('text'), '[ \\-•]+')}), {lit(L.starts(L.SLOT_STARTERS))}) or {has("' ' || text || ' '", L.SLOT_TASK)} or (owner is not null and regexp_matches(lower(text), '\\bwill\\b|\\bshould\\b|\\bneed[s]? to\\b')))""",
            "lower(s)",
            6,
            "s as text, owner",
        )
    ),
)
def p18(spark, sf):
    merged = X.merge_slot_actions(X.of_kind(_slots(), "action"))
    out = rows(_talk(spark, sf), X.valid_actions(merged), ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.text", "x.owner")


# ---- W09, W12-style keep-first on the sentence stream ------------------------------------------
@query(
    "w09_keep_first_by_key",
    oracle(
        deduped(
            "select doc_id, pos as ord, s from signal_sents",
            "regexp_replace(lower(s), '[^a-z0-9]+', '', 'g')",
            12,
            "s as sentence",
        )
    ),
)
def w09(spark, sf):
    kept = keep_first(S.sentences_signal(F.col("text")), T.compact_key, 12)
    return rows(_talk(spark, sf), kept, ["doc_id"], "sentence")
