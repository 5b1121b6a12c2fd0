"""Explicit-form recall, merge rules, hints, rule tables and key dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_first import COMPACT, LOCAL_DUE, _clean_rows
from colloquy.catalog.q_second import cap, spaced
from colloquy.catalog.q_signals import deduped, first_sql, steps_sql, CHUNK_WORDS
from colloquy.catalog.q_text import (
    _talk, clean_sentence_sql, content_key, has, like_any, lit, _speaker_noise_sql, sorted_key, sq, wc,
)
from colloquy.catalog.q_third import list_rows, pipe
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import rows
from colloquy.operators import points as P, recall as R, sentences as S, signals as X
from colloquy.operators.match import exact_key
from colloquy.plans.records import notes_records
from colloquy.sources.standins import standin

def _text():
    return F.coalesce(F.col("text"), F.lit(""))


SRC = "(select doc_id, coalesce(text, '') as text from transcripts)"


def listed2(source: str, pattern: str, groups: int, base: int = 0) -> str:
    gs = ", ".join(f"regexp_extract_all(text, {lit(pattern)}, {g}) as l{g}" for g in range(1, groups + 1))
    un = ", ".join(f"unnest(l{g}) as g{g}" for g in range(1, groups + 1))
    return f"select doc_id, {base} + generate_subscripts(l1, 1) as ord, {un} from (select doc_id, {gs} from {source}) m"


@query(
    "x13_recap_triples",
    oracle(
        f"select doc_id, ord as pos, case when lower({sq('g2')}) = 'unassigned' then 'Unassigned' else {sq('g2')} end as owner, {sq('g1')} as action, case when lower({sq('g3')}) not in ('no deadline', 'none') then {sq('g3')} end as deadline from ({listed2(SRC, R.RECAP_TRIPLE, 3)}) t where {sq('g1')} <> ''"
    ),
)
def x13(spark, sf):
    out = rows(_talk(spark, sf), R.recap_triples(_text()), ["doc_id"], "r")
    return out.select("doc_id", "pos", "r.owner", "r.action", "r.deadline")


# ---- X17, X18 -----------------------------------------------------------------------------------
def split_before(x: str, joint: str, following: str) -> str:
    """Split at ``joint`` where ``following`` comes next, without look-ahead."""
    return f"string_split(regexp_replace({x}, {lit(f'(?i){joint}({following})')}, chr(10) || '\\1', 'g'), chr(10))"


def compound_sql(x: str, verbs, joint: str = r"\s+(?:and|;|,)\s+") -> str:
    return f"list_filter(list_transform({split_before(sq(x), joint, '(?:' + '|'.join(verbs) + r')\b')}, lambda p: regexp_replace(p, '^[ .]+|[ .]+$', '', 'g')), lambda p: p <> '')"


@query(
    "x17_compound_task_split",
    oracle(
        f"select doc_id, pos, generate_subscripts(l, 1) as part, unnest(l) as task from (select doc_id, pos, {compound_sql('s', R.COMPOUND_VERBS)} as l from statement_sents) t"
    ),
)
def x17(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    out = out.select("doc_id", "pos", F.posexplode_outer(R.split_compound(F.col("s"))).alias("part", "task"))
    return out.filter(F.col("part").isNotNull()).withColumn("part", F.col("part") + 1)


TURN = r"[A-Z][A-Za-z]+:\s+(?:I|We|Team)\s+(?:will|should|need|needs)\b"


@query(
    "x18_speaker_turn_split",
    oracle(
        f"""select doc_id, row_number() over (partition by doc_id order by ord) as pos, s as turn from (select doc_id, generate_subscripts(l, 1) as ord, trim(unnest(l)) as s from (
        select doc_id, string_split(regexp_replace({sq('text')}, {lit(r'\s+(' + TURN + ')')}, chr(10) || '\\1', 'g'), chr(10)) as l from {SRC}) t) u where s <> ''"""
    ),
)
def x18(spark, sf):
    return rows(_talk(spark, sf), R.split_turns(_text()), ["doc_id"], "turn")


# ---- X14, X15 -------------------------------------------------------------------------------------
EDGE = "[ \\-–—:;,.\"'']+"


def recall_owner_sql(x: str) -> str:
    v = f"regexp_replace({sq(x)}, '^{EDGE}|{EDGE}$', '', 'g')"
    return f"case when lower({v}) in ('', 'we', 'i') then 'Team' else {cap(v)} end"


def recall_task_sql(x: str) -> str:
    return cap(steps_sql(x, R.TASK_STEPS))


BAD = f"({has('task', R.BAD_TASK)} or {wc('task')} < 3)"
DUE_SQL = "coalesce(" + ", ".join(first_sql("task", f"(?i){p}") for p in R.DUE) + ")"
cte(
    "marker_items",
    f"""select doc_id, ord, owner, task, {DUE_SQL} as due, 0.84e0 as confidence from (select doc_id, b * 100 + generate_subscripts(l, 1) as ord, owner, {recall_task_sql('unnest(l)')} as task from (
      select doc_id, b, {recall_owner_sql(f'regexp_extract(body, {lit(R.MARKER_HEAD)}, 1)')} as owner,
        {compound_sql(f"regexp_replace(regexp_replace(regexp_extract(body, {lit(R.MARKER_HEAD)}, 2), {lit(R.MARKER_STOP)}, ''), '(?i)^(?:i|we)\\s+will\\s+', '')", R.MARKER_VERBS, r',?\s+and\s+')} as l from (
        select doc_id, generate_subscripts(q, 1) as b, unnest(q) as body from (select doc_id, string_split_regex({sq('text')}, {lit(R.MARKER)})[2:] as q from {SRC}) a) a2 where regexp_matches(body, {lit(R.MARKER_HEAD)})) a3) a4 where task <> '' and not {BAD}""",
)
_ITEMS = "select doc_id, row_number() over (partition by doc_id order by ord) as pos, owner, task, due, confidence from "


def _item_rows(df, items):
    out = rows(df, items, ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.owner", "x.task", "x.due", "x.confidence")


@query("x14_owner_markers", oracle(_ITEMS + "marker_items"))
def x14(spark, sf):
    return _item_rows(_talk(spark, sf), R.owner_markers(_text()))


NAMES = "|".join(R.SPEAKERS)
cte(
    "speaker_turns",
    f"""select doc_id, ord, regexp_extract(p, '^({NAMES}):\\s', 1) as speaker, regexp_replace(p, '^(?:{NAMES}):\\s', '') as words from (select doc_id, generate_subscripts(l, 1) as ord, unnest(l) as p from (
    select doc_id, string_split(regexp_replace({sq('text')}, '\\s((?:{NAMES}):\\s)', chr(10) || '\\1', 'g'), chr(10)) as l from {SRC}) t) u where p <> ''""",
)
WILL_ARM = rf"(?i)\bI will\s+((?:{'|'.join(R.COMMIT_VERBS)})\b.*)$"
SAID = "case when speaker <> '' then speaker else 'Team' end"


def commit_body_sql(x: str) -> str:
    o = f"regexp_replace({sq(x)}, {lit(R.BODY_STOP)}, '')"
    o = f"regexp_replace({o}, '(?i)^(?:i accept\\s+(?:the\\s+)?(?:first|second|third)?\\s*action,?\\s*)?(?:i|we)\\s+will\\s+', '')"
    o = f"regexp_replace({o}, '(?i)\\bi accept ownership.*$', '')"
    return f"regexp_replace({o}, '(?i)\\.\\s+by\\s+', ' by ', 'g')"


def arm(n: int, body: str, owner: str, conf: str) -> str:
    return f"select doc_id, {n} * 100000 + ord as ord, {owner} as who, {body} as body, {conf} as confidence from speaker_turns where {body} <> ''"


_RDUE = sq(f"regexp_extract(words, {lit(R.RECAP_ARM)}, 3)")
_RBODY = f"regexp_extract(words, {lit(R.RECAP_ARM)}, 1)"
_EBODY = f"regexp_extract(words, {lit(R.EXPLICIT_ARM)}, 1)"
cte(
    "commit_items",
    f"""select doc_id, ord, {recall_owner_sql('who')} as owner, task, {DUE_SQL} as due, confidence from (select doc_id, ord, who, confidence, {recall_task_sql(commit_body_sql('body'))} as task from (
      select doc_id, ord, who, case when due <> '' and lower(due) not in ('no deadline', 'no deadline stated') then body || ' by ' || due else body end as body, confidence from (select doc_id, ord, regexp_extract(words, {lit(R.RECAP_ARM)}, 2) as who, {_RBODY} as body, {_RDUE} as due, 0.9e0 as confidence from speaker_turns where {_RBODY} <> '') r
      union all {arm(1, _EBODY, f"case when contains(lower({_EBODY}), 'intentionally unassigned') then 'Unassigned' else {SAID} end", '0.9e0')}
      union all {arm(2, f'regexp_extract(words, {lit(R.ACCEPT_ARM)}, 1)', SAID, '0.9e0')}
      union all {arm(3, f'regexp_extract(words, {lit(WILL_ARM)}, 1)', SAID, '0.84e0')}) a) b where task <> '' and not {BAD} and regexp_matches(lower(task), '^(?:{"|".join(R.COMMIT_VERBS)})\\b')""",
)


@query("x15_explicit_commitments", oracle(_ITEMS + "commit_items"))
def x15(spark, sf):
    return _item_rows(_talk(spark, sf), R.explicit_commitments(_text()))


# ---- A16, L04 ------------------------------------------------------------------------------------------
cte("recalled", "select doc_id, ord, owner, task, due, confidence from marker_items union all select doc_id, 10000000 + ord, owner, task, due, confidence from commit_items")
cte(
    "named_wins",
    f"""select doc_id, min_ord as ord, m.owner as owner, m.task as task, m.due as due, m.confidence as confidence from (select doc_id, min(ord) as min_ord, list_reduce(list({{'owner': owner, 'task': task, 'due': due, 'confidence': confidence}} order by ord), lambda b, x:
      case when (x.owner <> 'Team' and b.owner = 'Team') or x.confidence > b.confidence then x else b end) as m from (select *, {spaced('task')} as k from recalled) t group by doc_id, k) u""",
)
RANKING = ("send the pricing sheet", "review the order file", "prepare the demo script")


def _recall_all():
    return F.concat(R.owner_markers(_text()), R.explicit_commitments(_text()))


@query("a16_named_owner_wins", oracle(_ITEMS + "named_wins"))
def a16(spark, sf):
    return _item_rows(_talk(spark, sf), R.named_owner_wins(_recall_all()))


@query(
    "l04_rule_rank_sort",
    oracle(
        "select doc_id, row_number() over (partition by doc_id order by case "
        + " ".join(f"when contains(lower(task), '{p}') then {i}" for i, p in enumerate(RANKING))
        + " else 99 end, lower(task), ord) as pos, owner, task, due, confidence from named_wins qualify pos <= 10"
    ),
)
def l04(spark, sf):
    return _item_rows(_talk(spark, sf), R.rank_sort(R.named_owner_wins(_recall_all()), RANKING))


# ---- P17 --------------------------------------------------------------------------------------------------
LOW_SQL = f"({sq('s')} = '' or regexp_matches(lower({sq('s')}), '^(?:if |maybe |perhaps )') or regexp_matches(lower({sq('s')}), {lit(L.any_text(R.VAGUE + R.POLICY))}) or regexp_matches(lower({sq('s')}), {lit(L.starts(R.POLICY_STARTS))}))"


@query("p17_low_precision_filter", oracle(f"select doc_id, pos, s as sentence, {LOW_SQL} as is_low from statement_sents"))
def p17(spark, sf):
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "sentence")
    return out.withColumn("is_low", R.is_low_precision(F.col("sentence")))


# ---- W13, X16 ------------------------------------------------------------------------------------------------
START = ("questions and risks", "final action items")
STOP = ("helpful update", "publish the notes")
cte(
    "between_sents",
    f"""select doc_id, pos, s from (select *, min(pos) filter ({has('s', STOP)} and pos > p) over (partition by doc_id) as q from (select *, min(pos) filter ({has('s', START)}) over (partition by doc_id) as p from local_sents) a) b where p is not null and pos > p and (q is null or pos < q)""",
)


@query("w13_between_markers", oracle("select doc_id, row_number() over (partition by doc_id order by pos) as pos, s as sentence from between_sents"))
def w13(spark, sf):
    cut = R.between_markers(S.sentences_local(F.col("text")), START, STOP)
    return rows(_talk(spark, sf), cut, ["doc_id"], "sentence")


WILL = lit(r"\b([A-Z][a-z]+)\s+will\s+(?:also\s+)?(.+)$")
STEP = lit(r"(?i)\bnext step is to (.+)$")
FINAL_SRC = f"""select doc_id, ord, owner, {steps_sql('task', C.LOCAL_SENTENCE)} as task, due from (
    select doc_id, pos * 100 + generate_subscripts(l, 1) as ord, regexp_extract(s, {WILL}, 1) as owner, unnest(l) as task, due from (select doc_id, pos, s, {LOCAL_DUE} as due, {compound_sql(f'regexp_extract(s, {WILL}, 2)', R.COMPOUND_VERBS)} as l from (select doc_id, pos, {sq('s')} as s from local_sents) w) a
    union all select doc_id, pos * 100 + 99, null, regexp_extract(s, {STEP}, 1), {LOCAL_DUE} from (select doc_id, pos, {sq('s')} as s from local_sents) w where regexp_extract(s, {STEP}, 1) <> '') t"""
cte(
    "final_actions",
    deduped(
        f"select doc_id, ord, owner, task as s, due from ({FINAL_SRC}) f where {wc('task')} between 4 and 18 and regexp_matches(lower(task), '^(?:{'|'.join(R.GOOD_TASK)})\\b')",
        COMPACT, 8, "owner, s as task, due",
    ),
)


@query("x16_final_section_actions", oracle("select doc_id, pos, owner, task, due from final_actions"))
def x16(spark, sf):
    out = rows(_talk(spark, sf), R.final_actions(S.sentences_local(F.col("text"))), ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.owner", "x.task", "x.due")


# ---- J14 - J17, J19 ---------------------------------------------------------------------------------------------
cte(
    "cand_first",
    f"select doc_id, k, arg_min(chunk, pos) as source_chunk, arg_min(s, pos) as reason_context from (select *, {spaced('action')} as k from chunk_found) t group by 1, 2",
)


cte("commit_pos", _ITEMS + "commit_items")


@query(
    "j14_metadata_restore",
    oracle(
        f"select f.doc_id, f.pos, f.task, c.source_chunk, c.reason_context from (select *, {spaced('task')} as k from commit_pos) f left join cand_first c on c.doc_id = f.doc_id and c.k = f.k"
    ),
)
def j14(spark, sf):
    restored = R.restore_metadata(R.explicit_commitments(_text()), X.chunk_candidates(F.col("text"), CHUNK_WORDS))
    out = rows(_talk(spark, sf), restored, ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.task", "x.source_chunk", "x.reason_context")


BACKED = (
    R.BackedRule(("keep lane", "keep the lane"), ("lane setup",), "Confirm the lane setup with the pilot teams"),
    R.BackedRule(("support channel",), ("rollout note",), "Tell customers about the support channel"),
)


def _backed_sql() -> str:
    arms = []
    for i, r in enumerate(BACKED):
        arms.append(
            f"select doc_id, {i} as ord, '{r.task}' as task from backed_text where {has('d', r.decided)} and not {has('a', r.covered)}"
        )
    return " union all ".join(arms)


cte("backed_text", "select doc_id, replace(decisions, '|', ' ') as d, replace(action_items, '|', ' ') as a from records")


@query(
    "j15_decision_backed_action",
    oracle(
        f"select doc_id, row_number() over (partition by doc_id order by ord) as pos, task from ({_backed_sql()} union all select doc_id, 100 + ord, s from ({list_rows('action_items')}) w) t"
    ),
)
def j15(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    return rows(r, R.decision_backed(F.col("decisions"), F.col("action_items"), BACKED), ["doc_id"], "task")


cte("stored_tasks", f"select doc_id, ord, trim(regexp_extract(trim(s), {lit(r'^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$')}, 2)) as task from ({list_rows('action_items')}) w")
cte(
    "arm_counts",
    """select r.doc_id, coalesce(m.n, 0) as m, coalesce(i.n, 0) as i, coalesce(c.n, 0) as c from records r left join (select doc_id, count(*) as n from marker_items group by 1) m on m.doc_id = r.doc_id
    left join (select doc_id, count(*) as n from stored_tasks group by 1) i on i.doc_id = r.doc_id left join (select doc_id, count(*) as n from commit_items group by 1) c on c.doc_id = r.doc_id""",
)


@query(
    "j16_recall_backfill",
    oracle(
        """select doc_id, row_number() over (partition by doc_id order by arm, ord) as pos, arm, task from (
        select x.doc_id, 0 as arm, x.ord, x.task from marker_items x
        union all select x.doc_id, 1, x.ord, x.task from stored_tasks x join arm_counts k on k.doc_id = x.doc_id where k.m < 3
        union all select x.doc_id, 2, x.ord, x.task from commit_items x join arm_counts k on k.doc_id = x.doc_id where k.m < 3 and k.m + k.i < 3
        union all select x.doc_id, 3, x.pos, x.action from chunk_found x join arm_counts k on k.doc_id = x.doc_id where k.m < 3 and k.m + k.i + case when k.m + k.i < 3 then k.c else 0 end < 3) t"""
    ),
)
def j16(spark, sf):
    r = notes_records(standin(spark, sf, "records"))

    def tag(n, items, field):
        return F.transform(items, lambda x: F.struct(F.lit(n).alias("arm"), x[field].alias("task")))

    stored = F.transform("action_items", T.parse_action_line)
    out = rows(
        r,
        R.recall_backfill(
            tag(0, R.owner_markers(_text()), "task"),
            tag(1, stored, "task"),
            tag(2, R.explicit_commitments(_text()), "task"),
            tag(3, X.chunk_candidates(F.col("text"), CHUNK_WORDS), "action"),
        ),
        ["doc_id"],
        "x",
    )
    return out.select("doc_id", "pos", "x.arm", "x.task")


def norm_words_sql(x: str) -> str:
    return sq(f"regexp_replace(regexp_replace(lower(trim({x})), '[_*`#>\\[\\]()]+', ' ', 'g'), '[^a-z0-9%:\\s-]', ' ', 'g')")


HINT = lit(r"\b([A-Z][a-zA-Z]+)\s+for\s+([^.;]+)$")
cte(
    "hints",
    f"""select doc_id, row_number() over (partition by doc_id order by pos, b, w) as ord, owner, keyword from (select doc_id, pos, b, generate_subscripts(l, 1) as w, owner, {norm_words_sql('unnest(l)')} as keyword from (
      select doc_id, pos, b, regexp_extract(block, {HINT}, 1) as owner, string_split_regex(regexp_extract(block, {HINT}, 2), '\\s*,\\s*|\\s+and\\s+') as l from (
        select doc_id, pos, generate_subscripts(q, 1) as b, unnest(q) as block from (select doc_id, pos, string_split(regexp_replace(regexp_replace(regexp_replace(s, '\\.+$', ''), ',\\s+and\\s+([A-Z][a-zA-Z]+)\\s+for\\b', ', \\1 for', 'g'), ',\\s+([A-Z][a-zA-Z]+\\s+for\\b)', chr(10) || '\\1', 'g'), chr(10)) as q
          from local_sents where contains(lower(s), ' for ')) h0) h1) h2) h3 where keyword <> ''""",
)


@query(
    "j17_owner_hint_lookup",
    oracle(
        f"""select a.doc_id, a.pos, a.task, case when lower(trim(coalesce(a.owner, ''))) in ('team', 'unassigned', 'we', 'someone', 'everyone', '') then coalesce(h.owner, case when coalesce(a.owner, '') <> '' then a.owner else 'Team' end) else a.owner end as owner
        from local_actions a left join (select a.doc_id, a.pos, arg_min(h.owner, h.ord) as owner from (select doc_id, pos, {norm_words_sql('task')} as words from local_actions) a join hints h on h.doc_id = a.doc_id and contains(a.words, h.keyword) group by 1, 2) h on h.doc_id = a.doc_id and h.pos = a.pos"""
    ),
)
def j17(spark, sf):
    from colloquy.functions.arrays import let

    sents = S.sentences_local(F.col("text"))
    out = _talk(spark, sf).select("doc_id", sents.alias("sents"))
    filled = let(
        R.owner_hints(F.col("sents")),
        lambda hints: F.transform(
            P.local_actions(F.col("sents")),
            lambda a: F.struct(a["task"].alias("task"), R.infer_owner(a["owner"], a["task"], hints).alias("owner")),
        ),
    )
    out = rows(out, filled, ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.task", "x.owner")


RULES = (
    R.PhraseRule("risk", "Pricing work may hold up the client reply.", ("pricing",), ("confirm", "finance")),
    R.PhraseRule("decision", "Keep the reviewed lane for the pilot.", ("keep lane", "pilot"), (), 10, 400),
    R.PhraseRule("action", "Send a recap of the order review.", ("order file",), ("friday", "monday"), 20),
    R.PhraseRule("risk", "A short meeting may miss owners.", (), ("thanks",), 0, 30),
)


def _rules_sql() -> str:
    arms = []
    for i, r in enumerate(RULES):
        test = " and ".join(
            [f"n between {r.min_words} and {r.max_words}"]
            + [f"contains(low, '{t}')" for t in r.all_terms]
            + ([f"regexp_matches(low, {lit(L.any_text(r.any_terms))})"] if r.any_terms else [])
        )
        arms.append(f"select doc_id, {i} as ord, '{r.kind}' as kind, '{r.output}' as text from rule_text where {test}")
    return " union all ".join(arms)


cte("rule_text", f"select doc_id, low, {wc('low')} as n from (select doc_id, lower({sq('text')}) as low from {SRC}) t")


@query("j19_phrase_rule_synthesis", oracle(f"select doc_id, row_number() over (partition by doc_id order by ord) as pos, kind, text from ({_rules_sql()}) t"))
def j19(spark, sf):
    out = rows(_talk(spark, sf), R.phrase_items(F.col("text"), RULES), ["doc_id"], "x")
    return out.select("doc_id", "pos", "x.kind", "x.text")


# ---- F03 ---------------------------------------------------------------------------------------------------------------
def noise(x: str) -> str:
    return _speaker_noise_sql(x)


DUEX = "regexp_replace({0}, '\\(due:\\s*([^)]+)\\)', '', 'g')"


def stem_sql(w: str) -> str:
    arms = " ".join(f"when ends_with({w}, '{s}') and length({w}) > {len(s) + 3} then left({w}, length({w}) - {len(s)})" for s in ("ing", "ed", "es", "s"))
    return f"case {arms} else {w} end"


KEYS = {
    "compact": "regexp_replace(lower(s), '[^a-z0-9]+', '', 'g')",
    "spaced": spaced("s"),
    "content": content_key("s"),
    "token_set": sorted_key("s"),
    "article": sq(f"regexp_replace(regexp_replace(lower({noise('s')}), '\\b(the|a|an)\\b', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g')"),
    "stem": f"array_to_string(list_transform(list_filter(string_split({sq(f"regexp_replace(regexp_replace(lower({noise('s')}), '\\(due:\\s*([^)]+)\\)', '', 'g'), '[^a-z0-9\\s]', ' ', 'g')")}, ' '), lambda w: w not in ('', 'a', 'an', 'the', 'is', 'as')), lambda w: {stem_sql('w')}), ' ')",
    "action": sq("regexp_replace(regexp_replace(regexp_replace(lower(s), '\\(due:\\s*([^)]+)\\)', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the|is|as)\\b', ' ', 'g')"),
    "precision_task": spaced(steps_sql("s", C.PRECISION_TASK_KEY)),
    "precision_decision": sq(steps_sql(spaced("s"), C.PRECISION_DECISION_KEY)),
    "exact": f"trim({steps_sql('lower(trim(s))', C.EXACT_ACTION)})",
}


@query("f03_dedupe_keys", oracle("select doc_id, pos, " + ", ".join(f"{v} as k_{k}" for k, v in KEYS.items()) + " from statement_sents"))
def f03(spark, sf):
    s = F.col("s")
    made = {
        "compact": T.compact_key(s), "spaced": T.spaced_key(s), "content": T.content_key(s), "token_set": T.sorted_token_key(s),
        "article": R.article_key(s), "stem": R.stem_key(s), "action": R.action_key(s),
        "precision_task": R.precision_task_key(s), "precision_decision": R.precision_decision_key(s), "exact": exact_key(s),
    }
    out = rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "s")
    return out.select("doc_id", "pos", *[v.alias(f"k_{k}") for k, v in made.items()])


# ---- X21 -----------------------------------------------------------------------------------------------------------------
LDUE = lit(R.LINE_DUE)
LWILL = "'^([A-Z][a-zA-Z]+)\\s+will\\s+(.+)$'"
HINTS_SQL = lit(L.any_text(R.LINE_HINTS))
cte(
    "line_input",
    f"select doc_id, ord, {steps_sql('s', R.LINE_NORMAL)} as t from (select doc_id, ord, s from ({list_rows('action_items')}) w union all select doc_id, 1000 + pos, s from local_sents) x where not {like_any('s', R.DROP_LINE)}",
)
cte(
    "line_parts",
    f"""select doc_id, ord, due, case when owner = '' or lower(owner) in ('we', 'team') then 'Team' else owner end as owner, {steps_sql('task', R.LINE_TASK)} as task from (
      select doc_id, ord, due, case when contains(bare, ' - ') then trim(split_part(bare, ' - ', 1)) else regexp_extract(bare, {LWILL}, 1) end as owner,
        case when contains(bare, ' - ') then trim(regexp_replace(bare, '^.*? - ', '')) when regexp_matches(bare, {LWILL}) then regexp_extract(bare, {LWILL}, 2) else bare end as task from (
        select doc_id, ord, due, case when due <> '' then regexp_replace(left(t, position(due in t) - 1), '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g') else t end as bare from (select *, regexp_extract(t, {LDUE}, 0) as due from line_input) a) b) c""",
)
cte(
    "lines_clean",
    deduped(
        f"""select * from (select doc_id, ord * 10 + generate_subscripts(l, 1) as ord, owner || ' - ' || trim(unnest(l)) || case when due <> '' then ' (due: ' || due || ')' else '' end as s from (
          select *, case when not regexp_matches(lower(task), {lit(L.any_text(R.LINE_KEEP))}) and regexp_matches(lower(regexp_replace(task, '^.*?\\s+and\\s+', '')), '^(?:{"|".join(R.LINE_SPLIT)}) ') and regexp_matches(task, '\\s+and\\s+')
            then list_filter([regexp_extract(task, '^(.*?)\\s+and\\s+', 1), regexp_replace(task, '^.*?\\s+and\\s+', '')], lambda q: trim(q) <> '') else list_filter([task], lambda q: trim(q) <> '') end as l from line_parts
          where {wc('task')} between 3 and 22 and not regexp_matches(lower(task), {lit(L.starts(R.LINE_BAD_STARTS))}) and (contains(lower(task), ' will ') or regexp_matches(lower(task), {HINTS_SQL}))) a) b
        where not regexp_matches(lower(s), {lit(L.any_text(R.LINE_BAD_STARTS))}) and not regexp_matches(lower(s), 'speaker | sounds good| exactly') and regexp_matches(lower(regexp_replace(s, '^.*? - ', '')), {HINTS_SQL})""",
        sq("regexp_replace(regexp_replace(lower(s), '\\(due:[^)]+\\)', '', 'g'), '[^a-z0-9 ]+', '', 'g')"),
        1000000,
    ),
)


@query("x21_action_line_clean", oracle("select doc_id, pos, s as line from lines_clean"))
def x21(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    lines = F.concat(F.col("action_items"), S.sentences_local(F.col("text")))
    return rows(r, R.clean_lines(lines), ["doc_id"], "line")
