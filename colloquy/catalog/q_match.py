"""Matching, scoring and gates over cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_second import spaced
from colloquy.catalog.q_signals import steps_sql
from colloquy.catalog.q_text import lit, overlap_sql, sq, stop_list, stripped, token_list
from colloquy.catalog.q_third import list_rows
from colloquy.functions import chains as C, lexicons as L, text as T
from colloquy.functions.arrays import rows
from colloquy.operators import match as M
from colloquy.plans.records import as_list, notes_records
from colloquy.sources.standins import standin


def _cases(spark, sf):
    raw = standin(spark, sf, "cases")
    lists = {c: as_list(F.col(c)) for c in ("expected_decisions", "expected_risks", "expected_context", "actual_decisions", "actual_risks")}
    acts = {c: M.parse_actions(as_list(F.col(c))) for c in ("expected_actions", "actual_actions")}
    return raw.withColumns({**lists, **acts, "actual_context": F.array("actual_summary")})


def case_rows(column: str) -> str:
    return list_rows(column, "cases").replace("doc_id", "case_id")


def etok(x: str) -> str:
    return token_list(f"coalesce({x}, '')", "[a-z0-9]+", M.EVAL_STOP)


def text_match_sql(name: str, expected: str, actual: str) -> str:
    """(case_id, ord, s) against (case_id, ord, s)."""
    cte(f"{name}_pairs", f"""select e.case_id, e.ord as e, a.ord as a, e.s as expected, a.s as best, case when len(et) = 0 then 1.0 else len(list_intersect(et, ct)) / len(et) end as score
        from (select *, {etok('s')} as et from ({expected}) x) e left join (select *, {etok('s')} as ct from ({actual}) y) a on a.case_id = e.case_id""")
    return f"""select case_id, e as pos, expected, coalesce(score, 0) as score, case when coalesce(score, 0) > 0 then best else '' end as best, round(coalesce(score, 0), 4) >= 0.52 as matched from {name}_pairs qualify row_number() over (partition by case_id, e order by coalesce(score, 0) desc, a) = 1"""


cte("m_decisions", text_match_sql("dec", case_rows("expected_decisions"), case_rows("actual_decisions")))
cte("m_risks", text_match_sql("risk", case_rows("expected_risks"), case_rows("actual_risks")))
cte("m_context", text_match_sql("ctx", case_rows("expected_context"), "select case_id, 1 as ord, actual_summary as s from cases"))


def action_rows(column: str) -> str:
    return f"select case_id, ord, split_part(s, '~', 1) as owner, split_part(s, '~', 2) as action, split_part(s, '~', 3) as deadline from ({case_rows(column)}) w"




def dates_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {lit(M.DATE)}))"


cte(
    "act_pairs",
    f"""select e.case_id, e.ord as e, a.ord as a, e.action as expected, a.txt as best, 0.75e0 * case when len(et) = 0 then 1.0 else len(list_intersect(et, ct)) / len(et) end
      + 0.2e0 * case when eo = '' or (ao <> '' and ao = eo) or contains(an, eo) then 1 else 0 end + 0.05e0 * case when len(ed) = 0 or list_has_any(ed, ad) then 1 else 0 end as score
    from (select *, {etok('action')} as et, {spaced('owner')} as eo, {dates_sql('deadline')} as ed from ({action_rows('expected_actions')}) x) e
    left join (select *, {etok('txt')} as ct, {spaced('txt')} as an, {spaced('owner')} as ao, {dates_sql('txt')} as ad from (select *, concat_ws(' ', nullif(owner, ''), nullif(action, ''), nullif(deadline, '')) as txt from ({action_rows('actual_actions')}) y) z) a on a.case_id = e.case_id""",
)
cte(
    "m_actions",
    "select case_id, e as pos, expected, coalesce(score, 0) as score, case when coalesce(score, 0) > 0 then best else '' end as best, coalesce(score, 0) >= 0.55e0 as matched from act_pairs qualify row_number() over (partition by case_id, e order by coalesce(score, 0) desc, a) = 1",
)
_M = "select case_id, pos, expected, round(score, 4) as score, best, matched from "


def _match_rows(spark, sf, items):
    out = rows(_cases(spark, sf), items, ["case_id"], "m")
    return out.select("case_id", "pos", "m.expected", F.round("m.score", 4).alias("score"), "m.best", "m.matched")


@query("j06_best_text_match", oracle(_M + "m_decisions"))
def j06(spark, sf):
    return _match_rows(spark, sf, M.best_text_matches(F.col("expected_decisions"), F.col("actual_decisions"), 0.52))


@query("j07_best_action_match", oracle(_M + "m_actions"))
def j07(spark, sf):
    return _match_rows(spark, sf, M.best_action_matches(F.col("expected_actions"), F.col("actual_actions"), 0.55))


def _section(name: str) -> str:
    return f"(select case_id, count(*) as t, round(count(*) filter (matched) / count(*), 4) as r from m_{name} group by 1) {name}"


_W = {"decisions": "0.3e0", "actions": "0.4e0", "risks": "0.15e0", "context": "0.15e0"}
cte(
    "evaluated",
    "select c.case_id, " + ", ".join(f"coalesce({k}.r, 1.0) as {k}_recall, coalesce({k}.t, 0) as {k}_total" for k in _W)
    + ", case when " + " and ".join(f"{k}.t is null" for k in _W) + " then 1.0 else round(("
    + " + ".join(f"case when {k}.t is not null then {w} * {k}.r else 0e0 end" for k, w in _W.items()) + ") / ("
    + " + ".join(f"case when {k}.t is not null then {w} else 0e0 end" for k, w in _W.items()) + "), 4) end as score from cases c "
    + " ".join(f"left join {_section(k)} on {k}.case_id = c.case_id" for k in _W),
)
Q5_COLS = "case_id, decisions_recall, actions_recall, risks_recall, context_recall, decisions_total, actions_total, risks_total, context_total, score"


@query("q05_regression_eval", oracle(f"select {Q5_COLS}, score >= 0.7 as passed from evaluated"))
def q05(spark, sf):
    return M.evaluate_cases(_cases(spark, sf))


@query("a20_weighted_case_score", oracle("select case_id, score from evaluated"))
def a20(spark, sf):
    return M.evaluate_cases(_cases(spark, sf)).select("case_id", "score")


@query(
    "a21_suite_rollup",
    oracle(
        "select count(*) as total_cases, count(*) filter (score >= 0.7) as passed_cases, count(*) filter (score < 0.7) as failed_cases, round(avg(score), 4) as average_score, bool_and(score >= 0.7) as passed from evaluated"
    ),
)
def a21(spark, sf):
    return M.suite_rollup(M.evaluate_cases(_cases(spark, sf)))


# ---- J08, A19 ----------------------------------------------------------------------------------------
_BARE = f"lower({sq('action')})"
cte(
    "greedy_in",
    f"""select e.case_id, e.l as es, coalesce(a.l, []) as acts from (select case_id, list({{'i': rn - 1, 'norm': {_BARE}, 't': {stripped('action', L.SCORE_STOP)}, 'owner': owner, 'deadline': deadline, 'action': action}} order by ord) as l from (
      select *, row_number() over (partition by case_id order by ord) as rn from ({action_rows('expected_actions')}) x where not regexp_matches({_BARE}, '^tbd')) x2 group by case_id) e
    left join (select case_id, list({{'i': ord - 1, 'norm': {_BARE}, 't': {stripped('action', L.SCORE_STOP)}, 'owner': owner, 'deadline': deadline, 'action': action}} order by ord) as l from ({action_rows('actual_actions')}) y group by case_id) a on a.case_id = e.case_id""",
)
_SIM = f"case when y.norm = '' or z.norm = '' then 0.0 when contains(z.norm, y.norm) or contains(y.norm, z.norm) then 1.0 else {overlap_sql('y.t', 'z.t')} end"
# state and steps are both lists of (e, a) pairs; a step carries its own number in e, a = -1
cte(
    "greedy_best",
    f"""select case_id, es, acts, list_transform(es, lambda y: list_sort(list_filter(list_transform(acts, lambda z: {{'n': -({_SIM}), 'i': z.i}}), lambda q: q.n <= -0.45))) as ranked from greedy_in""",
)
cte(
    "greedy_out",
    """select case_id, es, acts, list_filter(list_reduce(list_concat([[{'e': cast(-1 as bigint), 'a': cast(-1 as bigint)}]], list_transform(es, lambda y: [{'e': cast(y.i as bigint), 'a': cast(-1 as bigint)}])), lambda acc, s:
      case when len(list_filter(ranked[s[1].e + 1], lambda q: len(list_filter(acc, lambda u: u.a = q.i)) = 0)) = 0 then acc
      else list_append(acc, {'e': s[1].e, 'a': cast(list_filter(ranked[s[1].e + 1], lambda q: len(list_filter(acc, lambda u: u.a = q.i)) = 0)[1].i as bigint)}) end), lambda p: p.e >= 0) as pairs from greedy_best""",
)


@query(
    "j08_greedy_one_to_one_match",
    oracle(
        "select case_id, es[p.e + 1].action as expected, acts[p.a + 1].action as actual from (select case_id, es, acts, unnest(pairs) as p from greedy_out) t"
    ),
)
def j08(spark, sf):
    c = _cases(spark, sf).withColumn("e", F.filter("expected_actions", lambda e: ~M.is_placeholder(e["action"])))
    c = c.select("case_id", "e", "actual_actions", F.explode_outer(M.greedy_pairs(F.col("e"), F.col("actual_actions"))).alias("p"))
    return c.filter(F.col("p").isNotNull()).select(
        "case_id",
        F.get(F.col("e"), F.col("p.e"))["action"].alias("expected"),
        F.get(F.col("actual_actions"), F.col("p.a"))["action"].alias("actual"),
    )


def _ok(f):
    return f"lower({sq(f'es[p.e + 1].{f}')}) = lower({sq(f'acts[p.a + 1].{f}')})"


def _counts(f, none):
    v = f"lower({sq(f'es[p.e + 1].{f}')})"
    return f"{v} <> '' and not regexp_matches({v}, '^tbd') and {v} <> '{none}'"


@query(
    "a19_recall_and_accuracy",
    oracle(
        f"""select g.case_id, len(g.es) as expected_count, len(g.pairs) as found_count, round(len(g.pairs) / len(g.es), 6) as recall, round(oo / nullif(oc, 0), 6) as owner_accuracy, round(dd / nullif(dc, 0), 6) as deadline_accuracy from greedy_out g left join (
        select case_id, count(*) filter ({_counts('owner', 'unassigned')}) as oc, count(*) filter ({_counts('owner', 'unassigned')} and {_ok('owner')}) as oo,
        count(*) filter ({_counts('deadline', 'no deadline stated')}) as dc, count(*) filter ({_counts('deadline', 'no deadline stated')} and {_ok('deadline')}) as dd
        from (select case_id, es, acts, unnest(pairs) as p from greedy_out) t group by 1) j on j.case_id = g.case_id"""
    ),
)
def a19(spark, sf):
    return M.score_actions(_cases(spark, sf))


# ---- J09, A18, U02 ---------------------------------------------------------------------------------------
LINES = {"expected_lines": "expected_actions", "actual_lines": "actual_actions"}


def _lines(spark, sf):
    """Action lines 'owner - action' as a scorer reads them."""
    c = _cases(spark, sf)
    made = {
        new: F.transform(
            F.col(old),
            lambda a: F.concat(F.lit("- [ ] "), F.when(a["owner"] != "", F.concat(a["owner"], F.lit(" - "))).otherwise(""), a["action"], F.lit(".")),
        )
        for new, old in LINES.items()
    }
    return c.select("case_id", *[v.alias(k) for k, v in made.items()])


def line_keys(column: str) -> str:
    line = "'- [ ] ' || case when owner <> '' then owner || ' - ' else '' end || action || '.'"
    return f"select distinct case_id, k from (select case_id, trim({steps_sql(f'lower(trim({line}))', C.EXACT_ACTION)}) as k from ({action_rows(column)}) x) y where k <> ''"


cte("e_keys", line_keys("expected_actions"))
cte("a_keys", line_keys("actual_actions"))
cte(
    "key_join",
    "select coalesce(e.case_id, a.case_id) as case_id, coalesce(e.k, a.k) as k, e.k is not null as in_e, a.k is not null as in_a from e_keys e full join a_keys a on a.case_id = e.case_id and a.k = e.k",
)
cte(
    "key_counts",
    "select c.case_id, count(*) filter (in_e) as ne, count(*) filter (in_a) as na, count(*) filter (in_e and in_a) as nm from cases c left join key_join j on j.case_id = c.case_id group by 1",
)
cte(
    "key_rates",
    "select *, case when ne = 0 and na = 0 then 1.0 when na > 0 then nm / na else 0.0 end as p, case when ne = 0 and na = 0 then 1.0 when ne > 0 then nm / ne else 1.0 end as r from key_counts",
)


@query(
    "a18_precision_recall_f1",
    oracle(
        """select case_id, case when p >= 0.8 and r >= 0.8 then 'PASS' else 'FAIL' end as status, ne as expected_count, na as actual_count, nm as matched_count, ne - nm as missing_count, na - nm as unexpected_count,
        round(p, 4) as precision, round(r, 4) as recall, round(case when ne = 0 and na = 0 then 1.0 when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 4) as f1 from key_rates"""
    ),
)
def a18(spark, sf):
    return M.exact_scores(_lines(spark, sf))


@query(
    "j09_exact_norm_set_match",
    oracle("select case_id, count(*) filter (in_e and in_a) as matched, count(*) filter (in_e and not in_a) as missing, count(*) filter (not in_e) as unexpected from key_join group by 1"),
)
def j09(spark, sf):
    lines = _lines(spark, sf)
    e = rows(lines, F.col("expected_lines"), ["case_id"], "item")
    a = rows(lines, F.col("actual_lines"), ["case_id"], "item")
    return M.full_outer_keys(e, a)


@query(
    "u02_intersect_except",
    oracle("select case_id, case when in_e and in_a then 'matched' when in_e then 'missing' else 'unexpected' end as part, k as key from key_join"),
)
def u02(spark, sf):
    return M.set_parts(_lines(spark, sf))


# ---- A17, P26 ----------------------------------------------------------------------------------------------
LINE = lit(r"^(?:([A-Z][A-Za-z ]{0,40}?) - )?(.*?)(?: \(due: ([^)]*)\))?\.?$")
cte(
    "stored_lines",
    f"select doc_id, ord, regexp_extract(trim(s), {LINE}, 1) as owner, trim(regexp_extract(trim(s), {LINE}, 2)) as task, regexp_extract(trim(s), {LINE}, 3) as due from ({list_rows('action_items')}) w",
)


@query(
    "a17_coverage_ratios",
    oracle(
        f"""select doc_id, round(count(*) filter (trim(owner) <> '') / count(*), 6) as owner_coverage, round(count(*) filter (trim(due) <> '') / count(*), 6) as due_coverage,
        count(*) filter (k <> '') - count(distinct k) filter (k <> '') as duplicates from (select *, {spaced('task')} as k from stored_lines) t group by 1"""
    ),
)
def a17(spark, sf):
    r = notes_records(standin(spark, sf, "records"))
    return r.select("doc_id", *M.coverage(F.transform("action_items", T.parse_action_line)))


@query(
    "p26_case_selection",
    oracle(
        """select c.case_id, reason, reason = '' as selected from (select c.case_id, case when c.category = 'long' then 'not_selected' when ground_truth_status <> 'complete' then 'ground_truth_incomplete'
        when coalesce(t.text, '') = '' then 'no_transcript' else '' end as reason from cases c join transcripts t on t.doc_id = c.case_id) c"""
    ),
)
def p26(spark, sf):
    cases = standin(spark, sf, "cases").select("case_id", "category", "ground_truth_status")
    talk = standin(spark, sf, "transcripts").select(
        F.col("doc_id").alias("case_id"), (F.coalesce("text", F.lit("")) != "").alias("has_text")
    )
    wanted = cases.filter(F.col("category") != "long").select("case_id")
    return M.select_cases(cases.join(talk, "case_id"), wanted, F.col("has_text"))
