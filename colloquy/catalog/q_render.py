"""Summaries, payloads, views and the remaining array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_first import TOPIC_SQL, greedy_sql, line_confidence_sql, clean_one_sql, summary_sql, tokens_sql
from colloquy.catalog.q_guards import _records
from colloquy.catalog.q_match import _cases, action_rows
from colloquy.catalog.q_second import ordlist
from colloquy.catalog.q_signals import deduped
from colloquy.catalog.q_text import SENTS, _docs, _talk, sq, wc
from colloquy.catalog.q_third import list_rows, pipe
from colloquy.functions import text as T
from colloquy.functions.arrays import rows
from colloquy.operators import points as P, render as N, sentences as S
from colloquy.plans.legacy import legacy_clean
from colloquy.sources import readers as R
from colloquy.sources.standins import given, standin


# ---- X24, S18 ---------------------------------------------------------------------------------
LEAD = """select {id}, coalesce((select string_agg(b, ' ' order by i) from (select trim(substr(x, 3)) as b, i from (select unnest(ls) as x, generate_subscripts(ls, 1) as i) z where x like '- %' or x like '* %' qualify row_number() over (order by i) <= 3) q),
    (select string_agg(b, ' ' order by i) from (select trim(x) as b, i from (select unnest(ss) as x, generate_subscripts(ss, 1) as i) z where trim(x) <> '' qualify row_number() over (order by i) <= 3) q), '') as summary from (
    select {id}, ls, string_split(regexp_replace(array_to_string(ls, ' '), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) as ss from (
      select {id}, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as ls from {src}) a) b"""


@query(
    "x24_lead_summary",
    oracle(
        "select 'd' as kind, * from (" + LEAD.format(id="doc_id", src="documents") + ") d union all select 'p', * from (" + LEAD.format(id="page_id", src="(select page_id, html as text from pages)") + ") p union all select 't', * from (" + LEAD.format(id="doc_id", src="transcripts") + ") t"
    ),
)
def x24(spark, sf):
    lead = lambda c: N.lead_summary(F.col(c)).alias("summary")
    d = _docs(spark, sf).select(F.lit("d").alias("kind"), "doc_id", lead("text"))
    p = given(spark, sf, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("doc_id"), lead("html"))
    t = _talk(spark, sf).select(F.lit("t").alias("kind"), "doc_id", lead("text"))
    return d.unionByName(p).unionByName(t)


cte("latest_talk", "select * from (select *, row_number() over (partition by user_id order by created_at desc, doc_id desc) as rn from transcripts) t where rn = 1")


@query("s18_derived_summary_insert", oracle("select user_id, 'simple' as model, summary from (" + LEAD.format(id="user_id", src="latest_talk") + ") s"))
def s18(spark, sf):
    talk = _talk(spark, sf).select("user_id", "doc_id", "created_at", "text")
    last = R.latest_rows(talk, ["user_id"], ["created_at", "doc_id"])
    return last.select("user_id", F.lit("simple").alias("model"), N.lead_summary(F.col("text")).alias("summary"))


@query(
    "j20_transcript_summary_view",
    oracle(
        "select t.user_id, left(coalesce(t.text, ''), 800) || '…' as snippet, s.summary from latest_talk t left join (select user_id, arg_max(summary, id) as summary from notes_raw group by 1) s on s.user_id = t.user_id"
    ),
)
def j20(spark, sf):
    talk = _talk(spark, sf).select("user_id", "doc_id", "created_at", F.substring(F.coalesce("text", F.lit("")), 1, 800).alias("text"))
    last = R.latest_rows(talk, ["user_id"], ["created_at", "doc_id"])
    summaries = standin(spark, sf, "notes_raw").groupBy("user_id").agg(F.max_by("summary", "id").alias("summary"))
    return last.join(summaries, "user_id", "left").select("user_id", F.concat("text", F.lit("…")).alias("snippet"), "summary")


# ---- S19, J18 -------------------------------------------------------------------------------------
FILES = """select concat('m', cast(doc_id - doc_id % 4 as varchar(20))) as dir, concat(cast(100000 + doc_id as varchar(20)), case when doc_id % 4 = 3 or doc_id % 40 < 4 then '.png' when doc_id % 3 = 0 then '.md' else '.txt' end) as name, text from {documents}"""
cte("dir_files", FILES.format(documents="documents"))


@query(
    "s19_directory_text_gather",
    oracle(
        "select d.dir, coalesce(t.text, 'No readable content found.') as text from (select distinct dir from dir_files) d left join (select dir, string_agg(text, chr(10) || chr(10) order by case when name like '%.txt' then 0 else 1 end, name) as text from dir_files where name not like '%.png' group by 1) t on t.dir = d.dir"
    ),
)
def s19(spark, sf):
    return R.gather_directories(spark.sql(FILES, documents=given(spark, sf, "documents")))


@query(
    "j18_slide_text_enrich",
    oracle(
        f"select doc_id, 'transcript' as source, pos, s as sentence from local_sents union all select doc_id, 'slide', row_number() over (partition by doc_id order by ord), trim(s) from (select doc_id, generate_subscripts(l, 1) as ord, unnest(l) as s from (select doc_id, string_split(regexp_replace(replace(replace({sq('summary')}, '•', '. '), ' - ', '. '), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) as l from records) a) b where trim(s) <> ''"
    ),
)
def j18(spark, sf):
    r = _records(spark, sf)
    talk = rows(r, S.sentences_local(F.col("text")), ["doc_id"], "sentence").withColumn("source", F.lit("transcript"))
    slides = rows(r, S.sentences_local(F.col("summary")), ["doc_id"], "sentence").withColumn("source", F.lit("slide"))
    return talk.unionByName(slides)


# ---- W14, W19, U03 ---------------------------------------------------------------------------------
def _chunks():
    segment = lambda s, i: F.struct((i * 5.0).alias("start"), (i * 5.0 + 4.0).alias("end"), s.alias("text"))
    chunk = lambda offset, text, language, items: F.struct(
        F.lit(float(offset)).alias("offset"), text.alias("text"), language.alias("language"), F.transform(items, segment).alias("segments")
    )
    none = F.lit(None).cast("string")
    lang = F.when(F.col("doc_id") % 2 == 0, "en").otherwise(none)
    return F.array(
        chunk(0, F.col("summary"), none, F.col("key_points")), chunk(600, F.lit(" "), lang, F.col("risks")), chunk(1200, F.col("outcome"), F.lit("fr"), F.col("decisions"))
    )


def _seg(column: str, offset: int, chunk: int) -> str:
    return f"select doc_id, {chunk} as c, ord, {offset} + (ord - 1) * 5.0 as st, s from ({list_rows(column)}) w{chunk}"


@query(
    "w14_segment_offset_merge",
    oracle(
        f"""select r.doc_id, concat_ws(chr(10) || chr(10), nullif(trim(r.summary), ''), nullif(trim(r.outcome), '')) as text, case when r.doc_id % 2 = 0 then 'en' else 'fr' end as language, g.n as segments, g.starts as starts, g.texts as texts from records r join (
        select doc_id, count(*) as n, string_agg(cast(cast(st as bigint) as varchar), ',' order by c, ord) as starts, string_agg(s, '|' order by c, ord) as texts from ({_seg('key_points', 0, 0)} union all {_seg('risks', 600, 1)} union all {_seg('decisions', 1200, 2)}) z group by 1) g on g.doc_id = r.doc_id"""
    ),
)
def w14(spark, sf):
    out = _records(spark, sf).select("doc_id", N.merge_segments(_chunks()).alias("t"))
    return out.select(
        "doc_id", "t.text", "t.language", F.size("t.segments").alias("segments"),
        F.array_join(F.transform("t.segments", lambda s: s["start"].cast("long").cast("string")), ",").alias("starts"),
        pipe(F.transform("t.segments", lambda s: s["text"])).alias("texts"),
    )


KEYWORDS = {"purpose": 1, "decided": 1, "risk": 1, "pilot": 1, "lane": 1, "review": 1}
_SC = " + ".join(f"case when contains(lower(s), '{k}') then {v} else 0 end" for k, v in KEYWORDS.items())
cte(
    "context_pick",
    deduped(f"select doc_id, ord, s from (select doc_id, case when pos <= 4 then pos else 1000000 - sc * 10000 + pos end as ord, s, pos, sc from (select *, {_SC} as sc from signal_sents) a) b where pos <= 4 or sc > 0", f"lower({sq('s')})", 8),
)


@query("w19_context_block", oracle("select t.doc_id, coalesce(left(v, 400), '') as block from transcripts t left join (select doc_id, string_agg(s, ' ' order by pos) as v from context_pick group by 1) c on c.doc_id = t.doc_id"))
def w19(spark, sf):
    block = N.context_block(S.sentences_signal(F.col("text")), KEYWORDS, 4, 8, 400)
    return _talk(spark, sf).select("doc_id", block.alias("block"))


@query(
    "u03_distinct_struct_union",
    oracle(
        f"""select case_id, row_number() over (partition by case_id order by o) as pos, owner, action, deadline from (select case_id, owner, action, deadline, min(o) as o from (
        select case_id, ord as o, owner, action, deadline from ({action_rows('actual_actions')}) a union all select case_id, 100 + ord, owner, action, deadline from ({action_rows('expected_actions')}) b union all select case_id, 200 + ord, owner, action, deadline from ({action_rows('actual_actions')}) c) t group by 1, 2, 3, 4) u"""
    ),
)
def u03(spark, sf):
    merged = F.array_distinct(F.concat("actual_actions", "expected_actions", "actual_actions"))
    out = rows(_cases(spark, sf), merged, ["case_id"], "a")
    return out.select("case_id", "pos", "a.owner", "a.action", "a.deadline")


# ---- X26, X27, X31, X33 ----------------------------------------------------------------------------------
def sentence_sql(x: str) -> str:
    b = f"regexp_replace(trim({x}), '[. ]+$', '')"
    return f"case when {b} = '' then '' else {b} || '.' end"


MK = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9 ]+', '', 'g'), '\\s+', ' ', 'g')"


@query(
    "x26_summary_compose",
    oracle(
        f"""select r.doc_id, concat_ws(' ', nullif(case when r.purpose <> '' then {sentence_sql('r.purpose')} end, ''), nullif(case when r.outcome <> '' and {MK.format('r.outcome')} <> {MK.format('r.purpose')} then {sentence_sql('r.outcome')} end, ''),
        case when d.v is not null then {sentence_sql("'Key decisions included ' || d.v")} end, case when n.n > 0 then cast(n.n as varchar) || ' validated action items were captured.' end) as summary from records r
        left join (select doc_id, string_agg(s, '; ' order by ord) as v from ({list_rows('decisions')}) w where ord <= 2 group by 1) d on d.doc_id = r.doc_id left join (select doc_id, count(*) as n from ({list_rows('action_items')}) w group by 1) n on n.doc_id = r.doc_id"""
    ),
)
def x26(spark, sf):
    r = _records(spark, sf)
    return r.select("doc_id", N.compose_summary(F.col("purpose"), F.col("outcome"), F.col("decisions"), F.size("action_items")).alias("summary"))


@query(
    "x27_push_payload",
    oracle(
        """select m.id, to_json({'meeting': {'id': m.id, 'title': m.title, 'status': coalesce(m.status, '')}, 'summary': {'raw_md': coalesce(s.raw_md, '')}, 'blocks': [{'type': 'paragraph', 'content': case when length(coalesce(s.raw_md, '')) > 40 then left(s.raw_md, 40) || '…' else coalesce(s.raw_md, '') end}]}) as payload
        from meetings m left join (select doc_id as id, summary || ' ' || purpose as raw_md from records) s on s.id = m.id"""
    ),
)
def x27(spark, sf):
    m = standin(spark, sf, "meetings").select("id", "title", F.coalesce("status", F.lit("")).alias("status"))
    s = _records(spark, sf).select(F.col("doc_id").alias("id"), F.concat_ws(" ", "summary", "purpose").alias("raw_md"))
    joined = m.join(s, "id", "left").withColumn("raw_md", F.coalesce("raw_md", F.lit("")))
    return N.push_payload(joined.drop("raw_md"), joined.select("id", "raw_md"), 40)


@query(
    "x31_truncated_summary",
    oracle(
        """select doc_id, case when length(b) <= 500 then b else left(b, 497) || '...' end as summary from (select doc_id, case when trim(s) <> '' then trim(coalesce(text, '') || chr(10) || chr(10) || '[Slides OCR]' || chr(10) || s) else coalesce(text, '') end as b from (select doc_id, text, case when doc_id % 2 = 0 then summary else '' end as s from records) a) t"""
    ),
)
def x31(spark, sf):
    slides = F.when(F.col("doc_id") % 2 == 0, F.col("summary")).otherwise("")
    return _records(spark, sf).select("doc_id", N.truncated_summary(F.col("text"), slides).alias("summary"))


@query(
    "x33_corpus_bullets",
    oracle(
        """select user_id, coalesce(v, '- No transcript or OCR text available.') as bullets from (select user_id, (select string_agg('- ' || left(x, 160), chr(10) order by i) from (select trim(x) as x, i from (select unnest(ls) as x, generate_subscripts(ls, 1) as i) y where trim(x) <> '' qualify row_number() over (order by i) <= 8) z) as v from (
        select user_id, string_split(left(string_agg(coalesce(text, ''), chr(10) || chr(10) order by created_at, doc_id), 8000), chr(10)) as ls from transcripts group by 1) a) b"""
    ),
)
def x33(spark, sf):
    return N.corpus_bullets(_talk(spark, sf), "user_id", ["created_at", "doc_id"])


# ---- X32 -----------------------------------------------------------------------------------------------------
def cleaned_list(column: str) -> str:
    return f"select doc_id, ord, {clean_one_sql('s')} as s from ({list_rows(column)}) w where trim(s) <> ''"


cte("x32_points", greedy_sql(cleaned_list("key_points"), ["s"], tokens_sql("s"), 8))
cte("x32_kept", greedy_sql(cleaned_list("action_items"), ["s"], tokens_sql("s"), 7))
cte("x32_scored", f"select *, {line_confidence_sql('s')} as sc from x32_kept")
cte("x32_good", "select *, count(*) over (partition by doc_id) as n from x32_scored where sc >= 2")
cte("x32_summary", summary_sql("select * from x32_points"))


@query(
    "x32_legacy_notes_clean",
    oracle(
        f"""select r.doc_id, case when {clean_one_sql('r.summary')} <> '' then {clean_one_sql('r.summary')} else coalesce(s.summary, '') end as summary, coalesce(p.v, '') as key_points, coalesce(a.v, '') as action_items from records r
        left join x32_summary s on s.doc_id = r.doc_id left join ({ordlist('x32_points', 'pos')}) p on p.doc_id = r.doc_id left join (select doc_id, string_agg(s, '|' order by pos) as v from x32_good where n > 1 or sc >= 3 group by 1) a on a.doc_id = r.doc_id"""
    ),
)
def x32(spark, sf):
    out = legacy_clean(_records(spark, sf))
    return out.select("doc_id", "summary", pipe(F.col("key_points")).alias("key_points"), pipe(F.col("action_items")).alias("action_items"))
