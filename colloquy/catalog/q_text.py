"""Sentence, section, chunk and text-function queries over transcripts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.functions import lexicons as L, text as T
from colloquy.functions.arrays import rows
from colloquy.operators import sentences as S
from colloquy.sources.standins import documents, given, standin


# ---- SQL spellings of the shared steps --------------------------------------------------
def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def edges(x: str, chars: str = "[ \\-–—•\\t]+") -> str:
    return f"regexp_replace({x}, '^{chars}|{chars}$', '', 'g')"


def cleaned(x: str) -> str:
    return edges(sq(x))


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def has(x: str, cues) -> str:
    return f"regexp_matches(lower({x}), {lit(L.any_text(cues))})"


def like_any(x: str, patterns) -> str:
    return f"regexp_matches(lower({x}), {lit(L.any_of(patterns))})"


def content_key(x: str) -> str:
    inner = f"regexp_replace(lower({cleaned(x)}), '[^a-z0-9]+', ' ', 'g')"
    return sq(f"regexp_replace({inner}, {lit(L.any_word(L.V3_KEY_STOP))}, ' ', 'g')")


def pieces(x: str) -> str:
    """Split after a sentence end or at line breaks."""
    return f"string_split_regex(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')"


def wc(x: str) -> str:
    return f"len(list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> ''))"


def stop_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def token_list(x: str, pattern: str, stop, min_len: int = 1) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({x}), {lit(pattern)})), "
        f"lambda w: not list_contains({stop_list(stop)}, w) and length(w) >= {min_len})"
    )


def sorted_key(x: str, stop=L.SIGNAL_STOP, min_len: int = 2) -> str:
    return f"array_to_string(list_sort({token_list(x, '[a-z0-9]+', stop, min_len)}), ' ')"


def stripped(x: str, stop=L.MERGE_STOP) -> str:
    bare = (
        f"list_transform(string_split_regex(lower(trim({x})), '\\s+'), "
        "lambda w: regexp_replace(w, '^[.,:;!?()\\[\\]{}]+|[.,:;!?()\\[\\]{}]+$', '', 'g'))"
    )
    return f"list_filter(list_distinct({bare}), lambda w: w <> '' and not list_contains({stop_list(stop)}, w))"


def overlap_sql(a: str, b: str) -> str:
    return (
        f"case when least(len({a}), len({b})) = 0 then 0.0 "
        f"else len(list_intersect({a}, {b})) / least(len({a}), len({b})) end"
    )


# ---- sentence sub-queries ---------------------------------------------------------------
cte(
    "raw_pieces",
    f"""select doc_id, unnest(l) as piece, generate_subscripts(l, 1) as ord from (select doc_id, {pieces("coalesce(text, '')")} as l from transcripts) x""",
)
cte(
    "doc_pieces",
    f"""select doc_id, unnest(l) as piece, generate_subscripts(l, 1) as ord from (select doc_id, {pieces("coalesce(text, '')")} as l from documents) x""",
)


def numbered(source: str, expr: str, keep: str) -> str:
    """Pieces after ``expr``, those that pass ``keep``, numbered from 1 in text order."""
    return f"""select doc_id, row_number() over (partition by doc_id order by ord) as pos, s from (select doc_id, ord, {expr} as s from {source}) y where {keep}"""


cte("signal_sents", numbered("raw_pieces", sq("piece"), "len(string_split(s, ' ')) >= 4"))
cte("doc_sents", numbered("doc_pieces", sq("piece"), "len(string_split(s, ' ')) >= 4"))
cte(
    "statement_sents",
    numbered("raw_pieces", "regexp_replace(piece, '^\\s+|\\s+$', '', 'g')", "s <> ''"),
)
cte(
    "slot_sents",
    numbered("raw_pieces", sq(edges("piece", "[ \\-•\\t]+")), "s <> ''"),
)
cte(
    "local_sents",
    f"""select doc_id, row_number() over (partition by doc_id order by ord) as pos, trim(s) as s from (
    select doc_id, unnest(l) as s, generate_subscripts(l, 1) as ord from (select doc_id, string_split(regexp_replace(replace(replace({sq("coalesce(text, '')")}, '•', '. '), ' - ', '. '), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) as l from transcripts) x) y where trim(s) <> ''""",
)


def owner_v3_sql(x: str) -> str:
    v = f"trim(regexp_replace({cleaned(x)}, '(?i)^(owner|assignee)\\s*:\\s*', ''))"
    names = ", ".join(f"'{n}'" for n in ("",) + L.V3_GENERIC_OWNERS + L.V3_NOT_OWNERS)
    return f"case when lower({v}) in ({names}) then 'Unassigned' when lower({v}) in ('team', 'the team') then 'Team' else upper(left({v}, 1)) || substr({v}, 2) end"


def spoken_cte(source: str) -> str:
    sp = lit(T.SPEAKER_V3)
    return f"""select doc_id, row_number() over (partition by doc_id order by ord, sub) as pos, s from (
    select *, row_number() over (partition by doc_id, k order by ord, sub) as rn from (
    select doc_id, ord, sub, s, {content_key('s')} as k from (
      select doc_id, ord, sub, case when sp = '' or regexp_matches(p, '^[A-Z][A-Za-z .''-]{{1,40}}\\s*:') then p else ow || ': ' || p end as s from (
        select doc_id, ord, sp, ow, generate_subscripts(parts, 1) as sub, {cleaned('unnest(parts)')} as p from (
          select doc_id, ord, sp, {owner_v3_sql('sp')} as ow, string_split(regexp_replace(case when sp <> '' then {cleaned(f"regexp_extract(line, {sp}, 2)")} else line end, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) as parts from (
            select doc_id, ord, line, regexp_extract(line, {sp}, 1) as sp from (select doc_id, generate_subscripts(l, 1) as ord, {cleaned('unnest(l)')} as line from (select doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') as l from {source}) a) b where line <> '') c) d) e where p <> '') f) g where k <> '') h where rn = 1"""


cte("spoken_sents", spoken_cte("transcripts"))
cte("clean_sents_in", "select doc_id, ord as pos, piece as s from raw_pieces")


def _docs(spark, sf):
    return documents(spark, sf)


def _talk(spark, sf):
    return standin(spark, sf, "transcripts")


SENTS = "select doc_id, pos, s as sentence from "


@query("x01_sentence_split", oracle(SENTS + "signal_sents"))
def x01(spark, sf):
    return rows(_talk(spark, sf), S.sentences_signal(F.col("text")), ["doc_id"], "sentence")


@query("x01_sentence_split_documents", oracle(SENTS + "doc_sents"))
def x01_docs(spark, sf):
    return rows(_docs(spark, sf), S.sentences_signal(F.col("text")), ["doc_id"], "sentence")


@query("x01_statements", oracle(SENTS + "statement_sents"))
def x01_statements(spark, sf):
    return rows(_talk(spark, sf), S.statements(F.col("text")), ["doc_id"], "sentence")


@query("x01_slot_sentences", oracle(SENTS + "slot_sents"))
def x01_slot(spark, sf):
    return rows(_talk(spark, sf), S.sentences_slot(F.col("text")), ["doc_id"], "sentence")


@query("x01_local_sentences", oracle(SENTS + "local_sents"))
def x01_local(spark, sf):
    return rows(_talk(spark, sf), S.sentences_local(F.col("text")), ["doc_id"], "sentence")


@query("x01_spoken_sentences", oracle(SENTS + "spoken_sents"))
def x01_spoken(spark, sf):
    return rows(_talk(spark, sf), S.sentences_spoken(F.col("text")), ["doc_id"], "sentence")


# ---- normalization ----------------------------------------------------------------------
def _noise_sql(x: str) -> str:
    out = f"translate({x}, '’‘“”–—' || chr(160), '''''\"\"-- ')"
    for table in (L.ACRONYMS, L.NOISE_PHRASES):
        for a, b in table.items():
            out = f"regexp_replace({out}, '(?i){L.any_text([a])}', '{b}', 'g')"
    for p, b in L.SPACED_ACRONYMS.items():
        out = f"regexp_replace({out}, '(?i){p}', '{b}', 'g')"
    for p in L.NOISE:
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    return f"coalesce({sq(f"regexp_replace({out}, '[|]+', '. ', 'g')")}, '')"


@query(
    "f01_transcript_noise_normalize",
    oracle(
        f"select 't' as kind, doc_id, {_noise_sql('text')} as clean_text from transcripts union all select 'd', doc_id, {_noise_sql('text')} from documents"
    ),
)
def f01(spark, sf):
    clean = T.noise_normalize(F.col("text")).alias("clean_text")
    a = _talk(spark, sf).select(F.lit("t").alias("kind"), "doc_id", clean)
    return a.unionByName(_docs(spark, sf).select(F.lit("d").alias("kind"), "doc_id", clean))


def _ws_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    "f02_whitespace_normalize",
    oracle(
        f"select 'd' as kind, doc_id as id, {_ws_sql('text')} as clean_text from documents union all select 'p', page_id, {_ws_sql('html')} from pages"
    ),
)
def f02(spark, sf):
    a = _docs(spark, sf).select(
        F.lit("d").alias("kind"),
        F.col("doc_id").alias("id"),
        T.whitespace_normalize(F.col("text")).alias("clean_text"),
    )
    b = given(spark, sf, "pages").select(
        F.lit("p").alias("kind"),
        F.col("page_id").alias("id"),
        T.whitespace_normalize(F.col("html")).alias("clean_text"),
    )
    return a.unionByName(b)


def _speaker_noise_sql(x: str) -> str:
    steps = [
        ("(?i)^(?:and|but|so)\\s+", ""),
        ("^(?:[A-Z][a-z]+,\\s*)+", ""),
        ("(?i)^(?:[A-Z][a-z]+,\\s*)?Decision\\s+\\d+[,\\s:-]*", ""),
        ("(?i)\\bto will\\b", "will"),
        ("(?i)\\bI would also us to confirm\\b", "We should confirm"),
        ("(?i)\\b[A-Z][a-z]+, agreed\\.?$", ""),
        ("^[ ,.\\-]+|[ ,.\\-]+$", ""),
    ]
    for p, r in steps:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


def clean_sentence_sql(x: str) -> str:
    """The look-ahead step of the speaker noise is implied by the following wider one."""
    a = f"regexp_replace({sq(x)}, {lit(L.FILLERS)}, '', 'g')"
    a = sq(_speaker_noise_sql(a))
    a = f"regexp_replace({a}, '\\s+([,.;:!?])', '\\1', 'g')"
    return edges(a, "[ \\-•\\t]+")


cte(
    "clean_sents",
    f"""select doc_id, row_number() over (partition by doc_id order by ord) as pos, case when regexp_matches(s, '^[a-z]') then upper(left(s, 1)) || substr(s, 2) else s end as s from (
    select doc_id, ord, {clean_sentence_sql('piece')} as s from raw_pieces) x where s <> ''""",
)


@query("f13_sentence_clean", oracle(SENTS + "clean_sents"))
def f13(spark, sf):
    return rows(_talk(spark, sf), S.sentences_clean(F.col("text")), ["doc_id"], "sentence")


# ---- token sets and similarities ----------------------------------------------------------
@query(
    "f04_token_sets",
    oracle(
        f"""select doc_id, pos, array_to_string(list_sort({token_list('s', "[a-z0-9']+", L.POINT_STOP, 3)}), ' ') as point_tokens,
        {sorted_key('s')} as signal_tokens, array_to_string(list_sort({stripped('s')}), ' ') as merge_tokens from doc_sents"""
    ),
)
def f04(spark, sf):
    sents = rows(_docs(spark, sf), S.sentences_signal(F.col("text")), ["doc_id"], "s")
    s = F.col("s")
    return sents.select(
        "doc_id",
        "pos",
        F.array_join(F.sort_array(T.point_tokens(s)), " ").alias("point_tokens"),
        T.sorted_token_key(s).alias("signal_tokens"),
        F.array_join(F.sort_array(T.stripped_tokens(s)), " ").alias("merge_tokens"),
    )


EVAL_STOP = (
    "a", "an", "the", "and", "or", "to", "of", "in", "on", "for", "with", "by", "is", "are",
    "be", "will",
)

# each sentence of a transcript against the one before it
cte(
    "sent_pairs",
    "select a.doc_id, a.pos, a.s as a, b.s as b from signal_sents a join signal_sents b on a.doc_id = b.doc_id and b.pos = a.pos + 1",
)


# the token lists once per sentence, not once per pair
cte(
    "sent_tokens",
    f"""select doc_id, pos, lower({sq('s')}) as low, {stripped('s')} as merged, {token_list('s', "[a-z0-9']+", L.POINT_STOP, 3)} as pointed,
    {token_list('s', '[a-z0-9]+', EVAL_STOP)} as judged from signal_sents""",
)
cte(
    "token_pairs",
    "select a.doc_id, a.pos, a.low as la, b.low as lb, a.merged as ma, b.merged as mb, a.pointed as pa, b.pointed as pb, a.judged as ja, b.judged as jb from sent_tokens a join sent_tokens b on a.doc_id = b.doc_id and b.pos = a.pos + 1",
)


def _pairs(spark, sf):
    s = S.sentences_signal(F.col("text"))
    docs = _talk(spark, sf).select("doc_id", s.alias("ss"))
    # neighbours inside the row: the array against itself moved by one
    moved = F.zip_with(
        F.col("ss"),
        F.slice("ss", 2, 2147483646),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    out = docs.select("doc_id", F.posexplode(moved).alias("pos", "p"))
    return out.filter(F.col("p.b").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "p.a", "p.b"
    )


@query(
    "f05_overlap_coefficient",
    oracle(
        f"""select doc_id, pos, round(case when la = '' or lb = '' then 0.0 when contains(lb, la) or contains(la, lb) then 1.0 else {overlap_sql('ma', 'mb')} end, 6) as similarity,
        round({overlap_sql('pa', 'pb')}, 6) as point_overlap from token_pairs"""
    ),
)
def f05(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf).select(
        "doc_id",
        "pos",
        F.round(T.text_similarity(a, b), 6).alias("similarity"),
        F.round(T.overlap(T.point_tokens(a), T.point_tokens(b)), 6).alias("point_overlap"),
    )


@query(
    "f06_token_recall",
    oracle(
        "select doc_id, pos, case when len(ja) = 0 then 1.0 else round(len(list_intersect(ja, jb)) / len(ja), 6) end as recall from token_pairs"
    ),
)
def f06(spark, sf):
    ea = T.token_set(F.col("a"), "[a-z0-9]+", EVAL_STOP)
    eb = T.token_set(F.col("b"), "[a-z0-9]+", EVAL_STOP)
    return _pairs(spark, sf).select("doc_id", "pos", F.round(T.recall(ea, eb), 6).alias("recall"))


# ---- statistics ---------------------------------------------------------------------------
WORD_SQL = r"[\p{L}\p{N}\p{M}_]+"


@query(
    "a09_transcript_stats",
    oracle(
        f"""select doc_id, length(text) as characters, w as words, ln as lines, w >= 7500 as is_long, w >= 15000 as is_very_long from (
        select *, len(regexp_extract_all(text, '{WORD_SQL}')) as w, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) as ln from documents) t"""
    ),
)
def a09(spark, sf):
    return _docs(spark, sf).select("doc_id", *S.transcript_stats(F.col("text")))


HEAD_SQL = lit(f"(?i){S.HEADING}")
cte(
    "talk_lines",
    """select doc_id, generate_subscripts(l, 1) as ln, unnest(l) as line from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10)) as l from transcripts) x""",
)
cte(
    "section_lines",
    f"""select *, sum(case when title <> '' then 1 else 0 end) over (partition by doc_id order by ln) as sec, max(case when title <> '' then 1 else 0 end) over (partition by doc_id) as any_head
    from (select *, regexp_extract(line, {HEAD_SQL}, 1) as title from talk_lines) x""",
)
cte(
    "sections",
    f"""select doc_id, idx, title, body as text, len(regexp_extract_all(body, '{WORD_SQL}')) as words, count(*) over (partition by doc_id) as n from (
    select doc_id, sec as idx, regexp_replace(trim(max(title)), '\\.+$', '') as title, trim(string_agg(line, chr(10) order by ln)) as body from section_lines where sec > 0 group by doc_id, sec
    union all select doc_id, 1, 'Full transcript', string_agg(line, chr(10) order by ln) from section_lines where any_head = 0 group by doc_id having string_agg(line, chr(10) order by ln) <> '') t""",
)


@query("w04_section_assign", oracle("select doc_id, idx, title, text, words from sections"))
def w04(spark, sf):
    out = _talk(spark, sf).select("doc_id", F.explode(S.sections(F.col("text"))).alias("s"))
    return out.select("doc_id", "s.*")


@query(
    "a10_section_metadata",
    oracle(
        """select t.doc_id, coalesce(c, 0) as section_count, coalesce(titles, '') as section_titles, coalesce(wcs, '') as section_word_counts, coalesce(c, 0) >= 3 as has_coverage, coalesce(cov, '') as coverage_indices
        from transcripts t left join (select doc_id, count(*) as c, string_agg(title, '|' order by idx) as titles, string_agg(cast(words as varchar), '|' order by idx) as wcs,
        string_agg(case when n <= 3 or idx in (1, (n - 1) // 2 + 1, n) then cast(idx as varchar) end, '|' order by idx) as cov from sections group by doc_id) s on s.doc_id = t.doc_id"""
    ),
)
def a10(spark, sf):
    out = _talk(spark, sf).select("doc_id", *S.section_metadata(F.col("text")))
    for c in ("section_titles", "section_word_counts", "coverage_indices"):
        out = out.withColumn(c, F.array_join(F.col(c).cast("array<string>"), "|"))
    return out


@query(
    "w05_begin_middle_end",
    oracle("select doc_id, idx, title from sections where n <= 3 or idx in (1, (n - 1) // 2 + 1, n)"),
)
def w05(spark, sf):
    picked = S.begin_middle_end(S.sections(F.col("text")))
    out = _talk(spark, sf).select("doc_id", F.explode(picked).alias("s"))
    return out.select("doc_id", "s.idx", "s.title")


cte(
    "covered_text",
    """select doc_id, string_agg(text, chr(10) order by idx) as text from sections where n <= 3 or idx in (1, (n - 1) // 2 + 1, n) group by doc_id having count(*) >= 3""",
)
cte("covered_spoken", spoken_cte("covered_text"))
cte(
    "covered_sents",
    f"""select doc_id, row_number() over (partition by doc_id order by part, pos) as pos, s from (
    select *, row_number() over (partition by doc_id, k order by part, pos) as rn from (select *, {content_key('s')} as k from (
    select doc_id, 0 as part, pos, s from covered_spoken union all select doc_id, 1, pos, s from spoken_sents) a) b) c where rn = 1""",
)


@query("w07_coverage_first_order", oracle(SENTS + "covered_sents"))
def w07(spark, sf):
    return rows(_talk(spark, sf), S.covered_sentences(F.col("text")), ["doc_id"], "sentence")


# ---- chunks ------------------------------------------------------------------------------
cte(
    "doc_words",
    """select doc_id, unnest(l) as w, generate_subscripts(l, 1) as i, len(l) as n from (select doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') as l from documents) x""",
)


@query(
    "w01_word_chunks",
    oracle(
        """select doc_id, (i - 1) // 900 + 1 as chunk, min(i) - 1 as start_word, max(i) as end_word, string_agg(w, ' ' order by i) as text from doc_words group by 1, 2"""
    ),
)
def w01(spark, sf):
    out = _docs(spark, sf).select("doc_id", F.explode(S.word_chunks(F.col("text"))).alias("c"))
    return out.select("doc_id", "c.*")


# the running sum that resets: a fold over the sentence lengths of a document
cte(
    "doc_local_sents",
    f"""select doc_id, row_number() over (partition by doc_id order by ord) as pos, trim(s) as s from (
    select doc_id, unnest(l) as s, generate_subscripts(l, 1) as ord from (select doc_id, string_split(regexp_replace(replace(replace({sq('text')}, '•', '. '), ' - ', '. '), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) as l from documents) x) y where trim(s) <> ''""",
)
cte(
    "doc_fold",
    """select doc_id, list_reduce(list_prepend([0, 0, 0], list_transform(lens, lambda x: [x, 0, 0])), lambda acc, x:
      case when acc[3] = 0 or acc[1] + x[1] <= 1800 then list_concat([acc[1] + x[1], acc[2], acc[3] + 1], list_concat(acc[4:], [acc[2]]))
           else list_concat([x[1], acc[2] + 1, acc[3] + 1], list_concat(acc[4:], [acc[2] + 1])) end) as f
    from (select doc_id, list(length(s) order by pos) as lens from doc_local_sents group by doc_id) t""",
)
cte(
    "doc_chunked",
    "select s.doc_id, s.pos, s.s, f[3 + s.pos] + 1 as chunk from doc_local_sents s join doc_fold d on d.doc_id = s.doc_id",
)


@query(
    "w02_char_budget_chunks",
    oracle(
        "select doc_id, chunk, count(*) as sentences, sum(length(s)) as characters, min(pos) as first_pos from doc_chunked group by 1, 2"
    ),
)
def w02(spark, sf):
    packed = S.budget_chunks(S.sentences_local(F.col("text")), 1800)
    out = _docs(spark, sf).select("doc_id", F.posexplode(packed).alias("pos", "c"))
    return out.groupBy("doc_id", F.col("c.chunk").alias("chunk")).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum(F.length("c.item")).alias("characters"),
        (F.min("pos") + 1).alias("first_pos"),
    )


cte(
    "doc_paras",
    """select doc_id, list_filter(list_transform(string_split_regex(text, '\\n{2,}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') as ps from documents""",
)
W03_SQL = """select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as chunk from (
  select doc_id, list_filter(f[2:] || [f[1]], lambda x: x <> '') as l from (
  select doc_id, list_reduce(list_prepend([''], list_transform(ps, lambda p: [p])), lambda acc, p:
    case when length(case when acc[1] <> '' then acc[1] || chr(10) || chr(10) || p[1] else p[1] end) <= 3500
           then list_concat([case when acc[1] <> '' then acc[1] || chr(10) || chr(10) || p[1] else p[1] end], acc[2:])
         when length(p[1]) <= 3500 then list_concat([p[1]], list_concat(acc[2:], [acc[1]]))
         else list_concat([''], list_concat(acc[2:], list_concat([acc[1]],
           list_transform(range(0, cast(ceil((length(p[1]) - 3500) / 3200.0) as bigint) + 1), lambda i: regexp_replace(substr(p[1], i * 3200 + 1, 3500), '^\\s+|\\s+$', '', 'g'))))) end) as f
  from doc_paras) t) u"""


@query("w03_paragraph_chunks", oracle(W03_SQL))
def w03(spark, sf):
    return rows(_docs(spark, sf), S.paragraph_chunks(F.col("text")), ["doc_id"], "chunk")


@query(
    "w06_representative_chunks",
    oracle(
        """select doc_id, array_to_string(list_sort(list_distinct(list_filter([0, 1, 2, greatest(0, m - 1), m, least(l, m + 1), greatest(0, l - 2), greatest(0, l - 1), l], lambda i: i >= 0 and i <= l))), ',') as top,
        n as chunks from (select doc_id, max(chunk) as n, max(chunk) - 1 as l, max(chunk) // 2 as m from doc_chunked group by 1) t"""
    ),
)
def w06(spark, sf):
    ids = F.transform(S.budget_chunks(S.sentences_local(F.col("text"))), lambda c: c["chunk"])
    out = _docs(spark, sf).select("doc_id", F.array_max(ids).alias("chunks"))
    out = out.filter(F.col("chunks").isNotNull())
    return out.select(
        "doc_id",
        F.array_join(S.representative_indexes(F.col("chunks")).cast("array<string>"), ",").alias("top"),
        F.col("chunks").cast("long").alias("chunks"),
    )


# ---- word frequency, sentence score, ranking ----------------------------------------------
cte(
    "talk_fold",
    """select doc_id, list_reduce(list_prepend([0, 0, 0], list_transform(lens, lambda x: [x, 0, 0])), lambda acc, x:
      case when acc[3] = 0 or acc[1] + x[1] <= 300 then list_concat([acc[1] + x[1], acc[2], acc[3] + 1], list_concat(acc[4:], [acc[2]]))
           else list_concat([x[1], acc[2] + 1, acc[3] + 1], list_concat(acc[4:], [acc[2] + 1])) end) as f
    from (select doc_id, list(length(s) order by pos) as lens from local_sents group by doc_id) t""",
)
cte(
    "talk_chunked",
    "select s.doc_id, s.pos, s.s, f[3 + s.pos] + 1 as chunk from local_sents s join talk_fold d on d.doc_id = s.doc_id",
)
cte(
    "talk_words",
    f"""select doc_id, chunk, pos, w from (select doc_id, chunk, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9_-]+')) as w from talk_chunked) t where length(w) > 2 and not list_contains({stop_list(L.LOCAL_STOP)}, w)""",
)
cte("talk_freq", "select doc_id, chunk, w as word, count(*) as n from talk_words group by all")
CHUNK_CHARS = 300


def chunked(df):
    """(doc_id, chunk, pos, s) rows of local sentences packed to a small budget."""
    packed = S.budget_chunks(S.sentences_local(F.col("text")), CHUNK_CHARS)
    out = df.select("doc_id", F.posexplode(packed).alias("pos", "c"))
    return out.select(
        "doc_id", F.col("c.chunk").alias("chunk"), (F.col("pos") + 1).cast("long").alias("pos"), F.col("c.item").alias("s")
    )


@query("a11_chunk_word_frequency", oracle("select doc_id, chunk, word, n from talk_freq"))
def a11(spark, sf):
    tokens = chunked(_talk(spark, sf)).select(
        "doc_id", "chunk", F.explode(S.content_tokens(F.col("s"))).alias("word")
    )
    return tokens.groupBy("doc_id", "chunk", "word").agg(F.count(F.lit(1)).alias("n"))
