"""Scans, document formats, sinks and the JSON operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import cte, oracle
from colloquy.catalog.q_accounts import TS, stamp
from colloquy.catalog.q_guards import _records
from colloquy.catalog.q_match import _cases, action_rows
from colloquy.catalog.q_signals import CUE_SQL
from colloquy.catalog.q_text import _talk, lit
from colloquy.catalog.q_third import list_rows, pipe
from colloquy.functions.arrays import rows
from colloquy.operators import documents as D, signals as X
from colloquy.plans.records import as_list
from colloquy.session import fresh_path
from colloquy.sources import readers as R, sinks as K
from colloquy.sources.standins import STANDINS, given, standin
from colloquy.streaming.runner import drain_batches, query_home, stream_table


# ---- S01, S02, W12 ----------------------------------------------------------------------------
ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"


@query("s01_relational_scan", f"select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '{TS}') as o_orderdate from orders where o_totalprice > 1000")
def s01(spark, sf):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ORDERS_SCHEMA)
    out = R.scan(spark, f"{sf}/orders.parquet", schema).filter(F.col("o_totalprice") > 1000)
    return out.withColumn("o_orderdate", stamp("o_orderdate"))


@query(
    "s02_reflected_scan",
    f"select user_id, event_id, strftime(ts, '{TS}') as ts, event_type, value, props from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1",
)
def s02(spark, sf):
    out = R.latest_rows(given(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return out.withColumn("ts", stamp("ts"))


@query(
    "w12_latest_per_key",
    oracle("select meeting_id, id, summary, model_version from (select *, row_number() over (partition by meeting_id order by id desc) as rn from notes_raw) t where rn = 1"),
)
def w12(spark, sf):
    return R.latest_rows(standin(spark, sf, "notes_raw"), ["meeting_id"], ["id"]).select("meeting_id", "id", "summary", "model_version")


# ---- S03 - S06: documents as files ----------------------------------------------------------------
DOC = "doc_id bigint, bucket int, summary string, key_points array<string>, slots struct<purpose:string,outcome:string,risks:array<string>>"


def _document_files(spark, sf):
    """Notes documents written as JSON files under sixteen folders."""
    from pyspark.sql.types import StructType

    path = fresh_path(spark, "documents")
    docs = _records(spark, sf).select(
        "doc_id", (F.col("doc_id") % 16).cast("int").alias("bucket"), "summary", "key_points",
        F.struct("purpose", "outcome", "risks").alias("slots"),
    )
    docs.withColumn("folder", F.col("bucket")).write.partitionBy("folder").json(path)
    return R.read_documents(spark, path, StructType.fromDDL(DOC), "*.json", whole_file=False)


@query(
    "s03_json_documents",
    oracle("select doc_id, summary, key_points, purpose, outcome, coalesce(risks, '') as risks from records"),
)
def s03(spark, sf):
    out = _document_files(spark, sf)
    return out.select("doc_id", "summary", pipe(F.col("key_points")).alias("key_points"), "slots.purpose", "slots.outcome", pipe(F.col("slots.risks")).alias("risks"))


@query(
    "s04_manifest_driven_load",
    oracle("select r.doc_id, r.summary from records r join cases c on c.case_id = r.doc_id where ground_truth_status = 'complete'"),
)
def s04(spark, sf):
    docs = _document_files(spark, sf).withColumn(
        "folder_name", F.regexp_extract("file_path", r"(folder=\d+)/", 1)
    )
    manifest = standin(spark, sf, "cases").select(
        F.col("case_id").alias("doc_id"), "ground_truth_status", F.concat(F.lit("folder="), (F.col("case_id") % 16).cast("string")).alias("folder_name")
    )
    return R.load_manifest(manifest, docs, ["folder_name", "doc_id"]).select("doc_id", "summary")


@query("s05_glob_discovery", oracle("select 'folder=' || cast(doc_id % 16 as varchar) as folder, count(*) as documents from records group by 1"))
def s05(spark, sf):
    docs = _document_files(spark, sf)
    return docs.groupBy(F.regexp_extract("file_path", r"(folder=\d+)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("documents"))


# embedded text for some cases, candidate files for most
_KINDS = ("_transcript.md", "_source.txt", "_raw_transcript.txt", ".md", "_other.txt")
FILES_SQL = " union all ".join(
    f"select cast(o_orderkey as varchar(20)) as case_id, concat(cast(o_orderkey as varchar(20)), '{name}') as name, case when (o_orderkey + {k}) % 7 = 0 then '  ' "
    f"else concat('File {k} of ', cast(o_orderkey as varchar(20)), ' ') end as text from {{orders}} where (o_orderkey + {k}) % 3 > 0 and o_orderkey % 10 <> {k}"
    for k, name in enumerate(_KINDS)
)
cte("case_files", FILES_SQL.format(orders="orders"))


@query(
    "s06_transcript_resolution",
    oracle(
        """select c.case_id, coalesce(b.text, '') as text, coalesce(b.source, 'not available') as source from (select cast(doc_id as varchar) as case_id from transcripts) c left join (
        select *, row_number() over (partition by case_id order by rank) as rn from (select cast(doc_id as varchar) as case_id, 0 as rank, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text, 'embedded' as source from transcripts where doc_id % 4 = 0 and trim(coalesce(text, '')) <> ''
        union all select case_id, case replace(name, case_id, '') when '_transcript.md' then 2 when '_source.txt' then 3 when '_raw_transcript.txt' then 5 when '.md' then 7 end, trim(text), name from case_files where trim(text) <> '' and name not like '%other%') t) b on b.case_id = c.case_id and rn = 1"""
    ),
)
def s06(spark, sf):
    embedded = _talk(spark, sf).select(
        F.col("doc_id").cast("string").alias("case_id"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("text")
    )
    files = spark.sql(FILES_SQL, orders=given(spark, sf, "orders"))
    return R.resolve_transcripts(embedded, files)


# ---- S07 - S09: Markdown -----------------------------------------------------------------------------
def _table_text():
    row = lambda a: F.concat(
        F.lit("| "), F.when(F.length(a["action"]) % 5 == 0, "no").otherwise("Yes"), F.lit(" | "), a["owner"], F.lit(" | "), a["action"], F.lit(" | "), a["deadline"], F.lit(" | said | - |")
    )
    return F.concat(
        F.lit("# Case\n\n| must_capture | owner | action | deadline | evidence | notes |\n| --- | --- | --- | --- | --- | --- |\n"),
        F.array_join(F.transform("expected_actions", row), "\n"), F.lit("\n| broken | row |\n"),
    )


@query(
    "s07_markdown_table_rows",
    oracle(f"select case_id, row_number() over (partition by case_id order by ord) as pos, owner, action, deadline from ({action_rows('expected_actions')}) t where length(action) % 5 <> 0 and not regexp_matches(lower(action), '^tbd')"),
)
def s07(spark, sf):
    out = rows(_cases(spark, sf), R.expected_from_markdown(_table_text()), ["case_id"], "r")
    return out.select("case_id", "pos", "r.owner", "r.action", "r.deadline")


@query(
    "s08_markdown_section_bullets",
    oracle(
        f"""select doc_id, 'key points' as section, row_number() over (partition by doc_id order by ord) as pos, regexp_replace(trim(regexp_replace(s, '[ \\t]+([,.;:!?])', '\\1', 'g')), '\\.+$', '') as bullet from ({list_rows('key_points')}) t where lower(trim(s)) not in ('', 'none')
        union all select doc_id, 'decisions', ord, regexp_replace(s, '\\.+$', '') from ({list_rows('decisions')}) u"""
    ),
)
def s08(spark, sf):
    from colloquy.catalog.q_guards import _markdown

    md = _records(spark, sf).select("doc_id", _markdown().alias("md"))
    parts = []
    for name in ("key points", "decisions"):
        parts.append(rows(md, R.section_bullets(F.col("md"), name), ["doc_id"], "bullet").withColumn("section", F.lit(name)))
    return parts[0].unionByName(parts[1])


FENCED = """concat('# After', chr(10), '```json', chr(10), '{{"action_items": ["Old item"]}}', chr(10), '```', chr(10), 'text', chr(10), '```json', chr(10),
    case when o_orderkey % 4 = 0 then '{{"action_items": ["Send the note", " ", "Call the supplier "]}}' when o_orderkey % 4 = 1 then '{{"action_item_objects": [{{"owner": "Priya", "task": "Review the file"}}, {{"text": "Alex: Ship it"}}, {{"task": "Keep the lane"}}]}}'
      when o_orderkey % 4 = 2 then '{{broken json' else '[1, 2]' end, chr(10), '```', chr(10), '## Action Items', chr(10), '- [ ] Bullet action.', chr(10))"""
FENCED_SQL = f"select o_orderkey as doc_id, {FENCED} as md from {{orders}}"


@query(
    "s09_fenced_json_block",
    "select o_orderkey as doc_id, unnest(case o_orderkey % 4 when 0 then [1, 2] when 1 then [1, 2, 3] else [1] end) as pos, unnest(case o_orderkey % 4 when 0 then ['Send the note', 'Call the supplier'] when 1 then ['Priya - Review the file', 'Alex: Ship it', 'Keep the lane'] else ['Old item'] end) as action from orders",
)
def s09(spark, sf):
    md = spark.sql(FENCED_SQL, orders=given(spark, sf, "orders"))
    return rows(md, R.actions_after(F.col("md")), ["doc_id"], "action")


# ---- S11 - S18: sinks ----------------------------------------------------------------------------------
@query("s11_csv_sink", oracle("select id, status, amount_cents from billing_payment_attempts"))
def s11(spark, sf):
    path = fresh_path(spark, "csv")
    df = standin(spark, sf, "billing_payment_attempts").select("id", "status", "amount_cents")
    K.write_csv(df, path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("s12_json_report_sink", oracle("select case_id, category, ground_truth_status from cases"))
def s12(spark, sf):
    path = fresh_path(spark, "report")
    df = standin(spark, sf, "cases").select("case_id", F.struct("category", "ground_truth_status").alias("meta"))
    K.write_report(df, path)
    return spark.read.schema(df.schema).json(path).select("case_id", "meta.category", "meta.ground_truth_status")


@query(
    "s13_replace_by_key_sink",
    oracle(
        """select meeting_id, id, summary from notes_raw where not (id % 2 = 1 and meeting_id % 6 = 0) and meeting_id not in (select meeting_id from notes_raw where id % 2 = 1 and meeting_id % 6 = 0)
        union all select meeting_id, id, 'new ' || summary from notes_raw where id % 2 = 1 and meeting_id % 6 = 0"""
    ),
)
def s13(spark, sf):
    path, staging = fresh_path(spark, "notes"), fresh_path(spark, "staging")
    notes = standin(spark, sf, "notes_raw").select("meeting_id", "id", "summary")
    later = (F.col("id") % 2 == 1) & (F.col("meeting_id") % 6 == 0)
    K.create_bucketed(notes.filter(~later), path, "meeting_id", 16)
    new = notes.filter(later).withColumn("summary", F.concat(F.lit("new "), "summary"))
    # keys with a new row lose their old ones; a key without one loses nothing
    K.replace_by_key(spark, path, new, "meeting_id", 16, staging)
    return spark.read.parquet(path).drop("bucket")


@query(
    "s14_upsert_sink",
    oracle("select user_id, meeting_id, id, usefulness, most_useful, nullif(trim(improvement_text), '') as improvement_text from (select *, row_number() over (partition by user_id, meeting_id order by updated_at desc, id desc) as rn from feedback) t where rn = 1"),
)
def s14(spark, sf):
    f = standin(spark, sf, "feedback").withColumn("improvement_text", K.blank_to_null(F.col("improvement_text")))
    path, staging = fresh_path(spark, "feedback"), fresh_path(spark, "staging")
    K.create_bucketed(f.filter(F.col("id") % 3 > 0), path, "meeting_id", 16)
    K.upsert_into(spark, path, f.filter(F.col("id") % 3 == 0), ["user_id", "meeting_id"], ["updated_at", "id"], "meeting_id", 16, staging)
    out = spark.read.parquet(path)
    return out.select("user_id", "meeting_id", "id", "usefulness", "most_useful", "improvement_text")


@query(
    "s15_insert_if_absent_sink",
    oracle(
        """select user_id, meeting_id, id, false as appended from upload_ledger where status <> 'started' union all
        select user_id, meeting_id, min(id) as id, true from upload_ledger n where status = 'started' and not exists (select 1 from upload_ledger o where o.user_id = n.user_id and o.meeting_id = n.meeting_id and o.counted_at is not null and o.deleted_at is null) group by 1, 2"""
    ),
)
def s15(spark, sf):
    ledger, path = standin(spark, sf, "upload_ledger"), fresh_path(spark, "ledger")
    cols = ["user_id", "meeting_id", "id", "counted_at", "deleted_at"]
    started = F.col("status") == "started"
    ledger.filter(~started).select(*cols, F.lit(False).alias("appended")).write.parquet(path)
    live = F.col("counted_at").isNotNull() & F.col("deleted_at").isNull()
    new = ledger.filter(started).select(*cols, F.lit(True).alias("appended"))
    K.append_absent(spark, path, new, ["user_id", "meeting_id"], live, ["id"])
    return spark.read.parquet(path).select("user_id", "meeting_id", "id", "appended")


@query(
    "s16_cascade_delete",
    oracle("select 'meetings' as tbl, id from meetings where id not in (select id from meetings where status = 'ERROR') union all select 'notes', id from notes_raw where meeting_id not in (select id from meetings where status = 'ERROR')"),
)
def s16(spark, sf):
    meetings = standin(spark, sf, "meetings")
    gone = meetings.filter(F.col("status") == "ERROR").select("id")
    notes = standin(spark, sf, "notes_raw").select("id", "meeting_id")
    paths = {name: fresh_path(spark, name) for name in ("meetings", "notes")}
    meetings.select("id", "status").write.parquet(paths["meetings"])
    notes.write.parquet(paths["notes"])
    after = K.delete_from(spark, {"meetings": (paths["meetings"], "id"), "notes": (paths["notes"], "meeting_id")}, gone, "id", fresh_path(spark, "left"))
    left = [spark.read.parquet(path).select(F.lit(name).alias("tbl"), "id") for name, path in after.items()]
    return left[0].unionByName(left[1])


@query(
    "s17_partial_update",
    oracle(
        """select doc_id, case when doc_id % 5 = 0 then 'Edited summary ' || cast(doc_id as varchar) else summary end as summary, case when doc_id % 5 = 0 then 'Edited summary ' || cast(doc_id as varchar) end as edited_summary,
        case when doc_id % 5 = 1 then 'One|Two' else key_points end as key_points, case when doc_id % 5 = 2 then 'Priya - Call back' else action_items end as action_items, case when doc_id % 5 = 2 then 0 else len(list_filter(string_split(action_items, '|'), lambda x: x <> '')) end as objects from records"""
    ),
)
def s17(spark, sf):
    notes = _records(spark, sf).select("doc_id", "summary", "key_points", "action_items", F.col("action_items").alias("action_item_objects"))
    kind = F.col("doc_id") % 5
    edits = notes.filter(kind < 3).select(
        "doc_id",
        F.when(kind == 0, "summary").when(kind == 1, "key_points").otherwise("action_items").alias("section"),
        F.when(kind == 0, F.concat(F.lit(" Edited summary "), F.col("doc_id").cast("string"))).alias("text_value"),
        F.when(kind == 1, F.array(F.lit("One"), F.lit(" "), F.lit(" Two "))).when(kind == 2, F.array(F.lit("Priya - Call back"))).alias("list_value"),
    )
    out = K.section_edit(notes, edits, "doc_id")
    return out.select(
        "doc_id", "summary", "edited_summary", pipe(F.col("key_points")).alias("key_points"), pipe(F.col("action_items")).alias("action_items"), F.size("action_item_objects").alias("objects")
    )


@query(
    "s17_field_update",
    oracle("select id, case when id % 7 = 0 then 'Renamed' else title end as title, case when id % 3 = 0 then 'DONE' else status end as status from meetings"),
)
def s17_fields(spark, sf):
    m = standin(spark, sf, "meetings").select("id", "title", "status")
    edits = m.filter((F.col("id") % 7 == 0) | (F.col("id") % 3 == 0)).select(
        "id", F.when(F.col("id") % 7 == 0, "Renamed").alias("title"), F.when(F.col("id") % 3 == 0, "DONE").alias("status")
    )
    return K.partial_update(m, edits, "id", ["title", "status"])


# ---- P13 - P15 --------------------------------------------------------------------------------------------
NOTES_JSON = """select o_orderkey as id, concat('{{"id": ', cast(o_orderkey as varchar(20)), ', "summary": "Order ', cast(o_orderkey as varchar(20)), ' was reviewed", "summary_slots": {{"purpose": "Review order ', cast(o_orderkey % 50 as varchar(20)),
    '", "risks": ["Batch may slip", "Late port"]}}, "meeting_id": "m', cast(o_orderkey as varchar(20)), '"',
    case when o_orderkey % 3 = 0 then concat(', "Decisions": ["Keep lane ', cast(o_orderkey % 20 as varchar(20)), '", {{"text": "Use mail", "meta": {{"note": "deep ', cast(o_orderkey % 7 as varchar(20)), '"}}}}]') else '' end,
    case when o_orderkey % 4 = 1 then ', "score": 0.5, "flags": [true, null]' else '' end, ', "items": [{{"task": "Send it", "owner": {{"name": "Priya", "id": "u1"}}}}, {{"action": "Call back"}}]}}') as payload from {orders}"""
cte("notes_json", NOTES_JSON.format(orders="orders"))
_TREE = """select n.id, lower(t.fullkey) as k, case when json_type(t.value) = 'VARCHAR' then t.value ->> '$' else cast(t.value as varchar) end as text from notes_json n, json_tree(n.payload) t where json_type(t.value) not in ('OBJECT', 'ARRAY', 'NULL')"""
cte("json_leaf", _TREE)
_SKIP = "(" + "|".join(D.SKIPPED_KEYS) + ")"


def _json(spark, sf):
    return spark.sql(NOTES_JSON, orders=given(spark, sf, "orders"))


@query("p14_json_flatten", oracle(f"""select id, text from json_leaf where not regexp_matches(k, '\\."?{_SKIP}"?(\\.|\\[|$)')"""))
def p14(spark, sf):
    return D.flatten_text(_json(spark, sf), "id", "payload")


@query(
    "p15_json_collect_by_key",
    oracle(
        """select id, text from (select *, bool_or(hit) over (partition by id) as any_hit from (select *, regexp_matches(k, '\\."?(decisions|decision)"?(\\.|\\[|$)') as hit from json_leaf) a) b where hit or not any_hit"""
    ),
)
def p15(spark, sf):
    return D.collect_by_key(_json(spark, sf), "id", "payload", ("decisions", "decision"))


FIELDS = {
    "action": "case when o_orderkey % 5 = 0 then 'Act now' when o_orderkey % 5 = 1 then '' else null end",
    "task": "case when o_orderkey % 4 = 0 then 'Do the task' else '' end",
    "text": "case when o_orderkey % 3 = 0 then concat('Text ', cast(o_orderkey as varchar(20))) else null end",
    "description": "case when o_orderkey % 2 = 0 then 'Described' else '' end",
    "title": "case when o_orderkey % 7 = 0 then 'Title' else '' end",
    "summary": "case when o_orderkey % 11 = 0 then 'Sum' else null end",
}


@query(
    "p13_json_field_fallback",
    "select o_orderkey as id, coalesce(" + ", ".join(f"nullif({v}, '')" for v in FIELDS.values()) + ", '') as text from orders",
)
def p13(spark, sf):
    o = given(spark, sf, "orders")
    item = F.struct(*[F.expr(v).alias(k) for k, v in FIELDS.items()])
    return o.select(F.col("o_orderkey").alias("id"), D.first_text(item).alias("text"))


# ---- T11 ------------------------------------------------------------------------------------------------------
@query("t11_incremental_notes", oracle(CUE_SQL))
def t11(spark, sf):
    """New transcripts are read once, and each batch goes through the extractor."""
    orders = stream_table(spark, f"{sf}/orders.parquet")
    talk = spark.sql(STANDINS["transcripts"], orders=orders)
    return drain_batches(spark, talk, "notes", X.cue_signals, home=query_home(spark, "notes", sf)).drop("batch_id")


@query("t11_retry_reset", oracle("select id, case when raw_media_path is not null and status = 'ERROR' then 'PROCESSING' else status end as status, case when raw_media_path is not null and status = 'ERROR' then 'uploaded' else processing_stage end as processing_stage, case when raw_media_path is not null and status = 'ERROR' then null else error_text end as last_error from meetings"))
def t11_retry(spark, sf):
    m = standin(spark, sf, "meetings")
    retry = F.col("raw_media_path").isNotNull() & F.coalesce(F.col("status") == "ERROR", F.lit(False))
    return m.select(
        "id",
        F.when(retry, "PROCESSING").otherwise(F.col("status")).alias("status"),
        F.when(retry, "uploaded").otherwise(F.col("processing_stage")).alias("processing_stage"),
        F.when(retry, F.lit(None)).otherwise(F.col("error_text")).alias("last_error"),
    )
