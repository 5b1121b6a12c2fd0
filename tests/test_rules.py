"""Plans, quotas, merging, matching and skewed groups on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from colloquy.operators import accounts as A, match as M, meetings as O, render as N, signals as X
from colloquy.sources import readers as R, sinks as K
from colloquy.streaming import webhooks as W

NOW = "2024-05-10 12:00:00"


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_plan_precedence_and_validity_edge(spark):
    users = spark.createDataFrame([(1, "a@x.org"), (2, "b@x.org"), (3, "c@x.org"), (4, "d@x.org")], "id long, email string")
    subs = spark.createDataFrame(
        [
            (1, 1, "paypal", "starter", "active", ts(NOW)),
            (9, 1, "square", "pro_pilot", "active", ts("2024-05-10 11:59:59")),
            (2, 2, "square", "team", "trialing", None),
            (3, 3, "square", "team", "canceled", None),
        ],
        "id long, user_id long, provider string, plan_code string, status string, current_period_end timestamp_ntz",
    )
    over = spark.createDataFrame(
        [(1, 2, "paid_pro", "active", None), (2, 3, "paid_pro", "canceled", None)],
        "id long, user_id long, plan_code string, status string, ends_at timestamp_ntz",
    )
    got = {r["user_id"]: (r["plan_code"], r["source"]) for r in A.effective_plan(users, subs, over, NOW).collect()}
    assert got == {
        1: ("starter", "subscription"),  # valid until exactly now; the newer one has just ended
        2: ("paid_pro", "manual_override"),
        3: ("free_trial", "default"),
        4: ("free_trial", "default"),
    }


def test_stuck_and_stale_are_two_flags(spark):
    df = spark.createDataFrame(
        [(1, "processing", "x", ts("2024-05-10 11:10:00")), (2, "PROCESSING", "x", ts("2024-05-10 08:00:00")), (3, "PROCESSING", "completed", ts("2024-05-01 00:00:00")), (4, "queued", "x", None)],
        "id long, status string, processing_stage string, updated_at timestamp_ntz",
    )
    rows = df.select(
        "id",
        O.is_stuck(F.col("status"), F.col("updated_at"), NOW).alias("stuck"),
        O.is_stale(F.col("status"), F.col("processing_stage"), F.col("updated_at"), NOW).alias("stale"),
    ).collect()
    assert {r["id"]: (r["stuck"], r["stale"]) for r in rows} == {1: (True, False), 2: (True, True), 3: (True, False), 4: (False, False)}


def candidate(action, owner="Priya", deadline="Friday", chunk=1, confidence="low", context=""):
    return (action, owner, deadline, context, "", "", chunk, confidence)


def test_consolidate_merges_only_same_owner_and_deadline(spark):
    items = [
        candidate("review the order file", chunk=2, confidence="low", context="short"),
        candidate("review the full order file", chunk=1, confidence="high", context="a longer context"),
        candidate("review the order file", owner="Alex"),
        candidate("review the order file", deadline="Monday"),
    ]
    df = spark.createDataFrame([(items,)], f"c array<{X.CANDIDATE}>")
    got = df.select(X.consolidate(F.col("c")).alias("o")).first()["o"]
    assert len(got) == 3
    merged = [g for g in got if g["owner"] == "Priya" and g["deadline"] == "Friday"]
    assert [(m["action"], m["source_chunk"], m["confidence"], m["reason_context"]) for m in merged] == [
        ("review the full order file", 1, "high", "a longer context")
    ]


def test_greedy_match_takes_each_action_once(spark):
    df = spark.createDataFrame(
        [([("P", "send the note", ""), ("P", "send the note", "")], [("P", "send the note", ""), ("A", "send a note now", "")])],
        f"e array<{M.ACTION}>, a array<{M.ACTION}>",
    )
    pairs = df.select(M.greedy_pairs(F.col("e"), F.col("a")).alias("o")).first()["o"]
    assert [(p["e"], p["a"]) for p in pairs] == [(0, 0), (1, 1)]


def test_exact_scores_conventions(spark):
    df = spark.createDataFrame(
        [(1, [], []), (2, ["- [ ] Priya - Send it."], ["send it"]), (3, ["a b c"], []), (4, [], ["x y"])],
        "case_id long, expected_lines array<string>, actual_lines array<string>",
    )
    rows = {r["case_id"]: r for r in M.exact_scores(df).collect()}
    assert [rows[i]["f1"] for i in (1, 2, 3, 4)] == [1.0, 1.0, 0.0, 0.0]
    assert (rows[3]["precision"], rows[3]["recall"]) == (0.0, 0.0)
    parts = M.set_parts(df).groupBy("case_id", "part").count().collect()
    assert {(p["case_id"], p["part"]) for p in parts} == {(2, "matched"), (3, "missing"), (4, "unexpected")}


def test_hot_key_results(spark):
    """One id holds a third of all deliveries: counts stay whole."""
    hooks = spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.lit(0).alias("copy_no"),
        F.lit("square").alias("provider"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("provider_event_id"),
        (F.lit(3000) - F.col("id")).alias("arrived_at"),
        F.lit("x").alias("event_type"),
    )
    out = W.first_deliveries(hooks)
    hot = out.filter("provider_event_id = 'hot'").first()
    assert (hot["deliveries"], hot["event_id"]) == (1000, 2997)
    assert out.count() == 2001


def test_corpus_bullets_of_a_hot_meeting(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("meeting"),
        F.col("id").alias("at"),
        F.concat(F.lit("line "), F.col("id")).alias("text"),
    )
    hot = N.corpus_bullets(rows, "meeting", ["at"], max_chars=200).filter("meeting = 1").first()["bullets"]
    assert hot.split("\n")[:3] == ["- line 0", "- line 3", "- line 6"]
    one = N.corpus_bullets(rows, "meeting", ["at"], max_chars=200, salts=1).orderBy("meeting").collect()
    assert N.corpus_bullets(rows, "meeting", ["at"], max_chars=200).orderBy("meeting").collect() == one


def test_upsert_and_insert_if_absent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, at int")
    assert sorted(map(tuple, K.upsert(old, new, ["k"], ["at"]).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    added = K.insert_if_absent(old, new, ["k"], F.lit(True), ["at"])
    assert [tuple(r) for r in added.collect()] == [(3, "d", 0)]


def test_json_documents_and_globs(spark, tmp_path):
    (tmp_path / "M01_current_notes.json").write_text('{\n "doc_id": 1,\n "summary": "s"\n}')
    (tmp_path / "other.txt").write_text("x")
    from pyspark.sql.types import StructType

    docs = R.read_documents(spark, str(tmp_path), StructType.fromDDL("doc_id long, summary string"), "*_current_notes.json")
    row = docs.select("doc_id", "summary", R.case_id_from_path(F.col("file_path")).alias("case_id")).first()
    assert tuple(row) == (1, "s", "M01")
    objects = R.read_objects(spark, str(tmp_path)).select("path", "size").collect()
    assert len(objects) == 2


def test_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "notes")
    rows = spark.range(40).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    K.create_bucketed(rows, path, "k", 4)
    new = spark.createDataFrame([(3, "new"), (99, "new")], "k long, v string")
    K.replace_by_key(spark, path, new, "k", 4, str(tmp_path / "stage"))
    out = spark.read.parquet(path)
    assert out.count() == 41
    assert sorted(r["k"] for r in out.filter("v = 'new'").collect()) == [3, 99]


def test_strategies_and_lexicons(spark, sf_dir):
    from colloquy.functions import lexicons as L
    from colloquy.plans.strategies import STRATEGIES, get_strategy
    from colloquy.sources.lexicon_tables import lexicon_frame, load_lexicons

    assert get_strategy(" V2 ") is STRATEGIES["v2"]
    assert get_strategy("unknown") is STRATEGIES["v1"]
    lists = load_lexicons(lexicon_frame(spark))
    assert lists["SIGNAL_RISK"] == L.SIGNAL_RISK
