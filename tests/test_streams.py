"""Streams over several files, late rows, and a stop between two runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import alerts, webhooks as W
from colloquy.streaming.runner import drain_append, drain_new_keys, stream_home, stream_table

T0 = datetime(2024, 1, 1)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture()
def feed(spark, tmp_path):
    return str(tmp_path / "feed")


def requests(first, count, step=1):
    return [(T0 + timedelta(minutes=first + step * i), "500" if i % 3 == 0 else "200") for i in range(count)]


def test_late_rows_within_the_delay_count(spark, feed):
    schema = "ts timestamp, status string"
    home = stream_home(spark, "late", feed)
    everything = []

    def run():
        rows = stream_table(spark, feed, files_per_batch=1)
        return drain_append(spark, alerts.error_rate(rows, "10 minutes", delay="30 minutes"), "late", home).collect()

    for rows in (requests(20, 20), requests(15, 10), requests(10, 60, 2)):
        add(spark, feed, rows, schema)
        everything += rows
        out = run()  # every run goes on where the last one stopped
    newest = max(ts for ts, _ in everything)
    want = {}
    for ts, status in everything:
        start = ts - timedelta(minutes=ts.minute % 10)
        if start + timedelta(minutes=10) <= newest - timedelta(minutes=30):
            n, e = want.get(start, (0, 0))
            want[start] = (n + 1, e + status.startswith("5"))
    # rows later than the delay are the only ones that may be missing; here there are none
    assert {r["window_start"]: (r["requests"], r["errors"]) for r in out} == want
    assert len(run()) == len(out)


def test_an_id_is_accepted_once_for_ever(spark, feed):
    schema = "provider string, provider_event_id string, arrived_at timestamp, event_id long, copy_no int"
    home = stream_home(spark, "ids", feed)

    def run():
        rows = stream_table(spark, feed, files_per_batch=1)
        return drain_new_keys(spark, rows, "ids", ["provider", "provider_event_id"], W.first_deliveries, home).collect()

    add(spark, feed, [("p", f"e{i}", T0 + timedelta(days=3), i, 0) for i in range(5)] + [("p", "", T0, 9, 0)], schema)
    assert len(run()) == 5
    # a redelivery after days, and an older delivery of a new id
    add(spark, feed, [("p", "e1", T0 + timedelta(days=30), 1, 1), ("p", "e7", T0, 7, 0), ("q", "e1", T0, 8, 0)], schema)
    out = run()
    assert sorted((r["provider"], r["provider_event_id"], r["event_id"]) for r in out) == [
        ("p", "e0", 0), ("p", "e1", 1), ("p", "e2", 2), ("p", "e3", 3), ("p", "e4", 4), ("p", "e7", 7), ("q", "e1", 8),
    ]
    assert len(run()) == 7


def test_answers_name_duplicates(spark):
    rows = [("p", "a", T0 + timedelta(minutes=m), m, 0) for m in (5, 1, 9)] + [("p", "", T0, 4, 0)]
    hooks = spark.createDataFrame(rows, "provider string, provider_event_id string, arrived_at timestamp, event_id long, copy_no int")
    found = {r["event_id"]: r["status"] for r in W.delivery_answers(hooks).collect()}
    assert found == {1: "accepted", 5: "duplicate", 9: "duplicate", 4: "ignored"}


def test_json_of_any_depth(spark):
    from colloquy.operators import documents as D

    text = '"x"'
    for level in range(12, 0, -1):
        text = f'{{"K{level}": [{text}, {level}], "id": "skip{level}"}}'
    df = spark.createDataFrame([(1, text), (2, "broken {"), (3, None), (4, '["a", null]'), (5, '{"Decision": ["d"], "b": "e"}')], "id long, payload string")
    flat = D.flatten_text(df, "id", "payload").collect()
    assert sorted(r["text"] for r in flat if r["id"] == 1) == sorted(["x", *map(str, range(1, 13))])
    assert [r["text"] for r in flat if r["id"] == 4] == ["a"]
    found = D.collect_by_key(df, "id", "payload", ("k12",)).collect()
    assert sorted(r["text"] for r in found if r["id"] == 1) == ["12", "x"]
    assert sorted(r["text"] for r in found if r["id"] == 5) == ["d", "e"]
    plan = D.collect_by_key(df, "id", "payload", ("k12",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("count", [0, 1, 5000])
def test_budget_chunks_of_long_rows(spark, count):
    from colloquy.operators import sentences as S

    sizes = [(i * 37) % 300 + 1 for i in range(count)]
    df = spark.createDataFrame([(sizes,)], "n array<int>")
    found = df.select(S.budget_chunk_ids(F.col("n"), 1800).alias("ids")).first()["ids"]
    want, used, chunk = [], 0, 0
    for i, n in enumerate(sizes):
        if i and used + n > 1800:
            used, chunk = 0, chunk + 1
        used += n
        want.append(chunk)
    assert found == want


def test_conversations_become_transcripts(spark):
    from colloquy.sources.conversations import PARTS, conversation_transcripts

    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f" say {t} ") for t in range(7)] + [(2, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r["doc_id"]: r["text"] for r in conversation_transcripts(df, part_turns=4).collect()}
    assert found == {
        PARTS: "User: say 0 Assistant: say 1 User: say 2 Assistant: say 3",
        PARTS + 1: "User: say 4 Assistant: say 5 User: say 6",
        2 * PARTS: ": ",
    }


def test_a_cancel_hits_the_newest_row_of_its_subscription(spark):
    moves = [(1, "a", "activate"), (2, "b", "activate"), (3, None, "cancel"), (4, "a", "activate")]
    again = [(1, None, "cancel"), (2, "c", "activate"), (3, None, "cancel"), (5, "c", "activate")]
    rows = [("p", key, user, (T0 + timedelta(hours=h), h), effect) for key, some in (("s", moves), ("r", again)) for h, user, effect in some]
    schema = "provider string, subscription_key string, user_id string, at struct<ts:timestamp,event_id:int>, effect string"
    found = {(r["subscription_key"], r["user_id"]): r["status"] for r in W.subscription_state(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("s", "a"): "active", ("s", "b"): "canceled", ("r", "c"): "active"}


def test_a_registered_stream_covers_the_table_at_hand(spark, tmp_path):
    from colloquy.catalog.everything import REGISTRY

    path = str(tmp_path / "events.parquet")
    query = REGISTRY["t01_webhook_dedupe_stream"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    counts = []
    for part in (0, 1):
        events.where(F.pmod("event_id", F.lit(2)) == part).coalesce(1).write.mode("overwrite").parquet(path)
        counts.append({r["event_id"] for r in query.run(spark, str(tmp_path)).collect()})
    assert counts[0] and counts[1] and not counts[0] & counts[1]
