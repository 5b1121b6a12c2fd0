"""Engines by row, replaced word lists, and the polish of long meetings."""

from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.operators import signals as X
from colloquy.operators.recall import PhraseRule
from colloquy.plans import long_polish as Q
from colloquy.plans.records import notes_records
from colloquy.plans.strategies import common_notes, generate, generate_by_route
from colloquy.sources.lexicon_tables import lexicon_frame, load_lexicons
from colloquy.sources.standins import standin


def test_routes_give_each_row_the_notes_of_its_engine(spark, sf_dir):
    some = notes_records(standin(spark, sf_dir, "records").where("doc_id < 60"))
    route = F.expr("case doc_id % 4 when 0 then 'v1' when 1 then ' V2' when 2 then 'v3' end")
    mixed = {r["doc_id"]: r for r in generate_by_route(some, route).collect()}
    assert len(mixed) == some.count() > 30
    for name, rests in {"v1": (0, 3), "v2": (1,), "v3": (2,)}.items():
        alone = [r for r in common_notes(generate(some, name)).collect() if r["doc_id"] % 4 in rests]
        assert alone and all(mixed[r["doc_id"]] == r for r in alone)


def test_a_version_of_the_lists(spark):
    old = lexicon_frame(spark).withColumn("version", F.lit(1))
    rows = [(2, "SIGNAL_RISK", 0, "a.b"), (2, "SIGNAL_NO_RISK", 0, None), (3, "SIGNAL_RISK", 0, "trial")]
    table = old.unionByName(spark.createDataFrame(rows, "version int, name string, pos int, entry string"))
    assert load_lexicons(table, 1)["SIGNAL_RISK"] == L.SIGNAL_RISK
    assert load_lexicons(table)["SIGNAL_RISK"] == ("trial",)
    lists = load_lexicons(table, 2)
    assert (lists["SIGNAL_RISK"], lists["SIGNAL_NO_RISK"], lists["SIGNAL_ACTION"]) == (("a.b",), (), L.SIGNAL_ACTION)

    texts = spark.createDataFrame([(1, "There are no risks with a.b in the plan today."), (2, "The axb has a risk for the plan.")], "doc_id long, text string")
    told = {(r["doc_id"], r["kind"]) for r in X.cue_signals(texts, lists).collect()}
    assert (1, "risk") in told and (2, "risk") not in told
    plain = {(r["doc_id"], r["kind"]) for r in X.cue_signals(texts).collect()}
    assert (1, "risk") not in plain and (2, "risk") in plain
    assert not [k for _, k in {(r["doc_id"], r["kind"]) for r in X.cue_signals(texts, {"SIGNAL_RISK": ()}).collect()} if k == "risk"]


RECORD = (
    "doc_id long, text string, summary string, purpose string, outcome string, key_points array<string>, decisions array<string>, "
    "risks array<string>, next_steps array<string>"
)
BUDGET = Q.SlotRule(Q.PURPOSE.generic, Q.PURPOSE.specific, "Default.", (((("budget", "cost"), ("april",)), "Plan the budget of April."), ((("budget",),), "Plan the budget.")))


def polished(spark, rows, **settings):
    return {r["doc_id"]: r for r in Q.polished(spark.createDataFrame(rows, RECORD), **settings).collect()}


def test_long_meetings_get_purpose_and_outcome(spark):
    talk = "We spoke. " * 7_500
    rows = [
        (1, talk, "s", "Align on main priorities", "  Upload expectations\n were set ", ["The cost."], ["Start in April."], ["It may slip , or fail."], []),
        (2, talk + "the budget", None, None, "Processing reliability was agreed", None, None, None, None),
        (3, "A short talk of the budget in April.", "kept", "Align on main priorities", None, ["long recording"], None, ["a , b"], None),
        (4, "How a Long Recording is kept.", "s", "3-hour calls: main priorities and next steps", "", [], [], [], []),
        (5, None, None, None, None, None, None, None, None),
    ]
    points = (PhraseRule("point", "The cost was a topic.", ("cost",)), PhraseRule("point", "The cost", ("cost",)))
    found = polished(spark, rows, purpose=BUDGET, point_rules=points)
    assert [found[i]["is_long"] for i in range(1, 6)] == [True, True, False, True, False]
    # evidence of key points and decisions counts; a generic slot goes, in the order of the choices
    assert found[1]["purpose"] == "Plan the budget of April." and found[2]["purpose"] == "Plan the budget."
    # a mark of the other slot does not keep this one
    assert found[1]["outcome"] == Q.OUTCOME.default and found[2]["outcome"] == "Processing reliability was agreed"
    assert found[1]["summary"] == f"Plan the budget of April. {Q.OUTCOME.default}"
    assert found[1]["risks"] == ["It may slip or fail"]
    assert found[1]["key_points"] == ["The cost", "The cost was a topic."]
    assert (found[3]["purpose"], found[3]["outcome"], found[3]["summary"], found[3]["risks"]) == ("Align on main priorities", None, "kept", ["a , b"])
    # generic beats specific
    assert found[4]["purpose"] == "Default."
    assert found[5]["summary"] is None and found[5]["risks"] is None
    assert "_found" not in Q.polished(spark.createDataFrame(rows, RECORD)).columns


def test_registered_polish_has_long_meetings(spark, sf_dir):
    from colloquy.catalog.everything import REGISTRY

    rows = REGISTRY["q11_long_polish_slots"].run(spark, sf_dir).collect()
    assert any(r["is_long"] for r in rows)
    assert all(r["purpose"] and r["outcome"] for r in rows if r["is_long"])
