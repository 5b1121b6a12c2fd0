"""Quick spellings match what the plain ones match, and nothing costly is computed twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import kinds
from colloquy.operators import commitments as K, hints as H, markers as M, points as P, recall as R, sentences as S
from colloquy.plans import guards as G

ODD = [
    None, "", " ", "  \t", "-", " - • a - ", "a  ", "a-\n", "a- \r\n", "a -\u0085", "•a• ", "\n a \n", "x y",
    "It's  two\tspaces\nand\r\nlines ", "the The A an is AS as.", "(due: Friday) Send the Draft, please: a/b_c é 漢字 \U0001f600!",
    "So, Priya, we will confirm, agreed.", "Priya, agreed", "Alex, , Agreed.", "but and so x", "to will TO WILL",
    "um you know it is kind of fine , like this .", "Decision 3: keep lane 4.", "Priya, Decision 12 - go", "we agreed to keep it",
    "risk", "norisk risks", "I'd like us to leave", "Open question: who signs?", "known blockers : the time  out", "...",
    "A b c :  said", "Name: ", "Priya Lee-Anne O'Neil . :x", "X" * 60 + ": y", "Dr. No   :  a: b", "by Friday before launch next week",
]
LISTS = (L.SIGNAL_DECISION, L.SIGNAL_RISK, L.CHUNK_MARKERS, L.TASK_VERBS, L.NARRATIVE, R.LINE_HINTS, H.CANON_DECISION)
PATTERNS = (
    L.any_of(L.V3_WEAK), L.any_of(L.V3_DECISION), L.any_word(L.V3_VERBS), L.FILLERS, L.DEADLINE, L.STRONG_ACTION, L.SIGNAL_DATE,
    r"(?i)^(?:risk|blocker)s?\s*[:\-]?\s*", "one risk|^risk|lines", r"\b(the|a|an)\b", r"(?is)\bdecision:.*$", r"\s+(?:and|;)", r"[.!?]$",
    *L.SLOT_DUE, *L.CHUNK_DEADLINES, *M.RISK_PATTERNS, *M.DUE_PATTERNS, *H.CANON_PURPOSE,
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(x,) for x in ODD], "s string").cache()


def unequal(df, pairs):
    """The pairs of columns that differ somewhere."""
    tests = [F.count_if(~a.eqNullSafe(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    return [i for i, n in enumerate(df.agg(*tests).first()) if n]


def test_look_ahead_changes_no_match(odd):
    s = F.col("s")
    pairs = [(F.regexp_replace(s, p, "#"), F.regexp_replace(s, J.ahead(p), "#")) for p in PATTERNS]
    assert unequal(odd, pairs) == []
    assert sum(J.ahead(p) != p for p in PATTERNS) > len(PATTERNS) // 2


def test_cues_by_first_letter(odd):
    low = F.lower("s")
    assert unequal(odd, [(low.rlike(L.any_text(c)), low.rlike(J.any_text(c))) for c in LISTS]) == []


def test_ends_are_cut_as_the_pattern_cuts_them(odd):
    s = F.col("s")
    ends = {p for steps in vars(C).values() if isinstance(steps, tuple) for p, to in steps if to == "" and J._end_chars(p)}
    ends |= {f"^{T.EDGE}|{T.EDGE}$", f"^{T.EDGE_V1}|{T.EDGE_V1}$", r"^[ \-–—:;,.\"']+|[ \-–—:;,.\"']+$"}
    assert len(ends) > 6 and J._end_chars(r"^\s+|\s+$") == J.WHITE
    assert unequal(odd, [(F.regexp_replace(s, p, ""), J.replace(s, p, "")) for p in sorted(ends)]) == []


def test_white_space_words_and_keys(odd):
    s, low = F.col("s"), F.lower("s")
    white = r"\s{2,}|[\t\n\x0B\f\r]"
    split = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    pairs = [
        (F.trim(F.regexp_replace(s, white, " ")), T.squash(s)),
        (F.regexp_replace(s, r"\s+", " "), J.replace(s, r"\s+", " ")),
        (split, T.words(s)),
        (F.regexp_replace(low, "[^a-z0-9]+", ""), T.compact_key(s)),
        (F.regexp_replace(low, r"[^a-z0-9\s]", " "), F.regexp_replace(low, J.NOT_ALNUM_WHITE, " ")),
        (F.regexp_replace(low, "[^a-z0-9 ]+", " "), F.regexp_replace(low, J.NOT_ALNUM_SPACE_RUN, " ")),
        (F.regexp_count(s, F.lit(r"(?U)\b\w+\b")), S.count_words(s)),
        (F.regexp_extract(s, T.SPEAKER_V3, 1), F.regexp_extract(s, T.SPEAKER_V3_ONCE, 1)),
        (F.regexp_extract(s, T.SPEAKER_V3, 2), F.regexp_extract(s, T.SPEAKER_V3_ONCE, 2)),
    ]
    assert unequal(odd, pairs) == []


@pytest.mark.parametrize(
    "made, step",
    [
        (T.sentence_clean, "sort of"),
        (M.risk_text, "blockers"),
        (M.question_text, "unresolved"),
        (M.decision_text, "eight"),
        (P.clean_decision, "sort of"),
        (R.recall_task, "transcript"),
        (R.recall_owner, r"\s(?:"),
        (H.canon_sentence, "sounds good"),
        (lambda c: G.consistent_actions(F.array(c), F.array().cast("array<string>"), R.owner_hints(F.array(c))), "reviewrecommended"),
    ],
)
def test_a_text_is_cleaned_once(spark, made, step):
    plan = spark.range(1).select(made(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    # the last case cleans two lists
    assert plan.count(step) == (2 if step == "reviewrecommended" else 1)


@pytest.mark.parametrize("key", [R.article_key, R.stem_key, R.action_key, R.norm_words, H.noise_key, T.merge_key])
def test_keys_use_no_class_of_ranges_and_white_space(spark, key):
    plan = spark.range(1).select(key(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "a-z0-9" not in plan and J.ALNUM in plan


def test_lists_of_two_kinds_come_from_one_pass(spark):
    df = spark.createDataFrame([(1, ["a", None], ["b"]), (2, None, ["c"]), (3, None, None), (1, [], ["d"])], "doc_id long, x array<string>, y array<string>")
    out = kinds(df, {"k": F.col("x"), "l": F.col("y")})
    assert out.columns == ["doc_id", "pos", "text", "kind"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, "a", "k"), (1, 2, None, "k"), (1, 1, "b", "l"), (2, 1, "c", "l"), (1, 1, "d", "l")], key=str)


def test_joined_queries_read_their_input_once(spark):
    from colloquy.catalog.everything import REGISTRY

    for name in ("u01_existing_union_extracted", "x23_structured_fallback"):
        plan = REGISTRY[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, name


def test_action_candidates_test_each_hint_once(spark):
    plan = spark.range(1).select(H.is_action_candidate(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("before .* demo|after") == 1
