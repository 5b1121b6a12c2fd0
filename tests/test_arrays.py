"""Array idioms against plain Python, with properties."""

import random

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.arrays import best_first, greedy_keep, keep_first
from colloquy.operators import markers as M, points as P, sentences as S


def lists(n=60, seed=7):
    rnd = random.Random(seed)
    words = ["Alpha", "alpha", "beta!", "Beta", "gamma ray", "", "delta", "gamma  ray", "omega"]
    return [[rnd.choice(words) for _ in range(rnd.randint(0, 12))] for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, a array<string>")


def py_key(s):
    return "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())


def test_keep_first_matches_brute_force(spark):
    rows = lists()
    got = frame(spark, rows).select("id", keep_first(F.col("a"), T.compact_key, 4).alias("o")).collect()
    for r in got:
        seen, want = set(), []
        for s in rows[r["id"]]:
            if py_key(s) and py_key(s) not in seen:
                seen.add(py_key(s))
                want.append(s)
        assert r["o"] == want[:4]


def test_keep_first_is_idempotent(spark):
    df = frame(spark, lists(seed=3)).withColumn("once", keep_first(F.col("a"), T.compact_key))
    twice = df.withColumn("twice", keep_first(F.col("once"), T.compact_key))
    assert twice.filter("once != twice").count() == 0


def test_best_first_is_stable(run_one):
    got = run_one(lambda a: best_first(a, lambda s: F.length(s)), ["bb", "a", "cc", "ddd"])
    assert got == ["ddd", "bb", "cc", "a"]


def test_greedy_keep_depends_on_order(run_one):
    fold = lambda a: greedy_keep(
        a, T.point_tokens, lambda x, y: T.overlap(x, y) >= 0.7, "string", "array<string>"
    )
    assert run_one(fold, ["red green blue", "green blue gray", "gray pink"]) == ["red green blue", "green blue gray", "gray pink"]
    assert run_one(fold, ["red green blue", "red green blue sky", "sky"]) == ["red green blue", "sky"]


def test_greedy_keep_matches_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["order", "file", "lane", "pilot", "batch", "sheet", "note"]
    rows = [[" ".join(rnd.sample(vocab, rnd.randint(1, 5))) for _ in range(rnd.randint(0, 9))] for _ in range(50)]
    got = frame(spark, rows).select("id", P.dedupe_texts(F.col("a"), 5).alias("o")).collect()
    for r in got:
        kept = []
        for s in rows[r["id"]]:
            t = set(s.split())
            if len(kept) < 5 and not any(len(t & k) / min(len(t), len(k)) >= 0.7 for _, k in kept):
                kept.append((s, t))
        assert r["o"] == [s for s, _ in kept]


def test_budget_chunks_reset(run_one):
    ids = run_one(lambda a: S.budget_chunk_ids(F.transform(a, F.length), 10), ["aaaa", "bbbb", "cccc", "d" * 30, "e"])
    assert ids == [0, 0, 1, 2, 3]


def test_word_chunks_cover_the_text(run_one):
    text = " ".join(f"w{i}" for i in range(25))
    chunks = run_one(lambda c: S.word_chunks(c, 10), text)
    assert [(c["start_word"], c["end_word"]) for c in chunks] == [(0, 10), (10, 20), (20, 25)]
    assert " ".join(c["text"] for c in chunks) == text


def test_paragraph_chunks_overlap(run_one):
    got = run_one(lambda c: S.paragraph_chunks(c, 10, 3), "aa\n\nbb\n\n" + "x" * 18)
    assert got == ["aa\n\nbb", "x" * 10, "x" * 10, "x" * 4]


def test_representative_indexes(run_one):
    assert run_one(S.representative_indexes, 1) == [0]
    assert run_one(S.representative_indexes, 12) == [0, 1, 2, 5, 6, 7, 9, 10, 11]
    assert run_one(S.priority_indexes, 4) == [0, 1, 2, 3]


def test_merge_decisions_twice_is_once(run_one):
    texts = ["we decided to keep lane 4", "Keep lane 4 open", "Ship the note"]
    once = run_one(M.merge_decisions, texts)
    assert run_one(M.merge_decisions, once) == once
