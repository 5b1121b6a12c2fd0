import zlib

import numpy as np
import pyarrow as pa

from colloquy.llm import toxicity
from colloquy.llm.everything import REGISTRY


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in REGISTRY["op11_toxicity"].run(spark, sf_dir).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    # 352 toxic documents in four languages to learn from; with 1,735, on check_s, it is 0.98 and 0.99
    for label, least in ((1, 0.7), (0, 0.97)):
        assert np.mean([rows[r["doc_id"]]["predicted"] == label for r in labels if r["toxic"] == label]) > least


def slow_bag(text):
    out = {}
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        for owner, place in zip(*toxicity.subwords([word]), strict=True):
            assert owner == 0
            out[place] = out.get(place, 0) + 1
    return out


def test_bags_count_the_subwords_of_each_document(monkeypatch):
    texts = ["the cat, THE hat", "", "  ...  ", "x", "ñandú été 123", "a b " * 50, "the cat, THE hat"]
    for block in (toxicity.WORD_BLOCK, 1):
        monkeypatch.setattr(toxicity, "WORD_BLOCK", block)
        doc, place, count = toxicity.bags(pa.array(texts))
        for i, text in enumerate(texts):
            assert dict(zip(place[doc == i].tolist(), count[doc == i].tolist(), strict=True)) == slow_bag(text)


def test_subwords_of_a_word_do_not_depend_on_its_neighbours():
    together = toxicity.subwords(["abc", "x", "longer"])
    for i, word in enumerate(["abc", "x", "longer"]):
        assert sorted(together[1][together[0] == i]) == sorted(toxicity.subwords([word])[1])
    # <abc>: three of 3, two of 4, one of 5 characters, and the word
    assert (together[0] == 0).sum() == 7 and (together[0] == 1).sum() == 2


def corpus(bad, n, draw):
    plain = [f"{a}{b}{c}" for a in "bdfglmnr" for b in "aeiou" for c in ("st", "nd", "rk", "lm")]
    rows = []
    for i in range(n):
        words = draw.choice(plain, 60).tolist()
        if i % 4 == 0:
            words[5] = words[20] = bad[i % len(bad)]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_unseen_misspellings_share_vectors(spark):
    draw = np.random.default_rng(4)
    rows = corpus(["scoundrel", "blockhead", "nincompoop"], 600, draw)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new = corpus(["scoundrell", "sc0undrel", "blokhead", "nincompooop"], 200, draw)
    found = model.scores(pa.array([r[1] for r in new])) >= 0.5
    assert np.mean(found == [bool(r[2]) for r in new]) > 0.97
    again = toxicity.fit(docs.repartition(3), labels)
    assert np.array_equal(model.place, again.place) and model.bias == again.bias
    # a bound on the sample keeps to whole documents
    small = toxicity.fit(docs, labels, sample_rows=50, sample_entries=20_000)
    assert np.isfinite(small.place).all() and not np.array_equal(small.place, model.place)


def test_training_parts_two_documents():
    draw = np.random.default_rng(0)
    place, share = np.array([3, 5, 5, 9]), np.array([0.5, 0.5, 0.25, 0.75])
    bag = toxicity.Bags(np.array([0, 2, 4]), place, share, np.array([1, 0]))
    row, p, s = bag.rows(np.array([1, 0]))
    assert row.tolist() == [0, 0, 1, 1] and p.tolist() == [5, 9, 3, 5] and s.tolist() == [0.25, 0.75, 0.5, 0.5]
    score, bias = toxicity.train(bag, epochs=200, min_docs=1)
    margin = np.bincount([0, 0, 1, 1], score[place] * share) + bias
    assert margin[0] > 3 and margin[1] < -3
    untouched = np.setdiff1d(draw.integers(0, toxicity.PLACES, 50), place)
    assert not score[untouched].any()
    # place 5 is the only one of two documents
    assert np.flatnonzero(toxicity.train(bag, min_docs=2)[0]).tolist() == [5]


def test_without_both_labels_the_share_is_the_score(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(9, 1), (1, 0), (None, 1)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = [r["score"] for r in toxicity.score_documents(docs, model).collect()]
        assert np.allclose(scores, want, atol=1e-5)
