import zlib

import numpy as np
import pyarrow as pa

from colloquy.llm import quality
from colloquy.llm.everything import REGISTRY


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = REGISTRY["op8_quality_classifier"].run(spark, sf_dir)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    right = [rows[r["doc_id"]]["predicted"] == r["quality"] for r in labels]
    assert np.mean(right) > 0.95
    good = [rows[r["doc_id"]]["predicted"] for r in labels if r["quality"] == 1]
    assert np.mean(good) > 0.98


def test_ngrams_are_indicators_of_one_document():
    texts = ["the cat the cat", "", "THE!! CAT!!", "the cat the cat", " \n"]
    doc, place = quality.ngrams(pa.array(texts))
    of = [place[doc == i].tolist() for i in range(len(texts))]
    assert of[0] == of[3] == sorted(set(of[0])) and not of[1] and not of[4] and of[0] != of[2]
    alone = [quality.ngrams(pa.array([t]))[1].tolist() for t in texts]
    assert alone == of


def test_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.sign(x @ draw.normal(size=5) + 0.1 * draw.normal(size=60))
    rows = [(np.arange(5), v) for v in x]
    w = quality.coordinate_descent(rows, y, 1.0, 500, 0)[:5]

    def loss(v):
        return v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()

    slow = np.zeros(5)
    for t in range(1, 20000):
        slow -= (slow - ((y * (x @ slow) < 1) * y) @ x) / (10 + t)
    assert loss(w) <= loss(slow) + 1e-3


def test_without_both_labels_the_share_is_the_score(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = [r["score"] for r in quality.score_documents(docs, model).collect()]
        assert np.allclose(scores, want, atol=1e-5)


def test_a_fit_does_not_depend_on_the_partitions(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = quality.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    first, second = quality.fit(docs, labels), quality.fit(docs.orderBy("n_chars").repartition(7), labels)
    assert np.array_equal(first.weights, second.weights) and (first.slope, first.offset) == (second.slope, second.offset)
