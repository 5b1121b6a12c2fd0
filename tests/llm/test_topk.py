import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import topk
from colloquy.llm.everything import REGISTRY


def brute(rows, k, asks):
    out = []
    fine = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in fine:
        if asks(q):
            scores = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dims", "cells", "spread"), [(5, 200, 1.0), (16, 1 << 20, 0.1), (3, 64, 300.0), (4, 100, 0.001)])
def test_equals_brute_force(spark, dims, cells, spread):
    draw = np.random.default_rng(dims)
    rows = [(int(i), (draw.normal(size=dims) * spread).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(600, [0.0] * dims), (601, [float("inf")] * dims), (602, None), (603, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=7, block_cells=cells)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 7, lambda q: q % 50 == 0)


def test_fewer_candidates_than_asked(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") == 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2 << 20), (0, 2, 2, -(1 << 20))]


@pytest.mark.parametrize("value", [*range(-40, 41), 12345, -98765, (1 << 40) - 1])
def test_signed_digits(value):
    digits = topk.signed_digits(value)
    assert sum(d << at for at, d in digits) == value
    assert all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:], strict=False))


def test_query_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = REGISTRY["op6_topk_search"].run(spark, sf_dir)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 10, lambda q: q % 100 == 0)
