"""Whitening against a dense eigensolver over exact integers."""

from fractions import Fraction

import numpy as np
import pytest

from colloquy.llm import whitening
from colloquy.llm.everything import REGISTRY


def all_cases():
    draw = np.random.default_rng(5)
    yield "random", draw.normal(size=(30, 12))
    yield "graded", draw.normal(size=(40, 10)) * 10.0 ** -np.arange(10)
    yield "graded the other way", draw.normal(size=(40, 10)) * 10.0 ** np.arange(10)
    yield "rank three", draw.normal(size=(30, 3)) @ draw.normal(size=(3, 9))
    yield "few rows", draw.normal(size=(2, 8))
    q = np.linalg.qr(draw.normal(size=(12, 12)))[0]
    yield "close values", np.diag(np.append([5, 5 * (1 - 1e-13), 5 * (1 - 1e-9)], np.linspace(3, 1, 9))) @ q
    yield "equal values", 3.0 * q
    yield "diagonal", np.diag([1.0, 7, 7, 7, 0, 2])
    yield "one", np.array([[2.0]])
    yield "like columns", np.repeat(draw.normal(size=(20, 3)), 2, axis=1)
    yield "wide", draw.normal(size=(100, 64))


@pytest.mark.parametrize("name, a", list(all_cases()))
def test_solver_against_dense_values(name, a):
    r = whitening.triangle(a, a.shape[1])
    squared, v = whitening.leading(r, 4)
    want = np.linalg.svd(a, compute_uv=False)
    rank = min(4, np.linalg.matrix_rank(a))
    assert len(squared) == rank
    assert np.allclose(np.sqrt(squared), want[:rank], rtol=1e-12)
    assert np.abs(v.T @ v - np.eye(rank)).max() < 1e-12
    # each is an eigenvector to rounding
    assert np.abs(a.T @ (a @ v) - v * squared).max() < 1e-11 * want[0] ** 2


def test_all_singular_values_are_relatively_accurate():
    # graded from large to small: the least value is as exact as the largest
    d, e = 10.0 ** -np.arange(12), 10.0 ** -np.arange(1, 12) * 0.5
    found = sorted(whitening.squares((d**2).tolist(), (e**2).tolist()))
    product = np.prod([Fraction(float(x)) for x in d**2])
    assert abs(float(np.prod([Fraction(x) for x in found]) / product) - 1) < 1e-12
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(found[::-1], np.linalg.svd(b, compute_uv=False) ** 2, rtol=1e-9, atol=1e-26)


def checked(vectors, found):
    """All columns of the result from the definition."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors]
    dims = max(len(x) for _, x in kept)
    kept = [(i, np.append(x, np.zeros(dims - len(x), np.int64))) for i, x in kept]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(4, np.linalg.matrix_rank(centred))
    assert len(found) == len(kept) * rank
    rows = {}
    for r in found:
        rows.setdefault((r["vec_id"], r["deviation"], r["component"]), []).append(r)
    scale = {}
    for i, x in kept:
        deviation = int(((n * x - sums) ** 2).sum())
        for c in range(rank):
            mine = rows[i, deviation, c + 1]
            want = (n * x - sums) / n @ axes[:, c] / np.sqrt(values[c])
            assert all(r["n"] == n and abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 for r in mine)
            assert all(0 <= r["identity_error"] < 1e-9 for r in mine)
            if abs(want) > 1e-6:
                signs = {round(r["whitened"] / want, 6) for r in mine}
                assert signs <= {1.0, -1.0}
                scale.setdefault(c, set()).update(signs)
    assert all(len(s) == 1 for s in scale.values())


def test_the_query_on_a_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    checked(vectors, REGISTRY["op12_embedding_whitening"].run(spark, sf_dir).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_many_triangles_and_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), (draw.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(300)]
    rows += rows[:40] + [(None, [1.0, 2.0]), (7, []), (8, [0.0] * 6), (9, [-0.0])]
    odd = [(1, None), (2, [None] * 6), (3, [float("nan")] + [0.0] * 5), (4, [float("inf")])]
    found = whitening.whiten(frame(spark, rows + odd).repartition(21)).collect()
    checked(rows, found)


def test_without_variance_there_is_no_component(spark):
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_large_entries_and_too_many_dimensions(spark):
    found = whitening.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3} and all(np.isfinite(r["whitened"]) for r in found)
    assert any(r["deviation"] is None for r in found)
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [0.0] * 9)]), max_dims=8)
