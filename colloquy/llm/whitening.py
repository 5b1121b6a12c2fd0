"""Whitening of embeddings by a bidiagonal qd solver.

An entry c becomes the integer floor(256 c).  The fit list, each different integer vector once,
is centred exactly (n x - S is an integer vector) and reduced block by block: a task stacks a
block of centred rows under the triangle R that it has, and keeps the R of their QR.  The
triangles of the tasks are combined in the same way, ``FAN`` at a time, until one is left; its
singular values and right vectors are those of all centred rows, and no covariance is formed.

On that one small triangle: Householder reflections from both sides make it bidiagonal; the
differential qd transform with shifts (dqds) finds its singular values to high relative
accuracy; for each value wanted, the stationary and the progressive transform meet in a twisted
factorisation, whose smallest pivot tells where to start the vector.  Vectors of values that lie
close together are made orthogonal and refined.  The reflections carry them back.

What the driver sees has the size of the dimensions, not of the data: n, S, one triangle, and the
covariance of the whitened components.  ``MAX_DIMS`` bounds it; longer vectors are refused.

Defined cases: a vector that is null or holds a null or non-finite entry is left out; vectors
shorter than the longest are as if zeros followed, the empty one too; an entry too large for a
long counts as the largest long; a component whose variance is zero but for rounding does not
exist, so equal vectors, one row alone, or no rows give no rows; the order of components with
equal variance, and their directions, are open but the same for all rows; repeated rows and a
null vec_id give rows as any other; ``deviation`` past the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table

COMPONENTS = 4
SCALE = 256
BLOCK_ENTRIES = 1 << 18
FAN = 8
MAX_DIMS = 2_048
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
SAFE = 2.0**62


# --- rows


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK_ENTRIES // dims)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            some = batch.slice(lo, step)
            yield some, matrix(some.column("x"), dims)


@dataclass(frozen=True)
class Moments:
    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n x - S, exact: as longs where these are wide enough, else as Python numbers."""
        most = self.n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, self.sums))
        if most < SAFE:
            return self.n * x - np.array(self.sums, np.int64), True
        return self.n * x.astype(object) - np.array(self.sums, object), False

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x)[0].astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        scaled, narrow = self.scaled(x)
        if narrow and (scaled.astype(float) ** 2).sum(axis=1).max(initial=0) < SAFE:
            return (scaled * scaled).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in scaled]
        return [v if v < 1 << 63 else None for v in exact]


def adder(dims: int) -> Callable:
    """(place, total): how many rows, at place -1, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for _, x in blocks(batches, dims):
            n += len(x)
            wide = x if np.abs(x.astype(float)).sum() < SAFE else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, wide.sum(axis=0), strict=True)]
        total = [str(v) for v in (n, *sums)]
        yield pa.record_batch([pa.array(range(-1, dims), pa.int32()), pa.array(total)], names=["place", "total"])

    return run


def moments(fit: DataFrame, dims: int) -> Moments:
    parts = fit.mapInArrow(adder(dims), "place int, total string")
    sums = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by_place = {r["place"]: int(r["total"]) for r in sums}
    return Moments(by_place.get(-1, 0), tuple(by_place.get(k, 0) for k in range(dims)))


# --- blockwise QR


def triangle(stack: np.ndarray, dims: int) -> np.ndarray:
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def reducer(mean: Moments, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((dims, dims)), 0
        for _, x in blocks(batches, dims):
            r, seen = triangle(np.vstack([r, mean.centred(x)]), dims), seen + len(x)
        if seen:
            yield pa.record_batch([pa.array([r.tobytes()])], names=["r"])

    return run


def combiner(dims: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        r = np.zeros((dims, dims))
        for value in group.column("r"):
            r = triangle(np.vstack([r, np.frombuffer(value.as_py()).reshape(dims, dims)]), dims)
        return pa.table([pa.array([r.tobytes()])], names=["r"])

    return run


def tall_triangle(fit: DataFrame, mean: Moments, dims: int) -> np.ndarray:
    """R of all centred rows; a task holds at most ``FAN`` triangles and one block."""
    parts = stored(fit.mapInArrow(reducer(mean, dims), "r binary"), "triangles")
    left = parts.count()
    while left > 1:
        groups = -(-left // FAN)
        numbered = parts.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups))) if groups > 1 else parts.withColumn("g", F.lit(0).cast("long"))
        parts = stored(numbered.groupBy("g").applyInArrow(combiner(dims), "r binary"), "triangles")
        left = parts.count()
    found = parts.collect()  # one triangle
    return np.frombuffer(found[0]["r"]).reshape(dims, dims) if found else np.zeros((dims, dims))


# --- the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) with r = U B V'; V is the product of the right reflections."""
    a, n = r.copy(), len(r)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        w = x.copy()
        size = np.abs(w).max(initial=0.0)
        if size == 0 or not np.abs(w[1:]).any():
            return np.zeros_like(w)
        w /= size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        w = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < n:
            w = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One differential qd transform; the last number is where it left the positive range, or -1."""
    n = len(q)
    q_new, e_new, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return q_new, e_new, i
        q_new[i] = max(d + e[i], TINY)
        t = q[i + 1] / q_new[i]
        e_new[i] = e[i] * t
        d = d * t - shift
    q_new[-1] = d
    return q_new, e_new, -1 if d >= 0 else n - 1


def squares(q: list[float], e: list[float]) -> list[float]:
    """The squared singular values of a bidiagonal matrix, from its squared entries."""
    done, work, negligible = [], [(list(q), list(e), 0.0)], (10 * EPS) ** 2
    while work:
        q, e, moved = work.pop()
        while q:
            if len(q) == 1:
                done.append(q.pop() + moved)
                break
            if e[-1] <= negligible * (q[-1] + moved):
                done.append(q.pop() + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= negligible * moved or e[i] == 0), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            # the least value of the last two by two is above the least of all; a shift below that is safe
            before = e[-2] if len(e) > 1 else 0.0
            a, b = q[-2] + before, q[-1] + e[-1]
            product = q[-2] * q[-1] + before * b
            shift = product / ((a + b) / 2 + (((a - b) / 2) ** 2 + q[-2] * e[-1]) ** 0.5)
            for attempt in range(4):
                q_new, e_new, at = dqds(q, e, shift)
                if at < 0:
                    break
                if attempt == 2:
                    shift = 0.0
                elif at == len(q) - 1 and shift + q_new[-1] > 0:
                    shift = (shift + q_new[-1]) * (1 - 4 * EPS)  # that last pivot says how far it went too far
                else:
                    shift /= 4
            q, e, moved = q_new, e_new, moved + shift
    return done


def twisted(q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B at ``value``; q and e are the squares of B's entries.

    B'B = L D L' with D = q and l = sqrt(e / q).  The stationary transform factors L D L' - value
    from the top, the progressive one from the bottom; where their pivots meet least, they join.
    """
    n = len(q)
    low = np.sqrt(e / q[:-1])
    top, up, s = np.empty(n), np.zeros(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        top[i] = s[i] + q[i]
        if top[i] == 0:
            top[i] = EPS * EPS * value + TINY
        up[i] = q[i] * low[i] / top[i]
        s[i + 1] = up[i] * low[i] * s[i] - value
    down, p = np.zeros(n - 1), np.empty(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * low[i] ** 2 + p[i + 1]
        if pivot == 0:
            pivot = EPS * EPS * value + TINY
        t = q[i] / pivot
        down[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def apart(z: np.ndarray, found: list[np.ndarray], b: np.ndarray, value: float) -> np.ndarray:
    """``z`` made orthogonal to the vectors found; anew by inverse iteration if nothing is left of it."""
    basis, n = np.array(found), len(z)
    draw, shifted = np.random.default_rng(len(found)), b.T @ b - value * (1 + 8 * EPS) * np.eye(n)
    for _ in range(8):
        before = np.linalg.norm(z)
        z = z - basis.T @ (basis @ z)
        z = z - basis.T @ (basis @ z)
        size = np.linalg.norm(z)
        if size > 0.5 * before:
            return z / size
        z = np.linalg.lstsq(shifted, draw.normal(size=n), rcond=None)[0]
    return z / max(size, TINY)


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; right vectors as columns), at most k that are not zero."""
    # dimensions without variance have no part in any component
    live = np.flatnonzero(r.any(axis=0))
    if not len(live):
        return np.empty(0), np.empty((len(r), 0))
    scale = float(np.abs(r).max())
    diagonal, upper, v = bidiagonal(triangle(r[:, live] / scale, len(live)))
    # B'B of B and of |B| differ only in signs, which are put back into the vectors
    signs = np.cumprod(np.append(1.0, np.where(diagonal[:-1] * upper < 0, -1.0, 1.0)))
    diagonal, upper = np.abs(diagonal), np.abs(upper)
    size = max(diagonal.max(), upper.max(initial=0.0))
    diagonal = np.maximum(diagonal, EPS * EPS * size)
    upper = np.where(upper <= EPS * size * 1e-3, 0.0, upper)
    borders = [0, *(np.flatnonzero(upper == 0) + 1).tolist(), len(diagonal)]
    values = []
    for lo, hi in zip(borders, borders[1:], strict=False):
        q, e = diagonal[lo:hi] ** 2, upper[lo : hi - 1] ** 2
        values.extend((value, lo, hi) for value in squares(q.tolist(), e.tolist()))
    values.sort(key=lambda x: (-x[0], x[1]))
    least = (4 * max(len(live), 64) * EPS) ** 2 * values[0][0]
    chosen, vectors = [x for x in values[:k] if x[0] > least], []
    for place, (value, lo, hi) in enumerate(chosen):
        q, e = diagonal[lo:hi] ** 2, upper[lo : hi - 1] ** 2
        z = twisted(q, e, value)
        near = [u[lo:hi] for u, (w, a, _) in zip(vectors, chosen[:place], strict=True) if a == lo and w - value <= 1e-3 * w]
        if near:
            z = apart(z, near, np.diag(diagonal[lo:hi]) + np.diag(upper[lo : hi - 1], 1), value)
        whole = np.zeros(len(live))
        whole[lo:hi] = z
        vectors.append(whole)
    out = np.zeros((len(r), len(chosen)))
    for c, z in enumerate(vectors):
        out[live, c] = v @ (signs * z)
    return np.array([x[0] for x in chosen]) * scale**2, out


# --- whitening


@dataclass(frozen=True)
class Whitening:
    mean: Moments
    variances: np.ndarray
    directions: np.ndarray
    total: float  # the trace of the covariance

    @property
    def size(self) -> int:
        return len(self.variances)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.directions / np.sqrt(self.variances)


def whitening_of(fit: DataFrame, dims: int, k: int = COMPONENTS) -> Whitening:
    """``fit`` has each different vector ``x`` once."""
    mean = moments(fit, dims)
    r = tall_triangle(fit, mean, dims) if mean.n else np.zeros((dims, dims))
    squared, directions = leading(r, k)
    n = max(1, mean.n)
    return Whitening(mean, squared / n, directions, float((r * r).sum()) / n)


def product_writer(model: Whitening, dims: int, middle: np.ndarray | None) -> Callable:
    """(i, j, total): sums of the whitened components or, around their means, of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((model.size, model.size))
        for _, x in blocks(batches, dims):
            w = model.whitened(x)
            total += np.diag(w.sum(axis=0)) if middle is None else (w - middle).T @ (w - middle)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    return run


def identity_error(fit: DataFrame, model: Whitening, dims: int) -> float:
    """The largest entry of the whitened covariance minus the identity, over the fit list."""

    def total(middle: np.ndarray | None) -> np.ndarray:
        parts = fit.mapInArrow(product_writer(model, dims, middle), "i int, j int, total double")
        out = np.zeros((model.size, model.size))
        for row in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # k x k rows
            out[row["i"], row["j"]] = row["total"]
        return out / model.mean.n

    middle = np.diag(total(None))
    return float(np.abs(total(middle) - np.eye(model.size)).max(initial=0.0))


def row_writer(model: Whitening, dims: int, error: float) -> Callable:
    explained = model.variances / model.total if model.size else np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, dims):
            rows, m = np.repeat(np.arange(len(x)), model.size), len(x) * model.size
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(rows)),
                "component": pa.array(np.tile(np.arange(1, model.size + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(m, model.mean.n)),
                "deviation": pa.array(model.mean.deviations(x), pa.int64()).take(pa.array(rows)),
                "whitened": pa.array(model.whitened(x).ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(m, error)),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, max_dims: int = MAX_DIMS) -> DataFrame:
    """``RESULT`` for each usable row of ``vectors`` (vec_id, embedding) and component."""
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x"))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > max_dims:
        raise ValueError(f"vectors of {dims} dimensions; the bound max_dims is {max_dims}")
    if not dims:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fit = stored(rows.select("x").distinct(), "fit")
    model = whitening_of(fit, dims, k)
    if not model.size:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(row_writer(model, dims, identity_error(fit, model, dims)), RESULT)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
