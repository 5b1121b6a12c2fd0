"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers.  Rows are dealt at random into blocks; for each block and
dimension the index keeps the least value and the bits of what exceeds it as slices: bitmaps
with one bit per row.  A query's score of all rows of a block is a sum of slices.  Each query
component is written in signed binary digits without neighbours (at most a third of them are
not zero on average); a digit adds the dimension's slices at its own weight, complemented if
the digit is negative, and a constant.  The slices of one weight are added three at a time by
carry-save adders (whole bitmaps at once), with the carries going to the next weight, until one
slice per weight is left: the scores of all rows, in vertical form.

The top rows are then chosen from the most significant slice downward: rows that have the bit
stay ahead, unless more than k do, in which case the others leave.  Rows still level after the
last slice are a tie at the boundary and are resolved exactly, by the smaller id.  Each block
gives its best k per query, and a window over these gives the answer, so the search is exact.

Queries are a stated set, taken in blocks against blocks of rows by an equi join on the block
number; memory is bounded by one block of each.  The work is rows times queries by nature.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no
part, as query or as candidate.  Missing components of shorter vectors count as zero.  A query
is never its own candidate, and neither are other rows with its id; repeated rows are each
queries and candidates.  A null id is never a query and, as a candidate, loses ties.  An empty
table gives no rows.  A component or score beyond a long is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.llm.common import query, stored, table

SCALE = 1024
TOP = 10
BLOCK_CELLS = 1 << 20
QUERY_BLOCK = 128
SEED = 11

INDEX = "block int, rows int, ids binary, low binary, widths binary, slices binary"
QUERIES = "query_block int, query_rows binary, query_ids binary, vectors binary"
HITS = "query_row long, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Integers, or null if the vector takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """(rows, dims) of a list column, padded with zeros."""
    sizes = pc.list_value_length(lists).to_numpy()
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = pc.list_flatten(lists).to_numpy()
    return out


def bitmaps(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    wide = np.zeros((rows.shape[0], -(-rows.shape[1] // 64) * 64), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def index_builder(dims: int) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        values = matrix(block.column("q"), dims)
        low = values.min(axis=0)
        values -= low
        widths = np.array([int(m).bit_length() for m in values.max(axis=0)], np.uint8)
        bits = [(values[:, d] >> i) & 1 for d in range(dims) for i in range(widths[d])]
        slices = bitmaps(np.array(bits, np.uint8).reshape(len(bits), len(values)))
        ids = block.column("vec_id").to_pandas().fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        one = {
            "block": pa.array([block.column("block")[0].as_py()], pa.int32()),
            "rows": pa.array([len(values)], pa.int32()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "low": pa.array([low.astype("<i8").tobytes()], pa.binary()),
            "widths": pa.array([widths.tobytes()], pa.binary()),
            "slices": pa.array([slices.tobytes()], pa.binary()),
        }
        return pa.table(one)

    return run


def query_packer(dims: int) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        packed = {
            "query_block": pa.array([block.column("query_block")[0].as_py()], pa.int32()),
            "query_rows": pa.array([block.column("row").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "query_ids": pa.array([block.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([matrix(block.column("q"), dims).astype("<i8").tobytes()], pa.binary()),
        }
        return pa.table(packed)

    return run


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(position, digit) with digits 1 and -1 and no two neighbours; their sum is the value."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


@dataclass
class Block:
    rows: int
    ids: np.ndarray
    low: np.ndarray
    widths: np.ndarray
    slices: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        widths = np.frombuffer(row["widths"], np.uint8)
        words = -(-row["rows"] // 64)
        slices = np.frombuffer(row["slices"], np.uint64).reshape(int(widths.sum()), words)
        ids, low = (np.frombuffer(row[c], "<i8") for c in ("ids", "low"))
        return cls(row["rows"], ids, low, widths, slices)

    def weigh(self, vector: np.ndarray) -> tuple[dict[int, list[tuple[int, bool]]], int]:
        """For each weight the slices to add, flipped or not, and the constant."""
        columns: dict[int, list[tuple[int, bool]]] = {}
        constant, first = 0, np.cumsum(self.widths.astype(int)) - self.widths
        for d in np.flatnonzero(vector).tolist():
            width, begin = int(self.widths[d]), int(first[d])
            constant += int(vector[d]) * int(self.low[d])
            for at, digit in signed_digits(int(vector[d])):
                constant -= ((1 << width) - 1) << at if digit < 0 else 0
                for i in range(width):
                    columns.setdefault(at + i, []).append((begin + i, digit < 0))
        return columns, constant

    def sums(self, columns: dict[int, list[tuple[int, bool]]]) -> np.ndarray:
        """Slices of the sum, least significant first."""
        words, out = self.slices.shape[1], []
        carried = np.empty((0, words), np.uint64)
        weight = 0
        while weight <= max(columns, default=-1) or len(carried):
            here = columns.get(weight, [])
            which = np.array([s for s, _ in here], int)
            flips = np.where(np.array([f for _, f in here], bool), ~np.uint64(0), np.uint64(0))
            rows, carries = np.concatenate([self.slices[which] ^ flips[:, None], carried]), []
            while len(rows) > 2:
                n = len(rows) // 3
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                half = a ^ b
                carries.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * n :]])
            if len(rows) == 2:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
            carried = np.concatenate(carries) if carries else np.empty((0, words), np.uint64)
            weight += 1
        return np.array(out, np.uint64).reshape(len(out), words)

    def best(self, vector: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Lanes of the best k rows, and their scores."""
        columns, constant = self.weigh(vector)
        total = self.sums(columns)
        ahead = np.zeros(self.slices.shape[1], np.uint64)
        level = bitmaps((self.ids != own)[None, :])[0]
        for bits in total[::-1]:
            with_bit = level & bits
            n = int(np.bitwise_count(ahead | with_bit).sum())
            if n > k:
                level = with_bit
            else:
                ahead, level = ahead | with_bit, level & ~bits
                if n == k:
                    level = np.zeros_like(level)
                    break
        lanes, tied = self.lanes(ahead), self.lanes(level)
        if len(lanes) < k and len(tied):
            lanes = np.concatenate([lanes, tied[np.argsort(self.ids[tied], kind="stable")[: k - len(lanes)]]])
        bits = (total[:, lanes // 64] >> (lanes % 64).astype(np.uint64)) & np.uint64(1)
        scores = [constant + sum(int(b) << w for w, b in enumerate(column)) for column in bits.T.tolist()]
        return lanes, scores

    def lanes(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def searcher(dims: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                block = Block.read(cell)
                vectors = np.frombuffer(cell["vectors"], "<i8").reshape(-1, dims)
                rows, own = (np.frombuffer(cell[c], "<i8") for c in ("query_rows", "query_ids"))
                out: list[list] = [[], [], [], []]
                for q, vector in enumerate(vectors):
                    lanes, scores = block.best(vector, int(own[q]), k)
                    for column, more in zip(out, ([rows[q]] * len(lanes), [own[q]] * len(lanes), block.ids[lanes], scores), strict=True):
                        column.extend(more)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that are queries."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("q"))
    rows = rows.where(F.col("q").isNotNull())
    rows = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "draw": F.rand(SEED)}), "vectors")
    n, dims, asked = rows.agg(F.count("*"), F.max(F.size("q")), F.count_if(F.coalesce(is_query, F.lit(False)))).first()
    dims = dims or 1
    blocks = max(1, -(-n // max(64, block_cells // dims)))
    index = rows.withColumn("block", F.floor(F.col("draw") * blocks).cast("int")).select("block", "vec_id", "q")
    index = stored(index.groupBy("block").applyInArrow(index_builder(dims), INDEX), "slices")
    query_blocks = max(1, -(-(asked or 0) // QUERY_BLOCK))
    asking = rows.where(is_query & F.col("vec_id").isNotNull())
    asking = asking.withColumn("query_block", F.floor(F.col("draw") * query_blocks).cast("int"))
    packed = asking.select("query_block", "row", "vec_id", "q").groupBy("query_block").applyInArrow(query_packer(dims), QUERIES)
    cells = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = cells.join(index, "block").mapInArrow(searcher(dims, k), HITS)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    none = F.lit(np.iinfo(np.int64).max)
    return best.select("query_id", "rank", F.nullif("vec_id", none).alias("vec_id"), "score")


SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op6_topk_search", SQL)
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
