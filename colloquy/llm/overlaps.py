"""Pairs of sets that may reach a Jaccard similarity: none that reaches it is missed.

Two sets with that similarity share a member among the first ``n - ceil(similarity n) + 1`` of
each, in any order that is the same for all sets (prefix filter).  The order puts members last
that are frequent in a sample, and members that chance would make often: the product of the shares
that their parts (the words of a shingle) have in the sample.  So neither a passage in many sets nor
a run of common words is in many prefixes, and what chance makes two sets share grows no faster
than the rarest runs do.  The sample decides the cost and never the result.  Members that are first
in one set only go nowhere.

The order also gives a place: of the pair's first shared member, at places i and j, at most
``1 + min(n - i - 1, m - j - 1)`` members are shared, this one and what follows.  A pair is proposed
where that bound allows the similarity; the bound holds its own at the first shared member, so a
similar pair is proposed there at least, and most others nowhere.

What is proposed is compared by parity bitmaps: a bit is set if an odd number of
members fall on it, so the bits that differ are at most the members that differ.  The bitmap
grows with its set, and a longer one folds to the length of a shorter one.

Sets that are joined already are not compared.  A member of more than ``small`` sets has them
compared side by side in blocks of at most about ``BLOCK_SETS`` and ``BLOCK_BYTES``; there each set proposes its nearest
first, and the caller asks again with more, until no set has one left that it did not propose.

Exact but for collisions of 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import stored

SAMPLE_TEXTS = 8_192
FREQUENT = 1 << 20
FREQUENT_PARTS = 1 << 18
SMALL_GROUP = 32
BLOCK_SETS = 4_096
BLOCK_BYTES = 16 << 20
EPSILON = 1e-9
MEMBER = {"token": pa.int64(), "s1": pa.int64(), "place": pa.int32(), "n": pa.int32()}
MEMBERS = "token long, s1 long, place int, n int"


def parity_bits(members: np.ndarray) -> bytes:
    length = max(256, 1 << (2 * len(members)).bit_length())
    odd = np.bincount((members & np.uint64(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    while len(bits) > length:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


@dataclass(frozen=True)
class Ranks:
    """How common members are in a sample, in eighths of a power of two: seen, and by chance."""

    members: np.ndarray
    seen: np.ndarray
    parts: np.ndarray
    share: np.ndarray
    unknown: int
    total: int

    def of(self, members: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Ranks of the members of a text, in its order; member i is made of the parts from i on."""
        share = looked_up(parts, self.parts, self.share, self.unknown)
        sums = np.append(0, np.cumsum(share))
        chance = sums[len(parts) - len(members) + 1 :] - sums[: len(members)] + self.total
        return np.maximum(chance, looked_up(members, self.members, self.seen, np.iinfo(np.int64).min))


def looked_up(asked: np.ndarray, keys: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), other, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other)


def first_members(members: np.ndarray, similarity: float, rank: np.ndarray) -> np.ndarray:
    """The members of which one is shared with any set that is similar enough."""
    length = len(members) - ceil(similarity * len(members) - EPSILON) + 1
    return members[np.lexsort((members, rank))][:length]


def member_writer(members_of: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [members_of(t.as_py() or "") for t in batch.column("text")]
            yield pa.record_batch([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["token"])

    return run


def sampled(texts: DataFrame, members_of: Callable, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, sorted; how often each comes) of those that come ``least`` times, at most ``most``."""
    counts = texts.mapInArrow(member_writer(members_of), "token long").groupBy("token").count().where(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "token").limit(most).toArrow()
    members = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(members)
    return members[order], found.column("count").to_numpy()[order]


def ranks(texts: DataFrame, n: int, members_of: Callable, parts_of: Callable) -> Ranks:
    """What a sample of fixed size tells; its tables have a fixed size too."""
    part = min(1.0, SAMPLE_TEXTS / max(1, n))
    some = texts.where(F.pmod("t1", F.lit(1 << 30)) <= int(part * (1 << 30))).select("text")
    members, seen = sampled(some, lambda text: np.unique(members_of(text)), 3, FREQUENT)
    parts, often = sampled(some, parts_of, 1, FREQUENT_PARTS)
    eighths = lambda x: np.rint(8 * np.log2(x)).astype(np.int64)
    total = int(eighths(max(1, int(often.sum()))))
    return Ranks(members, eighths(seen), parts, eighths(often) - total, -8 - total, total)


def prefix_writer(members_of: Callable, parts_of: Callable, similarity: float, order: Ranks) -> Callable:
    from colloquy.llm.simhash import set_hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set that comes often is told once in a while
        for batch in batches:
            tokens, owners, places, sizes = [np.empty(0, np.uint64)], *([np.empty(0, np.int64)] for _ in range(3))
            for text in batch.column("text"):
                whole = text.as_py() or ""
                listed = members_of(whole)
                members, at = np.unique(listed, return_index=True)
                owner = set_hash(members)[0]
                if owner in seen or not len(members):
                    continue
                if len(seen) > 1 << 16:
                    seen.clear()
                seen.add(owner)
                tokens.append(first_members(members, similarity, order.of(listed, parts_of(whole))[at]))
                owners.append(np.full(len(tokens[-1]), owner))
                places.append(np.arange(len(tokens[-1])))
                sizes.append(np.full(len(tokens[-1]), len(members)))
            rest = [pa.array(np.concatenate(c), t) for c, t in ((owners, pa.int64()), (places, pa.int32()), (sizes, pa.int32()))]
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), *rest], names=list(MEMBER))

    return run


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, s1) the distinct ones whose token has several sets."""
    kept, told = [np.empty(0, np.int64)] * len(MEMBER), False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, MEMBER, strict=True)]
        new = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
        columns = [c[new] for c in columns]
        like = columns[0][1:] == columns[0][:-1]
        shared = np.append(False, like) | np.append(like, False)
        # the last row of the batch before is the first here; it may have been told
        shared_out = shared.copy()
        if told:
            shared_out[0] = False
        yield pa.record_batch([pa.array(c[shared_out], t) for c, t in zip(columns, MEMBER.values(), strict=True)], names=list(MEMBER))
        told = bool(shared[-1]) if len(like) else told
        kept = [c[-1:] for c in columns]


def shared_prefixes(texts: DataFrame, n: int, similarity: float, members_of: Callable, parts_of: Callable) -> DataFrame:
    """(token, s1, place, n): the sets, by hash, that share a member among their first, where and how large they are."""
    order = ranks(texts, n, members_of, parts_of)
    rows = texts.select("text").mapInArrow(prefix_writer(members_of, parts_of, similarity, order), MEMBERS)
    rows = rows.repartition("token").sortWithinPartitions("token", "s1")
    return stored(rows.mapInArrow(shared_only, MEMBERS), "shared")


def possible_pairs(similarity: float) -> Callable:
    apart = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(na, nb, strict=True)):
                ok = min(x, y) >= similarity * max(x, y) - EPSILON
                if ok:
                    bits = [np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("bits_a", "bits_b")]
                    length = min(map(len, bits))
                    differ = np.bitwise_count(folded(bits[0], length) ^ folded(bits[1], length)).sum(dtype=np.int64)
                    ok = differ <= apart * (x + y) + EPSILON
                kept.append(bool(ok))
            mask = pa.array(kept, pa.bool_())
            yield pa.record_batch([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return run


def nearest_in_block(similarity: float, nearest: int) -> Callable:
    """The pairs of a block that may be similar, of each set the nearest of those not larger."""
    apart = (1 - similarity) / (1 + similarity)

    def run(block: pa.Table) -> pa.Table:
        n = block.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        n, node, root, chunk = n[order], *(block.column(c).to_numpy()[order] for c in ("node", "root", "chunk"))
        bits = block.column("bits").to_pylist()
        rows = [np.frombuffer(bits[i], np.uint64) for i in order]
        lengths = np.array([len(r) for r in rows])
        edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(rows)]
        levels = [(s, e, np.stack(rows[s:e])) for s, e in zip(edges, edges[1:], strict=False)]
        across = bool(block.column("i")[0].as_py() != block.column("j")[0].as_py())
        a, b, cut = [], [], []
        for x in range(1, len(rows)):
            low = int(np.searchsorted(n, similarity * n[x] - EPSILON))
            found, distance = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e, matrix in levels:
                s1, e1 = max(s, low), min(e, x)
                if s1 >= e1:
                    continue
                ok = root[s1:e1] != root[x]
                if across:
                    ok &= chunk[s1:e1] != chunk[x]
                at = np.flatnonzero(ok) + s1
                differ = np.bitwise_count(matrix[at - s] ^ folded(rows[x], matrix.shape[1])).sum(axis=1, dtype=np.int64)
                near = differ <= apart * (n[at] + n[x]) + EPSILON
                found.append(at[near])
                distance.append(differ[near])
            found, distance = np.concatenate(found), np.concatenate(distance)
            more = len(found) > nearest
            if more:
                found = found[np.argsort(distance, kind="stable")[:nearest]]
            a.extend([int(node[x])] * len(found))
            b.extend(node[found].tolist())
            cut.extend([more] * len(found))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])

    return run


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, m, weight, node, place, n, root) of the tokens whose sets are not all joined yet.

    Of tokens with the same sets the first stands for all: the order is the same in all sets.
    """
    placed = members.join(roots, "node", "left").select("token", "node", "place", "n", F.coalesce("root", "node").alias("root"))
    whole = (F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("h2"))
    sums = (F.count("*").alias("m"), F.sum("place").alias("places"), F.sum("n").alias("weight"))
    groups = placed.groupBy("token").agg(*sums, F.min("root").alias("low"), F.max("root").alias("high"), *whole)
    first = F.min(F.struct("places", "token", "weight")).alias("first")
    chosen = groups.where("low < high").groupBy("m", "h1", "h2").agg(first).select("first.token", "m", "first.weight")
    return stored(placed.join(stored(chosen, "chosen"), "token"), "open")


def proposer(similarity: float) -> Callable:
    """The pairs of each token's sets that size and place allow; rows come sorted by token."""
    share, names = similarity / (1 + similarity), ("token", "node", "root", "n", "place")

    def pairs(token: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        a, b, rest = [np.empty(0, np.int64)], [np.empty(0, np.int64)], n - place
        for shift in range(1, len(token)):
            i = np.flatnonzero(token[shift:] == token[:-shift])
            if not len(i):
                break
            j = i + shift
            ok = (root[i] != root[j]) & (np.minimum(rest[i], rest[j]) >= share * (n[i] + n[j]) - EPSILON)
            a.append(np.minimum(node[i], node[j])[ok])
            b.append(np.maximum(node[i], node[j])[ok])
        return pa.record_batch([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * len(names)
        for batch in batches:
            columns = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, names, strict=True)]
            change = np.flatnonzero(columns[0][1:] != columns[0][:-1])
            cut = change[-1] + 1 if len(change) else 0
            yield pairs(*(c[:cut] for c in columns))
            kept = [c[cut:] for c in columns]
        yield pairs(*kept)

    return run


def small_groups(opened: DataFrame, sets: DataFrame, similarity: float, small: int) -> DataFrame:
    """(a, b, cut): all pairs of small groups that may be similar."""
    rows = opened.where(F.col("m") <= small).repartition("token").sortWithinPartitions("token")
    found = rows.select("token", "node", "root", "n", "place").mapInArrow(proposer(similarity), "a long, b long")
    pairs = stored(found.distinct(), "pairs")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    pairs = pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(possible_pairs(similarity), "a long, b long")
    return pairs.withColumn("cut", F.lit(False))


def large_groups(opened: DataFrame, sets: DataFrame, similarity: float, small: int, nearest: int) -> DataFrame:
    """(a, b, cut): the nearest pairs of large groups; ``cut`` if the first of the pair has more."""
    size = F.col("weight") / 2 + 32 * F.col("m")  # a bitmap has at most half a byte for each member, 32 at least
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, size / BLOCK_BYTES)).cast("long")
    rows = opened.where(F.col("m") > small).drop("n").withColumn("parts", parts)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).join(sets, "node")
    rows = rows.select("token", "i", "j", "node", "root", "chunk", "n", "bits")
    return rows.groupBy("token", "i", "j").applyInArrow(nearest_in_block(similarity, nearest), "a long, b long, cut boolean")
