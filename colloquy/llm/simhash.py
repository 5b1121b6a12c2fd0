"""Near-duplicates by SimHash fingerprints and bit-sliced comparison.

A fingerprint has a bit set if more than half of the hashes of the document's word shingles
have it set.  Documents are linked if their fingerprints differ in at most ``radius`` bits; a
component is all that links reach.

``copies`` is the form for a pipeline: fingerprints and then shared shingles propose, and the
similarity of whole texts decides.

Search, over distinct fingerprints only: 64 bits are cut into ``radius + 2`` parts, so two
fingerprints within the radius agree in at least two parts.  Every fingerprint goes into one
bucket per pair of parts, and no link is missed.  A bucket of more than ``hot`` fingerprints is
parted again by the same rule on its remaining bits, and again, until buckets are small or no
bits are left to part: the rule holds on any set of bits, so that is exact too.

In a bucket, fingerprints stand as bit planes, one bit of 64 of them in a word.  Comparing one
with all others takes the planes, flipped where its own bit is set, and adds them to bitwise
carry-save counters, which start so that they overflow at radius + 1; a block of lanes is left
as soon as all of them have overflowed.  Small buckets are compared side by side: lanes are then
pairs.  A bucket yields a forest of links, one per fingerprint at most, never all pairs.

Links meet in ``components``; identical documents meet by their fingerprint, in plain equi
joins that adaptive execution can split at a hot one.

Defined cases: a text without words, null or empty, has fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; a null id takes no part in the least id,
and a component of null ids alone has a null component id; repeated rows are linked; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table
from colloquy.llm.components import components
from colloquy.llm.overlaps import SMALL_GROUP, large_groups, open_members, parity_bits, shared_prefixes, small_groups

WORDS = 5
RADIUS = 2
HOT = 1024
SMALL = 32
NEAREST = 4
BLOCK_WORDS = 64
HASH_SEED = 42
ALL = (1 << 64) - 1


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle; ASCII letters lower-cased, words parted by ASCII white space."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        rows = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprinter(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t.as_py() or "", words)) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        fingerprinter(words), "doc_id long, fp long"
    )


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_masks(radius: int, fixed: int = 0) -> list[int]:
    """Masks of which at least one covers only equal bits of any two within the radius.

    The bits outside ``fixed`` are cut into radius + 2 parts; a mask is ``fixed`` and two parts.
    """
    free = [b for b in range(64) if not fixed >> b & 1]
    parts = [sum(1 << b for b in some.tolist()) for some in np.array_split(free, radius + 2)]
    return [fixed | a | b for a, b in combinations(parts, 2)]


def planes_of(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """(len(bits), words): one bit of 64 values in each word."""
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    rows = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(rows[:, bits].T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, flip: np.ndarray, radius: int) -> np.ndarray:
    """Bitmap of the lanes with at most ``radius`` ones over the planes (flipped where told)."""
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    out = np.empty(planes.shape[1], np.uint64)
    for lo in range(0, planes.shape[1], BLOCK_WORDS):
        block = planes[:, lo : lo + BLOCK_WORDS]
        counter = [np.full(block.shape[1], ALL if start >> k & 1 else 0, np.uint64) for k in range(width)]
        over = np.zeros(block.shape[1], np.uint64)
        for i, plane in enumerate(block):
            carry = ~plane if flip[i] else plane
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if i % 4 == 3 and (over == ALL).all():
                break
        out[lo : lo + BLOCK_WORDS] = ~over
    return out


def lanes_set(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of_large(values: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of one bucket the least index that it reaches, and its nearest others.

    Each value is compared once; missing neighbours are the value itself.
    """
    planes, n = planes_of(values, bits), len(values)
    label, closest = np.full(n, -1), np.repeat(np.arange(n)[:, None], NEAREST, axis=1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        while queue:
            i = queue.pop()
            flip = (values[i] >> np.array(bits, np.uint64)) & np.uint64(1)
            near = lanes_set(within(planes, flip.astype(bool), radius), n)
            others = near[near != i]
            if len(others):
                order = np.argsort(np.bitwise_count(values[others] ^ values[i]), kind="stable")[:NEAREST]
                closest[i, : len(order)] = others[order]
            new = near[label[near] < 0]
            label[new] = seed
            queue.extend(new.tolist())
    return label, closest


def pairs_of_small(values: np.ndarray, group: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of many small buckets in a row; ``group`` numbers them. Lanes are pairs."""
    flip, a, b = np.zeros(len(bits), bool), [], []
    for shift in range(1, len(values)):
        at = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(at):
            break
        near = lanes_set(within(planes_of(values[at] ^ values[at + shift], bits), flip, radius), len(at))
        a.append(at[near])
        b.append(at[near] + shift)
    return np.concatenate([*a, []]).astype(int), np.concatenate([*b, []]).astype(int)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(spaces, masks, fingerprints), sorted, in pieces that end between buckets."""
    kept = [np.empty(0, np.uint64)] * 3
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy().view(np.uint64) for c in ("space", "mask", "fp")]
        columns = [np.concatenate(pair) for pair in zip(kept, new, strict=True)]
        key = [*columns[:2], columns[1] & columns[2]]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
        cut = change[-1] + 1 if len(change) else 0
        if cut:
            yield tuple(c[:cut] for c in columns)
        kept = [c[cut:] for c in columns]
    if len(kept[0]):
        yield tuple(kept)


def linker(radius: int, direct: bool) -> Callable:
    """Links that connect what is in reach; with ``direct`` each link itself is within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spaces, masks, fps in whole_buckets(batches):
            s, a, b = ([np.empty(0, np.uint64)] for _ in range(3))
            edges = np.flatnonzero(np.append(True, (masks[1:] != masks[:-1]) | (spaces[1:] != spaces[:-1])))
            for lo, hi in zip(edges, np.append(edges[1:], len(masks)), strict=True):
                mask, values = int(masks[lo]), fps[lo:hi]
                bits = [k for k in range(64) if not mask >> k & 1]
                key = values & np.uint64(mask)
                number = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
                size = np.bincount(number)[number]
                some = (size > 1) & (size <= SMALL)
                small = values[some]
                if len(small):
                    i, j = pairs_of_small(small, number[some], bits, radius)
                    if not direct:
                        i, j = np.arange(len(small)), forest(i, j, len(small))
                    a.append(small[i])
                    b.append(small[j])
                for g in np.unique(number[size > SMALL]):
                    large = values[number == g]
                    least, nearest = links_of_large(large, bits, radius)
                    a.append(np.repeat(large, NEAREST) if direct else large)
                    b.append(large[nearest.ravel() if direct else least])
                s.append(np.full(sum(map(len, a)) - sum(map(len, s)), spaces[lo]))
            s, a, b = np.concatenate(s), np.concatenate(a), np.concatenate(b)
            linked = a != b
            yield pa.record_batch([pa.array(x[linked].view(np.int64)) for x in (s, a, b)], names=["space", "a", "b"])

    return run


def bucketed(rows: DataFrame, radius: int, fixed: int) -> DataFrame:
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in bucket_masks(radius, fixed)])
    return rows.select("space", "fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def buckets(nodes: DataFrame, radius: int, hot: int, depth: int = 3) -> DataFrame:
    """(space, mask, key, fp): every two fingerprints of a space within the radius share a bucket."""
    rows, fixed, done = bucketed(nodes, radius, 0), bucket_masks(radius), None
    for level in range(depth):
        over = stored(rows.groupBy("space", "mask", "key").count().where(F.col("count") > hot).drop("count"), "hot")
        crowded = [int(r["mask"]) & ALL for r in over.select("mask").distinct().collect()]  # at most one row per mask
        if not crowded:
            break
        cold = rows.join(over, ["space", "mask", "key"], "left_anti")
        done = cold if done is None else done.unionAll(cold)
        inside = rows.join(over, ["space", "mask", "key"], "left_semi")
        finer = {signed(m): [signed(x) for x in bucket_masks(radius, m)] for m in crowded if 64 - m.bit_count() >= radius + 2}
        if len(finer) < len(crowded) or level == depth - 1:
            rows = inside
            break
        table_of = F.create_map(*[x for m, xs in finer.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(y).cast("long") for y in xs]))])
        rows = inside.select("space", "fp", F.explode(table_of[F.col("mask")]).alias("mask"))
        rows = rows.distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return rows if done is None else done.unionAll(rows)


def link(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT, direct: bool = False) -> DataFrame:
    """Edges (space, a, b) that connect exactly the distinct fingerprints (``fp``) within the radius.

    Fingerprints of different spaces (``space``, 0 if there is no such column) have no links.
    With ``direct`` the edges are themselves within the radius, for a check to follow: all of
    them in buckets of up to ``SMALL``, each fingerprint's ``NEAREST`` in larger ones.
    """
    space = F.col("space") if "space" in nodes.columns else F.lit(0)
    rows = buckets(nodes.select(space.cast("long").alias("space"), "fp"), radius, hot)
    rows = rows.repartition("space", "mask", "key").sortWithinPartitions("space", "mask", "key", "fp")
    return rows.select("space", "mask", "fp").mapInArrow(linker(radius, direct), "space long, a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): the least id of the documents that links reach."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(link(nodes, radius, hot))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_fp = placed.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def word_set_fingerprints(text: str, seeds: int) -> list[int]:
    """One fingerprint per seed over the distinct words of a text."""
    words = np.unique(shingle_hashes(text, 1))
    found = []
    for seed in range(seeds):
        h = words ^ np.uint64(seed * 0x9E3779B97F4A7C15 & ALL)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(majority(h ^ (h >> np.uint64(32))))
    return found


def set_hash(members: np.ndarray) -> tuple[int, int]:
    """Two hashes that stand for a sorted set of hashes."""
    from xxhash import xxh3_128_intdigest

    whole = xxh3_128_intdigest(members.tobytes())
    return tuple(h - (1 << 64) if h >> 63 else h for h in (whole & ALL, whole >> 64))


def set_fingerprinter(words: int, seeds: int) -> Callable:
    """Fingerprints, and of the set of shingles two hashes, its size and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_set_fingerprints(t.as_py() or "", seeds) for t in batch.column("text")]
            sets = [np.unique(shingle_hashes(t.as_py() or "", words)) for t in batch.column("text")]
            own = [batch.column(c) for c in ("t1", "t2", "doc_id")]
            s1, s2 = ([set_hash(x)[k] for x in sets] for k in (0, 1))
            rest = [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([len(x) for x in sets], pa.int32())]
            bits = pa.array([parity_bits(x) for x in sets], pa.binary())
            names = ["t1", "t2", "doc_id", "fps", "s1", "s2", "n", "bits"]
            yield pa.record_batch([*own, pa.array(found, pa.list_(pa.int64())), *rest, bits], names=names)

    return run


def likeness(words: int, least: float) -> Callable:
    """The pairs whose sets of word shingles have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts, alike = (batch.column("text_a"), batch.column("text_b")), []
            for i, pair in enumerate(zip(a, b, strict=True)):
                sets = []
                for node, column in zip(pair, texts, strict=True):
                    if node not in seen:
                        if len(seen) > 256:
                            seen.clear()
                        seen[node] = np.unique(shingle_hashes(column[i].as_py() or "", words))
                    sets.append(seen[node])
                both = len(np.intersect1d(*sets, assume_unique=True))
                alike.append(both >= least * max(1, len(sets[0]) + len(sets[1]) - both))
            kept = pa.array(alike, pa.bool_())
            yield pa.record_batch([batch.column(c).filter(kept) for c in ("a", "b")], names=["a", "b"])

    return run


def text_key(text: str) -> dict:
    """Two hashes that stand for a text (null counts as empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return {"t1": F.xxhash64(whole), "t2": F.xxhash64(F.lit(7), whole)}


def alike_pairs(edges: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the proposed pairs of nodes (a, b) those whose whole texts are alike."""
    used = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    asked = nodes.join(used, "node").select("node", "t1", "t2", "least")
    texts = rows.join(asked, ["t1", "t2"]).where(F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("least")).select("node", "text")
    texts = stored(texts, "asked")
    pairs = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(pairs.select("a", "b", "text_a", "text_b").mapInArrow(likeness(words, similarity), "a long, b long"), "alike")


def copies(
    docs: DataFrame, words: int = WORDS, similarity: float = 0.8, radius: int = 4, seeds: int = 4, hot: int = HOT, small: int = SMALL_GROUP
) -> DataFrame:
    """(t1, t2, doc_id, rows, keep): for each text and id, how many rows, and whether it stays.

    Documents are alike if their sets of word shingles have that similarity.  Equal texts and
    equal sets are alike at once.  For others, fingerprints over the distinct words, one per seed,
    first propose pairs within the radius of any seed, in a bucket of more than ``SMALL``
    fingerprints the ``NEAREST`` of each; that joins most copies at little cost.  Then all pairs
    that may be alike and are not joined yet are proposed by the shingles that they share
    (``overlaps``), the nearest first and the rest among what is still apart, until no pair is
    left.  The similarity of each proposed pair is computed from the whole texts.  Texts without
    words are alike only if they are equal.  Of each component the least id stays, of equal ids
    the least hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns(text_key("text"))
    kinds = "t1 long, t2 long, doc_id long, fps array<long>, s1 long, s2 long, n int, bits binary"
    prints = stored(rows.mapInArrow(set_fingerprinter(words, seeds), kinds), "prints")
    own = F.first(F.struct("fps", "s1", "s2", "n", "bits")).alias("own")
    one = prints.groupBy("t1", "t2").agg(F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("least"), own)
    one = one.select("t1", "t2", "least", "own.*")
    nodes = stored(one.withColumn("node", F.monotonically_increasing_id()), "texts")
    marked = nodes.select("node", F.posexplode("fps").alias("space", "fp"))
    leads = stored(marked.groupBy("space", "fp").agg(F.min("node").alias("lead")), "leads")
    same = marked.join(leads, ["space", "fp"]).where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    near = link(leads, radius, hot, direct=True).distinct()
    near = near.join(leads.select("space", F.col("fp").alias("a"), F.col("lead").alias("x")), ["space", "a"])
    near = near.join(leads.select("space", F.col("fp").alias("b"), F.col("lead").alias("y")), ["space", "b"])
    edges = same.unionAll(near.select("x", "y")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    asked = stored(edges.distinct(), "proposed")
    sets = stored(nodes.where("n > 0").groupBy("s1", "s2").agg(F.min("node").alias("lead")), "sets")
    equal = nodes.join(sets, ["s1", "s2"]).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    alike = equal.unionAll(alike_pairs(asked, nodes, rows, words, similarity))

    members_of, parts_of = (partial(shingle_hashes, words=w) for w in (words, 1))
    shared = shared_prefixes(rows, prints.count(), similarity, members_of, parts_of)
    members = stored(shared.join(sets, "s1").select("token", "place", "n", F.col("lead").alias("node")), "members")
    sized = nodes.select("node", "n", "bits")
    roots, nearest, more = components(alike), NEAREST, True
    while more:
        opened = open_members(members, roots)
        found = large_groups(opened, sized, similarity, small, nearest)
        if nearest == NEAREST:  # later rounds are for what large groups have left
            found = found.unionAll(small_groups(opened, sized, similarity, small))
        found = stored(found, "found")
        more = found.where("cut").limit(1).count() > 0
        edges = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = stored(edges.join(asked, ["a", "b"], "left_anti"), "proposed")
        asked, nearest = asked.unionAll(edges), nearest * 8
        if edges.limit(1).count():
            alike = alike.unionAll(alike_pairs(edges, nodes, rows, words, similarity))
            roots = components(alike)

    placed = nodes.join(roots, "node", "left").select("t1", "t2", "least", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min(F.struct("least", "t1", "t2")).alias("best"))
    # the text that stays, and the id under which it stays
    stays = stored(best.select("best.t1", "best.t2", F.col("best.least").alias("least")), "stays")
    counted = prints.groupBy("t1", "t2", "doc_id").agg(F.count("*").alias("rows"))
    keep = F.coalesce(F.col("least") == F.coalesce("doc_id", F.lit(2**63 - 1)), F.lit(False))
    return counted.join(stays, ["t1", "t2"], "left").select("t1", "t2", "doc_id", "rows", keep.alias("keep"))


def without_copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of documents that are alike."""
    keep = stored(copies(docs, **settings).where("keep").drop("keep"), "kept")
    key = F.struct(*[c.alias(k) for k, c in text_key("text").items()], F.col("doc_id").cast("long").alias("doc_id"))
    mine = docs.select(F.struct("*").alias("row"), key.alias("key"))
    asked = keep.select(F.struct("t1", "t2", "doc_id").alias("asked"), "rows")
    same = (F.col("key.t1") == F.col("asked.t1")) & (F.col("key.t2") == F.col("asked.t2"))
    here = mine.join(asked, same & F.col("key.doc_id").eqNullSafe(F.col("asked.doc_id")))
    # rows that share id and text: one stays
    several = here.where("rows > 1").dropDuplicates(["asked"])
    return here.where("rows = 1").select("row.*").unionAll(several.select("row.*"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
