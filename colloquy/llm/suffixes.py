"""Repeated passages by a distributed merge sort of suffixes.

Every byte that lies in a string of ``window`` bytes which also starts anywhere else in the
corpus is removed; strings are judged on the input, as bytes, and never cross documents.

Which suffixes to sort.  All windows of a text together would be far more bytes than the text.
Each window is therefore represented by one anchor inside it: the start of that one of its
substrings of ``gram`` bytes whose hash is least (the leftmost of equals).  Equal windows choose
the same anchor, neighbouring windows mostly share theirs, and so a text becomes contexts: runs
of windows with a common anchor, about one per ``(window - gram) / 2`` bytes.  Contexts whose
gram hash occurs once in the corpus hold no repeat and are never sent anywhere (the usual
bounding of distinguishing prefixes by hashes before strings are exchanged).  Contexts that are
equal as a whole, by 128 bits of hash, repeat in all their windows.  What is left, the distinct
contexts that share a gram with another, is sorted.

The sort.  A task sorts the suffixes that start at its anchors, cuts them into runs by key range
and sends the runs front-coded: of each suffix only what follows the prefix it shares with the
one before.  A receiver merges the runs with a loser tree that carries, for every contender, the
length of the prefix shared with the last winner: the longer one wins without a look at the
bytes, and equal ones are compared only from there on.  The merge gives the order and all
neighbours' common prefixes; suffixes stand behind the hash of their gram, so key ranges are
even without sampling, and suffixes with a common gram come out together.

The windows.  Window o bytes before the anchor is equal in two contexts if they share at least o
bytes to the left and window - o to the right.  Each side's neighbours' common prefixes cut the
order into classes for each o; two contexts in the same pair of classes repeat each other.

Hot grams.  A gram with more than ``hot`` distinct contexts, such as a passage in a third of all
documents with different text behind it, is not brought together.  Its contexts are cut into
shorter runs of windows, which have more bytes in common: the longer gram parts most of them, or
shows them to be equal or unique.  What is still crowded is cut into single windows, whose gram
is the window itself, so that equal grams are equal windows and nothing is left to sort.  Counts
per gram are summed before the shuffle, and all joins are plain equi joins against written
tables, so that adaptive execution can split a hot key.

Two rules at once.  With ``passages`` a second rule of shorter windows, judged by whole words,
runs first.  A repeated string of ``window`` bytes lies, at each of its places, in a run of repeated
shorter windows of at least that length, so only such runs are then searched for it.

Defined cases: a null or empty text, or one shorter than a window, loses nothing; a repeated row
repeats all its windows; a document with a null id is treated as any other; an empty table gives
no rows; texts are worked on one at a time, in blocks.
All columns of the input pass through in a
struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table, text_bytes

WINDOW = 400
GRAM = 200
PASSAGE_WINDOW = 200
PASSAGE_GRAM = 100
PASSAGE_WORDS = 51
HOT = 256
BUCKET = 2_048
RUN_BYTES = 16 << 20
BLOCK = 1 << 18
POSITION_BITS = 20
BASE = 0x9E3779B97F4A7C15
ONES = (1 << 64) - 1

CONTEXTS = "t1 long, t2 long, doc_id long, start long, more array<long>, n int, anchor int, gram long, whole long"
RUN = (
    "bucket int, shared array<int>, rest array<binary>, left array<binary>, t1 array<long>, t2 array<long>, "
    "start array<long>, n array<int>, open array<boolean>"
)
SPANS = "t1 long, t2 long, begin long, end long"


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    both = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64))) for b in (BASE, inverse)]
    return both[0], both[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes at each position."""
    up, down = powers(BLOCK + 4096 if len(data) <= BLOCK + 4096 else len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def spread_hash(h: np.ndarray) -> np.ndarray:
    """The hash of a chosen gram, one to one, over the whole range: chosen ones are all small."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def contexts_of(data: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, gram hash) of each context of a text."""
    array, low = np.frombuffer(data, np.uint8), np.uint64((1 << POSITION_BITS) - 1)
    out = [[np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]]
    for lo in range(0, len(data) - window + 1, BLOCK):
        hi = min(lo + BLOCK, len(data) - window + 1)
        h = gram_hashes(array[lo : hi - 1 + window], gram)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append([lo + first, np.diff(first, append=hi - lo), lo + at[first], spread_hash(h[at[first]])])
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def context_writer(window: int, gram: int) -> Callable:
    """Contexts that are equal within a text share a row: ``more`` has the other places, if any.

    If there is a column ``_runs``, windows that do not lie in one of these runs are left out.
    """
    from xxhash import xxh3_64_intdigest

    names = [c.split()[0] for c in CONTEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.empty(0, np.int64)] for _ in range(6)]
            texts = batch.column("data")
            runs = joined_spans(batch.column("_runs")) if "_runs" in batch.schema.names else ([(0, n)] for n in pc.binary_length(texts).to_pylist())
            for i, found in enumerate(runs):
                long = [(a, b) for a, b in found if b - a >= window]
                if not long:
                    continue
                data = texts[i].as_py()
                found = [(a, contexts_of(data[a:b], window, gram)) for a, b in long]
                first, anchor = (np.concatenate([a + c[k] for a, c in found]) for k in (0, 2))
                n, key = (np.concatenate([c[k] for _, c in found]) for k in (1, 3))
                ends = (first + n - 1 + window).tolist()
                whole = [xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
                columns = (np.full(len(first), i), first, n, anchor - first, key.view(np.int64), np.array(whole, np.uint64).view(np.int64))
                for column, more in zip(parts, columns, strict=True):
                    column.append(more)
            columns = [np.concatenate(p) for p in parts]
            row, first, n, anchor, key, whole = (c[np.lexsort((columns[1], columns[5], columns[4], columns[0]))] for c in columns)
            lead = np.append(True, np.any([c[1:] != c[:-1] for c in (row, key, whole)], axis=0))[: len(row)]
            row, start, n, anchor, key, whole = (c[lead] for c in (row, first, n, anchor, key, whole))
            others = np.append(0, np.cumsum(~lead))[np.append(np.flatnonzero(lead), len(lead))]
            more = pa.ListArray.from_arrays(pa.array(others, pa.int32()), pa.array(first[~lead]))
            more = pc.if_else(pa.array(np.diff(others) > 0), more, pa.scalar(None, more.type))
            own = [batch.column(c).take(pa.array(row)) for c in ("t1", "t2", "doc_id")]
            rest = [pa.array(start), more, pa.array(n, pa.int32()), pa.array(anchor, pa.int32()), pa.array(key), pa.array(whole)]
            yield pa.record_batch([*own, *rest], names=names)

    return run


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share at least ``known`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted front-coded runs; a run is a list of (shared with the one before, rest)."""

    def __init__(self, runs: list[list[tuple[int, bytes]]]):
        self.runs, self.at = runs, [-1] * len(runs)
        self.string: list[bytes | None] = [b""] * len(runs)
        self.shared = [0] * len(runs)  # with the last winner
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        for r in range(len(runs)):
            self.advance(r)
        self.loser = [-1] * self.leaves
        self.top = self.build(1)

    def advance(self, r: int) -> None:
        self.at[r] += 1
        if self.at[r] < len(self.runs[r]):
            shared, rest = self.runs[r][self.at[r]]
            self.string[r] = self.string[r][:shared] + rest
            self.shared[r] = shared
        else:
            self.string[r] = None

    def build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves if node - self.leaves < len(self.runs) else -1
        winner, self.loser[node] = self.play(self.build(2 * node), self.build(2 * node + 1))
        return winner

    def play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length then refers to the winner."""
        if b < 0 or self.string[b] is None:
            return a, b
        if a < 0 or self.string[a] is None:
            return b, a
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        x, y = self.string[a], self.string[b]
        n = common(x, y, self.shared[a])
        if n == len(x) and (n < len(y) or a < b) or n < min(len(x), len(y)) and x[n] < y[n]:
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(run, place in it, string, length shared with the string before)."""
        while self.top >= 0 and self.string[self.top] is not None:
            r = self.top
            yield r, self.at[r], self.string[r], self.shared[r]
            self.advance(r)
            node, winner = (r + self.leaves) // 2, r
            while node:
                winner, self.loser[node] = self.play(winner, self.loser[node])
                node //= 2
            self.top = winner


def repeated_offsets(shared_right: np.ndarray, left: list[bytes], window: int, offsets: np.ndarray) -> np.ndarray:
    """(offset, context): whether the window that many bytes before the anchor occurs in another.

    ``shared_right`` has the common lengths of neighbours in the sorted order of the contexts;
    ``left`` the bytes before the anchors, backwards.
    """
    m = len(left)
    order = sorted(range(m), key=left.__getitem__)
    shared_left = np.array([common(left[i], left[j], 0) for i, j in zip(order, order[1:], strict=False)])
    right_class, left_class = np.zeros((2, len(offsets), m), np.int64)
    np.cumsum(shared_right[None, :] < (window - offsets)[:, None], axis=1, out=right_class[:, 1:])
    sorted_class = np.zeros((len(offsets), m), np.int64)
    np.cumsum(shared_left[None, :] < offsets[:, None], axis=1, out=sorted_class[:, 1:])
    left_class[:, order] = sorted_class
    both = right_class * m + left_class
    place = np.argsort(both, axis=1)
    ranked = np.take_along_axis(both, place, axis=1)
    same, out = ranked[:, 1:] == ranked[:, :-1], np.zeros(both.shape, bool)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] |= same
    twice[:, :-1] |= same
    np.put_along_axis(out, place, twice, axis=1)
    return out


def extract(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[tuple[dict, bytes]]:
    """Each wanted context and its bytes."""
    for batch in batches:
        datas, lists = batch.column("data"), batch.column("_wanted")
        for i in range(batch.num_rows):
            wanted = [w for w in lists[i].as_py() or [] if w["hot"] == hot]
            if wanted:
                data = datas[i].as_py()
                own = {c: batch.column(c)[i].as_py() for c in ("t1", "t2")}
                for w in wanted:
                    yield w | own, data


def run_writer(window: int, buckets: int) -> Callable:
    """Sorted, front-coded runs of the suffixes at the anchors, cut by key range."""
    width = -(-(1 << 64) // buckets)

    def front_coded(entries: list[tuple]) -> Iterator[pa.RecordBatch]:
        entries.sort(key=lambda e: e[0])
        begin = 0
        while begin < len(entries):
            bucket = int.from_bytes(entries[begin][0][:8], "big") // width
            end = begin
            columns: list[list] = [[] for _ in range(8)]
            before = b""
            while end < len(entries) and int.from_bytes(entries[end][0][:8], "big") // width == bucket:
                string, *payload = entries[end]
                shared = common(before, string, 0)
                for column, value in zip(columns, (shared, string[shared:], *payload), strict=True):
                    column.append(value)
                before, end = string, end + 1
            inner = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            arrays = [pa.array([c], pa.list_(t)) for c, t in zip(columns, inner, strict=True)]
            yield pa.record_batch([pa.array([bucket], pa.int32()), *arrays], names=[c.split()[0] for c in RUN.split(", ")])
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held = [], 0
        for w, data in extract(batches, False):
            anchor, end = w["start"] + w["anchor"], w["start"] + w["n"] - 1 + window
            string = struct.pack(">q", w["gram"] ^ -(1 << 63)) + data[anchor:end]
            left = data[w["start"] : anchor][::-1]
            entries.append((string, left, w["t1"], w["t2"], w["start"], w["n"], w["open"]))
            held += len(string) + len(left)
            if held > RUN_BYTES:
                yield from front_coded(entries)
                entries, held = [], 0
        yield from front_coded(entries)

    return run


def merger(window: int) -> Callable:
    """Merges the runs of one key range and tells the repeated spans of its open contexts."""

    def spans(group: list[tuple[bytes, int, tuple]]) -> Iterator[tuple]:
        # the same context comes twice if equal rows share an id
        group = [g for k, g in enumerate(group) if not k or g[2][1:4] != group[k - 1][2][1:4]]
        if len(group) < 2:
            return
        before = [len(payload[0]) for _, _, payload in group]
        offsets = np.arange(min(b - p[4] + 1 for b, (_, _, p) in zip(before, group, strict=True)), max(before) + 1)
        shared = np.array([g[1] - 8 for g in group[1:]])
        found = repeated_offsets(shared, [p[0] for _, _, p in group], window, offsets)
        for i, (_, _, (left, t1, t2, start, n, open_)) in enumerate(group):
            if open_:
                starts = start + len(left) - offsets[::-1]
                hit = found[::-1, i] & (starts >= start) & (starts < start + n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                for a, b in edge.reshape(-1, 2).tolist():
                    yield t1, t2, int(starts[a]), int(starts[b - 1]) + window

    def run(runs: pa.Table) -> pa.Table:
        columns = {c: runs.column(c).to_pylist() for c in runs.column_names}
        names = ("left", "t1", "t2", "start", "n", "open")
        tree = LoserTree([list(zip(a, b, strict=True)) for a, b in zip(columns["shared"], columns["rest"], strict=True)])
        out, group = [], []
        for r, at, string, shared in tree:
            if shared < 8 and group:
                out.extend(spans(group))
                group = []
            group.append((string, shared, tuple(columns[c][r][at] for c in names)))
        out.extend(spans(group))
        columns_out = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns_out], names=["t1", "t2", "begin", "end"])

    return run


def part_writer(window: int, width: int) -> Callable:
    """The contexts of hot grams, cut into runs of at most ``width`` windows.

    Cuts lie at fixed distances from the anchor, so equal windows come into like parts.  The gram
    of a part is what all windows between two cuts have in common.
    """
    from xxhash import xxh3_64_intdigest

    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for w, data in extract(batches, True):
            anchor, last = w["start"] + w["anchor"], w["start"] + w["n"] - 1
            for k in range((anchor - last) // width, (anchor - w["start"]) // width + 1):
                low, high = max(w["start"], anchor - k * width - width + 1), min(last, anchor - k * width)
                core = anchor - k * width
                gram = xxh3_64_intdigest(data[core : core - width + 1 + window], seed=w["gram"] & ONES)
                whole = xxh3_64_intdigest(data[low : high + window], seed=core - low)
                out.append((w["t1"], w["t2"], w["doc_id"], low, None, high - low + 1, core - low, signed(gram), signed(whole)))
            if len(out) > 50_000:
                yield table_of(out)
                out = []
        yield table_of(out)

    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in CONTEXTS.split(", ")]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def joined_spans(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Of each row the runs that its spans make up together; null counts as none."""
    at = column.offsets.to_numpy()
    begins, ends = (column.values.field(c).to_numpy() for c in ("begin", "end"))
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if low == high:
            yield []
            continue
        order = np.argsort(begins[low:high], kind="stable")
        begin, reach = begins[low:high][order], np.maximum.accumulate(ends[low:high][order])
        lead = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
        yield list(zip(begin[lead].tolist(), reach[np.append(lead[1:], len(begin)) - 1].tolist(), strict=True))


RESULT = (
    "_spans array<struct<begin:long,end:long>>, _n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string, "
    "_kept binary, _text string, _n_passages long, _passage_bytes long, _passage_text string"
)


def word_runs(data: bytes, runs: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Of the runs that hold that many whole words, from the first of these to the last."""
    out = []
    for a, b in runs:
        begin = a if not a or data[a - 1 : a].isspace() else a + len(re.match(rb"\S*", data[a:b])[0])
        end = b if b == len(data) or data[b : b + 1].isspace() else b - len(re.search(rb"\S*\Z", data[a:b])[0])
        found = list(re.finditer(rb"\S+", data[begin:end])) if end > begin else []
        if len(found) >= words:
            out.append((begin + found[0].start(), begin + found[-1].end()))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    borders = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))


def passage_result(data: bytes, runs: list[tuple[int, int]], words: int, same: bool) -> dict:
    """The second rule; with ``same`` a text that loses nothing by it is not given again."""
    found = word_runs(data, runs, words)
    text = None if same and not found else without(data, found).decode("utf-8", "ignore")
    return {"_n_passages": len(found), "_passage_bytes": sum(b - a for a, b in found), "_passage_text": text}


def result_of(data: bytes, runs: list[tuple[int, int]], keep: str, words: int = 0) -> dict:
    if words:
        runs = word_runs(data, runs, words)
    kept = without(data, runs)
    return {
        "_spans": [{"begin": a, "end": b} for a, b in runs],
        "_n_bytes": len(data),
        "_n_removed": len(data) - len(kept),
        "_n_spans": len(runs),
        "_kept_sha256": hashlib.sha256(kept).hexdigest(),
        "_kept": kept if keep == "bytes" else None,
        # a character that a cut leaves incomplete goes with the cut
        "_text": kept.decode("utf-8", "ignore") if keep == "text" else None,
    }


RESULT_TYPES = {
    "_spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
    "_n_bytes": pa.int64(),
    "_n_removed": pa.int64(),
    "_n_spans": pa.int64(),
    "_kept_sha256": pa.string(),
    "_kept": pa.binary(),
    "_text": pa.string(),
    "_n_passages": pa.int64(),
    "_passage_bytes": pa.int64(),
    "_passage_text": pa.string(),
}
NO_RESULT = dict.fromkeys(RESULT_TYPES)
OF_PASSAGES = ("_n_passages", "_passage_bytes", "_passage_text")


def finisher(keep: str, put_off: bool, words: int = 0, passage_words: int = 0) -> Callable:
    """Apply the spans; with ``put_off`` rows that wait for the sort keep their text instead."""

    def result(data: bytes, full: list[tuple[int, int]], runs: list[tuple[int, int]]) -> dict:
        found = NO_RESULT | result_of(data, full, keep, words)
        if passage_words:
            found |= passage_result(data, runs, passage_words, keep == "text" and not found["_spans"])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waits = batch.column("_waits").to_pylist() if put_off else [False] * batch.num_rows
            data = batch.column("data")
            known = zip(waits, joined_spans(batch.column("_full")), joined_spans(batch.column("_runs")), strict=True)
            out = [NO_RESULT if later else result(data[i].as_py(), full, runs) for i, (later, full, runs) in enumerate(known)]
            arrays = [pa.array([o[c] for o in out], t) for c, t in RESULT_TYPES.items()]
            if not put_off:
                yield pa.record_batch([batch.column("_row"), *arrays], names=["_row", *RESULT_TYPES])
                continue
            none = pa.scalar(None, pa.binary())
            later = pc.if_else(pa.array(waits, pa.bool_()), data, none)
            own = [batch.column(c) for c in ("_row", "t1", "t2", "_full", "_runs", "_wanted", "_waits")]
            yield pa.record_batch([*own, later, *arrays], names=["_row", "t1", "t2", "_full", "_runs", "_wanted", "_waits", "data", *RESULT_TYPES])

    return run


SPAN_LIST = "array<struct<begin:long,end:long>>"
WANTED = "array<struct<start:long,n:int,anchor:int,gram:long,open:boolean,hot:boolean,doc_id:long>>"


def judged(contexts: DataFrame, window: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(spans that repeat as a whole, contexts that have to be compared).

    The second has one row for each of the different contexts that share their gram with another,
    whether it is still open, and whether its gram is hot.
    """
    places = F.lit(1).cast("long") + F.coalesce(F.array_size("more"), F.lit(0))
    grams = contexts.groupBy("gram").agg(F.sum(places).alias("c"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    shared = contexts.join(stored(grams.where("c > 1"), "grams"), "gram").drop("c")
    shared = stored(shared.withColumn("equal", F.col("least") == F.col("most")).drop("least", "most"), "shared")
    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<long>")))
    long = F.col("n").cast("long") - 1 + window
    span = F.transform(starts, lambda s: F.struct(s.alias("begin"), (s + long).alias("end"))).alias("spans")
    differ = shared.where("not equal")
    place = F.struct("t1", "t2", "doc_id", "start", "n", "anchor")
    distinct = stored(differ.groupBy("gram", "whole").agg(F.sum(places).alias("c"), F.min(place).alias("p")), "distinct")
    many = distinct.where("c > 1").select("gram", "whole")
    full = shared.where("equal").select("t1", "t2", span).unionAll(differ.join(many, ["gram", "whole"]).select("t1", "t2", span))
    sizes = stored(distinct.groupBy("gram").agg(F.count("*").alias("m")), "sizes")
    want = F.struct("p.start", "p.n", "p.anchor", "gram", (F.col("c") == 1).alias("open"), (F.col("m") > hot).alias("hot"), "p.doc_id")
    wanted = distinct.join(sizes, "gram").select(F.col("p.t1").alias("t1"), F.col("p.t2").alias("t2"), want.alias("want"))
    return full.distinct(), wanted


def noted_texts(full: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t1, t2, _full, _wanted): what is known of each text."""
    no_spans, no_want = F.lit(None).cast(SPAN_LIST), F.lit(None).cast(WANTED.removeprefix("array<")[:-1])
    notes = full.select("t1", "t2", "spans", no_want.alias("want")).unionAll(wanted.select("t1", "t2", no_spans.alias("spans"), "want"))
    notes = notes.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("_full"), F.collect_list("want").alias("_wanted"))
    return stored(notes, "notes")


def sorted_spans(texts: DataFrame, window: int, bucket: int) -> DataFrame:
    """The repeated spans of the open contexts of grams that are not hot."""
    cold = texts.select(F.sum(F.size(F.filter("_wanted", lambda w: ~w["hot"])))).first()[0] or 0
    runs = texts.select("t1", "t2", "_wanted", "data").mapInArrow(run_writer(window, max(1, -(-cold // bucket))), RUN)
    return runs.groupBy("bucket").applyInArrow(merger(window), SPANS)


def repeat_notes(found: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    contexts = stored(found.mapInArrow(context_writer(window, gram), CONTEXTS), "contexts")
    return noted_texts(*judged(contexts, window, hot))


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """``rows`` and what is known of their texts, and what each row's text is asked for."""
    mine = F.filter("_wanted", lambda w: w["doc_id"].eqNullSafe(F.col("doc_id")))
    return rows.join(notes, ["t1", "t2"], "left").withColumn("_wanted", mine)


def compared(waiting: DataFrame, window: int, gram: int, hot: int, bucket: int) -> DataFrame:
    """(t1, t2, _more): the repeated spans that come out of the sort."""
    spans, texts = sorted_spans(waiting, window, bucket), waiting
    for width in (max(1, (window - gram) // 8), 1):
        if not texts.where(F.exists("_wanted", lambda w: w["hot"])).limit(1).count():
            break
        parts = stored(texts.select("t1", "t2", "_wanted", "data").mapInArrow(part_writer(window, width), CONTEXTS), "parts")
        full, wanted = judged(parts.distinct(), window, hot)
        spans = spans.unionAll(full.select("t1", "t2", F.explode("spans").alias("span")).select("t1", "t2", "span.*"))
        if width > 1:
            found = noted_texts(full.where("false"), wanted).drop("_full")
            texts = stored(waiting.select("t1", "t2", "data").join(found, ["t1", "t2"]), "hot-texts")
            spans = spans.unionAll(sorted_spans(texts, window, bucket))
    spans = stored(spans, "spans")
    return stored(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("_more")), "more")


def with_more(waiting: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``waiting`` with all repeated spans, those known before the sort and those from it."""
    spans = F.concat(F.coalesce("_full", F.array().cast(SPAN_LIST)), F.coalesce("_more", F.array().cast(SPAN_LIST)))
    return waiting.join(more, ["t1", "t2"], "left").withColumn(name, spans)


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    keep: str = "bytes",
    hot: int = HOT,
    bucket: int = BUCKET,
    words: int = 0,
    passages: tuple[int, int, int] | None = None,
) -> DataFrame:
    """For each row of ``docs`` (with doc_id and text): ``row``, all its columns but text, ``spans``,
    ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, as ``keep`` says, the remaining
    bytes ``kept`` or ``text``.

    With ``words`` a run of repeated bytes goes only if it holds that many whole words (parted by
    ASCII white space), and from the first of these to the last; ``window`` then has to be
    shorter than a passage of so many words.

    ``passages`` is a second rule (window, gram, words) beside the first, on the same input:
    ``n_passages``, ``passage_bytes`` and ``passage_text`` tell what it cuts and leaves.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), text_bytes(F.col("text")).alias("data"))
    rows = rows.withColumns({"t1": F.xxhash64("data"), "t2": F.xxhash64(F.lit(7), "data"), "doc_id": F.col("_row.doc_id").cast("long")})
    fine, fine_gram, passage_words = passages or (window, gram, 0)
    if fine > window:
        raise ValueError("the windows of passages must not be longer than those of the first rule")
    row_type = rows.schema["_row"].dataType.simpleString()
    columns = ["_row", "t1", "t2", "_full", "_runs", "_wanted", "_waits", "data"]
    kinds = f"_row {row_type}, t1 long, t2 long, _full {SPAN_LIST}, _runs {SPAN_LIST}, _wanted {WANTED}, _waits boolean, data binary, {RESULT}"

    def step(noted: DataFrame, waits: Column) -> tuple[DataFrame, DataFrame]:
        """One pass over the texts: (rows that are done, rows that wait)."""
        noted = noted.withColumn("_waits", F.coalesce(waits, F.lit(False))).select(columns)
        first = stored(noted.mapInArrow(finisher(keep, True, words, passage_words), kinds), "first")
        return first.where("not _waits").select("_row", *RESULT_TYPES), first.where("_waits").select(columns)

    found = rows.where(F.octet_length("data") >= fine).select("t1", "t2", "doc_id", "data")
    noted = with_notes(rows, repeat_notes(found, fine, fine_gram, hot)).withColumn("_runs", F.lit(None).cast(SPAN_LIST))
    asked = F.size("_wanted") > 0
    if not passages:
        done, waiting = step(noted, asked)
    else:
        # texts without a repeat are done; of the others only the runs are searched for longer ones
        done, held = step(noted, F.col("_full").isNotNull())
        more = compared(held.where(asked), fine, fine_gram, hot, bucket)
        known = with_more(held, more, "_runs").select("_row", "t1", "t2", F.col("_row.doc_id").cast("long").alias("doc_id"), "data", "_runs")
        noted = with_notes(known, repeat_notes(known.select("t1", "t2", "doc_id", "data", "_runs"), window, gram, hot))
        second, waiting = step(noted, asked)
        done = done.unionAll(second)

    late = with_more(waiting, compared(waiting, window, gram, hot, bucket), "_full").select("_row", "data", "_full", "_runs")
    done = done.unionAll(late.mapInArrow(finisher(keep, False, words, passage_words), f"_row {row_type}, {RESULT}"))
    if keep == "text":
        done = done.withColumn("_passage_text", F.coalesce("_passage_text", "_text"))
    shown = [c for c in RESULT_TYPES if passages or c not in OF_PASSAGES]
    return done.select(F.col("_row").alias("row"), *[F.col(c).alias(c[1:]) for c in shown])


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, keep="text", passages=(PASSAGE_WINDOW, PASSAGE_GRAM, PASSAGE_WORDS))
    contract = ("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
    return found.select(*contract, "n_passages", "passage_bytes", "passage_text")
