"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text is cut before each run of word-start signs into units that no piece can span.  The
distinct units of a batch are grouped by length, and all units of one length advance together,
one character at a time: for each piece length the hash of the substring that ends there is
probed in the sorted keys of the pieces, and the best way in is kept with a back pointer.

For a unigram model the best way is the one with the greatest sum of scores; among equals the
longest last piece, as the library takes it.  For a byte-pair model the sum of scores would not
be the library's answer, so the maximum runs over allowed ways only: a piece may follow another
if merging the two, by themselves, in the model's order would give back just these two.  A
sequence whose neighbours all allow each other is the merge result, and every prefix has exactly
one, so the same lattice with the same back pointers gives the library's ids.  Whether two
pieces allow each other is found by undoing, merge by merge, what lies next to their border, for
all distinct pairs of a batch at once.

Units of more than 256 characters (text without spaces) would advance alone, so for a byte-pair
model they are cut into overlapping windows, which advance together and are joined where both
have the same piece; see ``encode_long``.  Long units of a unigram model advance alone.  The keys
of pieces are 64-bit hashes and are not compared with the text again.

Characters without a piece become byte pieces if the model has them, else the unknown id (a run
of them is one unknown).  Decoding gathers the pieces' bytes by index, turns signs into spaces
and takes away the sign that encoding put in front.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows get
equal ids; a unit may have any length, and its cost is linear in that; an empty table gives no
rows.  A model that changes texts before it cuts them (a normalizer other than the identity) is
an error, as its texts could not be given back.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import batches_by_bytes, query, table

SIGN = "▁"
UNIT = re.compile(f"{SIGN}+[^{SIGN}]*|[^{SIGN}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_UNITS = 600_000
CELLS = 1 << 19
WINDOW = 256
SHIFTS = 4
NO_CHARACTER = 0x110000  # stands behind the end of a unit; no piece has it
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # fixed values: kinds of pieces in a model file
UNIGRAM, BPE = 1, 2  # fixed values: kinds of models
PENALTY = np.float32(10)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """The pieces of a model file, their sorted keys, and the merge order of a byte-pair model."""

    def __init__(self, model: bytes):
        self.kind, self.prefix, self.texts, scores, kinds = UNIGRAM, True, [], [], []
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.texts.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                told = dict(fields(value))
                self.prefix = bool(told.get(3, 1))
                if told.get(2) or told.get(4, 1):
                    raise ValueError("this model changes texts before it cuts them")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models")
        self.size, self.scores, kind = len(self.texts), np.array(scores, np.float32), np.array(kinds)
        self.unknown = int(np.flatnonzero(kind == UNKNOWN)[0])
        normal = np.flatnonzero(kind == NORMAL)
        self.ids = {self.texts[i]: int(i) for i in normal}
        self.longest = max(len(self.texts[i]) for i in normal)
        self.safe = not any(re.search(f"[^{SIGN}]{SIGN}", self.texts[i]) for i in normal)
        self.bytes = {int(self.texts[i][3:5], 16): int(i) for i in np.flatnonzero(kind == BYTE)}
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        self.low = self.scores[normal].min() - PENALTY
        self.outputs = [
            bytes([int(t[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SIGN, " ").encode() if k == NORMAL else b""
            for t, k in zip(self.texts, kinds, strict=True)
        ]
        alive = normal
        if self.kind == BPE:
            self.read_merges(normal)
            alive = normal[[self.texts[i] in self.whole for i in normal]]
        keys = np.array([self.key(self.texts[i]) for i in alive], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], alive[order]

    @staticmethod
    def key(text: str) -> int:
        value = 0
        for c in text:
            value = (value * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def read_merges(self, normal: np.ndarray) -> None:
        """Pairs that merge, and for each piece the last merge of its own making."""
        n = self.size + 1  # the last number stands for a character without a piece
        self.rank = np.full(n, np.inf)
        self.rank[: self.size] = -self.scores
        pairs = {}
        for i in normal:
            text = self.texts[i]
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = int(i)
        self.pairs, self.whole = pairs, set()
        self.left, self.right = np.arange(n), np.arange(n)
        for i in normal:
            text = self.texts[i]
            if len(text) == 1:
                self.whole.add(text)
            elif (parts := self.last_merge(text)) is not None:
                self.whole.add(text)
                self.left[i], self.right[i] = parts
        pair_keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(pair_keys)
        self.pair_keys, self.pair_ids = pair_keys[order], np.array(list(pairs.values()), np.int64)[order]

    def last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``text``; None if its merges end elsewhere."""
        parts, last = [self.ids.get(c) for c in text], None
        if None in parts:
            return None
        while len(parts) > 1:
            ready = [(-self.scores[self.pairs[p]], k) for k in range(len(parts) - 1) if (p := (parts[k], parts[k + 1])) in self.pairs]
            if not ready:
                return None
            k = heapq.nsmallest(1, ready)[0][1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [self.pairs[last]]
        return last

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], np.inf)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can stay after piece a: no merge over their border ever comes first."""
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        limit, equal_too = np.full(len(a), np.inf), np.zeros(len(a), bool)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            over = self.merged_rank(x, y)
            first = (over < limit[open_]) | (equal_too[open_] & (over == limit[open_]))
            out[open_[first]] = False
            leaf_x, leaf_y = self.left[x] == x, self.left[y] == y
            go = ~first & ~(leaf_x & leaf_y)
            rank_x, rank_y = np.where(leaf_x, -np.inf, self.rank[x]), np.where(leaf_y, -np.inf, self.rank[y])
            undo_x = go & (rank_x > rank_y)
            undo_y = go & ~undo_x
            i, j = open_[undo_x], open_[undo_y]
            limit[i], equal_too[i], a[i] = rank_x[undo_x], False, self.right[x[undo_x]]
            limit[j], equal_too[j], b[j] = rank_y[undo_y], True, self.left[y[undo_y]]
            open_ = open_[go]
        return out

    def probe(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ids[at], -1)

    def cut_units(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the piece that ends after each character, on the best way there."""
        n, length = chars.shape
        sums = np.zeros((n, length + 1), np.uint64)
        powers = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        for e in range(length):
            sums[:, e + 1] = sums[:, e] * BASE + chars[:, e] + np.uint64(1)
        piece, back = np.full((n, length + 1), -1, np.int32), np.zeros((n, length + 1), np.int32)
        score = np.zeros((n, length + 1), np.float32)
        everyone = np.arange(n)
        for e in range(1, length + 1):
            best, single = np.full(n, -np.inf, np.float32), None
            for size in range(min(e, self.longest), 0, -1):
                found = self.probe(sums[:, e] - sums[:, e - size] * powers[size])
                if size == 1:
                    single = found < 0
                    found = np.where(single, self.size, found)
                rows = everyone[found >= 0]
                found = found[rows]
                if self.kind == BPE:
                    if e > size:
                        ok = self.allowed_pairs(piece[rows, e - size], found)
                        rows, found = rows[ok], found[ok]
                    value = np.zeros(len(rows), np.float32)
                else:
                    own = np.where(found < self.size, self.scores[np.minimum(found, self.size - 1)], self.low)
                    value = own + score[rows, e - size]
                better = value > best[rows]
                rows, found, value = rows[better], found[better], value[better]
                best[rows], piece[rows, e], back[rows, e] = value, found, size
            score[:, e] = best
        return piece, back

    def allowed_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.empty(0, bool)
        key, where = np.unique(a.astype(np.int64) * (self.size + 1) + b, return_inverse=True)
        return self.allowed(key // (self.size + 1), key % (self.size + 1))[where]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, how many each unit has)."""
        by_length, order, ids, sizes = defaultdict(list), [], [], []
        for i, u in enumerate(units):
            by_length[len(u) if self.kind == UNIGRAM or len(u) <= WINDOW else None].append(i)
        for i, flat, n in self.encode_long(by_length.pop(None, []), units):
            order.append(i)
            ids.append(flat)
            sizes.append(n)
        for length, some in by_length.items():
            step = max(1, CELLS // (length + 1))
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                chars = np.frombuffer("".join(units[i] for i in rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), length)
                found, ends, row = self.follow(*self.cut_units(chars.astype(np.uint64)))
                flat, n = self.spell(found, chars[row, ends - 1], row, len(rows))
                order.extend(rows)
                ids.append(flat)
                sizes.append(n)
        if not units:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        flat, n = np.concatenate(ids), np.concatenate(sizes)
        back = np.argsort(np.array(order))
        begins = (np.cumsum(n) - n)[back]
        return gathered(flat, begins, n[back]), n[back]

    def encode_long(self, which: list[int], units: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, ids, how many) of long units of a byte-pair model.

        Windows of all units advance together.  Two neighbouring windows are joined at a piece that
        both have in the same place: all neighbours in the joined way allow each other, so it is the
        merge result.  Where there is no such piece, as in a run of one sign that the windows cut out
        of step, the later windows are moved to a border of the earlier one, a few times; after that
        the unit is done in windows twice as wide, in the end in one.
        """
        window, tries = WINDOW, 0
        codes = {i: np.frombuffer(units[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in which}
        starts: dict[int, np.ndarray] = {}
        while codes:
            shared, step = window // 4, max(1, CELLS // (window + 1))
            if not tries:
                starts = {i: np.arange(0, max(1, len(c) - shared), window - shared) for i, c in codes.items()}
            slots = [(i, at) for i in codes for at in starts[i].tolist()]
            ways = defaultdict(list)
            for lo in range(0, len(slots), step):
                some = slots[lo : lo + step]
                chars = np.full((len(some), window), NO_CHARACTER, np.uint64)
                for row, (i, at) in enumerate(some):
                    part = codes[i][at : at + window]
                    chars[row, : len(part)] = part
                found, ends, row = self.follow(*self.cut_units(chars))
                edges = np.searchsorted(row, np.arange(len(some) + 1))
                for k, (i, at) in enumerate(some):
                    mine = slice(edges[k], edges[k + 1])
                    ways[i].append((found[mine], ends[mine] + at))
            for i, way in ways.items():
                found, ends, apart = joined(way, starts[i], len(codes[i]))
                if not apart:
                    yield i, *self.spell(found, codes.pop(i)[ends - 1], np.zeros(len(found), np.int64), 1)
                else:
                    begins = starts[i].copy()
                    for k, end in zip(apart, apart[1:] + [len(begins)], strict=True):
                        borders, begin = way[k][1], begins[k + 1]
                        starts[i][k + 1 : end + 1] += borders[min(np.searchsorted(borders, begin), len(borders) - 1)] - begin
            tries = (tries + 1) % SHIFTS
            if not tries:
                window *= 2

    def follow(self, piece: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, where they end, their rows) on the best ways, found by the back pointers of all rows together."""
        n, at = len(piece), np.full(len(piece), piece.shape[1] - 1)
        steps, ends, rows = [], [], np.arange(n)
        on = at > 0
        while on.any():
            steps.append(np.where(on, piece[rows, at], -1).astype(np.int32))
            ends.append(at)
            at = np.where(on, at - back[rows, at], 0)
            on = at > 0
        ways = np.array(steps[::-1], np.int32).T
        full = ways >= 0
        return ways[full], np.array(ends[::-1]).T[full], np.nonzero(full)[0]

    def spell(self, ids: np.ndarray, code: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each of n rows has), with what has no piece spelt out; ``code`` is each piece's last character."""
        bare = ids == self.size
        if not bare.any():
            return ids, np.bincount(row, minlength=n)
        if not self.bytes:
            again = np.append(False, bare[1:] & bare[:-1] & (row[1:] == row[:-1]))
            ids = np.where(bare, self.unknown, ids)[~again].astype(np.int32)
            return ids, np.bincount(row[~again], minlength=n)
        code = code.astype(np.int64)
        size = np.where(bare, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids, bare, code, total = (np.repeat(x, size) for x in (ids, bare, code, size))
        bits = code >> (6 * (total - 1 - place))
        lead = np.where(total == 1, 0, (0xF00 >> total) & 0xFF)
        byte = np.where(place == 0, lead | bits, 0x80 | (bits & 0x3F))
        return np.where(bare, self.byte_ids[byte & 0xFF], ids).astype(np.int32), np.bincount(np.repeat(row, size), minlength=n)


def joined(ways: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(pieces, ends, windows that share no piece with the next) of a unit from those of its windows; right if there are none."""
    begins = [np.append(at, ends[:-1]) for at, (_, ends) in zip(starts, ways, strict=True)]
    pieces, places, apart, done = [], [], [], 0
    for k, (found, ends) in enumerate(ways):
        until = length
        if k + 1 < len(ways):
            both = np.intersect1d(begins[k][begins[k] >= max(done, starts[k + 1])], begins[k + 1])
            after = ends[np.searchsorted(begins[k], both)]
            same = (after == ways[k + 1][1][np.searchsorted(begins[k + 1], both)]) & (after <= length)
            if not same.any():
                apart.append(k)
                done = starts[k + 1]
                continue
            until = after[same][0]
        keep = (begins[k] >= done) & (ends <= until)
        pieces.append(found[keep])
        places.append(ends[keep])
        done = until
    return np.concatenate(pieces), np.concatenate(places), apart


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin there, one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(begins - before, sizes) + np.arange(sizes.sum())]


class Coder:
    """Encodes and decodes batches of texts; remembers the units that it has cut."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.forget()
        lengths = np.array([len(o) for o in self.vocabulary.outputs], np.int64)
        self.sizes, self.begins = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.vocabulary.outputs), np.uint8)

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, where each text's ids begin, and the end)."""
        if len(self.places) > CACHE_UNITS:
            self.forget()
        cut = [self.units(t) for t in texts]
        new = [u for u in set().union(*cut) if u not in self.places]
        if new:
            ids, sizes = self.vocabulary.encode_units(new)
            first = len(self.places)
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        places = np.fromiter((self.places[u] for units in cut for u in units), np.int64, count.sum())
        sizes = self.ends[places + 1] - self.ends[places]
        ids = gathered(self.ids, self.ends[places], sizes)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(count))]
        if self.vocabulary.bytes or not len(ids):
            return ids, ends
        # a run of unknowns may pass from unit to unit
        again = np.append(False, (ids[1:] == self.vocabulary.unknown) & (ids[:-1] == self.vocabulary.unknown))
        again[ends[:-1][ends[:-1] < len(ids)]] = False
        return ids[~again], np.append(0, np.cumsum(~again))[ends]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SIGN if self.vocabulary.prefix else "") + text.replace(" ", SIGN)
        return UNIT.findall(text) if self.vocabulary.safe else [text]

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        text = self.flat[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    with open(path, "rb") as f:
        return Coder(f.read())


def encoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for lo, hi in batches_by_bytes(texts):
                ids, ends = coder(path).encode(texts.slice(lo, hi - lo).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return run


def decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            texts = [coder(path).decode(lists[i].values.to_numpy()) for i in range(len(lists))]
            yield pa.record_batch([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        encoder(path), "doc_id long, ids array<int>"
    )


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of ids as ``encode`` gives them."""
    return coded.select("doc_id", "ids").mapInArrow(decoder(path), "doc_id long, ids array<int>, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, a digest of them, and the text that they decode to, as a digest."""
    docs = table(spark, sf_dir, "documents")
    coded = decode(encode(docs, model_path()), model_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )
