"""Packing token sequences: first-fit decreasing with a tournament tree, in random groups.

Every document becomes its token ids and an end id, cut into pieces of at most ``length`` ids.
The pieces are dealt at random into groups of about ``group_size``; each group is packed by
itself, so no task ever sees more than one group, whatever the size of the corpus, and the
padding lost is at most about one sequence in a group.  In a group the pieces come in
decreasing length and each goes to the first sequence that still has room.  A tournament tree
over the sequences' free room finds that sequence in log n steps: an inner node holds the
larger room of its two children, and the search goes left whenever the left child has enough.

Tokens: the text between spaces and line feeds is tokenised by itself, which is exact for a
tokenizer whose pre-tokenizer never lets a token span white space (``white_space_safe`` checks
that; other tokenizers get whole texts).  Such a tokenizer lower-cases, and parts a letter from
a full stop or comma, so both can be done before.  A worker tokenises each distinct word once
and gathers the documents' ids by array indexing; it forgets its words when they pass
``CACHE_WORDS``.  Batches are cut by bytes, and a longer text is a batch of its own.

Defined cases: a null text counts as empty and yields the end id alone; a null document id
stays null; repeated rows are packed as separate documents; an empty table yields no piece.
Pieces of equal length are taken in the order of a random draw that is fixed in a written
table, so a recomputed task packs alike.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import batches_by_bytes, query, stored, table

LENGTH = 4096
GROUP_SIZE = 1024
SEED = 7
END_ID = 2
CACHE_WORDS = 1_500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACES = "piece long, sequence_id long, offset long"


class ChunkTokenizer:
    """Token ids of many texts; remembers the ids of words that it has seen."""

    #: stands between words that are tokenised in one go; a word that holds it goes alone
    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = white_space_safe(path)
        self.mark = self.ids([self.MARK])[0]
        self.forget()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.begins = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def learn(self, words: list[str]) -> np.ndarray:
        """The place of each word: its ids are ``flat[begins[place] : begins[place + 1]]``."""
        new = [w for w in words if w not in self.places]
        plain = [w for w in new if self.MARK not in w]
        found, sizes = [], []
        for at in range(0, len(plain), 1000):
            ids = self.ids([f" {self.MARK} ".join(plain[at : at + 1000] + [""])])[0]
            ends = np.flatnonzero(np.isin(ids, self.mark))
            found.append(np.delete(ids, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        odd = [w for w in new if self.MARK in w]
        for ids in self.ids(odd):
            found.append(ids)
            sizes.append(np.array([len(ids)]))
        if new:
            first = len(self.places)
            self.places.update(zip(plain + odd, range(first, first + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *found])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.concatenate(sizes))])
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, where each text's ids begin, and the end)."""
        if not self.by_word:
            found = self.ids(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
            return (np.concatenate(found) if found else np.empty(0, np.uint32)), ends
        if len(self.places) > CACHE_WORDS:
            self.forget()
        texts = pc.replace_substring(texts, "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # a capital letter could else turn a written-out special token into one
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])", r"\1 \2")
        pieces = pc.split_pattern(texts, " ")
        coded = pieces.values.dictionary_encode()
        places = self.learn(coded.dictionary.to_pylist())
        begins, sizes = self.begins[places], (self.begins[1:] - self.begins[:-1])[places]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        took = sizes[codes]
        before = np.concatenate([[0], np.cumsum(took)])
        ids = self.flat[np.repeat(begins[codes] - before[:-1], took) + np.arange(before[-1])]
        offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        return ids, before[offsets]


def white_space_safe(path: str) -> bool:
    """Whether words can be tokenised one by one, by the tokenizer's own description.

    True for the form that replaces runs of white space by a space, lower-cases, and removes
    all that its splitting pattern does not match, where the pattern takes no space and parts
    letters from full stops and commas.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
    norms = (said.get("normalizer") or {}).get("normalizers") or []
    spaces = any(n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
    for p in before:
        if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]:
            import regex

            pattern = regex.compile(p["pattern"]["Regex"])
            lower = any(n["type"] == "Lowercase" for n in norms)
            whole = not any(" " in m for m in pattern.findall(" a b'  1 . ' 's 2 , "))
            return spaces and lower and whole and pattern.findall("ab.cd,e") == ["ab", ".", "cd", ",", "e"]
    return False


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def piece_writer(path: str, end_id: int, length: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            for lo, hi in batches_by_bytes(texts):
                yield cut(batch.column("doc_id").slice(lo, hi - lo), *tokenizer.encode(texts.slice(lo, hi - lo)))

    def cut(docs: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(ends)
        own = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
        sizes = sizes + 1
        starts = np.cumsum(sizes) - sizes
        count = -(-sizes // length)
        doc = np.repeat(np.arange(len(sizes)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
        size = np.minimum(length, sizes[doc] - start)
        data = memoryview(own.tobytes())
        spans = [(4 * a, 4 * b) for a, b in zip((starts[doc] + start).tolist(), (starts[doc] + start + size).tolist(), strict=True)]
        columns = {
            "doc_id": docs.take(pa.array(doc)),
            "start": pa.array(start),
            "length": pa.array(size),
            "ids_crc32": pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()),
            "doc_tokens": pa.array(sizes[doc]),
        }
        if with_ids:
            columns["ids"] = pa.array([bytes(data[a:b]) for a, b in spans], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    return run


def pieces_of(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` are its token ids as little-endian unsigned 32-bit numbers."""
    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        piece_writer(path, end_id, length, with_ids), schema
    )


class Rooms:
    """Tournament tree over the free room of sequences 0, 1, 2, ..."""

    def __init__(self, sequences: int, room: int):
        self.leaves = 1 << max(0, (sequences - 1)).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def first_with(self, size: int) -> int:
        node, tree = 1, self.tree
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        return node - self.leaves

    def take(self, sequence: int, size: int) -> int:
        """The room that was free before."""
        node, tree = sequence + self.leaves, self.tree
        free = tree[node]
        tree[node] = free - size
        while node > 1:
            node //= 2
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
        return free


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """For sizes in decreasing order: the sequence of each, and its offset there."""
    rooms, sequences, offsets = Rooms(len(sizes), room), [], []
    for size in sizes:
        s = rooms.first_with(size)
        sequences.append(s)
        offsets.append(room - rooms.take(s, size))
    return sequences, offsets


def packer(length: int) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "draw", "piece"], ascending=[False, True, True])
        sequences, offsets = first_fit_decreasing(group["length"].tolist(), length)
        first = int(group["pack_group"].iloc[0]) << 32
        return pd.DataFrame({"piece": group["piece"], "sequence_id": np.array(sequences, np.int64) + first, "offset": offsets})

    return run


def pack(
    pieces: DataFrame, length: int = LENGTH, group_size: int = GROUP_SIZE, seed: int = SEED
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``length``.

    Only the lengths go through the groups; other columns meet the answer by piece number.
    """
    rows = stored(pieces.withColumns({"_piece": F.monotonically_increasing_id(), "_draw": F.rand(seed)}), "pieces")
    groups = max(1, round(rows.count() / group_size))
    narrow = rows.select(
        F.col("_piece").alias("piece"),
        F.col("length").cast("long").alias("length"),
        F.col("_draw").alias("draw"),
        F.floor(F.col("_draw") * groups).cast("long").alias("pack_group"),
    )
    places = narrow.groupBy("pack_group").applyInPandas(packer(length), PLACES)
    return rows.join(places, rows["_piece"] == places["piece"]).drop("_piece", "_draw", "piece")


def sequences_of(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``ids`` (little-endian) in order of offset, and their length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces_of(docs, tokenizer_path(), with_ids=False))
