import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from colloquy.llm import packing
from colloquy.llm.everything import REGISTRY

TEXTS = ["", None, "It's a <|endoftext|>test.\n\nA.B,c  d", "日本 語 😀 İx Σας", "word " * 9000, "x" * 7000, "\u0001 \u0001a", "e\u0301 A\u0301.b"]


def test_words_tokenise_as_whole_texts():
    whole = Tokenizer.from_file(packing.tokenizer_path())
    coder = packing.chunk_tokenizer(packing.tokenizer_path())
    assert coder.by_word
    for texts in (TEXTS, TEXTS[:2], [t for t in TEXTS if t and "<|" not in t]):
        ids, ends = coder.encode(pa.array([t or "" for t in texts]))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want


def test_first_fit_decreasing_equals_its_definition():
    draw = np.random.default_rng(2)
    sizes = sorted(draw.integers(1, 101, 400).tolist(), reverse=True)
    free, want = [], []
    for size in sizes:
        k = next((i for i, f in enumerate(free) if f >= size), len(free))
        if k == len(free):
            free.append(100)
        want.append((k, 100 - free[k]))
        free[k] -= size
    assert list(zip(*packing.first_fit_decreasing(sizes, 100), strict=True)) == want


def test_query_places_every_id_once(spark, folder):
    texts = TEXTS + ["some words " * (i * 37 % 500) for i in range(300)]
    path = folder(documents=[(i, t, None, None, 0) for i, t in enumerate(texts)])
    rows = REGISTRY["op4_packing"].run(spark, path).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part.tobytes()), len(ids))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-tokens // packing.LENGTH) + 1


def test_groups_and_sequences(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 90)) for i in range(200)], "doc_id long, text string").repartition(3)
    packed = packing.pack(packing.pieces_of(docs, packing.tokenizer_path(), length=128), length=128, group_size=20)
    groups = {r["sequence_id"] >> 32 for r in packed.collect()}
    assert len(groups) > 5
    for r in packing.sequences_of(packed).collect():
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 128
