import base64
import random
import time

import pytest
import sentencepiece

from colloquy.llm import pieces

TEXTS = [
    "", " ", "  a  b ", "aaaa aaa aaaaaaa", "日本語テキスト 😀👍🏽x", "<s> </s> <0x0A>\n\n\tx", "hello world's The quick-brown FOX 123456 á",
    "x" * 300, "...!!!!---", "\u0000\u0001 Über größe", "a\u00a0b\u2003c",
]


def as_unigram(model, drop_bytes):
    """The same pieces and scores, read as a unigram model; byte pieces become unused ones."""
    out = b""

    def wrap(number, body):
        size, more = len(body), b""
        while size > 127:
            more += bytes([size & 127 | 128])
            size >>= 7
        return bytes([number << 3 | 2]) + more + bytes([size]) + body

    for number, value in pieces.fields(model):
        if number == 1 and drop_bytes and dict(pieces.fields(value)).get(3) == pieces.BYTE:
            value = value.replace(b"\x18\x06", b"\x18\x05")
        if number == 2:
            value = b"\x18\x01" + (b"\x98\x02\x00" if drop_bytes else b"\x98\x02\x01")
        out += wrap(number, value)
    return out


@pytest.fixture(scope="module")
def model():
    with open(pieces.model_path(), "rb") as f:
        return f.read()


def test_merge_model_equals_the_library(model, spark, sf_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Coder(model)
    for _ in range(2):  # the second time from memory
        ids, ends = coder.encode(texts)
        own = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        assert [x.tolist() for x in own] == library.encode(texts, num_threads=1)
    assert [coder.decode(x) for x in own] == texts


@pytest.mark.parametrize("drop_bytes", [False, True])
def test_unigram_model_equals_the_library(model, drop_bytes):
    changed = as_unigram(model, drop_bytes)
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=changed), pieces.Coder(changed)
    assert coder.vocabulary.kind == pieces.UNIGRAM
    ids, ends = coder.encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == library.encode(TEXTS, num_threads=1)


def test_a_model_that_changes_texts_is_refused(model):
    changed = model.replace(b"\x1a\x0e\x0a\x08identity", b"\x1a\x0e\x0a\x08identity")
    with pytest.raises(ValueError):
        pieces.Vocabulary(changed + b"\x1a\x02\x20\x01")


def long_units():
    rng = random.Random(7)
    common = "的一是不了人我在有他这中大来上国日本語テキスト"
    yield "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(16_000))
    yield "".join(rng.choice(common) for _ in range(4_000))
    yield base64.b64encode(rng.randbytes(6_000)).decode()
    yield "".join(rng.choice("etaoinshrdlu") for _ in range(5_000))
    yield "".join(rng.choice(["the", "and", "ing", "😀", "ß", "1234", "x" * 40, "."]) for _ in range(2_000))
    for unit, n in (("a", 5_000), ("ab", 3_001), ("abcde", 1_000), ("=", 4_099), ("the", 999), ("😀", 700), ("lo", 128), ("l", 257)):
        yield unit * n
    yield "w" + "=" * 900 + "q" + "-" * 901 + "zyx" * 100 + "_" * 902 + "a" * 903 + "0" * 904 + "." * 905
    for n in (255, 256, 257, 320, 321, 448, 449, 512):
        yield "".join(rng.choice("etaoinshrdlu") for _ in range(n))


def test_text_without_spaces_equals_the_library(model):
    texts = list(long_units()) + ["short words", "one " + "zyx" * 300 + " two"]
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Coder(model)
    ids, ends = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == library.encode(texts, num_threads=1)


def test_text_without_spaces_is_not_walked_alone(model):
    coder, text = pieces.Coder(model), next(long_units())
    began = time.perf_counter()
    ids, _ = coder.encode([text])
    assert time.perf_counter() - began < 4
    assert coder.decode(ids) == text
