import hashlib
import struct
import zlib

import numpy as np
import pytest

from colloquy.llm import media
from colloquy.llm.everything import REGISTRY


def filtered_by_rule(pixels, kinds):
    """The five filters, pixel by pixel."""
    h, w, c = pixels.shape
    out = np.zeros((h, 1 + w * c), np.uint8)
    for y in range(h):
        out[y, 0] = kinds[y]
        for x in range(w):
            for k in range(c):
                a = int(pixels[y, x - 1, k]) if x else 0
                b = int(pixels[y - 1, x, k]) if y else 0
                d = int(pixels[y - 1, x - 1, k]) if x and y else 0
                p = a + b - d
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out[y, 1 + x * c + k] = (int(pixels[y, x, k]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    return out


def png(pixels, kinds, color):
    h, w, _ = pixels.shape
    head = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    data = zlib.compress(filtered_by_rule(pixels, kinds).tobytes())
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"tEXt", b"x") + media.chunk(b"IDAT", data[:7]) + media.chunk(b"IDAT", data[7:]) + media.chunk(b"IEND", b"")


@pytest.mark.parametrize("color", sorted(media.CHANNELS))
@pytest.mark.parametrize("top", [3, 5])
def test_reads_every_filter(color, top):
    draw = np.random.default_rng(color * 10 + top)
    pixels = draw.integers(0, 256, (13, 7, media.CHANNELS[color]), dtype=np.uint8)
    assert (media.decode_png(png(pixels, draw.integers(0, top, 13), color)) == pixels).all()


def test_damage_is_found():
    good = media.encode_png(media.pad(b"some words " * 200))
    for at in (3, 20, len(good) // 2, len(good) - 5):
        with pytest.raises(ValueError):
            media.decode_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(good[:-12])


def test_query_round_trip(spark, folder):
    texts = ["", None, "a" * 575, "a" * 576, "a" * 577, "Ünïcode " * 999, "a" * 577]
    found = REGISTRY["op2_media"].run(spark, folder(documents=[(i, t, None, None, 0) for i, t in enumerate(texts)]))
    by_id = {r["doc_id"]: r for r in found.collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        row = by_id[i]
        assert (row["n_bytes"], row["payload_bytes"]) == (len(data), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-32:])
    assert by_id[4][5:] == by_id[6][5:] and len(by_id[0]["feature"]) == 16


def test_hash_follows_the_look():
    draw = np.random.default_rng(1)
    waves = [np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n)) for n in (96, 24) for k in range(8)]
    rich = sum(draw.normal() * np.outer(waves[i], waves[8 + j]) for i in range(8) for j in range(8))
    smooth = np.clip(128 + 12 * rich, 0, 255).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + draw.integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    other = draw.integers(0, 256, smooth.shape, dtype=np.uint8)

    def differ(a, b):
        return sum((x ^ y).bit_count() for x, y in zip(media.look(a), media.look(b), strict=True))

    assert differ(smooth, noisy) < 12 < differ(smooth, other)
