"""Payloads kept as PNG images in a binary column, and hashes of what the images look like.

A payload is padded with bytes 255 to a positive multiple of ``ROW * ROW``, laid out as an
8-bit grey image ``ROW`` pixels wide, filtered row by row with the filter that leaves the least
sum of differences, compressed with zlib and cut into chunks, each with its CRC-32.  The reader
tests the signature, every checksum and every length, inflates the data chunk by chunk and
undoes the filters with numpy: rows without a filter, or with the left or upper one, by running
sums over the whole image at once; an image that holds averaging or Paeth rows along its
diagonals, on which no pixel depends on another.  It reads any 8-bit grey, grey-alpha, RGB or
RGBA image that is not interlaced.

The feature is a 64-bit hash: the image's mean over a grid of bands and columns, its discrete
cosine transform, and for each of the 8 x 8 lowest frequencies whether it is above their median.
All of it is integer arithmetic, so equal payloads have equal hashes on any machine.

Defined cases: a null text counts as empty and gives one padded block; repeated rows get equal
media; an empty table gives no rows; a row is as large as its payload, whatever that is, and
rows are worked on one at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table, text_bytes

ROW = 24
BLOCK = ROW * ROW
IDAT_BYTES = 32 << 10
LEVEL = 6
BANDS = 32
LOW = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: colour type to samples per pixel

STORED = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, feature_hash binary"
)


def chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(data, zlib.crc32(kind)).to_bytes(4, "big")


def filtered(pixels: np.ndarray) -> np.ndarray:
    """(height, 1 + width): each row under the best of no, left and upper filter."""
    h, w = pixels.shape
    ways = np.empty((3, h, w), np.uint8)
    ways[0] = pixels
    ways[1] = pixels
    ways[1, :, 1:] -= pixels[:, :-1]
    ways[2] = pixels
    ways[2, 1:] -= pixels[:-1]
    cost = np.minimum(ways, 0 - ways).sum(axis=2, dtype=np.int64)  # as signed differences
    kind = cost.argmin(axis=0)
    out = np.empty((h, w + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = ways[kind, np.arange(h)]
    return out


def encode_png(payload: bytes, width: int = ROW, level: int = LEVEL, idat_bytes: int = IDAT_BYTES) -> bytes:
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    data = zlib.compress(filtered(pixels).tobytes(), level)
    head = width.to_bytes(4, "big") + len(pixels).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    body = [chunk(b"IDAT", data[i : i + idat_bytes]) for i in range(0, len(data), idat_bytes)]
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *body, chunk(b"IEND", b"")])


def read_chunks(png: bytes) -> Iterator[tuple[bytes, memoryview]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    view, at = memoryview(png), 8
    while at < len(png):
        n, kind = int.from_bytes(view[at : at + 4], "big"), bytes(view[at + 4 : at + 8])
        data, end = view[at + 8 : at + 8 + n], at + 12 + n
        if end > len(png) or zlib.crc32(view[at + 4 : at + 8 + n]) != int.from_bytes(view[end - 4 : end], "big"):
            raise ValueError(f"chunk {kind!r} at {at} is damaged")
        yield kind, data
        at = end


def running_sums(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undo no, left and upper filters, all rows at once (sums wrap at 256)."""
    out = raw.copy()
    left = kinds == 1
    if left.any():
        out[left] = np.cumsum(raw[left], axis=1, dtype=np.uint8)
    upper = kinds == 2
    if upper.any():
        # in a run of upper-filtered rows, a pixel is the sum from the last other row down
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        base = np.maximum.accumulate(np.where(upper, -1, np.arange(len(kinds))))
        above = np.where((base > 0)[:, None, None], total[base - 1], 0).astype(np.uint8)
        out[upper] = (total - above)[upper]
    return out


def along_diagonals(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undo any filters: the pixels with equal row + column are independent of each other."""
    h, w, c = raw.shape
    out = np.zeros((h + 1, w + 1, c), np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, ab = out[y + 1, x], out[y, x + 1], out[y, x]
        pa_, pb, pc = np.abs(b - ab), np.abs(a - ab), np.abs(a + b - 2 * ab)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, ab))
        guess = np.select([(kinds[y] == k)[:, None] for k in (1, 2, 3, 4)], [a, b, (a + b) >> 1, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(png: bytes) -> np.ndarray:
    """Pixels as (height, width, samples)."""
    inflate, parts, shape, ended = zlib.decompressobj(), [], None, False
    for kind, data in read_chunks(png):
        if kind == b"IHDR":
            w, h = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
            if data[8] != 8 or data[9] not in CHANNELS or any(data[10:13]):
                raise ValueError("only 8-bit images without palette or interlace")
            shape = (h, w, CHANNELS[data[9]])
        elif kind == b"IDAT":
            parts.append(inflate.decompress(data))
        elif kind == b"IEND":
            ended = True
    parts.append(inflate.flush())
    if shape is None or not ended or not inflate.eof:
        raise ValueError("the image is not complete")
    h, w, c = shape
    rows = np.frombuffer(b"".join(parts), np.uint8).reshape(h, 1 + w * c)
    kinds, raw = rows[:, 0], rows[:, 1:].reshape(h, w, c)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    return along_diagonals(raw, kinds) if kinds.max(initial=0) > 2 else running_sums(raw, kinds)


@lru_cache(maxsize=8)
def cosines(n: int) -> np.ndarray:
    """The lowest frequencies over n samples, in 1/4096."""
    k, i = np.arange(LOW)[:, None], np.arange(n)[None, :]
    return np.round(4096 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))).astype(np.int64)


def look(grey: np.ndarray) -> bytes:
    """The 64-bit hash of a (height, width) image."""
    h, w = grey.shape
    bands, columns = min(h, BANDS), min(w, BANDS)
    y, x = np.arange(bands) * h // bands, np.arange(columns) * w // columns
    sums = np.add.reduceat(np.add.reduceat(grey, y, axis=0, dtype=np.int64), x, axis=1)
    size = np.diff(y, append=h)[:, None] * np.diff(x, append=w)[None, :]
    low = cosines(bands) @ (sums * 256 // size) @ cosines(columns).T
    flat = low.ravel()
    return np.packbits(flat > np.sort(flat)[len(flat) // 2]).tobytes()


def pad(payload: bytes) -> bytes:
    return payload + b"\xff" * (max(1, -(-len(payload) // BLOCK)) * BLOCK - len(payload))


def to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for value in batch.column("payload"):
            payload = value.as_py()
            sizes.append(len(payload))
            media.append(encode_png(pad(payload)))
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
        )


def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in FEATURES.split(", ")]
    for batch in batches:
        out = []
        for doc, n, media in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True):
            png = media.as_py()
            pixels = decode_png(png)
            payload = pixels.tobytes()
            seen = look(pixels[:, :, 0])
            tail = zlib.crc32(payload[-32:])
            sha, own = hashlib.sha256(payload).hexdigest(), hashlib.sha256(png).hexdigest()
            out.append((doc.as_py(), n.as_py(), len(payload), sha, tail, len(png), own, seen.hex(), seen))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG of each text's UTF-8 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("payload")).mapInArrow(
        to_media, STORED
    )


def media_features(media: DataFrame) -> DataFrame:
    """Decode the images of ``store_media`` and describe payload, medium and look."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(to_features, FEATURES)


@query("op2_media")
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media_features(stored(store_media(docs), "media")).drop("feature_hash")
