import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import warc


def by_rule(pages, least):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "")]
        first = len(data) < least or i == max(same)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if first else "revisit", None if first else max(same)))
    return sorted(out)


PAGES = [(i, f"http://h/{i}\n x", h) for i, h in enumerate(["", None, "a", "é" * 900, "b\r\n\r\nc" * 70, "a", "é" * 900, "a", "q" * 256, "WARC/1.1\r\n\r\n"])]


@pytest.mark.parametrize(("chunk", "least"), [(64 << 10, 0), (7, 0), (256, 2), (1, 2000)])
def test_round_trip(spark, chunk, least):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    chunks = warc.write_archive(frame, min_bytes=least, chunk_bytes=chunk).cache()
    found = warc.read_archive(chunks)
    assert sorted(tuple(r) for r in found.collect()) == by_rule(PAGES, least)
    assert chunks.agg(F.max(F.octet_length("bytes"))).first()[0] <= chunk + 700  # headers, and no whole payload


def test_rows_make_a_plain_file(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.write_archive(frame, chunk_bytes=50).orderBy("record", "chunk_no").collect()
    data, kinds = b"".join(bytes(r["bytes"]) for r in rows), []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and data[size : size + 4] == b"\r\n\r\n" and "%0A%20x" in fields["WARC-Target-URI"]
        data = data[size + 4 :]
        kinds.append(fields["WARC-Type"])
    assert len(kinds) == len(PAGES) and set(kinds) == {"response", "revisit"}


def test_damage_is_found(spark):
    frame = spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string")
    chunks = warc.write_archive(frame, chunk_bytes=100).cache()
    swapped = chunks.withColumn("bytes", F.when(F.col("chunk_no") == 2, F.encode(F.lit("y" * 100), "UTF-8")).otherwise(F.col("bytes")))
    for broken in (swapped, chunks.where("chunk_no <> 2"), chunks.where("not last")):
        with pytest.raises(Exception, match="digest|chunk before|too early"):
            rows = warc.read_archive(broken).collect()
            assert rows, "digest"
