"""WARC archives kept as a table of record chunks.

A record is a run of rows (record, chunk_no): chunk 0 begins with the record's headers, the
others go on with the payload, the last ends it.  ``bytes`` put together in the order (record,
chunk_no) are a plain WARC 1.1 file.  A payload is cut on the way in, by ``substring`` over its
row, so neither the writer nor the reader ever holds more of a record than one chunk; both
carry a SHA-1 from chunk to chunk.  Each row stores the digest of the payload so far: the
reader compares it at every chunk, and the last one is the record's payload digest.

Of records with equal payloads of at least ``min_bytes`` the one with the largest id is the
response; the others are revisits, which refer to it and store headers only.  Equality is by
SHA-256 of the payload.  Counts per payload are reduced before the shuffle and the join back is
a plain equi join whose hot partitions adaptive execution splits, so one payload may fill a
third of the table.

Reading: records of one chunk, nearly all, are read where they lie.  Only longer ones are
dealt by record and sorted by chunk, so that a reader sees each as a stream.

Defined cases: a null payload counts as empty; a null url has no target header; a null id is
smaller than any other.  Rows that share both id and payload are all responses if that id is
the largest.  An empty table gives no rows.  Other columns of the input are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, stored, table, text_bytes

CHUNK_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "record long, chunk_no int, last boolean, digest string, bytes binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record_head(row: dict) -> bytes:
    """The WARC headers and the HTTP head of a record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["n"]
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (row["n"] if row["record_type"] == "response" else 0))),
    ]
    if row["url"] is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        fields.insert(2, ("WARC-Target-URI", clean))
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + http


def write_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive record by record, chunk by chunk; the digest goes on over batch borders."""
    sha1 = hashlib.sha1()
    schema = pa.schema([("record", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("digest", pa.string()), ("bytes", pa.binary())])
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if row["chunk_no"] == 0:
                sha1 = hashlib.sha1()
            sha1.update(row["data"])
            if row["last"] and row["record_type"] == "response" and sha1.hexdigest() != row["sha1"]:
                raise ValueError(f"payload of page {row['page_id']} came in pieces that do not make up the whole")
            head = record_head(row) if row["chunk_no"] == 0 else b""
            end = b"\r\n\r\n" if row["last"] else b""
            out.append((row["record"], row["chunk_no"], row["last"], base32(sha1), head + row["data"] + end))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class RecordReader:
    """Takes a record's bytes piece by piece; keeps headers, counts and a digest, no payload."""

    def __init__(self) -> None:
        self.pending, self.warc, self.http = b"", None, None
        self.left, self.n, self.sha1 = 0, 0, hashlib.sha1()

    @staticmethod
    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        return {"": lines[0]} | dict(line.split(": ", 1) for line in lines[1:] if ": " in line)

    def head(self) -> dict[str, str] | None:
        head, found, rest = self.pending.partition(b"\r\n\r\n")
        if not found:
            return None
        self.pending = rest
        return self.fields(head)

    def feed(self, data: bytes) -> None:
        self.pending += data
        if self.warc is None:
            if (warc := self.head()) is None:
                return
            if not warc[""].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.warc, self.left = warc, int(warc["Content-Length"])
        if self.http is None:
            before = len(self.pending)
            if (http := self.head()) is None:
                return
            self.http = http
            self.left -= before - len(self.pending)
        payload = memoryview(self.pending)[: self.left]
        self.sha1.update(payload)
        self.n += len(payload)
        self.left -= len(payload)
        self.pending = self.pending[len(payload) :]

    def done(self) -> tuple:
        if self.warc is None or self.http is None or self.left or self.pending != b"\r\n\r\n":
            raise ValueError("a record ends too early or too late")
        told = self.warc["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = self.warc["WARC-Type"]
        if kind == "response" and told != base32(self.sha1):
            raise ValueError(f"payload digest of {self.warc['WARC-Record-ID']} does not fit its bytes")
        size = self.n if kind == "response" else int(self.http["Content-Length"])
        return (page_of(self.warc["WARC-Record-ID"]), size, told, kind, page_of(self.warc.get("WARC-Refers-To")))


def page_of(urn: str | None) -> int | None:
    name = "" if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name not in ("", "None") else None


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, at = None, None
    for batch in batches:
        out: list[tuple] = []
        numbers, lasts = batch.column("chunk_no").to_pylist(), batch.column("last").to_pylist()
        records, digests, data = batch.column("record").to_pylist(), batch.column("digest").to_pylist(), batch.column("bytes")
        for i, (record, number) in enumerate(zip(records, numbers, strict=True)):
            if number == 0:
                reader = RecordReader()
            elif at != (record, number - 1):
                raise ValueError(f"record {record} lacks the chunk before {number}")
            at = (record, number)
            reader.feed(data[i].as_py())
            if reader.warc["WARC-Type"] == "response" and base32(reader.sha1) != digests[i]:
                raise ValueError(f"record {record} differs from its digest at chunk {number}")
            if lasts[i]:
                out.append(reader.done())
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [c.split()[0] for c in RECORDS.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def write_archive(
    pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = DATE
) -> DataFrame:
    """The chunk table of ``pages`` (page_id, url, html); a later ``stored`` fixes it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes(F.col("html")).alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    largest = stored(rows.groupBy("key").agg(F.max("page_id").alias("largest")), "largest")
    rows = rows.join(largest, "key")
    first = (F.col("n") < min_bytes) | F.col("page_id").eqNullSafe(F.col("largest"))
    rows = rows.withColumns(
        {
            "record": F.monotonically_increasing_id(),
            "record_type": F.when(first, "response").otherwise("revisit"),
            "refers_to": F.when(~first, F.col("largest")),
            "sha1": F.sha1("payload"),
            "date": F.lit(date),
        }
    )
    chunks = F.when(first, F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_bytes))).otherwise(1).cast("int")
    rows = rows.withColumn("chunks", chunks)
    fields = ["record", "page_id", "url", "n", "record_type", "refers_to", "sha1", "date"]
    cut = rows.select(*fields, "chunks", "payload", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    data = F.when(
        F.col("record_type") == "response",
        F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)),
    ).otherwise(F.lit(b""))
    cut = cut.select(*fields, "chunk_no", (F.col("chunk_no") == F.col("chunks") - 1).alias("last"), data.alias("data"))
    return cut.mapInArrow(write_chunks, CHUNKS)


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, with every digest checked on the way."""
    whole = F.col("last") & (F.col("chunk_no") == 0)
    short = chunks.where(whole)
    long = chunks.where(~whole).repartition("record").sortWithinPartitions("record", "chunk_no")
    return short.mapInArrow(read_chunks, RECORDS).unionAll(long.mapInArrow(read_chunks, RECORDS))


SQL = """
WITH digits AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
fives AS (
  SELECT page_id, payload,
    list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::INTEGER) AS parts FROM digits),
told AS (
  SELECT page_id, payload, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')
    AS payload_digest FROM fives)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
FROM told WINDOW same AS (PARTITION BY payload)
"""


@query("op7_warc", SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(stored(write_archive(table(spark, sf_dir, "pages")), "warc"))
