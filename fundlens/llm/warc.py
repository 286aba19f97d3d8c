"""Operator 3, WARC archives: a writer and a salvage reader.

Writing: pages become WARC/1.1 records, one gzip member each, packed into archives of about
``ARCHIVE_BYTES``. Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the
smallest id is the response; the others are revisit records that refer to it and carry only the
HTTP headers. Spark's own text sink writes the files (a row is an archive), so any store that Spark
can write to will do: a small closing record's gzip member ends with a zero byte, which is left to
the sink as its line separator.

Reading: archives are read whole by Spark's binary source and walked record by record. A record
counts once its gzip member inflates with a right checksum (or, uncompressed, its version line and
headers parse), its Content-Length ends at the record's closing line breaks, and its block digest is
right. After a failed check the reader searches for the next place where a valid member or a version
line begins with a whole valid record, goes on there, and logs the bytes between as a quarantined
gap (archive, from, to, reason).

Scale: only the smallest id per repeated payload is gathered (map-side combined), and joined by
broadcast only if counted small. Payloads are not shuffled in that case. A task holds one archive.

Defined cases: a null payload is empty; a null id is written as an empty one and read back as null;
pages that share id and payload with the response are responses too; an empty table writes no
archive and reads back empty; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, write_table
from .common import small_side
from .text import whole

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 100
VERSION = b"WARC/1."
STEP = 1 << 14                    # bytes inflated at once
RECORDS = ("archive string, from long, to long, problem string, page_id string, record_type string, refers_to string, "
           "payload_bytes long, payload_digest string, payload binary")


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """id, url and payload with the payload's digest and, for revisits, the response's id."""
    p = pages.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{payload_col}`")).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    again = (p.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    out = p.join(small_side(write_table(again, "repeated")), "digest", "left")
    return out.withColumn("refers", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).select(
        F.col("id").cast("string").alias("id"), "digest", F.col("refers").cast("string").alias("refers"), F.col("payload").cast("binary").alias("payload"))


def record(kind: str, page: str, block: bytes, headers: dict[str, str]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page}>", **headers,
             "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: str | None, digest: str, refers: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is None:
        return record("response", page or "", http + payload, headers)
    headers |= {"WARC-Refers-To": f"<urn:page:{refers}>",
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", page or "", http, headers)


def closing(members: int) -> bytes:
    """The closing member, without its last byte (a zero, the highest byte of its length)."""
    note = f"records: {members}\r\n".encode()
    member = gzip.compress(record("metadata", "", note, {"Content-Type": "application/warc-fields"}), 1, mtime=0)
    assert member[-1] == 0
    return member[:-1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> archives, one row each."""
    def made():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts) + closing(len(parts))], pa.binary())], ["archive"])

    parts: list[bytes] = []
    size = 0
    for batch in batches:
        for row in range(batch.num_rows):
            member = gzip.compress(page_record(*(c[row].as_py() for c in batch.columns)), 1, mtime=0)
            if parts and size + len(member) > ARCHIVE_BYTES:
                yield made()
                parts, size = [], 0
            parts.append(member)
            size += len(member)
    if parts:
        yield made()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html") -> None:
    rows = with_revisits(pages, id_col, payload_col)
    # the cast keeps the bytes as they are; one row a file, closed by the separator
    (rows.mapInArrow(_pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, block, length) of the record that ``raw`` begins with, or what is wrong with it."""
    if not raw.startswith(VERSION):
        return "no version line"
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return "headers do not end"
    headers = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        return "no content length"
    stop = end + 4 + int(headers["content-length"])
    if raw[stop:stop + 4] != b"\r\n\r\n":
        return "record does not end at its content length"
    block = raw[end + 4:stop]
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm.lower() == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        return "wrong block digest"
    return headers, block, stop + 4


def inflate(raw: bytes, at: int) -> tuple[bytes, int] | str:
    """(content, end) of the gzip member at ``at``, or what is wrong with it."""
    z, out, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(raw):
            step = raw[end:end + STEP]
            out.append(z.decompress(step))
            end += len(step)
    except zlib.error as e:
        return f"gzip: {e}"
    return (b"".join(out), end - len(z.unused_data)) if z.eof else "gzip: member is cut short"


def record_at(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, block, end) of the record at ``at``, compressed or not, or what is wrong."""
    if raw[at:at + 2] == b"\x1f\x8b":
        member = inflate(raw, at)
        if isinstance(member, str):
            return member
        found = parse_record(member[0])
        if isinstance(found, str):
            return found
        return (found[0], found[1], member[1]) if found[2] == len(member[0]) else "bytes after the record in its member"
    if raw[at:at + len(VERSION)] != VERSION:
        return "neither a gzip member nor a version line"
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers do not end"
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n)", raw[at:end + 2])
    found = parse_record(raw[at:end + 8 + int(length[1])] if length else raw[at:end + 4])
    return found if isinstance(found, str) else (found[0], found[1], at + found[2])


STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def salvage(raw: bytes) -> Iterator[tuple]:
    """(from, to, None, headers, block) for records, (from, to, reason, None, None) for gaps."""
    at = 0
    while at < len(raw):
        found = record_at(raw, at)
        if not isinstance(found, str):
            yield at, found[2], None, found[0], found[1]
            at = found[2]
            continue
        reason, begin, at = found, at, len(raw)
        for m in STARTS.finditer(raw, begin + 1):
            if not isinstance(record_at(raw, m.start()), str):
                at = m.start()
                break
        yield begin, at, reason, None, None


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """(bytes, SHA-256, payload) of a response; a revisit's come from its headers, payload null."""
    head, _, body = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        return len(body), hashlib.sha256(body).hexdigest(), body
    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
    return int(length[1]) if length else 0, headers.get("warc-payload-digest", "").rpartition(":")[2], None


def _read(batches: Iterator[pa.RecordBatch], payloads: bool = True) -> Iterator[pa.RecordBatch]:
    page = lambda h, name: re.sub(r"^<urn:page:(.*)>$", r"\1", h.get(name, "")) or None
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for row in range(batch.num_rows):
            archive, raw = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            rows = []
            for a, b, problem, headers, block in salvage(raw):
                if problem is not None:
                    rows.append((archive, a, b, problem, None, None, None, None, None, None))
                elif headers.get("warc-type") in ("response", "revisit"):
                    rows.append((archive, a, b, None, page(headers, "warc-record-id"), headers["warc-type"],
                                 page(headers, "warc-refers-to"), *payload_of(headers, block)[:3 if payloads else 2], *([] if payloads else [None])))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``: ``problem`` is null for records. Without
    ``payloads`` that column is null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _read(batches, payloads), RECORDS)


def gaps(read: DataFrame) -> DataFrame:
    return read.where("problem IS NOT NULL").select("archive", "from", "to", "problem")


def digest(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    read = read_archives(spark, path, payloads=False).where("problem IS NULL")
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
