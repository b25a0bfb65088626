"""WARC archives: deduplicating writer, and a reader that salvages damaged archives.

Records are gzip members of their own, gathered into archives of bounded size. Spark's text writer
puts the bytes into files, so a task that is repeated leaves no half-written archive; the one zero
byte it adds behind an archive is padding. The reader checks every record (the member's checksum,
the record's form, its block and payload digests). After a failed check it searches for the next
valid member or version line, goes on from there, and logs the bytes in between as a quarantined
gap. Plain records between or without gzip members are read as well.

Defined results: a null payload is empty; of equal payloads of at least ``revisit_from`` bytes the
one with the largest ``page_id`` is the response (rows repeating that ``page_id`` too), the others
revisit it; rows with a null ``page_id`` get an empty record id and read back as null; an empty
table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.session import cut_lineage, scratch_path

#: Compressed bytes after which a new archive is begun; a longer record gets one of its own.
ARCHIVE_BYTES = 4 << 20
#: Payload bytes of a writing task, about, so that small inputs make no swarm of tiny archives.
TASK_BYTES = 16 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_FEED = 1 << 14

RECORDS_DDL = (
    "archive string, position long, size long, gap boolean, page_id long, target_uri string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(name: str, value: str) -> bytes:
    """One header line; what could end the line is percent-encoded."""
    return f"{name}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', value)}\r\n".encode()


def record(page_id: int | None, uri: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit of the page ``refers_to``."""
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _header("Content-Length", str(len(payload))) + b"\r\n"
    if refers_to is None:
        kind, more, block = "response", b"", block + payload
    else:
        kind, more = "revisit", _header("WARC-Refers-To", urn(refers_to)) + _header("WARC-Profile", _PROFILE)
    head = b"".join(
        [
            b"WARC/1.1\r\n",
            _header("WARC-Type", kind),
            _header("WARC-Record-ID", urn(page_id)),
            _header("WARC-Target-URI", uri or ""),
            _header("WARC-Date", _DATE),
            more,
            _header("WARC-Payload-Digest", f"sha1:{payload_digest}"),
            _header("WARC-Block-Digest", f"sha1:{digest(block)}"),
            _header("Content-Type", "application/http; msgtype=response"),
            _header("Content-Length", str(len(block))),
        ]
    )
    return head + b"\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


@dataclass
class Record:
    position: int
    size: int
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int


@dataclass
class Gap:
    position: int
    size: int


def _headers(lines: bytes) -> dict[str, str] | None:
    found = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def _plain_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes, int] | None:
    """(end, headers, payload, payload bytes) of a sound record that begins at ``at``, else None."""
    if not data.startswith(_VERSION, at):
        return None
    first, head_end = data.find(b"\r\n", at), data.find(b"\r\n\r\n", at)
    if first < 0 or head_end <= first:
        return None
    headers = _headers(data[first + 2 : head_end])
    if headers is None or not headers.get("content-length", "").isdecimal():
        return None
    begin = head_end + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest(block)}":
        return None
    payload, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        sent = _headers(http.partition(b"\r\n")[2]) or {}
        size = int(sent["content-length"]) if sent.get("content-length", "").isdecimal() else len(payload)
    if headers.get("warc-type") == "response":
        size = len(payload)
        if "warc-payload-digest" in headers and headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
            return None
    return end + 4, headers, payload, size


def _member_at(data: bytes, at: int) -> tuple[int, bytes] | None:
    """(end, content) of a sound gzip member that begins at ``at``, else None."""
    unpacker, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if fed >= len(data):
                return None
            parts.append(unpacker.decompress(data[fed : fed + _FEED]))
            fed = min(len(data), fed + _FEED)
    except zlib.error:
        return None
    return fed - len(unpacker.unused_data), b"".join(parts)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Sound records of an archive in order, and the gaps between them."""
    at, bad = 0, None
    while at < len(data):
        if bad is None and data[at] == 0 and not data[at:].strip(b"\0"):
            return  # padding
        found = None
        if data.startswith(_MEMBER, at):
            unpacked = _member_at(data, at)
            if unpacked:
                inner = _plain_record(unpacked[1], 0)
                if inner and inner[0] == len(unpacked[1]):
                    found = (unpacked[0], *inner[1:])
        else:
            found = _plain_record(data, at)
        if found:
            if bad is not None:
                yield Gap(bad, at - bad)
                bad = None
            yield Record(at, found[0] - at, *found[1:])
            at = found[0]
        else:
            bad = at if bad is None else bad
            later = [p for p in (data.find(_MEMBER, at + 1), data.find(_VERSION, at + 1)) if p >= 0]
            at = min(later, default=len(data))
    if bad is not None:
        yield Gap(bad, len(data) - bad)


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``path``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    # a checkpoint, so that both sides of the join have exchanges of their own and a hot payload can be split
    largest = cut_lineage(rows.filter(F.octet_length("payload") >= revisit_from).groupBy("sha1").agg(F.max("page_id").alias("response")))
    size = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    is_response = F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response"))
    joined = rows.join(largest, "sha1", "left").select("page_id", "url", "payload", F.when(~is_response, F.col("response")).alias("refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, body, refers_to in zip(*(c for c in batch.columns), strict=True):
                body = body.as_py()
                packed = member(record(page_id.as_py(), url.as_py(), body, digest(body), refers_to.as_py()))
                if held and size + len(packed) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [], 0
                held.append(packed)
                size += len(packed)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    written = joined.coalesce(-(-size // TASK_BYTES) or 1).mapInArrow(archives, "content binary").select(F.col("content").cast("string").alias("value"))
    written.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``gap``) of all archives below ``path``."""

    def page(urn: str | None) -> int | None:
        number = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(number[1]) if number else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for found in salvage(content.as_py()):
                    if isinstance(found, Gap):
                        rows.append((name, found.position, found.size, True, *[None] * 7))
                        continue
                    h = found.headers
                    rows.append(
                        (name, found.position, found.size, False, page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"))
                        + (page(h.get("warc-refers-to")), found.payload_bytes, h.get("warc-payload-digest", "").removeprefix("sha1:") or None)
                        + (found.payload if with_payload else None,)
                    )
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                names = [f.split(" ")[0] for f in RECORDS_DDL.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORDS_DDL)


def write_and_read(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Archives in the shared folder, read back without the payloads' bytes."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, revisit_from)
    return read_archives(pages.sparkSession, path, with_payload=False)
