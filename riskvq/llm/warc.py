"""Operator 12: WARC archives, written from a table of pages and read back in sequence.

Writing: payloads of TWIN_BYTES or more that occur twice become one response
(that of the largest page_id) and revisit records, which hold the HTTP header
alone.  Each task appends records, one gzip member each, until an archive has
ARCHIVE_BYTES; a closing metadata record counts them.  Spark's text writer puts
each archive into a file of its own, so files are committed like those of any
Spark write.  That writer ends a value with a separator, here the byte 0: the
last byte of a gzip member is 0 as long as it holds less than 16 MiB, as the
closing record does, so an archive is passed on without its last byte and the
file is a plain sequence of gzip members.

Reading: one pass over an archive; every member is decompressed a piece at a
time, header lines end the header, Content-Length frames the block, and the
digests of block and payload are computed as pieces pass and compared with
those of the header.  A damaged member is reported in ``problem`` and reading
goes on at the next one.

Cases: a NULL html is the empty payload; rows without page_id are records
without a number, never the one that others refer to; rows that share the
largest page_id of a payload are all responses; a NULL url is left out; an
empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, ddl, sliced
from riskvq.session import ensure_checkpoint_dir

TWIN_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
PIECE = 1 << 16
LONGEST_HEADER = 1 << 20
# fixed values of the WARC 1.1 format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"

FIELDS = [("record_type", "string"), ("record_id", "string"), ("target_uri", "string"), ("payload_bytes", "bigint"),
          ("payload_digest", "string"), ("refers_to_id", "string"), ("problem", "string"), ("payload", "binary")]


def digest_label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(page_id: int | None) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else quote(str(page_id))}>"


def gzip_member(record_type: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    fields = [("WARC-Type", record_type), *headers,
              ("WARC-Block-Digest", digest_label(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: bytes,
                response: int | None, date: str) -> bytes:
    """The record of a page: a response with its payload, or a revisit of page ``response``."""
    headers = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        # what is no plain URL character could end the header line
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")))
    headers += [("WARC-Payload-Digest", digest_label(sha1)), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if response is None:
        return gzip_member("response", headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(response)), ("WARC-Truncated", "length")]
    return gzip_member("revisit", headers, http)


def _write(date: str, archive_bytes: int):
    """Rows (page_id, url, payload, size, sha1, response) to archives without their last byte."""
    def closed(archive: bytearray, n: int):
        archive += gzip_member("metadata", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date),
                                            ("Content-Type", "application/warc-fields")], f"records: {n}\r\n".encode())
        return arrow_rows([[bytes(memoryview(archive)[:-1])]], [("archive", "binary")])

    def run(batches):
        archive, n = bytearray(), 0
        for batch in sliced(batches):
            for page_id, url, payload, size, sha1, response in zip(*batch.columns, strict=True):
                archive += page_member(page_id.as_py(), url.as_py(), payload.as_py() or b"", size.as_py(),
                                       bytes.fromhex(sha1.as_py()), response.as_py(), date)
                n += 1
                if len(archive) >= archive_bytes:
                    yield closed(archive, n)
                    archive, n = bytearray(), 0
        if n:
            yield closed(archive, n)

    return run


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z",
               archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> None:
    """Write (page_id, url, html) rows as WARC archives under path; ``folder`` takes the table of repeated payloads.

    Only digests and ids are shuffled to find repeated payloads.  Their table is
    written first, so that its size is known when pages are joined to it: Spark
    broadcasts it below its own threshold and else joins by digest, where a hot
    payload is split by adaptive execution.
    """
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/twins-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("size"),
                        F.sha2(payload, 256).alias("key"))
    (rows.where(F.col("size") >= TWIN_BYTES).groupBy("key")
     .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
     .where("n > 1 AND response IS NOT NULL").select("key", "response").write.parquet(folder))
    twins = pages.sparkSession.read.parquet(folder)
    joined = rows.join(twins, "key", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    out = joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size",
                        F.sha1("payload").alias("sha1"), F.when(revisit, F.col("response")).alias("response"))
    (out.mapInArrow(_write(date, archive_bytes), "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path))


class Damaged(ValueError):
    """A member that does not hold what its header or gzip frame says."""


class Member:
    """The bytes of one gzip member, decompressed a piece at a time."""

    def __init__(self, raw: memoryview, at: int):
        self.raw, self.at, self.have = raw, at, b""
        self.z = zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress one more piece; False at the end of the member."""
        while not self.z.eof:
            source = self.z.unconsumed_tail
            if not source:
                source = self.raw[self.at:self.at + PIECE]
                if not len(source):
                    raise Damaged("archive ends inside a record")
                self.at += len(source)
            try:
                piece = self.z.decompress(source, PIECE)
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            if piece:
                self.have += piece
                return True
        return False

    def header(self) -> bytes:
        """What comes before the next empty line."""
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if len(self.have) > LONGEST_HEADER or not self.more():
                raise Damaged("header without an end")
        out, self.have = self.have[:end], self.have[end + 4:]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.have and not self.more():
                raise Damaged("block shorter than Content-Length")
            piece, self.have = self.have[:n], self.have[n:]
            n -= len(piece)
            yield piece

    def end(self) -> int:
        """Checks the end of the record; the position of the next member."""
        while self.more():
            if len(self.have) > 4:
                break
        if self.have != b"\r\n\r\n":
            raise Damaged("record does not end after Content-Length bytes")
        return self.at - len(self.z.unused_data)


def fields_of(header: bytes) -> tuple[str, dict[str, str]]:
    """First line and named fields (names in lower case) of a header; folded lines are joined."""
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", header).decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise Damaged("no Content-Length")
    return int(value)


def read_record(member: Member, with_payload: bool) -> tuple:
    """One record as FIELDS, verified."""
    first, warc = fields_of(member.header())
    if not first.startswith("WARC/"):
        raise Damaged("no WARC record")
    kind, left = warc.get("warc-type"), _length(warc)
    keep = with_payload or kind == "metadata"
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    http: dict[str, str] | None = None
    size, head = 0, b""
    is_http = warc.get("content-type", "").startswith("application/http")
    for piece in member.take(left):
        block.update(piece)
        if is_http and http is None:
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                if len(head) > LONGEST_HEADER:
                    raise Damaged("HTTP header without an end")
                continue
            http, piece, head = fields_of(head[:end])[1], head[end + 4:], b""
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if is_http and http is None:
        raise Damaged("HTTP header without an end")
    if "warc-block-digest" in warc and warc["warc-block-digest"] != digest_label(block.digest()):
        raise Damaged("block digest differs")
    said = warc.get("warc-payload-digest")
    if kind == "revisit":
        if not said or not said.startswith("sha1:"):
            raise Damaged("revisit without payload digest")
        try:
            sha1 = base64.b32decode(said[5:]).hex()
        except ValueError:
            raise Damaged("payload digest is no base 32") from None
        size = _length(http or {})
    else:
        sha1 = payload.hexdigest()
        if said and said != digest_label(payload.digest()):
            raise Damaged("payload digest differs")
        if http is not None and "content-length" in http and _length(http) != size:
            raise Damaged("payload shorter or longer than the HTTP header says")
    return (kind, warc.get("warc-record-id"), warc.get("warc-target-uri"), size, sha1, warc.get("warc-refers-to"),
            None, b"".join(kept) if keep and kind != "revisit" else None)


def read_archive(raw: memoryview, with_payload: bool = False, counted: bool = False) -> Iterator[tuple]:
    """The records of an archive in order, as FIELDS; of a damaged one the problem alone.

    ``counted``: the archive must end with the closing record of ``write_warc``, which is not returned.
    """
    at, found, said = 0, 0, None
    while at < len(raw):
        member = Member(raw, at)
        try:
            record = read_record(member, with_payload)
            at = member.end()
            if counted and record[0] == "metadata":
                said = int(record[7].removeprefix(b"records:"))
            else:
                found += 1
                yield record if with_payload else (*record[:7], None)
        except Damaged as e:
            yield (*[None] * 6, str(e), None)
            at = _next_member(raw, at + 1)
    if counted and len(raw) and said != found:
        yield (*[None] * 6, f"archive of {said} records holds {found}", None)


def _next_member(raw: memoryview, at: int) -> int:
    """The next place that begins like a gzip member."""
    while at < len(raw):
        piece = bytes(raw[at:at + PIECE + 2])
        k = piece.find(b"\x1f\x8b\x08")
        if k >= 0:
            return at + k
        at += PIECE
    return len(raw)


def _read(with_payload: bool, counted: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in read_archive(memoryview(content.as_buffer()), with_payload, counted):
                    rows.append(record)
                    held += len(record[7] or b"")
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield arrow_rows([list(c) for c in zip(*rows, strict=True)], FIELDS)
                        rows, held = [], 0
                if rows:
                    yield arrow_rows([list(c) for c in zip(*rows, strict=True)], FIELDS)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, counted: bool = False) -> DataFrame:
    """FIELDS of every record under path, with its payload if asked for; ``counted`` as in ``read_archive``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload, counted), ddl(FIELDS))


def page_of(record: Column) -> Column:
    """The page_id in a record id of ``write_warc``."""
    number = F.regexp_extract(record, f"^<{RECORD_ID}(.+)>$", 1)
    return F.when(number != "", number.cast("bigint"))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives and read them: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    path = path or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, f"{path}/archives", folder=f"{path}/twins")
    records = read_warc(pages.sparkSession, f"{path}/archives", counted=True)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page_of(F.col("refers_to_id")).alias("refers_to"), "problem")

