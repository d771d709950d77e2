"""WARC archives: one gzip member for each record, written and read sequentially.

Archives are rows (path, content), the shape of Spark's binaryFile source, so real files read the same way:
read(spark.read.format("binaryFile").load("*.warc.gz")).  A row is one archive of about `archive_bytes`; a
task writes one after another and never holds more than one.

The reader goes through an archive once.  It inflates a member piece by piece, takes the header up to the
empty line, then exactly Content-Length bytes of block, then the two line ends, and checks the payload's
SHA-1 while it passes.  A member that ends early, is followed by anything but a member, or whose digest
differs raises ValueError.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is a response
and the others are revisits that refer to it; smaller payloads are all responses.

Defined cases: null html is an empty payload; a null url has no target header; rows with the smallest
page_id twice are both responses; a null page_id comes after all others; equal rows are a record each; a very long
page is one record, of which the reader holds what it has inflated; empty tables give empty archives; other columns
aren't read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import only, sliced, written

ARCHIVE_BYTES = 8 << 20
#: Compressed bytes that the reader inflates at a time.
STEP = 1 << 16
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "!#$%&'()*+,/:;=?@[]~"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit where refers_to is given: then the block ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    headers = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<{NAME}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", quote(url, safe=_URL_SAFE))] if url else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}")]
    headers += [("WARC-Refers-To", f"<{NAME}{refers_to}>"), ("WARC-Profile", PROFILE)] if again else []
    headers += [("Content-Type", "application/http; msgtype=response")]
    return member(headers, http if again else http + payload)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def with_kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, sha1 (hexadecimal) and refers_to, the response's page_id for revisits.

    Copies are found by digest and length; a large group of them is pre-aggregated, and the join that
    brings the pages to their response splits it (adaptive skew join).
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = only(pages, "page_id", "url", "html").withColumn("sha1", F.sha1(raw)).withColumn("n", F.octet_length(raw))
    first = rows.filter(F.col("n") >= least).groupBy("sha1", "n").agg(F.min("page_id").alias("first"))
    first = first.select(F.col("sha1").alias("_sha1"), F.col("n").alias("_n"), "first")
    joined = rows.join(first, (F.col("sha1") == F.col("_sha1")) & (F.col("n") == F.col("_n")), "left")
    return joined.select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def archives(rows: DataFrame, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, length, content): archives of the rows that with_kinds() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        made, size = [], 0

        def closed() -> pa.RecordBatch:
            nonlocal made, size, count
            content = b"".join(made)
            made, size, count = [], 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}.warc.gz"]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

        for batch in sliced(batches):
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not made:
                    made.append(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{part}:{count}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                made.append(page_record(page_id, url, (html or "").encode(), base32(bytes.fromhex(sha1)), refers_to, date))
                size += len(made[-1])
                if size >= archive_bytes:
                    yield closed()
        if made:
            yield closed()

    typed = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "sha1", F.col("refers_to").cast("long"))
    return typed.mapInArrow(run, "path string, length long, content binary")


@dataclass
class Record:
    headers: dict[str, str]  # by lower-case name
    http: dict[str, str]  # the HTTP header's fields, if the block is an HTTP message
    payload: bytes | None  # None where not kept
    payload_length: int  # bytes of payload in this record
    digest: str  # of those bytes


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class _Member:
    """Inflates one member on demand from `data` at `at`."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.begin, self.at = data, at, at
        self.inflate, self.ready = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflates another piece into `ready`; False at the member's end."""
        if self.inflate.eof:
            return False
        fed = self.inflate.unconsumed_tail or self.data[self.at : self.at + STEP]
        if not self.inflate.unconsumed_tail:
            self.at += len(fed)
        if not len(fed):
            raise ValueError(f"the member at {self.begin} is cut off")
        try:
            self.ready += self.inflate.decompress(fed, 4 * STEP)
        except zlib.error as bad:
            raise ValueError(f"no gzip member at {self.begin}: {bad}") from bad
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while (end := self.ready.find(mark)) < 0:
            if not self.more():
                raise ValueError(f"the member at {self.begin} has no {mark!r}")
        out, self.ready = self.ready[:end], self.ready[end + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError(f"the member at {self.begin} ends inside its block")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out


def records(content: bytes | memoryview, keep: bool = True) -> Iterator[Record]:
    """The records of an archive, one at a time; keep=False digests payloads without keeping them."""
    data, at = memoryview(content), 0
    while at < len(data):
        one = _Member(data, at)
        head = one.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"the member at {at} is no WARC record")
        headers = _fields(head)
        left, http = int(headers["content-length"]), {}
        if headers.get("content-type", "").startswith("application/http"):
            block = b""
            for piece in one.take(left):
                block += piece
                if b"\r\n\r\n" in block:
                    break
            message, _, rest = block.partition(b"\r\n\r\n")
            http, left = _fields(message), left - len(block)
        else:
            rest = b""
        digest, kept, n = hashlib.sha1(rest), [rest], len(rest)
        for piece in one.take(left):
            digest.update(piece)
            n += len(piece)
            if keep:
                kept.append(piece)
        while len(one.ready) < 4 and one.more():
            pass
        while one.more():
            pass
        if one.ready != b"\r\n\r\n":
            raise ValueError(f"the member at {at} doesn't end after its block")
        found, told = base32(digest.digest()), headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if told and headers.get("warc-type") != "revisit" and told != found:
            raise ValueError(f"the payload at {at} has digest {found}, not {told}")
        yield Record(headers, http, b"".join(kept) if keep else None, n, found)
        at = one.at


def read(files: DataFrame, keep: bool = True) -> DataFrame:
    """The responses and revisits of archives (content): page_id, url, record_type, refers_to, payload_digest, payload_bytes (of the full payload) and payload (null for revisits, or where not kept)."""

    def number(name: str | None) -> int | None:
        text = (name or "").strip("<>").removeprefix(NAME)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for content in batch.column(0):
                out: list[list] = [[] for _ in names]
                for r in records(content.as_buffer(), keep):
                    kind = r.headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    again = kind == "revisit"
                    digest = r.headers["warc-payload-digest"].removeprefix("sha1:") if again else r.digest
                    size = int(r.http["content-length"]) if again else r.payload_length
                    row = (number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), kind, number(r.headers.get("warc-refers-to")), digest, size, None if again else r.payload)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def archived(pages: DataFrame, least: int = 0, keep: bool = False) -> DataFrame:
    """Writes the pages' archives into the shared folder and reads them back."""
    files = written(archives(with_kinds(pages, least)), "archives")
    return read(files, keep)
