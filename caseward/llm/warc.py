"""Operator 9: WARC archives, written with revisit records and read sequentially.

Every record is a gzip member of its own.  Of pages with equal payloads the one
with the largest page_id is stored as a response; the others are revisit records
that name it and carry the HTTP header alone.  The reader walks through an archive
member by member: it decompresses step by step, frames a record by its content
length and checks both digests.

Scale: the group of a payload is its digest's largest page_id, a map-side
combined aggregate; pages are shuffled once, by page_id, so that a payload shared
by a third of all pages is no hot key.  Tasks stream archives of bounded size to
the shared folder and move them when complete; reading holds one record at a time.

Defined results: a null payload is the empty one; a null page_id is smaller than
any other; rows with equal page_id and payload get equal records; payloads
shorter than ``least`` bytes are all responses; an empty table gives no archive
and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.files import located, written
from caseward.llm.slabs import slabs
from caseward.sources.shared import stored

#: An archive ends after the record that takes it over this size.
ARCHIVE_BYTES = 256 << 20
_CHUNK = 1 << 16
_SLAB = 8 << 20
_NULL_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return b32encode(sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, stored_elsewhere: bool) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if stored_elsewhere else http + payload
    fields = [
        ("WARC-Type", "revisit" if stored_elsewhere else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if stored_elsewhere:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Members:
    """The bytes of one gzip member after the other, decompressed as they are asked for."""

    def __init__(self, stream):
        self.stream = stream
        self.raw = b""
        self.open()

    def open(self) -> None:
        self.inflate, self.data = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decompress another step; false at the member's end."""
        if self.inflate.eof:
            return False
        self.raw = self.raw or self.stream.read(_CHUNK)
        if not self.raw:
            raise ValueError("archive ends inside a record")
        self.data += self.inflate.decompress(self.raw, _CHUNK)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                raise ValueError("record without end of header")
        out, self.data = self.data[: at + len(mark)], self.data[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, size = [self.data], len(self.data)
        while size < n:
            self.data = b""
            if not self.more():
                raise ValueError("record is shorter than its content length")
            parts.append(self.data)
            size += len(self.data)
        whole = b"".join(parts)
        self.data = whole[n:]
        return whole[:n]

    def close(self) -> bool:
        """Leave a member at its end; false when the archive ends there too."""
        while self.more():
            pass
        if self.data:
            raise ValueError("bytes after the end of a record")
        self.raw = self.raw or self.stream.read(_CHUNK)
        self.open()
        return bool(self.raw)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive; digests are checked."""
    members = Members(stream)
    members.raw = stream.read(_CHUNK)
    more = bool(members.raw)
    while more:
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("record is longer than its content length")
        if fields["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest differs: {fields['warc-record-id']}")
        yield fields, block
        more = members.close()


def _number(uri: str | None) -> int | None:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _page(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    size = int(_fields(head)["content-length"])
    if kind == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"payload digest differs: {fields['warc-record-id']}")
    number = _number(fields["warc-record-id"])
    return number, size, told, kind, _number(fields.get("warc-refers-to")), payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page; returns (path, n_records) of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rows = (
            row
            for slab in slabs(batches, "html", _SLAB)
            for row in zip(*(slab.column(c).to_pylist() for c in ("page_id", "url", "html", "newest", "revisits")), strict=True)
        )
        row, number = next(rows, None), 0
        while row is not None:
            path, n, size = f"{folder}/pages-{context.partitionId():06d}-{number:04d}.warc.gz", 0, 0
            with written(path, str(context.taskAttemptId())) as stream:
                while row is not None and size < archive_bytes:
                    page_id, url, html, newest, revisits = row
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    size += stream.write(packer.compress(record(page_id, url, html.encode(), newest, revisits)) + packer.flush())
                    n += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})
            number += 1

    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    base = base.select("*", F.coalesce("page_id", F.lit(_NULL_ID)).alias("k"), F.sha1(F.encode("html", "UTF-8")).alias("sha"))
    small = base.filter(F.octet_length("html") >= least).select("k", "sha")
    newest = small.groupBy("sha").agg(F.max("k").alias("newest"))
    older = small.join(newest, "sha").filter("k < newest").distinct()
    rows = base.join(older, ["k", "sha"], "left").select("page_id", "url", "html", "newest", F.col("newest").isNotNull().alias("revisits"))
    return stored(rows.mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses) of every record."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    width = 6 if payload else 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))[:width]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds[:width], strict=True)], names[:width])

        for paths in batches:
            for path in paths.column("path").to_pylist():
                system, where = located(path)
                held, size = [], 0
                with system.open_input_stream(where, compression=None) as stream:
                    for fields, block in records(stream):
                        held.append(_page(fields, block))
                        size += len(block)
                        if size > _SLAB:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, schema + ", payload binary" * payload)


#: Base32 of the digest: every five hexadecimal digits are four letters.
SQL = """
WITH page AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages
), letters AS (
    SELECT page_id, n, newest, list_transform(range(8), lambda i : CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS v FROM page
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(v, lambda x : array_to_string(list_transform([15, 10, 5, 0], lambda s : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> s) & 31) AS INT), 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM letters
"""
