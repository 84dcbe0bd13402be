"""WARC archives: writing with revisits, and a sequential reader (operator 9).

Writing: payload digests find equal payloads; the record with the smallest page_id
of each is a response, the others are revisits that refer to it.  Each task writes
its own archives, one gzip member per record, under a name of its own in the shared
folder, and only archives of tasks that ended well are listed, so a repeated task
leaves nothing double.

Reading: an archive is one task.  Its members are inflated piece by piece with
zlib, framed by Content-Length, and the block and payload digests are checked as
the bytes pass; at most one piece of a record is held, besides its headers.

Null html is an empty payload.  A null page_id ranks after all others.  Of rows that
repeat a page_id and its payload one is the response and the others revisit it.
An empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, scratch_dir, slices

PIECE = 1 << 18
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_NULL = "null"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _uri(page: object) -> str:
    return f"<urn:x-page:{_NULL if page is None else page}>"


def record(page: object, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record before compression; ``refers_to`` is the URI of the response it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = "".join((url or "").split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_uri(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write archives below ``folder``; the list of them: path, n_records, n_bytes."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    rows = save(rows, "payloads")
    # digests meet without their bodies, which then move by row: a payload that many pages share goes to no one task
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("p"), "rid")
    light = rows.where(F.length("body") >= min_bytes).select("digest", "page_id", "rid")
    first = light.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("f")).where("n > 1").select("digest", "f")
    uri = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("f.p").cast("string"), F.lit(_NULL)), F.lit(">"))
    revisits = light.join(first, "digest").where(F.col("f.rid") != F.col("rid")).select("rid", uri.alias("refers_to"))
    rows = rows.join(revisits, "rid", "left").select("page_id", "url", "body", "refers_to")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        out, done, path, count, size = None, [], "", 0, 0
        for batch in slices(batches, "body", 8 << 20):
            for page, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "refers_to"))):
                if out is None:
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(path, compression=None)
                deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = deflate.compress(record(page, url, payload, refers_to)) + deflate.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return rows.mapInArrow(archive, "path string, n_records long, n_bytes long")


class _Member:
    """Bytes of the gzip members of one open file, inflated as they are asked for."""

    def __init__(self, source):
        self.source, self.raw, self.ready, self.inflate = source, b"", b"", None
        self.ended = False

    def more(self) -> bool:
        """Inflate another piece of the member; False at its end."""
        if self.inflate is None:
            if not self.raw:
                self.raw = self.source.read(PIECE)
            if not self.raw:
                self.ended = True
                return False
            self.inflate = zlib.decompressobj(31)
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.raw
            if not data:
                data = self.source.read(PIECE)
                if not data:
                    raise ValueError("archive ends within a record")
            self.raw = b""
            piece = self.inflate.decompress(data, PIECE)
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
            if piece:
                self.ready += piece
                return True
        return False

    def line(self) -> bytes:
        while b"\r\n" not in self.ready:
            if not self.more():
                raise ValueError("record without a header")
        head, _, self.ready = self.ready.partition(b"\r\n")
        return head

    def headers(self) -> dict[str, str]:
        out: dict[str, str] = {}
        while text := self.line():
            name, _, value = text.decode("utf-8").partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    def take(self, most: int) -> bytes:
        if not self.ready and not self.more():
            raise ValueError("record is shorter than its Content-Length")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out


def records(source) -> Iterator[dict]:
    """Records of an open archive in order, checked; the payload is digested but not kept."""
    stream = _Member(source)
    while True:
        if not stream.ready and not stream.more():
            if stream.ended:
                return
            stream.inflate = None
            continue
        if stream.line() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        head = stream.headers()
        left, whole, payload, size, seen, status = int(head["content-length"]), hashlib.sha1(), hashlib.sha1(), 0, b"", None
        while left:
            piece = stream.take(left)
            left -= len(piece)
            whole.update(piece)
            if status is None:
                seen += piece
                if b"\r\n\r\n" not in seen:
                    continue
                status, _, piece = seen.partition(b"\r\n\r\n")
            payload.update(piece)
            size += len(piece)
        tail = b""
        while len(tail) < 4:
            tail += stream.take(4 - len(tail))
        if tail != b"\r\n\r\n" or stream.ready or stream.more():
            raise ValueError("record isn't framed by its Content-Length")
        stream.inflate = None
        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        if _base32(whole.digest()) != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError("block digest differs")
        if kind == "response" and _base32(payload.digest()) != digest:
            raise ValueError("payload digest differs")
        declared = next(int(x.split(b":")[1]) for x in status.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if kind == "response" and size != declared:
            raise ValueError("payload length differs")
        yield {"id": head["warc-record-id"], "url": head.get("warc-target-uri"), "bytes": declared, "digest": digest, "type": kind, "refers_to": head.get("warc-refers-to")}


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def number(uri: str | None) -> int | None:
        text = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(text) if text not in ("", _NULL) else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number(r["id"]) for r in rows], pa.int64()),
                    pa.array([r["bytes"] for r in rows], pa.int64()),
                    *(pa.array([r[c] for r in rows], pa.string()) for c in ("digest", "type")),
                    pa.array([number(r["refers_to"]) for r in rows], pa.int64()),
                ],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with where.open_input_stream(path, compression=None) as source:
                    for r in records(source):
                        rows.append(r)
                        if len(rows) == 10_000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    count = max(1, archives.count())
    return archives.select("path").repartition(count).mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    return read(save(write(pages, folder), "archives"), folder)
