"""WARC archives as a chunked record table.

`write_archives` turns pages into gzipped WARC 1.1 files (a member per record, so a reader may start at
any record); `read_archives` streams them back as rows (record, chunk number), each with the digest of
the payload so far. Neither holds more than a chunk of a record beyond the row it was given, whatever
the payload's size. Files go to and come from any file system that pyarrow can open by URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, saved, table, utf8, work_path

#: Payload bytes in a row of the record table.
CHUNK = 1 << 16
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str) -> str:
    """A header value: line ends and other control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _head(page, url, kind, refers, length, digest) -> tuple[bytes, bytes]:
    """WARC header up to Content-Length's value, and the HTTP header that opens the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    block = len(http) + (length if kind == "response" else 0)
    return ("\r\n".join(lines) + f"\r\nContent-Length: {block}\r\n\r\n").encode(), http


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


class _Archive:
    def __init__(self, folder):
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{base}/{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.warc.gz"
        fs.create_dir(base, recursive=True)
        self.fs, self.to, self.uri, self.records, self.bytes = fs, name, f"{folder}/{name.rpartition('/')[2]}", 0, 0
        self.out = fs.open_output_stream(name + ".open")

    def add(self, head: bytes, http: bytes, payload) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(z.compress(head + http))
        for at in range(0, len(payload), CHUNK):
            self._put(z.compress(payload[at : at + CHUNK]))
        self._put(z.compress(b"\r\n\r\n") + z.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self):
        self.out.close()
        self.fs.move(self.to + ".open", self.to)
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([self.records]), pa.array([self.bytes])], schema=_MANIFEST)


def _writer(folder):
    def run(batches):
        archive = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "record_type", "refers_to", "payload_digest")]
            payloads = batch.column("payload")
            for i, (page, url, kind, refers, digest) in enumerate(zip(*columns, strict=True)):
                payload = memoryview(payloads[i].as_buffer())
                archive = archive or _Archive(folder)
                head, http = _head(page, url, kind, refers, len(payload), digest)
                archive.add(head, http, payload if kind == "response" else b"")
                if archive.bytes > ARCHIVE_BYTES:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return run


def base32_sha1(hexed):
    """A hexadecimal SHA-1 column in bare upper-case base32: eight groups of four digits, then the rest."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda i: F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 10).cast("long")
    return F.concat(*[F.substring(F.lit(digits), (F.shiftright(part(i), 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(4) for j in range(8)])


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_digest, record_type and refers_to.

    Of payloads of at least min_bytes that are equal, the least page_id's is a response and the others
    refer to it; rows that repeat a page_id and its payload are all responses when they are the least.
    Null html is empty. Rows without a page_id are responses.
    """
    have = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"), utf8("html").alias("payload"))
    have = have.withColumn("hex", F.sha1("payload"))
    seen = saved(have.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "hex"), "warc-digests")
    first = seen.groupBy("hex").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("hex", "first")
    revisits = seen.join(first, "hex").where("page_id <> first").select("page_id", "hex", "first").distinct()
    out = have.join(revisits, ["page_id", "hex"], "left")
    return out.select("page_id", "url", "payload", base32_sha1(F.col("hex")).alias("payload_digest"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records as archives under the folder; (path, records, bytes) of those that count.

    A task's archive appears under its name when complete, and only archives of tasks that succeeded are
    in the returned (saved) manifest, so lost executors and repeated tasks leave no record twice.
    """
    bounded_batches(records.sparkSession)
    return saved(records.mapInArrow(_writer(folder), "path string, records long, bytes long"), "warc-manifest")


_CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("last", pa.bool_())])
_SCHEMA = "page_id long, url string, record_type string, refers_to long, chunk long, data binary, payload_bytes long, payload_digest string, stated_digest string, last boolean"


def _inflated(stream):
    """Pieces of the decompressed file, of bounded size."""
    z, data = zlib.decompressobj(31), b""
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                return
        piece = z.decompress(data, CHUNK)
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail
        if piece:
            yield piece


class _Reader:
    def __init__(self, stream):
        self.pieces, self.buffer = _inflated(stream), bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece:
            self.buffer += piece
        return piece is not None

    def upto(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is dropped; None at the end of the file."""
        at = 0
        while (end := self.buffer.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.buffer)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one."""
        if not self.buffer and not self.more():
            raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[: len(out)]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def record_chunks(stream, chunk: int = CHUNK):
    """Rows of the record table from an open archive, one at a time."""
    r = _Reader(stream)
    while (head := r.upto(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        h = _fields(head)
        left = int(h["content-length"])
        http = r.upto(b"\r\n\r\n") or b""
        left -= len(http) + 4
        sha, size, number = hashlib.sha1(), 0, 0
        base = (_page(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], _page(h.get("warc-refers-to")))
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if h["warc-type"] == "revisit":
            yield (*base, 0, b"", int(_fields(http).get("content-length", 0)), stated, stated, True)
        held = bytearray()
        while h["warc-type"] != "revisit":
            while left and len(held) < chunk:
                piece = r.take(min(left, chunk - len(held)))
                left -= len(piece)
                held += piece
            sha.update(held)
            size += len(held)
            yield (*base, number, bytes(held), size, base64.b32encode(sha.digest()).decode(), stated, not left)
            held.clear()
            number += 1
            if not left:
                break
        if r.upto(b"\r\n\r\n") != b"":
            raise ValueError("bytes after a record's block")


def _read(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(name, compression=None) as stream:
                rows, held = [], 0
                for row in record_chunks(stream):
                    rows.append(row)
                    held += len(row[5])
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The record table of the archives in the manifest's `path`.

    (page_id, url, record_type, refers_to, chunk, data, payload_bytes and payload_digest up to and with the
    chunk, stated_digest, last). An empty payload is one empty chunk. A revisit has no data; its length and
    digest are those that it states for the full payload. A truncated archive is an error.
    """
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_read, _SCHEMA)


def query(spark, sf_dir):
    records = with_revisits(table(spark, sf_dir, "pages"))
    chunks = read_archives(write_archives(records, work_path(spark, "warc")))
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("payload_digest") == F.col("stated_digest")).alias("digest_ok"))


def _base32_sql(hexed: str) -> str:
    part = lambda i: f"CAST('0x' || substr({hexed}, {1 + 10 * i}, 10) AS BIGINT)"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({part(i)} >> {35 - 5 * j}) & 31) + 1 AS INTEGER), 1)" for i in range(4) for j in range(8))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
     f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, payload_bytes, {_base32_sql('x')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS digest_ok
FROM p JOIN f USING (x)
"""
