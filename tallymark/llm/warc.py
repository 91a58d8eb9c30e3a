"""WARC archives: one gzip member per record, written and read sequentially.

Writing: of all pages with equal payloads the one with the smallest id is a
``response`` record, the others are ``revisit`` records without payload that
refer to it. Every task writes archives of bounded size, record by record, and
returns one row per archive; only archives of tasks that succeeded are listed,
so a task that is run again or twice leaves nothing wrong.

Reading: each archive is streamed in small chunks through an incremental zlib
decompressor. A record's headers end at a blank line, its block is cut by
Content-Length, a member must end where its record ends, and the digests of
block and payload are recomputed and compared. No record is held more than
once and no archive is ever held.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import fresh_path, join_small, materialise

#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Tasks that read archives at most.
MOST_READERS = 10_000
#: Bytes read from an archive at once.
CHUNK = 1 << 16
LEVEL = 3

# Fixed values of the formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; cluster names of stores are mapped to Arrow's."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line_safe(value: str) -> str:
    """A header value without line breaks: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, identity: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record of an HTTP answer; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identity}>"), ("WARC-Date", date),
              ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if uri is not None:
        fields.append(("WARC-Target-URI", _line_safe(uri)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)]) + b"\r\n\r\n"
    return head + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; equal data gives equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class RecordError(ValueError):
    """An archive breaks the format or a digest does not match."""


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The decompressed chunks of each gzip member; a member is read to its end before the next."""
    raw = stream.read(CHUNK)

    def chunks():
        nonlocal raw
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not raw:
                raise RecordError("archive ends inside a member")
            try:
                out = unpack.decompress(raw, CHUNK)
            except zlib.error as error:
                raise RecordError(f"broken member: {error}") from error
            raw = unpack.unconsumed_tail or unpack.unused_data
            if out:
                yield out
            if not raw and not unpack.eof:
                raw = stream.read(CHUNK)
                if not raw:
                    tail = unpack.flush()
                    if tail:
                        yield tail
        raw = raw or stream.read(CHUNK)

    while raw:
        yield chunks()


def read_records(stream) -> Iterator[dict]:
    """Records of an archive in order: ``headers``, ``http`` headers, ``payload``.

    Raises :class:`RecordError` for broken framing or a digest that differs.
    """
    for chunks in _members(stream):
        held = bytearray()
        for part in chunks:
            held += part
            if b"\r\n\r\n" in held:
                break
        head, gap, rest = bytes(held).partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not gap or not lines[0].startswith(b"WARC/"):
            raise RecordError("a member does not begin with a record")
        headers = {}
        for line in lines[1:]:
            name, colon, value = line.partition(b":")
            if not colon:
                raise RecordError(f"bad header line {line[:80]!r}")
            headers[name.decode().lower()] = value.strip().decode()
        length = int(headers["content-length"])
        block = bytearray(rest)
        for part in chunks:
            block += part
            if len(block) > length + 4:
                raise RecordError("a record is longer than its Content-Length")
        if bytes(block[length:]) != b"\r\n\r\n":
            raise RecordError("a record does not end where its Content-Length says")
        del block[length:]
        block = bytes(block)
        if headers.get("warc-block-digest") not in (None, f"sha1:{digest(block)}"):
            raise RecordError(f"block digest of {headers.get('warc-record-id')} differs")
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in http_head.decode("latin-1").split("\r\n")[1:])}
        if headers["warc-type"] == "response":
            if headers.get("warc-payload-digest") not in (None, f"sha1:{digest(payload)}"):
                raise RecordError(f"payload digest of {headers.get('warc-record-id')} differs")
            if "content-length" in http and int(http["content-length"]) != len(payload):
                raise RecordError(f"payload of {headers.get('warc-record-id')} is cut")
        yield {"headers": headers, "http": http, "payload": payload}


def identity(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def originals(pages: DataFrame) -> DataFrame:
    """``payload_sha1, original`` of the payloads that several pages have.

    Only ids and digests are shuffled, added up by task first.
    """
    digests = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("payload_sha1"))
    return (digests.groupBy("payload_sha1").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("payload_sha1", "original"))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` as archives below ``folder``; one row per archive.

    A null html is an empty payload. Pages that repeat the id of the original
    are responses as well; a page without id revisits an original that has one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("payload_sha1"))
    rows = join_small(rows, originals(pages), "payload_sha1", "left")

    def run(batches: Iterator[pa.RecordBatch]):
        out, path, size, n = None, "", 0, 0
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_sha1", "original")]
            for i in range(batch.num_rows):
                page_id, url, data, sha, original = (c[i].as_py() for c in columns)
                if out is None:
                    path = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[-1]}", compression=None), 0, 0
                kind = "revisit" if original is not None and original != page_id else "response"
                done = member(record(kind, identity(page_id), url, data, base64.b32encode(bytes.fromhex(sha)).decode(),
                                     identity(original), date))
                out.write(done)
                size, n = size + len(done), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(rows.mapInArrow(run, "path string, bytes bigint, records bigint"))


def read(archives: DataFrame) -> DataFrame:
    """Every record of the listed archives (``path, records``).

    Gives ``page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, html``; for a revisit the payload's figures come from its
    headers and ``html`` is null. An archive with another number of records
    than listed is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for listed in batch.to_pylist():
                store, name = open_store(listed["path"])
                rows, held, seen = [], 0, 0
                with store.open_input_stream(name, compression=None) as stream:
                    for found in read_records(stream):
                        head, kind = found["headers"], found["headers"]["warc-type"]
                        response = kind == "response"
                        rows.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), kind,
                                     len(found["payload"]) if response else int(found["http"]["content-length"]),
                                     head["warc-payload-digest"].removeprefix("sha1:"),
                                     None if response else page_of(head.get("warc-refers-to")),
                                     found["payload"].decode("utf-8", "replace") if response else None))
                        held, seen = held + len(found["payload"]), seen + 1
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if seen != listed["records"]:
                    raise RecordError(f"{listed['path']} has {seen} records, {listed['records']} are listed")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # a number of its own: rows of paths are so small that adaptive execution would hand them all to one task
    return archives.select("path", "records").repartition(min(max(archives.count(), 1), MOST_READERS), "path").mapInArrow(
        run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, html string")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives and read them back."""
    return read(write(pages, folder or fresh_path(pages.sparkSession, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS original, count(*) AS n FROM p GROUP BY html),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
        CASE WHEN n > 1 AND original <> page_id THEN original END AS refers_to FROM p JOIN f USING (html))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (k // 4))::INT, 5))::BIGINT
      >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM h
"""
