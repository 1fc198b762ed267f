"""WARC records inside ZIP packages, read by byte range.

A package holds archive/data.warc.gz, stored without compression and itself one gzip member per record, and
indexes/index.cdx, a line per record. A reader needs no extraction: the end record (or its ZIP64 form) leads to the
central directory, that to each member's local header, the index to each record's offset; records are then read as
ranges of the package.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heristat.llm.common import materialize, shared_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads below this size are stored whole even if they repeat.
MIN_REVISIT = 100
#: A package is closed at the first record that takes it past this size.
PACKAGE_BYTES = 32 << 20
#: Neighbouring records are fetched in one read up to this size.
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def opened(uri: str, mode: str) -> BinaryIO:
    """A local or remote file; remote ones through pyarrow."""
    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file://").removeprefix("file:")
        if mode == "wb":
            import os

            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


# --- ZIP ------------------------------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int  # of its local header


class ZipReader:
    """The directory of a ZIP or ZIP64 package and ranges of its stored members."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.length = file.seek(0, 2)
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        got = self.file.read(size)
        if len(got) < size:
            raise ValueError(f"the package ends within {size} bytes at {offset}")
        return got

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.length - 22 - 65535)
        tail = self.at(tail_at, self.length - tail_at)
        found = tail.rfind(b"PK\x05\x06")
        while found >= 0:  # a comment may hold the mark: the record must end where the file does
            if len(tail) - found >= 22 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
                break
            found = tail.rfind(b"PK\x05\x06", 0, found)
        if found < 0:
            raise ValueError("no end record: not a ZIP package")
        count, size, offset = struct.unpack_from("<HII", tail, found + 10)
        end = tail_at + found
        directory_end = end
        if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
            mark, _, where, _ = struct.unpack("<4sIQI", self.at(end - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            if self.at(where, 4) != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, size, offset = struct.unpack("<QQQ", self.at(where + 32, 24))
            directory_end = where
        shift = directory_end - size - offset  # of a package behind other bytes
        block, p = self.at(offset + shift, size), 0
        for _ in range(count):
            if block[p : p + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", block, p + 8)
            stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", block, p + 20)
            header = struct.unpack_from("<I", block, p + 42)[0]
            name = block[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = block[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # 64-bit forms of just the fields that overflowed, in this order
                    wide, r = extra[q + 4 : q + 4 + n], 0
                    if full == 0xFFFFFFFF:
                        full, r = struct.unpack_from("<Q", wide, r)[0], r + 8
                    if stored == 0xFFFFFFFF:
                        stored, r = struct.unpack_from("<Q", wide, r)[0], r + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", wide, r)[0]
                q += 4 + n
            yield Member(name, method, full, stored, header + shift)
            p += 46 + n_name + n_extra + n_note

    def start(self, name: str) -> int:
        """Offset in the package of a stored member's first byte."""
        if name not in self._starts:
            m = self.members[name]
            if m.method != 0:
                raise ValueError(f"{name} is compressed; only stored members can be read by range")
            head = self.at(m.header, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header for {name}")
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            self._starts[name] = m.header + 30 + n_name + n_extra
        return self._starts[name]

    def read(self, name: str) -> bytes:
        return self.at(self.start(name), self.members[name].size)


# --- WARC -----------------------------------------------------------------------------------------------------------


def _line(text: str) -> bytes:
    return text.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit has its payload's digest and length, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(), b"WARC-Date: " + DATE.encode(),
        *([b"WARC-Target-URI: " + _line(url)] if url is not None else []), b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha256:" + digest.encode(),
        *([b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()] if kind == "revisit" else []), b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def _page(urn: bytes | None) -> int | None:
    inner = (urn or b"")[10:-1]
    return int(inner) if inner else None


def parse(raw: bytes) -> Record:
    """Read a record back; a response's digest must be its payload's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields[b'WARC-Record-ID']!r} doesn't match its digest")
    uri = fields.get(b"WARC-Target-URI")
    return Record(_page(fields[b"WARC-Record-ID"]), None if uri is None else uri.decode("utf-8", "surrogatepass"), kind, _page(fields.get(b"WARC-Refers-To")), digest, length, payload if kind == "response" else None)


# --- Spark ----------------------------------------------------------------------------------------------------------


def _package(folder: str, limit: int):
    """Write the rows of a partition to packages; a row (path, records) for each. Names are unique, so that a task that
    runs again leaves no half-written package behind a listed name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        stack, package, data, lines, offset = contextlib.ExitStack(), None, None, [], 0
        path = ""

        def close() -> None:
            nonlocal package, data, lines, offset
            if package is not None:
                data.close()
                package.writestr(INDEX, "".join(lines))
                stack.close()
                done.append((path, len(lines)))
                package, data, lines, offset = None, None, [], 0

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "kind", "refers_to")]
            for (page_id, url, digest, kind, refers_to), payload in zip(zip(*cols), batch.column("html").to_pylist()):
                if package is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    package = stack.enter_context(zipfile.ZipFile(stack.enter_context(opened(path, "wb")), "w", zipfile.ZIP_STORED))
                    data = package.open(DATA, "w", force_zip64=True)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id, url, (payload or "").encode(), digest, kind, refers_to)) + squeeze.flush()
                data.write(member)
                lines.append(json.dumps([page_id, offset, len(member)]) + "\n")
                offset += len(member)
                if offset > limit:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return run


def write(pages: DataFrame, min_bytes: int = MIN_REVISIT, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record to packages in the shared folder; rows (path, records).

    Null html is an empty payload; one of any length is written whole; no rows, no packages. Line breaks in a URL are kept
    percent-encoded, as a header line has none. Other columns don't count. Of equal payloads of at least min_bytes the record with the smallest page_id is the
    response, the others revisit it; rows that repeat that smallest page_id, or have no page_id where none has, are
    responses as well. A payload that very many pages share is pre-aggregated, and its pages are joined and dealt by
    page, not by payload.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html")).withColumn("digest", F.sha2("html", 256))
    narrow = named.select("page_id", "digest", F.octet_length("html").alias("n"))
    first = narrow.filter(f"n >= {int(min_bytes)}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("same")).filter("same > 1 AND first IS NOT NULL")
    kinds = narrow.join(first, "digest").filter("NOT page_id <=> first").groupBy(F.col("page_id").alias("p"), F.col("digest").alias("g")).agg(F.min("first").alias("refers_to"))
    joined = named.join(kinds, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left")
    rows = joined.select("page_id", "url", "html", "digest", F.expr("CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END").alias("kind"), "refers_to")
    return materialize(rows.mapInArrow(_package(shared_path(spark, "warc"), limit), "path string, records long"), "packages")


def index(packages: DataFrame) -> DataFrame:
    """Rows (path, page_id, offset, length): where in its package each record is. Reads directories and indexes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path, "rb") as f:
                    package = ZipReader(f)
                    start = package.start(DATA)
                    rows = [json.loads(x) for x in package.read(INDEX).splitlines()]
                ids, offsets, lengths = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(ids, pa.int64()), pa.array([start + o for o in offsets], pa.int64()), pa.array(lengths, pa.int64())], ["path", "page_id", "offset", "length"])

    return packages.select("path").mapInArrow(run, "path string, page_id long, offset long, length long")


def read(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-read the records of index() rows: (page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]).
    A revisit's payload is null; digest and length are those of the payload it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch_of(found: list[Record]) -> pa.RecordBatch:
            cols = [[r.page_id for r in found], [r.url for r in found], [r.kind for r in found], [r.refers_to for r in found], [r.digest for r in found], [r.payload_bytes for r in found]]
            extra = [pa.array([r.payload for r in found], pa.binary())] if with_payload else []
            return pa.RecordBatch.from_arrays([*map(pa.array, cols, kinds), *extra], [*names, *["payload"][: len(extra)]])

        for batch in batches:
            todo = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
            at = 0
            while at < len(todo):
                path, begin, _ = todo[at]
                end, to = begin, at
                while to < len(todo) and todo[to][0] == path and todo[to][1] == end and (to == at or end + todo[to][2] - begin <= READ_BYTES):
                    end += todo[to][2]
                    to += 1
                with opened(path, "rb") as f:
                    f.seek(begin)
                    raw = f.read(end - begin)
                yield batch_of([parse(zlib.decompress(raw[o - begin : o - begin + n], 31)) for _, o, n in todo[at:to]])
                at = to

    fields = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    return entries.select("path", "offset", "length").mapInArrow(run, fields + ", payload binary" * with_payload)


def query(pages: DataFrame) -> DataFrame:
    """Every page's record as it is read back; nulls, repeated rows and empty tables as in write()."""
    found = read(index(write(pages)), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, url FROM pages),
d AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM f
"""
