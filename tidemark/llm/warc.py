"""WARC archives: a writer, and a reader that salvages damaged files.

The writer makes one gzip member per record. Of records with equal payloads of at
least ``MIN_REVISIT`` bytes the one with the least key is a ``response``, the others are
``revisit`` records that name it. Tasks write their own files of bounded size under names
that no other attempt of a task uses, and return them as rows; only files in that list count,
so lost or repeated attempts leave nothing to read.

The reader checks each record (gzip checksum, version line, headers, length, end
mark, block and payload digests). After a failed check it searches for the next gzip member or version
line that passes them all, goes on from there, and returns the bytes in
between as a ``gap`` with the reason. It reads through a window, and a length is believed only
if the end mark is where it says, so memory is bounded by the largest record or gzip member.

Cases. A null body is an empty payload; a null address has no header. A null key is
written as such and is a revisit if an equal payload has a key. Rows that
share key and payload are alike: all responses or all revisits. Control characters
and blanks of an address are percent-encoded. Other columns are ignored.
A whole valid record inside the damaged part of a payload is read as a record.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, shuffle_parts
from tidemark.sources.scratch import scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WINDOW = 1 << 20
#: A header line whose name does not end within so many bytes is none.
_NAME = 1 << 16
_VERSIONS = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_DATE = "2000-01-01T00:00:00Z"


# Records.


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key} {digest}')}>"


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")


def record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """An uncompressed record; ``key`` and ``refers_to`` are JSON values."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("X-Key", key), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Key", refers_to)]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + _headers(fields) + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damage(Exception):
    """A check of a record failed."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    #: Place in the file: of the record, or of the gzip member it is in.
    start: int = 0
    stop: int = 0


@dataclass
class Gap:
    start: int
    stop: int
    reason: str


def _fields(head: bytes) -> dict[str, str]:
    """Headers below the version line, and a length among them."""
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damage("header without a colon")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise Damage("no length")
    return headers


def _checked(headers: dict[str, str], block: bytes) -> Record:
    def digest(name: str, of: bytes) -> None:
        how, _, want = headers.get(name, "").partition(":")
        if how == "sha256" and hashlib.sha256(of).hexdigest() != want:
            raise Damage(f"{name} differs")

    digest("warc-block-digest", block)
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        if head < 0:
            raise Damage("no end of HTTP headers")
        payload = block[head + 4 :]
    if headers.get("warc-type") != "revisit":
        digest("warc-payload-digest", payload)
    return Record(headers, payload)


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; all checks pass."""
    return _plain(lambda place, n: data[place : place + n], at, len(data))


# Reading.


def _plain(read: Callable[[int, int], bytes], at: int, size: int) -> tuple[Record, int]:
    """As :func:`parse`. The end mark is looked at before the block, so a damaged length reads nothing."""
    n = _WINDOW
    while True:
        data = read(at, n)
        whole = at + len(data) >= size
        if not _VERSIONS.match(data):
            raise Damage("no version line")
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            break
        # Only what can still be headers is read on.
        *lines, last = data.split(b"\r\n")[1:]
        if not all(b":" in x for x in lines) or (len(last) > _NAME and b":" not in last):
            raise Damage("header without a colon")
        if whole:
            raise Damage("headers do not end")
        n *= 2
    headers = _fields(data[:end])
    start, stop = at + end + 4, at + end + 4 + int(headers["content-length"])
    if size < stop + 4:
        raise Damage("record is cut off")
    if read(stop, 4) != b"\r\n\r\n":
        raise Damage("no end mark")
    return _checked(headers, read(start, stop - start)), stop + 4


def _inflated(read: Callable[[int, int], bytes], at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and where it ends. It is inflated on only if it begins like a record."""
    z, out, place, seen = zlib.decompressobj(31), [], at, b""
    while not z.eof:
        chunk = read(place, _WINDOW)
        if not chunk:
            raise Damage("member is cut off")
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            raise Damage(f"gzip: {e}") from None
        place += len(chunk)
        if len(seen) < len(VERSION):
            seen = b"".join(out)[: len(VERSION)]
            if len(seen) == len(VERSION) and not _VERSIONS.match(seen):
                raise Damage("no version line")
    return b"".join(out), place - len(z.unused_data)


def _search(read: Callable[[int, int], bytes], at: int, size: int) -> int:
    """The next place from ``at`` on where a whole valid record begins, or the end."""
    while at < size:
        data = read(at, _WINDOW)
        for m in re.finditer(re.escape(_MEMBER) + rb"|WARC/1\.[01]\r\n", data):
            place = at + m.start()
            try:
                if m[0] == _MEMBER:
                    whole, _ = _inflated(read, place)
                    parse(whole, 0)
                else:
                    _plain(read, place, size)
                return place
            except Damage:
                continue
        if at + len(data) >= size:
            return size
        at += max(1, len(data) - 10)
    return size


def salvage(read: Callable[[int, int], bytes], size: int) -> Iterator[Record | Gap]:
    """Records in file order, and a gap for each run of bytes that holds none.

    ``read(at, n)`` gives up to n bytes. Members and plain records may mix.
    """
    at = 0
    while at < size:
        start = at
        try:
            if read(at, 3) == _MEMBER:
                whole, stop = _inflated(read, at)
                place = 0
                while place < len(whole):
                    try:
                        found, place = parse(whole, place)
                    except Damage as e:
                        if not place:
                            raise
                        inside = _search(lambda a, n, w=whole: w[a : a + n], place + 1, len(whole))
                        yield Gap(at, stop, f"{e}, from byte {place} to {inside} of the member")
                        place = inside
                        continue
                    found.start, found.stop = at, stop
                    yield found
                at = stop
            else:
                found, at = _plain(read, at, size)
                found.start, found.stop = start, at
                yield found
        except Damage as e:
            at = _search(read, start + 1, size)
            yield Gap(start, at, str(e))


# Spark.


def _written(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}" if task else "part"
        out, done, n, size, path = None, [], 0, 0, ""

        def close() -> None:
            out.close()
            done.append((path, n, size))

        for b in batches:
            for key, url, body, digest, refers_to in zip(*b.columns, strict=True):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        close()
                    path, n, size = posixpath.join(root, f"{name}-{len(done):04d}.warc.gz"), 0, 0
                    out = files.open_output_stream(path, compression=None)
                refers = refers_to.as_py()
                data = _member(record(key.as_py(), url.as_py(), body.as_py() or b"", digest.as_py(), refers))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            close()
            paths, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html",
    min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages`` under ``folder`` (a URI that all executors reach); the files' (path, records, bytes)."""
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    first = (
        pages.select(F.col(key).alias("key"), payload.alias("body")).where(F.octet_length("body") >= min_revisit)
        .groupBy(F.sha2("body", 256).alias("f_digest")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where("n > 1").drop("n")
    )
    first = materialize(first, "first-copies")  # a join of two plain exchanges is one that adaptive execution can split
    as_json = lambda c: F.get(F.split(F.to_json(F.array(c)), r"^\[|\]$"), F.lit(1))
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    marked = rows.join(first, F.col("digest") == F.col("f_digest"), "left").select(
        as_json("key").alias("key"), "url", "body", "digest", F.when(again, as_json("first")).alias("refers_to")
    )
    return materialize(marked.mapInArrow(_written(folder, archive_bytes), "path string, records long, bytes long"), "archives")


def _loaded(folder: str, with_payload: bool):
    schema = pa.schema([
        ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("key", pa.string()),
        ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return path, x.start, x.stop, "gap", x.reason, None, None, None, None, None, None
        h = x.headers
        value = lambda name: None if name not in h else v if isinstance(v := json.loads(h[name]), str | None) else h[name]
        kind = h.get("warc-type")
        digest = h.get("warc-payload-digest", "").partition(":")[2] or hashlib.sha256(x.payload).hexdigest()
        size = int(h.get("x-payload-length", 0)) if kind == "revisit" else len(x.payload)
        return path, x.start, x.stop, kind, None, value("x-key"), h.get("warc-target-uri"), value("x-refers-to-key"), digest, size, x.payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    rows, held, window = [], 0, [0, b""]

                    def read(at: int, n: int, f=f, window=window) -> bytes:
                        if not window[0] <= at <= at + n <= window[0] + len(window[1]):
                            window[:] = at, f.read_at(max(n, 4 * _WINDOW), at)
                        return window[1][at - window[0] : at - window[0] + n]

                    for x in salvage(read, f.size()):
                        rows.append(row(path, x))
                        held += len(x.payload) if with_payload and isinstance(x, Record) else 0
                        if len(rows) >= 2000 or held > _WINDOW * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files in ``archives`` (a column ``path``) of the file system of ``folder``."""
    spread = archives.select("path").repartition(shuffle_parts(archives.sparkSession))
    return spread.mapInArrow(
        _loaded(folder, with_payload),
        "path string, start long, stop long, kind string, reason string, key string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary",
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back: a row for each page."""
    folder = scratch_path(pages.sparkSession, "warc")
    kind = pages.schema[key].dataType
    back = read_archives(write_archives(pages, folder, key, url, body), folder, with_payload=False)
    return back.where(F.col("kind").isin("response", "revisit")).select(
        F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
    )
