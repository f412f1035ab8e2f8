"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a
skippable frame at its end, the seek table, with the sizes of all frames.  An index maps every
record to its frame and to its place inside the frame, so one record costs one frame.

Records are dealt to bundles by the digest of their payload and a salt, so copies of one payload
are spread however many there are.  Tasks write the bundles themselves, under names of their own;
the index, which Spark commits, names the bundles of the attempts that ended well.  What a lost
attempt left behind is in no index and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ship
from quire.session import checkpoint_root

#: Skippable frame of the seek table and the end of its footer (fixed values of the format).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Parts that the copies of one payload are dealt in.
SALTS = 1024
#: Bytes of records in a frame, and of frames in a bundle, at which the next one is begun.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Compressed bytes that a reading task is given.
READ_BYTES = 8 << 20

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "record_id string, page_id long, record_type string, refers_to string, bundle string, frame_at long, "
    "frame_bytes long, offset long, length long"
)
FRAMES = "bundle string, frame_at long, frame_bytes long"
RECORDS = (
    "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


# --- records and frames


def record_id(page_id: int | None, place: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{place}"


def page_of(record: str) -> int | None:
    number = record.split(":")[2]
    return int(number) if number else None


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(ident: str, url: str | None, payload: bytes, sha1: bytes, size: int, refers_to: str | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` it is a revisit and holds no payload.

    Of a URL, all but printable ASCII is percent-encoded, and ``%`` too; one that is null has no line.
    """
    body = HTTP if refers_to is not None else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ident}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}"]),
        f"WARC-Payload-Digest: sha1:{digest32(sha1)}",
        f"X-Payload-Length: {size}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return b"".join([("\r\n".join(lines) + "\r\n\r\n").encode(), body, b"\r\n\r\n"])


_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def parsed(data: bytes, at: int = 0) -> Iterator[dict]:
    """The records of a frame from a place on; a damaged one is an error."""
    while at < len(data):
        head = _HEAD.match(data, at)
        if head is None:
            raise ValueError(f"no WARC record at byte {at} of the frame")
        fields = dict(line.split(": ", 1) for line in head[1].decode().split("\r\n") if line)
        end = head.end() + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} of the frame does not end where it says")
        ident, kind = fields["WARC-Record-ID"][1:-1], fields["WARC-Type"]
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        refers = fields.get("WARC-Refers-To")
        payload = None
        if kind == "response":
            payload = data[data.index(b"\r\n\r\n", head.end()) + 4 : end]
            if len(payload) != size or digest32(hashlib.sha1(payload, usedforsecurity=False).digest()) != digest:
                raise ValueError(f"the payload of {ident} is not the one that was written")
        url = fields.get("WARC-Target-URI")
        yield {
            "record_id": ident, "page_id": page_of(ident), "url": None if url is None else unquote(url), "payload": payload,
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": None if refers is None else page_of(refers[1:-1]),
        }
        at = end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the compressed and plain size of every frame."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frames_of(file) -> list[tuple[int, int, int]]:
    """Place, compressed and plain size of every frame, from the table at the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the file does not end with a seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    entries, at, out = file.read(n * width), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


class Bundles:
    """Bundles of one task: records go in, index rows come out when their frame is written."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int) -> None:
        self.system, self.folder = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.file, self.name, self.sizes, self.written = None, "", [], 0
        self.held, self.places = io.BytesIO(), []

    def add(self, ident: str, page_id: int | None, refers_to: str | None, data: bytes) -> list[tuple]:
        kind = "response" if refers_to is None else "revisit"
        self.places.append((ident, page_id, kind, refers_to, self.held.tell(), len(data)))
        self.held.write(data)
        return self.frame() if self.held.tell() >= self.frame_bytes else []

    def frame(self) -> list[tuple]:
        if not self.places:
            return []
        if self.file is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            # the frames are packed here: without None the name would pack the stream once more
            self.file = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.sizes, self.written = [], 0
        plain = self.held.getvalue()
        packed = self.packer.compress(plain)
        self.file.write(packed)
        rows = [(*known, self.name, self.written, len(packed), at, n) for *known, at, n in self.places]
        self.sizes.append((len(packed), len(plain)))
        self.written += len(packed)
        self.held, self.places = io.BytesIO(), []
        if self.written >= self.bundle_bytes:
            self.end()
        return rows

    def end(self) -> None:
        if self.file is not None:
            self.file.write(seek_table(self.sizes))
            self.file.close()
            self.file = None


# --- on Spark


@dataclass(frozen=True)
class Archive:
    """``folder`` holds the bundles and, below ``index``, the index as Parquet."""

    spark: SparkSession
    folder: str

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that names its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def landed(pages: DataFrame, ident: Column, url: Column, payload: Column, least_bytes: int) -> DataFrame:
    """Each row with the row that holds its payload: ``first`` is null for responses.

    Of equal payloads of ``least_bytes`` or more the row with the largest id (null is the least)
    is the response; of rows with one id it is the last in the table.
    """
    rows = pages.select(
        ident.cast("long").alias("page_id"), url.cast("string").alias("url"),
        F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("place"),
    )
    salt = F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "salt": salt})
    # two steps: a payload that half the rows have is a row for each salt, never a group
    parts = rows.groupBy("sha1", "salt").agg(F.max(F.struct("page_id", "place")).alias("top"))
    tops = parts.groupBy("sha1").agg(F.max("top").alias("first"))
    named = parts.select("sha1", "salt").join(tops, "sha1")
    size = F.octet_length("payload").cast("long")
    same = (F.col("first.place") == F.col("place")) | (size < least_bytes)
    return rows.join(named, ["sha1", "salt"]).select(
        "page_id", "place", "url", "sha1", size.alias("size"),
        F.when(~same, F.col("first")).alias("first"), F.when(same, F.col("payload")).alias("payload"),
    )


def write(
    pages: DataFrame, ident: Column, url: Column, payload: Column, folder: str | None = None, *, least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3,
) -> Archive:
    """Write a record for every row of ``pages``; the archive is below ``folder``, else below the
    session's shared folder.

    A payload that is null is empty.  Rows that repeat in all columns are records of their own, a
    table without rows gives an archive without bundles, other columns are not looked at, and a
    payload of any length is in one frame.  ``pages`` is read twice and must give its rows in the
    same order, as a stored table does: a revisit whose response was not written is an error.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or f"{checkpoint_root(spark)}/quire/warc-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own = arrow_schema(INDEX), Bundles(folder, frame_bytes, bundle_bytes, level)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                first = r["first"]
                refers = None if first is None else record_id(first["page_id"], first["place"])
                name = record_id(r["page_id"], r["place"])
                data = record(name, r["url"], r["payload"] or b"", r["sha1"], r["size"], refers, date)
                if rows := own.add(name, r["page_id"], refers, data):
                    yield out(rows)
        if rows := own.frame():
            yield out(rows)
        own.end()

    ship(spark)
    landed(pages, ident, url, payload, least_bytes).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    archive = Archive(spark, folder)
    asked = archive.index.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    lost = asked.join(archive.index.where("record_type = 'response'"), "record_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("the rows came in another order the second time: store them before writing an archive")
    return archive


def frames(archive: Archive) -> DataFrame:
    """Every frame of the archive, from the seek tables of its bundles."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        schema = arrow_schema(FRAMES)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with system.open_input_file(f"{base}/{name}") as file:
                    found = frames_of(file)
                rows = [[name] * len(found), [f[0] for f in found], [f[1] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    ship(archive.spark)
    return archive.index.select("bundle").distinct().mapInArrow(run, FRAMES)


def spread(archive: Archive, rows: DataFrame, size: str) -> DataFrame:
    """Rows dealt so that a task reads about ``READ_BYTES`` of frames."""
    total = rows.agg(F.sum(size)).head()[0] or 0
    parts = max(archive.spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return rows.repartition(int(parts), "bundle", "frame_at")


def read(archive: Archive, payloads: bool = True) -> DataFrame:
    """All records of the archive, from its bundles; every payload is checked against its digest.

    ``refers_to`` is the page whose response a revisit names.  Without ``payloads`` they are read
    and checked, but null in the result, as those of revisits are.
    """
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), unpack = pafs.FileSystem.from_uri(folder), zstandard.ZstdDecompressor()
        schema = arrow_schema(RECORDS)
        for batch in batches:
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{base}/{name}") as file:
                    file.seek(at)
                    plain = unpack.decompress(file.read(n))
                rows = list(parsed(plain))
                if not payloads:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spread(archive, frames(archive), "frame_bytes").mapInArrow(run, RECORDS)


def lookup(archive: Archive, wanted: DataFrame, column: str = "page_id") -> DataFrame:
    """The records of the pages asked for (a column of ids), read by way of the index: only their
    frames are fetched.  Ids that repeat are asked for once, null asks for pages without an id."""
    folder = archive.folder
    asked = wanted.select(F.col(column).cast("long").alias("page_id")).distinct().alias("a")
    index = archive.index.alias("i")
    places = index.join(asked, F.col("i.page_id").eqNullSafe(F.col("a.page_id")), "left_semi").select(
        "bundle", "frame_at", "frame_bytes", "offset", "length"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), unpack = pafs.FileSystem.from_uri(folder), zstandard.ZstdDecompressor()
        schema, held, plain = arrow_schema(RECORDS), None, b""
        for batch in batches:
            for name, at, n, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (name, at):
                    with system.open_input_file(f"{base}/{name}") as file:
                        file.seek(at)
                        plain, held = unpack.decompress(file.read(n)), (name, at)
                yield pa.RecordBatch.from_pylist(list(parsed(plain[offset : offset + length])), schema)

    ship(archive.spark)
    return spread(archive, places, "length").sortWithinPartitions("bundle", "frame_at").mapInArrow(run, RECORDS)
