"""WARC records in seekable Zstandard bundles.

Each task writes its records into bundles. Records are grouped into independent Zstandard frames; a
skippable frame at the end holds the seek table of the seekable format, so a reader finds any frame
from the last bytes of a bundle. An index maps each record identifier to its bundle, its frame, and its
offset in the frame's content; so a revisit's WARC-Refers-To is found as any other record. The index is a
table that Spark commits: a bundle left by a lost task is in no index and is never read.

Bundles are written and read through ``pyarrow.fs``, by the folder's URI.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import BROADCAST_ROWS, HOT_GROUPS, new_folder, ship, written

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id string, file string, frame int, offset long, length long, page_id long, record_type string"
RECORD = (
    "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, refers_to_record string, target_uri string, payload binary"
)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame, for frames of (compressed, original) size."""
    body = b"".join(struct.pack("<II", *f) for f in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed, original) of every frame of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    entry = 12 if flags & 0x80 else 8
    file.seek(end - 9 - n * entry)
    raw, at, frames = file.read(n * entry), 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", raw, i * entry)
        frames.append((at, packed, size))
        at += packed
    return frames


def record_id(key: bytes) -> str:
    """The identifier of the record of a page with this key."""
    return f"<urn:uuid:{uuid.UUID(bytes=key, version=5)}>"


def record(page_id, url, payload: bytes, digest: str, key: bytes, refers_to, first_key: bytes | None) -> bytes:
    """One WARC record. A revisit has the payload's length and digest, but not the payload."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    kind = "revisit" if revisit else "response"
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(first_key)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, start: int) -> dict:
    """The record at an offset of a frame's content, with its digests checked."""
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != int(http["Content-Length"]):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
    refers = fields.get("Refers-To-Page-ID")
    page = fields.get("Page-ID")
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": None if page is None else int(page),
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
        "refers_to_record": fields.get("WARC-Refers-To"),
        "target_uri": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
    }


def store(folder: str):
    """File system and path of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Bundle:
    """One archive being written."""

    def __init__(self, folder: str, level: int, frame_bytes: int):
        import zstandard

        self.frame_bytes = frame_bytes

        files, path = store(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.filled = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset in its content at which the record stands."""
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.filled
        self.waiting.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        if self.waiting:
            packed = self.packer.compress(b"".join(self.waiting))
            self.out.write(packed)
            self.frames.append((len(packed), self.filled))
            self.waiting, self.filled = [], 0

    def written(self) -> int:
        return sum(size for _, size in self.frames) + self.filled

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with sha, key (both binary), and first_id, first_key: those of the page that holds their payload,
    null if it is their own.

    Payloads are compared by SHA-1. Of equal payloads of at least ``min_bytes`` bytes, the smallest page_id
    holds it; rows that repeat that very id hold it, too, and the one with the smallest key is referred to. If
    no row has an id, all do. The key names a record: it is made of page_id, url and payload, so that only rows
    equal in all three share one.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", payload.alias("payload"))
    pages = pages.withColumn("sha", F.unhex(F.sha1("payload")))
    name = F.to_json(F.struct("page_id", "url", F.hex("sha").alias("sha")), {"ignoreNullFields": "false"})
    pages = pages.withColumn("key", F.unhex(F.substring(F.sha1(name), 1, 32)))
    sizes = pages.filter(F.octet_length("payload") >= min_bytes).select("sha", "page_id", "key")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key")))
    groups = sizes.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.select("sha", F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key"), "n")
    groups = written(groups.filter("n > 1 AND first_id IS NOT NULL"), "payloads")
    n = groups.count()
    if n <= BROADCAST_ROWS:
        joined = pages.join(F.broadcast(groups), "sha", "left")
    else:
        limit = max(1000, groups.agg(F.sum("n")).first()[0] // HOT_GROUPS)
        hot = F.broadcast(groups.filter(F.col("n") > limit))
        cold = groups.filter(F.col("n") <= limit)
        rest = pages.join(hot.select("sha"), "sha", "left_anti").join(cold, "sha", "left")
        joined = pages.join(hot, "sha").unionByName(rest)
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("first_id", F.when(~own, F.col("first_id"))).drop("n")


def write_bundles(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    level: int = 3,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write one record per page (page_id, url, html) into bundles under ``folder``; return their index.

    A null html is an empty payload; a null url gets a name made from the id. Rows are not moved: a
    task's records go into its own bundles, of about ``bundle_bytes`` each. A larger record has a frame,
    and if need be a bundle, of its own. An empty table writes nothing.
    """
    ship(pages.sparkSession)
    rows = with_types(pages, min_bytes)
    kind = pa.schema(
        [
            ("record_id", pa.string()),
            ("file", pa.string()),
            ("frame", pa.int32()),
            ("offset", pa.int64()),
            ("length", pa.int64()),
            ("page_id", pa.int64()),
            ("record_type", pa.string()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = None, []
        names = ("page_id", "url", "payload", "sha", "key", "first_id", "first_key")
        for batch in batches:
            cells = (batch.column(c) for c in names)
            for page_id, url, payload, sha, key, first_id, first_key in zip(*cells):
                if bundle is None:
                    bundle = Bundle(folder, level, frame_bytes)
                page, payload = page_id.as_py(), payload.as_py()
                digest = base64.b32encode(sha.as_py()).decode()
                first, key = first_id.as_py(), key.as_py()
                data = record(page, url.as_py(), payload, digest, key, first, first_key.as_py())
                frame, offset = bundle.add(data)
                what = "response" if first is None else "revisit"
                index.append((record_id(key), bundle.name, frame, offset, len(data), page, what))
                if bundle.written() >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kind.types)], schema=kind)
                index = []
        if bundle is not None:
            bundle.close()

    return written(rows.mapInArrow(pack, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of an index, or of any part of it, each found through its bundle's seek table.

    Only frames that hold a wanted record are read and unpacked, each once.
    """
    ship(index.sparkSession)
    frames = index.groupBy("file", "frame").agg(F.collect_list("offset").alias("offsets"))
    kind = pa.schema(
        [
            ("record_id", pa.string()),
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("refers_to_record", pa.string()),
            ("target_uri", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, path = store(folder)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            wanted: dict[str, list[tuple[int, list[int]]]] = {}
            for row in batch.to_pylist():
                wanted.setdefault(row["file"], []).append((row["frame"], row["offsets"]))
            for name, some in sorted(wanted.items()):
                with files.open_input_file(f"{path}/{name}") as file:
                    table = read_seek_table(file)
                    for frame, offsets in sorted(some):
                        start, packed, size = table[frame]
                        file.seek(start)
                        data = unpacker.decompress(file.read(packed), max_output_size=size)
                        rows = [parse(data, o) for o in sorted(offsets)]
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return frames.mapInArrow(unpack, RECORD)


def find_records(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose identifiers stand in column record_id of ``wanted``.

    Repeated and null identifiers, and those that no record has, add nothing. Pages equal in id, url and
    payload share an identifier, and all of their records are found.
    """
    return read_records(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi"), folder)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the bundles back, and return a row per record without its payload."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = write_bundles(pages, folder)
    return read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha, min(page_id) OVER (PARTITION BY sha) AS first_id,
         CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS bits
  FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
         + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q
"""
