"""WARC archives: written by tasks, read back in byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range, looks for gzip magic from its start, takes
the first candidate that decodes to a WARC header, and then follows member after member; it owns the records that start
inside its range and reads past the range's end to finish the last. Ranges need no index and no whole file in memory.

Files live where pyarrow's filesystems reach (local paths, HDFS, object stores). A writing task picks a new name for
each file, so a repeated attempt never touches what another wrote; only files listed in the manifest count.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import reachable

from .common import at_exit, load, shared_dir, slices, stored

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
RANGES_PER_TASK = 16
CHUNK = 256 << 10
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The longest gzip and WARC header a candidate may need before it counts as none.
MOST_HEAD = 1 << 20


class WarcError(ValueError):
    """The bytes are not a sound record."""


def _plain(value: str) -> str:
    """A header value on one line, in ASCII."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), value)


def record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One gzip member with a response record, or with a revisit record of the record ``refers_to``.

    ``key`` and ``refers_to`` are record names that fit a URN. A revisit holds the HTTP header only.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{key}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_plain(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    whole = "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(whole) + deflate.flush()


@dataclass
class Record:
    """A record read back; headers by lower-case name."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int


class Source:
    """A file read forward in chunks from any place."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at`` on; fewer at the end of the file."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.held, self.at = self.file.read(min(max(n, CHUNK), self.size - at)), at
        return self.held[at - self.at : at - self.at + n]


def member(source: Source, at: int, most: int | None = None) -> tuple[bytes, int | None]:
    """The decoded bytes of the gzip member at ``at`` and the place after it; with ``most``, the first bytes only and None."""
    inflate, out, size = zlib.decompressobj(31), [], 0
    while not inflate.eof:
        data = source.bytes_at(at, CHUNK // 4)
        if not data:
            raise WarcError("a gzip member has no end")
        try:
            out.append(inflate.decompress(data, 0 if most is None else max(1, most - size)))
        except zlib.error as e:
            raise WarcError(str(e)) from e
        size += len(out[-1])
        at += len(data)
        if most is not None and size >= most:
            return b"".join(out), None
    return b"".join(out), at - len(inflate.unused_data)


def is_record(source: Source, at: int) -> bool:
    """Whether a gzip member at ``at`` decodes to a WARC header."""
    try:
        head, _ = member(source, at, 4096)
    except WarcError:
        return False
    return re.match(rb"WARC/\d\.\d\r\n", head) is not None


def first_record(source: Source, start: int, end: int) -> int | None:
    """The first place in [start, end) where a record begins."""
    at = start
    while at < end:
        window = source.bytes_at(at, min(CHUNK, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        while found >= 0 and at + found < end:
            if is_record(source, at + found):
                return at + found
            window = source.bytes_at(at, min(CHUNK, end - at) + len(MAGIC) - 1)
            found = window.find(MAGIC, found + 1)
        at += CHUNK
    return None


def records(file: BinaryIO, size: int, start: int, end: int) -> Iterator[Record]:
    """The records that start in [start, end) of a file of ``size`` bytes."""
    source = Source(file, size)
    at = first_record(source, start, end)
    while at is not None and at < min(end, size):
        whole, after = member(source, at)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if rest[n:] != b"\r\n\r\n":
            raise WarcError(f"the record at {at} has another length than it says")
        yield Record(headers, rest[:n], at, after)
        at = after


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per page and returns the manifest: path, size and records of each file.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the least page_id are responses and the
    others revisits of it; a null page_id is greater than any other. Shorter ones are all responses, as are all rows
    of a group without any page_id. Null html is an empty payload. Pages are shuffled once, by digest; the side with
    the least ids is dealt anew, so that the join can split a digest that many pages share.
    """
    reachable(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("string").alias("key"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"))
    heads = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    heads = heads.where("n > 1").select("digest", "first").hint("rebalance")
    linked = rows.join(heads, "digest", "left")
    linked = linked.select("key", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        listed: list[tuple[str, int, int]] = []
        try:
            for b in slices(batches, 64):
                for key, url_, data, digest, refers in zip(*(b.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "refers_to")), strict=True):
                    if out is None:
                        path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(path, compression=None)
                    data = record(key if key is not None else "", url_, data, digest, refers)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        listed.append((path, size, n))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            listed.append((path, size, n))
        if listed:
            names = [f"{folder.rstrip('/')}/{p.rpartition('/')[2]}" for p, _, _ in listed]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([s for _, s, _ in listed], pa.int64()), pa.array([k for _, _, k in listed], pa.int64())], names=["path", "size", "records"])

    return stored(linked.mapInArrow(run, "path string, size bigint, records bigint"))


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files in ``manifest`` (path, size): record_id, record_type, refers_to, url, payload_digest
    (from the header), payload_bytes (from the HTTP header), payload (null for revisits).

    Files are cut into ranges of ``range_bytes``; each range is a row of its own and read by itself, RANGES_PER_TASK a
    task, or fewer where that leaves cores idle.
    """
    spark = reachable(manifest.sparkSession)
    total = manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    # the rows are few and light, the work behind them isn't: a number given here is not coalesced away by size
    tasks = max(-(-int(total) // RANGES_PER_TASK), min(int(total), spark.sparkContext.defaultParallelism))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.where("size > 0").select("path", "size", F.explode(starts).alias("start")).repartition(tasks)

    def text(value: str | None) -> str | None:
        return None if value is None else value.removeprefix("<urn:x-page:").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = ["record_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for r in records(file, size, start, start + range_bytes):
                        http, _, payload = r.block.partition(b"\r\n\r\n")
                        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                        kind = r.headers["warc-type"]
                        rows.append((text(r.headers["warc-record-id"]), kind, text(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri"), r.headers["warc-payload-digest"].removeprefix("sha256:"), int(said[1]), payload if kind == "response" else None))
                        held += len(payload)
                        if len(rows) >= 256 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return ranges.mapInArrow(run, "record_id string, record_type string, refers_to string, url string, payload_digest string, payload_bytes bigint, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives.

    For responses, size and digest are taken from the payload read; for revisits, from the record's headers.
    """
    pages = load(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = read_archives(archive(pages, at_exit(spark, shared_dir(spark))))
    own = F.col("payload").isNotNull()
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(
        number("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
