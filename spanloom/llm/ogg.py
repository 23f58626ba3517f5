"""Media columns: sample streams in Ogg files, written and read page by page.

Writer: 8-bit PCM samples behind an OggPCM header, interleaved with a second logical stream (a Skeleton head). Reader:
page checksums are verified, packets reassembled from lacing values over page bounds, logical streams told apart by
serial number, and times derived from granule positions and the sample rate in the header.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, with_columns_from

CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
PCM_SERIAL, HEAD_SERIAL = 1, 2
PCM_MAGIC, HEAD_MAGIC = b"PCM     ", b"fishead\0"
UNSIGNED_8 = 1
RATE = 8000
PACKET = 8192
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The Ogg checksum (polynomial 0x04c11db7, most significant bit first, from zero) of a page with its field zeroed.

    zlib's CRC is the same division with bits mirrored, so it runs over mirrored bytes and the result is mirrored back.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    """One page; ``lacing`` holds its segment lengths."""
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]], number: int = 0, flags: int = 0, last: bool = True) -> list[bytes]:
    """Pages for (packet, granule at its end) pairs: full pages of 255 segments, packets continued from page to page."""
    lacing, ends = bytearray(), []
    for data, granule in packets:
        lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        ends.append((len(lacing), granule))
    body = b"".join(p for p, _ in packets)
    out, at, done = [], 0, 0
    for s in range(0, len(lacing), 255):
        part = bytes(lacing[s : s + 255])
        continued = CONTINUED if s and lacing[s - 1] == 255 else 0
        granule = NO_GRANULE
        while done < len(ends) and ends[done][0] <= s + len(part):
            granule, done = ends[done][1], done + 1
        end = LAST if last and s + 255 >= len(lacing) else 0
        size = sum(part)
        out.append(page(serial, number + len(out), flags | continued | end, granule, part, body[at : at + size]))
        flags, at = 0, at + size
    return out


def write_pcm(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file with the payload as unsigned 8-bit mono samples, one sample a byte."""
    head = PCM_MAGIC + struct.pack(">HHIIBBH", 0, 0, UNSIGNED_8, rate, 8, 1, 0) + struct.pack(">I", 0)
    skeleton = HEAD_MAGIC + struct.pack("<HHqqqq", 3, 0, 0, 1000, 0, 1000) + b"\0" * 20
    data = [(payload[k : k + packet], min(k + packet, len(payload))) for k in range(0, len(payload), packet)]
    first = pages_of(HEAD_SERIAL, [(skeleton, 0)], 0, FIRST, last=False) + pages_of(PCM_SERIAL, [(head, 0)], 0, FIRST, last=False)
    rest = pages_of(HEAD_SERIAL, [(b"", 0)], 1) + pages_of(PCM_SERIAL, data, 1)
    return b"".join(first + rest)


class OggError(ValueError):
    """The bytes are not a sound Ogg file."""


@dataclass
class Stream:
    """One logical stream: whole packets, the granule position and file offset of each page, whether it ended."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises OggError on a bad page, checksum, order or packet."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise OggError(f"no page at {at}")
        _, _, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if end > len(data) or len(lacing) != count:
            raise OggError(f"page at {at} is cut off")
        if page_crc(bytes(view[at : at + 22]) + b"\0\0\0\0" + bytes(view[at + 26 : end])) != crc:
            raise OggError(f"bad checksum at {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if s.ended or number != s.pages or bool(flags & CONTINUED) != bool(s.open):
            raise OggError(f"page {number} of stream {serial} is out of order")
        place, begin = at + 27 + count, at + 27 + count
        for n in lacing:
            place += n
            if n < 255:
                s.packets.append(b"".join([*s.open, view[begin:place]]))
                s.open, begin = [], place
        if begin < place:
            s.open.append(bytes(view[begin:place]))
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        if granule != NO_GRANULE:
            s.granules.append(granule)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


@dataclass
class Sound:
    """Samples read back, with the rate and the end time in seconds of each page on which a packet ends."""

    samples: bytes
    rate: int
    times: list[float]
    streams: int
    pages: int


def read_pcm(data: bytes) -> Sound:
    """The PCM stream of an Ogg file. The granule positions must agree with the samples."""
    streams = read(data)
    found = [s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC)]
    if len(found) != 1:
        raise OggError(f"{len(found)} PCM streams")
    kind, rate, _, channels = struct.unpack_from(">IIBB", found[0].packets[0], 12)
    if kind != UNSIGNED_8 or channels != 1:
        raise OggError(f"format {kind} with {channels} channels")
    samples = b"".join(found[0].packets[1:])
    if found[0].granules[-1] != len(samples):
        raise OggError("granule position and samples differ")
    return Sound(samples, rate, [g / rate for g in found[0].granules[1:]], len(streams), sum(s.pages for s in streams.values()))


def encode_column(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """df with binary column ``media``, an Ogg file of the binary column ``payload``. Null stays null; no bytes give a stream without samples."""

    def make():
        return lambda values: [[None if v is None else write_pcm(v) for v in values]]

    return with_columns_from(df, [payload], T.StructType([T.StructField(media, T.BinaryType())]), make, rows=64)


#: What decode_column adds. error: why the file could not be read; the others are null then.
DECODED = T.StructType(
    [T.StructField(n, k) for n, k in (("samples", T.BinaryType()), ("rate", T.IntegerType()), ("times", T.ArrayType(T.DoubleType())), ("n_streams", T.IntegerType()), ("n_pages", T.IntegerType()), ("error", T.StringType()))]
)


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the columns DECODED, read from Ogg files. A null file gives nulls; a bad one gives nulls and its error."""

    def make():
        def work(values):
            out = []
            for v in values:
                try:
                    s = None if v is None else read_pcm(v)
                    out.append((None,) * 6 if s is None else (s.samples, s.rate, s.times, s.streams, s.pages, None))
                except (OggError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, None, str(e) or "unreadable"))
            return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in DECODED]

        return work

    return with_columns_from(df, [media], DECODED, make, rows=64)


def features(df: DataFrame, samples: str = "samples", times: str = "times", tail: int = 64) -> DataFrame:
    """df with payload_bytes, payload_sha256, tail_crc32 (of the last ``tail`` samples) and feature (levels and timing) of decoded samples; null samples give nulls."""

    def one(v: bytes | None, t: list[float] | None):
        if v is None:
            return (None,) * 4
        x = np.frombuffer(v, np.uint8)
        level = (float(x.mean()), float(x.std()), int(np.count_nonzero(np.diff(x > 128)))) if len(x) else (0.0, 0.0, 0)
        said = f"seconds={t[-1] if t else 0.0:.6f};pages={len(t or [])};mean={level[0]:.4f};std={level[1]:.4f};crossings={level[2]}"
        return len(v), hashlib.sha256(v).hexdigest(), zlib.crc32(v[-tail:]), said

    def make():
        def work(values, at):
            out = [one(v, t) for v, t in zip(values, at, strict=True)]
            return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(4)]

        return work

    fields = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])
    return with_columns_from(df, [samples, times], fields, make, rows=64)


def padded(text: str, multiple: int = 64):
    """UTF-8 bytes of a text column (null: none), then zero bytes up to a positive multiple."""
    data = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(data)
    full = F.greatest(F.lit(multiple), F.ceil(size / multiple) * multiple)
    return F.concat(data.cast("binary"), F.repeat(F.lit("\0"), (full - size).cast("int")).cast("binary"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sound: written to Ogg, read back, described.

    Null and empty texts are 64 zero bytes, n_bytes 0. Each row is a file, however often it recurs; equal texts have equal
    files, since serial numbers don't depend on the row. A table without rows gives none. A file that doesn't read back
    would have nulls in what is read from it; none does (tests).
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded("text").alias("payload"))
    media = encode_column(docs, "payload").select("doc_id", "n_bytes", "media")
    media = media.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return features(decode_column(media).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "samples", "times")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


