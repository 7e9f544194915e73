"""Ogg: a writer and a reader of physical bitstreams with several logical streams.

The reader verifies every page's checksum, reassembles packets from lacing values across pages, separates the
logical streams by serial number and derives a timestamp for every packet from granule positions: a page's
granule position belongs to the last packet that ends there, the packets before it are counted back by their
durations.

A text is stored as two interleaved streams: unsigned 8-bit PCM samples, and marks that carry the unpadded
length and, every ``MARK_EVERY`` packets, a checksum of the samples so far.

Defined results
    null or empty text: one unit of padding is stored. repeated rows and equal texts: equal bytes and features.
    null doc_id: an ordinary value. very long texts: stored whole, over as many pages as they need.
    a damaged page, a lost page or a packet cut off: ``OggError``. empty table: empty result.
    extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import workspace

UNIT = 576
RATE = 8000
PACKET = 7 * UNIT
MARK_EVERY = 8
PCM_SERIAL, MARK_SERIAL = 1, 2
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER, HEADER_SIZE = "<4sBBqIIIB", 27
MAX_SEGMENTS = 255
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bitstream is damaged."""


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (most significant bit first, no inversion), from zlib's mirrored one."""
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class _Stream:
    serial: int
    sequence: int = 0
    lacing: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False


class OggWriter:
    """Builds pages; ``put`` appends a packet to a logical stream."""

    def __init__(self):
        self.pages: list[bytes] = []
        self.streams: dict[int, _Stream] = {}

    def put(self, serial: int, packet: bytes, granule: int, flush: bool = False, last: bool = False) -> None:
        s = self.streams.setdefault(serial, _Stream(serial))
        lacing = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while lacing:
            room = MAX_SEGMENTS - len(s.lacing)
            part, lacing = lacing[:room], lacing[room:]
            n = sum(part)
            s.lacing += part
            s.body.append(packet[at : at + n])
            at += n
            if not lacing:
                s.granule = granule
            if lacing or len(s.lacing) == MAX_SEGMENTS and not last:
                self._page(s, 0)
                s.continued = bool(lacing)
        if flush or last:
            self._page(s, LAST if last else 0)

    def _page(self, s: _Stream, flags: int) -> None:
        if not s.lacing and not flags & LAST:
            return
        flags |= (CONTINUED if s.continued else 0) | (FIRST if s.sequence == 0 else 0)
        body = b"".join(s.body)
        fields = [b"OggS", 0, flags, s.granule, s.serial, s.sequence, 0, len(s.lacing)]
        tail = bytes(s.lacing) + body
        fields[6] = checksum(struct.pack(HEADER, *fields) + tail)
        self.pages.append(struct.pack(HEADER, *fields) + tail)
        s.sequence += 1
        s.lacing, s.body, s.granule, s.continued = [], [], -1, False

    def bytes(self) -> bytes:
        return b"".join(self.pages)


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: memoryview


def pages_of(data: bytes) -> Iterator[Page]:
    """All pages, each with its checksum verified."""
    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < HEADER_SIZE:
            raise OggError("cut off in a page header")
        magic, version, flags, granule, serial, sequence, crc, segments = struct.unpack_from(HEADER, data, at)
        if magic != b"OggS" or version:
            raise OggError("not a page")
        start = at + HEADER_SIZE + segments
        lacing = bytes(view[at + HEADER_SIZE : start])
        end = start + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("cut off in a page")
        if checksum(bytes(view[at : at + 22]) + b"\0\0\0\0" + bytes(view[at + 26 : end])) != crc:
            raise OggError("checksum of a page differs")
        yield Page(flags, granule, serial, sequence, lacing, view[start:end])
        at = end


@dataclass
class Packet:
    data: bytes
    page: int
    #: Granule position at the packet's end; None where the stream does not tell.
    granule: int | None = None


def packets_of(data: bytes, duration=lambda serial, packet: 0) -> dict[int, list[Packet]]:
    """The packets of every logical stream, with granule positions.

    ``duration(serial, packet)`` is a packet's length in granules, for those that end before a page's last packet.
    """
    out: dict[int, list[Packet]] = {}
    partial: dict[int, list[bytes]] = {}
    following: dict[int, int] = {}
    ended: set[int] = set()
    for number, page in enumerate(pages_of(data)):
        if page.serial not in out:
            if not page.flags & FIRST:
                raise OggError("a stream without its first page")
            out[page.serial], partial[page.serial], following[page.serial] = [], [], 0
        if page.serial in ended or page.sequence != following[page.serial]:
            raise OggError("a page is lost or out of order")
        following[page.serial] += 1
        if bool(page.flags & CONTINUED) != bool(partial[page.serial]):
            raise OggError("a packet is cut off")
        at, begin, done = 0, 0, []
        for value in page.lacing:
            at += value
            if value < 255:
                done.append(Packet(b"".join([*partial[page.serial], page.body[begin:at]]), number))
                partial[page.serial], begin = [], at
        if begin < at:
            partial[page.serial].append(bytes(page.body[begin:at]))
        end = page.granule
        if done and end < 0 or not done and end >= 0 and page.lacing:
            raise OggError("a granule position without a packet's end")
        for packet in reversed(done):
            packet.granule = end
            end -= duration(page.serial, packet.data)
        out[page.serial] += done
        if page.flags & LAST:
            ended.add(page.serial)
    if any(partial.values()):
        raise OggError("a packet is cut off")
    return out


PCM_HEADER = ">8sHHIIBBH"
MARK_HEADER = "<8sQ"
MARK = "<QI"


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def encode(raw: bytes) -> bytes:
    """A text's bytes as a physical stream: samples and marks, interleaved."""
    payload, w = padded(raw), OggWriter()
    w.put(PCM_SERIAL, struct.pack(PCM_HEADER, b"PCM     ", 0, 0, 1, RATE, 8, 1, 0), 0, flush=True)
    w.put(MARK_SERIAL, struct.pack(MARK_HEADER, b"MARKS\0\0\0", len(raw)), 0, flush=True)
    starts, crc = range(0, len(payload), PACKET), 0
    for i, at in enumerate(starts):
        packet = payload[at : at + PACKET]
        crc, end, last = zlib.crc32(packet, crc), at + len(packet), i == len(starts) - 1
        if last or i % MARK_EVERY == MARK_EVERY - 1:
            w.put(MARK_SERIAL, struct.pack(MARK, end, crc), end, flush=True, last=last)
        w.put(PCM_SERIAL, packet, end, last=last)
    return w.bytes()


@dataclass
class Decoded:
    payload: bytes
    n_bytes: int
    n_pages: int
    packets: list[Packet]
    marks: list[tuple[float, int]]


def decode(data: bytes) -> Decoded:
    """The payload back, its marks checked against it."""
    headers = (b"PCM     ", b"MARKS\0\0\0")
    streams = packets_of(data, lambda serial, p: len(p) if serial == PCM_SERIAL and p[:8] != headers[0] else 0)
    pcm, marks = streams.get(PCM_SERIAL, []), streams.get(MARK_SERIAL, [])
    if not pcm or not marks or pcm[0].data[:8] != headers[0] or marks[0].data[:8] != headers[1]:
        raise OggError("not a stream of samples and marks")
    rate = struct.unpack(PCM_HEADER, pcm[0].data)[4]
    payload = b"".join(p.data for p in pcm[1:])
    crc, done, found = 0, 0, []
    for m in marks[1:]:
        end, want = struct.unpack(MARK, m.data)
        crc, done = zlib.crc32(payload[done:end], crc), end
        if crc != want or m.granule != end:
            raise OggError("samples differ from their mark")
        found.append((m.granule / rate, want))
    if done != len(payload):
        raise OggError("samples after the last mark")
    n_pages = max(p.page for s in streams.values() for p in s) + 1
    return Decoded(payload, struct.unpack(MARK_HEADER, marks[0].data)[1], n_pages, pcm[1:], found)


def feature_of(d: Decoded) -> str:
    """Pages, packets, seconds, and mean, root mean square and level crossings of the samples."""
    x = np.frombuffer(d.payload, np.uint8)
    total, squares, crossings = int(x.sum(dtype=np.int64)), 0, 0
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20)].astype(np.int64)
        squares += int((part * part).sum())
        high = x[max(0, at - 1) : at + (1 << 20)] >= 128
        crossings += int((high[1:] != high[:-1]).sum())
    n = len(x)
    return f"pages={d.n_pages};packets={len(d.packets)};seconds={d.packets[-1].granule / RATE:.6f};mean={total / n:.6f};rms={(squares / n) ** 0.5:.6f};crossings={crossings}"


def encode_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of each row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = [encode(t.as_buffer().to_pybytes()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(write, f"doc_id {kind}, media binary")


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_features(media: DataFrame) -> DataFrame:
    """What the stored streams of (doc_id, media) hold."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def read(batches):
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                raw = cell.as_buffer().to_pybytes()
                d = decode(raw)
                rows.append((d.n_bytes, len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(d)))
            kinds = [pa.string() if "string" in f else pa.int64() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", *names])

    return media.mapInArrow(read, f"doc_id {kind}, {FEATURES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text stored as Ogg, and what is read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_features(workspace.written(encode_documents(docs), "media"))
