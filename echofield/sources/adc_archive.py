"""Self-describing archives of ADC frames: header, JSON contract, compressed frames, index, footer.

``spark.read.format("adc_archive")`` reads frames by index slices. Writing reads the source once, publishes by a
link that never replaces a file, and reopens what it wrote.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
import zlib
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..plans.contracts import RadarCapture, require
from .adc_files import FRAME_SCHEMA, FrameRange, frame_batch, split_frames
from .codecs import inflate, shuffle, unshuffle
from .files import read_range, regular_size, strict_json

# Fixed values of the format.
MAGIC, COMMIT_MAGIC, VERSION = b"MMWADCA2", b"MMWACMT2", 2
HEADER, HEADER_BYTES = "<8sIIQQQQIIII32s", 96
RECORD, RECORD_BYTES = "<QQ32s", 48
FOOTER, FOOTER_BYTES = "<8sIIQQ32s32s32s32s", 160
CODEC, METADATA_FORMAT, LEVEL = 1, 1, 1
MOST_METADATA, MOST_FRAME = 1 << 20, 64 << 20


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def metadata_of(capture: RadarCapture, frames: int, schema: str) -> bytes:
    record = replace(capture, num_frames=frames).to_record() | {"schema": schema}
    return json.dumps(record, sort_keys=True, separators=(",", ":")).encode()


def write_archive(source: str, destination: str, capture: RadarCapture, schema: str = "radar_capture.v1", expected_sha256: str | None = None) -> Archive:
    """Archive a headerless ADC file; an existing destination is never replaced."""
    frame_bytes, size = 2 * capture.adc.words, regular_size(source)
    require(size > 0 and size % frame_bytes == 0, "the source does not hold whole frames")
    require(frame_bytes <= MOST_FRAME, "frames are too long")
    frames = size // frame_bytes
    require(capture.num_frames in (None, frames), "the source contradicts the contract")
    meta = metadata_of(capture, frames, schema)
    head = struct.pack(HEADER, MAGIC, VERSION, HEADER_BYTES, HEADER_BYTES + len(meta), len(meta), frame_bytes, frames, RECORD_BYTES, CODEC, METADATA_FORMAT, 0, sha(meta)) + meta
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(destination)))
    try:
        whole, index, at = hashlib.sha256(), [], len(head)
        with os.fdopen(handle, "wb") as out:
            out.write(head)
            for i in range(frames):
                raw = read_range(source, i * frame_bytes, frame_bytes)
                whole.update(raw)
                stored = zlib.compress(shuffle(raw), LEVEL)
                out.write(stored)
                index.append(struct.pack(RECORD, at, len(stored), sha(raw)))
                at += len(stored)
            table = b"".join(index)
            body = struct.pack("<8sIIQQ32s32s32s", COMMIT_MAGIC, VERSION, FOOTER_BYTES, at, len(table), sha(head), sha(table), whole.digest())
            out.write(table + body + sha(body))
            out.flush()
            os.fsync(out.fileno())
        require(expected_sha256 is None or whole.hexdigest() == expected_sha256, "the source has another digest")
        Archive(name)
        os.link(name, destination)  # fails if the destination exists
    finally:
        os.unlink(name)
    return Archive(destination)


class Archive:
    """An opened archive: structure and all digests but those of the frames are verified."""

    def __init__(self, path: str):
        self.path, size = path, regular_size(path)
        require(size >= HEADER_BYTES + FOOTER_BYTES, "too short for an archive")
        fixed = read_range(path, 0, HEADER_BYTES)
        magic, version, fixed_bytes, header_bytes, meta_bytes, self.frame_bytes, self.frame_count, record, codec, kind, flags, meta_sha = struct.unpack(HEADER, fixed)
        require((magic, version, fixed_bytes, record, codec, kind, flags) == (MAGIC, VERSION, HEADER_BYTES, RECORD_BYTES, CODEC, METADATA_FORMAT, 0), "unknown header")
        require(header_bytes == HEADER_BYTES + meta_bytes and 1 <= meta_bytes <= MOST_METADATA, "bad metadata size")
        require(0 < self.frame_bytes <= MOST_FRAME and self.frame_bytes % 2 == 0 and self.frame_count > 0, "bad frame size or count")
        foot = read_range(path, size - FOOTER_BYTES, FOOTER_BYTES)
        magic, version, foot_bytes, index_at, index_bytes, head_sha, index_sha, self.adc_sha, foot_sha = struct.unpack(FOOTER, foot)
        require((magic, version, foot_bytes) == (COMMIT_MAGIC, VERSION, FOOTER_BYTES) and sha(foot[:128]) == foot_sha, "unknown or damaged footer")
        require(index_bytes == self.frame_count * RECORD_BYTES and index_at + index_bytes == size - FOOTER_BYTES, "the index is displaced")
        require(header_bytes <= index_at, "the header is too long")
        meta = read_range(path, HEADER_BYTES, meta_bytes)
        require(sha(meta) == meta_sha and sha(fixed + meta) == head_sha, "the header is damaged")
        table = read_range(path, index_at, index_bytes)
        require(sha(table) == index_sha, "the index is damaged")
        self.index = [struct.unpack_from(RECORD, table, i * RECORD_BYTES) for i in range(self.frame_count)]
        at, most = header_bytes, self.frame_bytes + self.frame_bytes // 16 + 1024
        for offset, stored, _ in self.index:
            require(offset == at and 0 < stored <= most, "frames are not contiguous")
            at += stored
        require(at == index_at, "frames do not fill the archive")
        record = strict_json(meta)
        record.pop("schema")
        self.capture = RadarCapture.from_record(record)
        require(2 * self.capture.adc.words == self.frame_bytes and self.capture.num_frames == self.frame_count, "metadata contradicts the header")
        self.verified, self.identity = False, (size, os.stat(path).st_mtime_ns if os.path.exists(path) else None)

    def frame(self, i: int, verify: bool = True) -> bytes:
        require(verify or self.verified, "unverified reads need verify_all first")
        offset, stored, digest = self.index[i]
        raw = unshuffle(inflate(read_range(self.path, offset, stored), self.frame_bytes))
        require(not verify or sha(raw) == digest, f"frame {i} is damaged")
        return raw

    def read_frames(self, start: int, stop: int, verify: bool = True) -> bytes:
        require(0 <= start < stop <= self.frame_count, "no such frames")
        return b"".join(self.frame(i, verify) for i in range(start, stop))

    def verify_all(self) -> None:
        """Check every frame and the digest of all of them; unverified reads are allowed from then on."""
        whole = hashlib.sha256()
        for i in range(self.frame_count):
            whole.update(self.frame(i))
        require(whole.digest() == self.adc_sha, "the frames have another digest")
        self.verified = True

    def revalidate(self) -> None:
        again = Archive(self.path)
        require(again.identity == self.identity and again.index == self.index, "the archive has changed")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bounds = options["path"], FrameRange()
        archive = Archive(self.path)
        self.total, self.frame_bytes, self.period = archive.frame_count, archive.frame_bytes, archive.capture.frame_periodicity_s

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.narrow(f):
                yield f

    def partitions(self):
        return split_frames(self.bounds, self.total, self.frame_bytes)

    def read(self, partition):
        archive = Archive(self.path)
        for i in range(partition.first, partition.stop):
            yield frame_batch(self.path, i, self.period, np.frombuffer(archive.frame(i), "<i2"))


class ArchiveSource(DataSource):
    """Format ``adc_archive``: option path; every frame read is verified."""

    @classmethod
    def name(cls):
        return "adc_archive"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return ArchiveReader(dict(self.options))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("adc_archive").load(path)
