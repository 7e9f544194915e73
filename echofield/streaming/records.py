"""Framed record streams: strict readers, a streaming source, and commit evidence as queries.

A record is a fixed header (magic, version, kind, sequence, counters, sizes, SHA-256 over domain, header prefix and
payload) and its payload. Streams are finite and strictly ordered; any contradiction poisons the stream. Items
are provisional until a COMMIT covers them.

Magic, digest domain and schema names belong to the producer, so they are parameters of ``StreamFormat``.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.adc import words_from_bytes
from ..operators.dense import dense_range_doppler
from ..plans.contracts import RadarCapture, RangeDopplerRecipe
from ..plans.runners import adc_to_range_doppler, check_capture
from ..sources.files import read_range, regular_size, strict_json
from ..sources.radar_cfg import parse_capture

HEADER, HEADER_BYTES, PREFIX_BYTES = "<8sHHHHQQQQ32s", 80, 48
SESSION, CONFIG, FRAME, COMMIT, ABORT = 1, 2, 3, 4, 5
NAMES = {SESSION: "SESSION", CONFIG: "RADAR_CONFIG", FRAME: "FRAME", COMMIT: "COMMIT", ABORT: "ABORT"}
#: Largest payload of each kind.
MOST = {SESSION: 64 << 10, CONFIG: 1 << 20, FRAME: 64 << 20, COMMIT: 4 << 10, ABORT: 4 << 10}


#: Counters that a stream starts at 0.
ORIGINS = ("record_sequence_origin", "frame_index_origin", "adc_byte_offset_origin")


class StreamError(ValueError):
    """The stream is malformed, damaged or incomplete."""


class StreamAborted(RuntimeError):
    """The producer ended the stream without a commit."""


@dataclass(frozen=True)
class StreamFormat:
    magic: bytes = b"RADSTRM1"
    domain: bytes = b"capture_stream.record.v1\0"


@dataclass(frozen=True)
class Record:
    kind: int
    sequence: int
    item: int
    payload: bytes


def pack_record(r: Record, fmt: StreamFormat = StreamFormat()) -> bytes:
    prefix = struct.pack("<8sHHHHQQQQ", fmt.magic, 1, HEADER_BYTES, r.kind, 0, r.sequence, r.item, len(r.payload), 0)
    return prefix + hashlib.sha256(fmt.domain + prefix + r.payload).digest() + r.payload


def unpack_header(data: bytes, fmt: StreamFormat) -> tuple[int, int, int, int, bytes]:
    """(kind, sequence, item, payload size, digest)."""
    magic, major, size, kind, flags, sequence, item, length, reserved, digest = struct.unpack(HEADER, data)
    if magic != fmt.magic or major != 1 or size != HEADER_BYTES or flags or reserved:
        raise StreamError("unknown record header")
    if kind not in NAMES or length > MOST[kind]:
        raise StreamError("unknown kind or a payload beyond its limit")
    return kind, sequence, item, length, digest


def check_digest(header: bytes, payload: bytes, digest: bytes, fmt: StreamFormat) -> None:
    if hashlib.sha256(fmt.domain + header[:PREFIX_BYTES] + payload).digest() != digest:
        raise StreamError("a record's digest differs")


@dataclass
class CaptureMachine:
    """The order of records: SESSION, RADAR_CONFIG, FRAME ..., COMMIT or ABORT. ``accept`` fails on any other."""

    session: dict | None = None
    config: bytes | None = None
    frames: int = 0
    adc: object = field(default_factory=hashlib.sha256)
    adc_bytes: int = 0
    sequence: int = 0
    outcome: str | None = None
    broken: str | None = None

    def accept(self, r: Record) -> None:
        if self.broken:
            raise StreamError(self.broken)
        try:
            self._accept(r)
        except StreamError as e:
            self.broken = str(e)
            raise
        except (KeyError, TypeError, ValueError) as e:
            self.broken = f"{NAMES[r.kind]}: {e}"
            raise StreamError(self.broken) from e

    def _accept(self, r: Record) -> None:
        if self.outcome:
            raise StreamError("data after the terminal record")
        expected = {0: {SESSION}, 1: {CONFIG}}.get(self.sequence, {FRAME, COMMIT, ABORT})
        if r.kind not in expected:
            raise StreamError(f"{NAMES[r.kind]} is out of order")
        if r.sequence != self.sequence or r.item != self.frames:
            raise StreamError("not the next sequence or item number")
        self.sequence += 1
        if r.kind == SESSION:
            self.session = strict_json(r.payload)
            shape = self.session["capture"]
            if not (shape["frame_count"] > 0 and 0 < shape["frame_bytes"] <= MOST[FRAME] and shape["frame_bytes"] % 2 == 0):
                raise StreamError("SESSION declares no frames")
            if shape["expected_bytes"] != shape["frame_count"] * shape["frame_bytes"] or any(shape[o] for o in ORIGINS):
                raise StreamError("SESSION contradicts itself")
        elif r.kind == CONFIG:
            want = self.session["radar_config"]
            if len(r.payload) != want["size_bytes"] or hashlib.sha256(r.payload).hexdigest() != want["sha256"]:
                raise StreamError("RADAR_CONFIG differs from SESSION")
            self.config = r.payload
        elif r.kind == FRAME:
            if self.frames >= self.session["capture"]["frame_count"] or len(r.payload) != self.session["capture"]["frame_bytes"]:
                raise StreamError("FRAME differs from SESSION")
            self.adc.update(r.payload)  # type: ignore[attr-defined]
            self.adc_bytes += len(r.payload)
            self.frames += 1
        else:
            end = strict_json(r.payload)
            evidence = (end["stream_id"], end["outcome"], end["frames"], end["adc_bytes"], end["adc_sha256"])
            if evidence != (self.session["stream_id"], NAMES[r.kind].lower(), self.frames, self.adc_bytes, self.adc.hexdigest()):  # type: ignore[attr-defined]
                raise StreamError("the terminal record differs from the stream")
            if r.kind == COMMIT and self.frames != self.session["capture"]["frame_count"]:
                raise StreamError("COMMIT before all frames")
            self.outcome = "commit" if r.kind == COMMIT else "abort"


class CaptureStream:
    """Pull-driven reader of a caller's binary source: ``contract``, then ``frames``, then ``require_commit``."""

    def __init__(self, source: BinaryIO, fmt: StreamFormat = StreamFormat()):
        self.source, self.fmt, self.machine, self.held = source, fmt, CaptureMachine(), None
        self.stage = "new"

    def _exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            more = self.source.read(n - len(out))
            if not more:
                self.machine.broken = "the stream ended within a record"
                raise StreamError(self.machine.broken)
            out += more
        return out

    def _next(self) -> Record:
        if self.machine.broken:
            raise StreamError(self.machine.broken)
        header = self._exactly(HEADER_BYTES)
        try:
            kind, sequence, item, length, digest = unpack_header(header, self.fmt)
            payload = self._exactly(length)
            check_digest(header, payload, digest, self.fmt)
        except StreamError as e:
            self.machine.broken = str(e)
            raise
        record = Record(kind, sequence, item, payload)
        self.machine.accept(record)
        return record

    def contract(self) -> dict:
        if self.stage != "new":
            raise RuntimeError("the contract has been read")
        self._next()
        self._next()
        self.stage = "frames"
        return self.machine.session

    def radar_capture(self) -> RadarCapture:
        """The capture that the stream's command file sets up; it must agree with SESSION."""
        s = self.machine.session
        shape = s["capture"]
        out = parse_capture(self.machine.config.decode(), s["adc"]["layout"], s["hardware"]["family"])
        if out.num_frames != shape["frame_count"] or 2 * out.adc.words != shape["frame_bytes"]:
            self.machine.broken = "the command file differs from SESSION"
            raise StreamError(self.machine.broken)
        return out

    def frames(self) -> Iterator[tuple[int, np.ndarray]]:
        """(index, words) of every declared frame, once; provisional until the commit."""
        if self.stage != "frames":
            raise RuntimeError("frames follow the contract, once")
        self.stage = "reading"
        for i in range(self.machine.session["capture"]["frame_count"]):
            record = self._next()
            if record.kind == ABORT:
                raise StreamAborted(json.loads(record.payload).get("reason_code"))
            if record.kind != FRAME:
                raise StreamError("the stream ended before all frames")
            yield i, np.frombuffer(record.payload, "<i2")
        self.stage = "read"

    def require_commit(self) -> dict:
        """The commit's evidence; nothing may follow it."""
        if self.stage != "read":
            raise RuntimeError("the commit follows all frames")
        record = self._next()
        if self.source.read(1):
            self.machine.broken = "data after the terminal record"
            raise StreamError(self.machine.broken)
        self.stage = "done"
        if record.kind == ABORT:
            raise StreamAborted(json.loads(record.payload).get("reason_code"))
        return json.loads(record.payload)


# --- streaming source

RECORDS = "stream_id string, sequence bigint, kind string, item_index bigint, payload binary"


class RecordStreamReader(SimpleDataSourceStreamReader):
    """Reads the whole records that a growing file has gained; the offset is the file position."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.fmt = StreamFormat(options.get("magic", "RADSTRM1").encode(), bytes.fromhex(options["domain_hex"]) if "domain_hex" in options else StreamFormat().domain)
        self.most = int(options.get("max_records", 1000))

    def initialOffset(self):
        return {"at": 0}

    def _records(self, at: int, stop: int | None):
        size = regular_size(self.path)
        limit = size if stop is None else min(size, stop)
        n = 0
        while at + HEADER_BYTES <= limit and (stop is not None or n < self.most):
            header = read_range(self.path, at, HEADER_BYTES)
            kind, sequence, item, length, digest = unpack_header(header, self.fmt)
            if at + HEADER_BYTES + length > limit:
                break
            payload = read_range(self.path, at + HEADER_BYTES, length)
            check_digest(header, payload, digest, self.fmt)
            at, n = at + HEADER_BYTES + length, n + 1
            yield at, (self.path, sequence, NAMES[kind], item, payload)

    def read(self, start):
        rows, at = [], start["at"]
        for at, row in self._records(start["at"], None):
            rows.append(row)
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start, end):
        return iter([row for _, row in self._records(start["at"], end["at"])])


class RecordStreamSource(DataSource):
    """Format ``record_stream``: options path, magic, domain_hex, max_records."""

    @classmethod
    def name(cls):
        return "record_stream"

    def schema(self):
        return RECORDS

    def simpleStreamReader(self, schema):
        return RecordStreamReader(dict(self.options))


def read_record_stream(spark: SparkSession, path: str, fmt: StreamFormat = StreamFormat(), max_records: int = 1000) -> DataFrame:
    """An unbounded table of records as a stream file grows."""
    spark.dataSource.register(RecordStreamSource)
    return (
        spark.readStream.format("record_stream").option("magic", fmt.magic.decode()).option("domain_hex", fmt.domain.hex()).option("max_records", max_records).load(path)
    )


# --- records as tables


def provisional_frames(records: DataFrame) -> DataFrame:
    """(stream_id, frame_id, samples, provisional) of the frames seen so far, on a batch or a stream."""
    frames = records.filter(F.col("kind") == "FRAME")
    return frames.select("stream_id", F.col("item_index").alias("frame_id"), words_from_bytes(F.col("payload")).alias("samples"), F.lit(True).alias("provisional"))


_OUTCOME = "stream_id string, outcome string, frames bigint, adc_bytes bigint, adc_sha256 string, problem string"


def stream_outcomes(records: DataFrame) -> DataFrame:
    """One row per stream: commit, abort, open (no terminal record yet) or broken, with the evidence or the problem.

    Records of a stream are sorted into one partition and pass through the state machine one by one, so memory
    does not grow with a stream.
    """

    def run(batches):
        current, machine, out = None, None, []

        def close():
            state = "broken" if machine.broken else machine.outcome or "open"
            out.append((current, state, machine.frames, machine.adc_bytes, machine.adc.hexdigest(), machine.broken))

        kinds = {v: k for k, v in NAMES.items()}
        for batch in batches:
            for stream, sequence, kind, item, payload in zip(*[batch.column(i) for i in range(5)]):
                name = stream.as_py()
                if machine is None or name != current:
                    if machine is not None:
                        close()
                    current, machine = name, CaptureMachine()
                if not machine.broken:
                    try:
                        machine.accept(Record(kinds[kind.as_py()], sequence.as_py(), item.as_py(), payload.as_buffer().to_pybytes()))
                    except StreamError:
                        pass  # the machine keeps the problem
        if machine is not None:
            close()
        if out:
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _OUTCOME.split(", ")])

    ordered = records.select("stream_id", "sequence", "kind", "item_index", "payload").repartition("stream_id").sortWithinPartitions("stream_id", "sequence")
    return ordered.mapInArrow(run, _OUTCOME)


def committed_frames(records: DataFrame) -> DataFrame:
    """Frames of committed streams alone."""
    done = stream_outcomes(records).filter(F.col("outcome") == "commit").select("stream_id")
    return provisional_frames(records).join(done, "stream_id", "left_semi").withColumn("provisional", F.lit(False))


def stream_range_doppler(records: DataFrame, recipe: RangeDopplerRecipe, capture: RadarCapture | None = None) -> DataFrame:
    """The recipe over provisional frames of a batch or stream, frame by frame: (stream_id, frame_id, re, im)."""
    if capture is not None:
        check_capture(recipe, capture)
    frames = provisional_frames(records).select(F.concat_ws("#", "stream_id", "frame_id").alias("capture_id"), "samples")
    out = dense_range_doppler(frames, recipe).frames()
    at = F.substring_index("capture_id", "#", -1)
    return out.select(F.expr("substring(capture_id, 1, length(capture_id) - length(substring_index(capture_id, '#', -1)) - 1)").alias("stream_id"), at.cast("bigint").alias("frame_id"), "re", "im")


def batch_range_doppler(records: DataFrame, recipe: RangeDopplerRecipe):
    """The same as a long-form cube, for committed frames."""
    frames = committed_frames(records).select(F.concat_ws("#", "stream_id", "frame_id").alias("capture_id"), "samples")
    return adc_to_range_doppler(frames, recipe)


def _forget_streams(spark, records_at: str, ended_at: str, epoch: int) -> None:
    """Delete the staged records of streams that ended before this epoch."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    system = path(ended_at).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(ended_at)):
        return
    for status in system.listStatus(path(ended_at)):
        if int(status.getPath().getName().removeprefix("epoch=")) < epoch:
            for r in spark.read.schema("stream_id string").parquet(status.getPath().toString()).collect():
                system.delete(path(f"{records_at}/stream_id={escape(r.stream_id)}"), True)
            system.delete(status.getPath(), True)


def publish_commits(records: DataFrame, staging: str, published: str, checkpoint: str):
    """A streaming query that stages records by stream and publishes a stream's frames once, when its COMMIT has come.

    An epoch reads only the streams that it ends. Their records are deleted by the next epoch, which starts when
    this one is committed; until then a repeated epoch finds them again.
    """
    records_at, ended_at = f"{staging}/records", f"{staging}/ended"

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        _forget_streams(spark, records_at, ended_at, epoch)
        # a repeated epoch replaces its own folders
        staged = df.withColumn("epoch", F.lit(epoch))
        staged.write.partitionBy("stream_id", "epoch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(records_at)
        ended = df.filter(F.col("kind").isin("COMMIT", "ABORT")).groupBy("stream_id").agg(F.max(F.col("kind") == "COMMIT").alias("commit"))
        ended = {r.stream_id: r.commit for r in ended.collect()}  # the streams that end in this epoch
        if not ended:
            return
        spark.createDataFrame([(s,) for s in sorted(ended)], "stream_id string").coalesce(1).write.mode("overwrite").parquet(f"{ended_at}/epoch={epoch}")
        if done := [s for s, commit in ended.items() if commit]:
            whole = spark.read.schema(staged.schema).parquet(records_at).filter(F.col("stream_id").isin(done)).select(df.columns)
            committed_frames(whole).write.mode("overwrite").parquet(f"{published}/epoch={epoch}")

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
