"""Headerless int16 ADC files, and capture directories around them.

``spark.read.format("adc_frames")`` reads frames by range: partitions are frame ranges, a filter on frame_id selects
them before anything is read, and only the columns of a frame row are made.
"""

from __future__ import annotations

import hmac
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.adc import organize_adc_samples, words_from_bytes
from ..operators.cube import Cube
from ..plans.contracts import AdcFrame, RadarCapture, RangeDopplerRecipe, require
from ..plans.runners import adc_to_range_doppler, check_capture
from .files import locate, read_all, regular_size, sha256_of, strict_json
from .radar_cfg import parse_capture

FRAME_SCHEMA = "capture_id string, frame_id bigint, ts double, samples array<smallint>"
#: Bytes that one partition reads.
PARTITION_BYTES = 64 << 20


class FrameRange:
    """Bounds on frame_id, narrowed by pushed filters."""

    def __init__(self):
        self.first, self.stop = 0, None

    def narrow(self, f) -> bool:
        v = getattr(f, "value", None)
        if getattr(f, "attribute", None) != ("frame_id",) or v is None:
            return False
        low = {EqualTo: v, GreaterThanOrEqual: v, GreaterThan: v + 1}.get(type(f))
        high = {EqualTo: v + 1, LessThan: v, LessThanOrEqual: v + 1}.get(type(f))
        if low is None and high is None:
            return False
        if low is not None:
            self.first = max(self.first, low)
        if high is not None:
            self.stop = high if self.stop is None else min(self.stop, high)
        return True


@dataclass
class Frames(InputPartition):
    first: int
    stop: int

    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


def split_frames(bounds: FrameRange, total: int, frame_bytes: int) -> list[Frames]:
    stop = total if bounds.stop is None else min(total, bounds.stop)
    step = max(1, PARTITION_BYTES // frame_bytes)
    return [Frames(a, min(stop, a + step)) for a in range(bounds.first, stop, step)]


def frame_batch(capture_id: str, frame_id: int, period: float | None, samples: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int16())]
    values = [[capture_id], [frame_id], [None if period is None else frame_id * period], [samples]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["capture_id", "frame_id", "ts", "samples"])


class AdcFramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.words = int(options["frame_words"])
        self.period = float(options["period_s"]) if options.get("period_s") else None
        self.bounds = FrameRange()
        size = regular_size(self.path)
        if size % 2:
            raise ValueError("an odd byte at the end of the file")
        if not size // (2 * self.words) or (size % (2 * self.words) and options.get("drop_incomplete", "false") != "true"):
            raise ValueError("the file does not hold whole frames")
        self.total = size // (2 * self.words)

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.narrow(f):
                yield f

    def partitions(self):
        return split_frames(self.bounds, self.total, 2 * self.words)

    def read(self, partition):
        system, name = locate(self.path)
        with system.open_input_file(name) as f:
            for i in range(partition.first, partition.stop):
                data = f.read_at(2 * self.words, 2 * self.words * i)
                yield frame_batch(self.path, i, self.period, np.frombuffer(data, "<i2"))


class AdcFramesSource(DataSource):
    """Format ``adc_frames``: options path, frame_words, period_s, drop_incomplete."""

    @classmethod
    def name(cls):
        return "adc_frames"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return AdcFramesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AdcFramesSource)


def load_adc_file(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, samples): a whole file as one vector of words, no shape checked."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("capture_id"), words_from_bytes(F.col("content")).alias("samples"))


def load_adc_cube(spark: SparkSession, path: str, spec: AdcFrame, drop_incomplete: bool = False) -> Cube:
    return organize_adc_samples(load_adc_file(spark, path), spec, drop_incomplete)


def read_frames(spark: SparkSession, path: str, spec: AdcFrame, period_s: float | None = None, drop_incomplete: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format("adc_frames").option("frame_words", spec.words).option("drop_incomplete", str(drop_incomplete).lower())
    if period_s is not None:
        reader = reader.option("period_s", repr(period_s))
    return reader.load(path)


@dataclass(frozen=True)
class Capture:
    """A capture directory whose sizes and digests have been checked."""

    path: str
    contract: RadarCapture
    manifest: dict
    config: str
    num_frames: int

    @property
    def adc_path(self) -> str:
        return f"{self.path}/adc.bin"

    def frames(self, spark: SparkSession, start: int = 0, stop: int | None = None) -> DataFrame:
        rows = read_frames(spark, self.adc_path, self.contract.adc, self.contract.frame_periodicity_s)
        rows = rows.filter(F.col("frame_id") >= start) if start else rows
        return rows if stop is None else rows.filter(F.col("frame_id") < stop)

    def range_doppler(self, spark: SparkSession, recipe: RangeDopplerRecipe, start: int = 0, stop: int | None = None) -> Cube:
        """The recipe over a range of frames, keyed by (capture_id = frame_id, frame = 0)."""
        check_capture(recipe, self.contract)
        raw = self.frames(spark, start, stop).select(F.col("frame_id").alias("capture_id"), "samples")
        return adc_to_range_doppler(raw, recipe)

    def revalidate(self) -> None:
        """Fail if the directory has changed since it was opened."""
        check_files(self.path, self.manifest)


def check_files(path: str, manifest: dict) -> None:
    adc, cfg = manifest["adc"], manifest["radar_config"]
    require(regular_size(f"{path}/adc.bin") == adc["size_bytes"], "adc.bin has another size")
    require(hmac.compare_digest(sha256_of(f"{path}/adc.bin"), adc["sha256"]), "adc.bin has another digest")
    require(hmac.compare_digest(sha256_of(f"{path}/radar.cfg"), cfg["sha256"]), "radar.cfg has another digest")


def open_capture(path: str, schema: str | None = None, with_adc: bool = True) -> Capture:
    """Open ``capture.json``, ``adc.bin`` and ``radar.cfg``; ``schema`` is the manifest's expected schema name.

    Without ``with_adc`` only metadata is opened, as after the ADC file has been archived.
    """
    path = path.rstrip("/")
    manifest = strict_json(read_all(f"{path}/capture.json", 1 << 20))
    require(schema is None or manifest.get("schema") == schema, "the manifest has another schema")
    adc, cfg = manifest.get("adc"), manifest.get("radar_config")
    require(isinstance(adc, dict) and isinstance(cfg, dict), "the manifest names no files")
    require(adc.get("path") == "adc.bin" and cfg.get("path") == "radar.cfg", "files have fixed names")
    require(isinstance(adc.get("size_bytes"), int) and adc["size_bytes"] > 0 and adc["size_bytes"] % 2 == 0, "the ADC size must be positive and even")
    if with_adc:
        check_files(path, manifest)
    text = read_all(f"{path}/radar.cfg", 1 << 20).decode()
    contract = parse_capture(text, adc.get("layout", "group2_i_then_q"), manifest["hardware"]["family"])
    frame_bytes = 2 * contract.adc.words
    require(adc["size_bytes"] % frame_bytes == 0, "adc.bin does not hold whole frames")
    frames = adc["size_bytes"] // frame_bytes
    require(contract.num_frames in (None, frames), "the command file plans another number of frames")
    return Capture(path, contract, manifest, text, frames)
