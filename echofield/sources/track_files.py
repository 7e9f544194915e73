"""Track vectors in type-length-value frames, and JSON records of track frames."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed values of the format: the types of point and target lists, and their records.
POINTS, TARGETS = 6, 7
POINT, TARGET = "<4f", "<I6f"


def tlv_frames(data: bytes) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(frame number, points (range, azimuth, doppler, snr), targets (id, x, y, vx, vy, ax, ay))."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("cut off in a frame header")
        number, n = struct.unpack_from("<II", data, at)
        at += 8
        found: dict[int, bytes] = {}
        for _ in range(n):
            if len(data) - at < 8:
                raise ValueError("cut off in a header")
            kind, length = struct.unpack_from("<II", data, at)
            body = data[at + 8 : at + 8 + length]
            if len(body) < length:
                raise ValueError("cut off in a value")
            if kind in found:
                raise ValueError(f"frame {number} repeats type {kind}")
            found[kind], at = body, at + 8 + length
        for kind, record in ((POINTS, POINT), (TARGETS, TARGET)):
            if len(found.get(kind, b"")) % struct.calcsize(record):
                raise ValueError("a list is not whole records")
        yield number, list(struct.iter_unpack(POINT, found.get(POINTS, b""))), list(struct.iter_unpack(TARGET, found.get(TARGETS, b"")))


_ROW = pa.schema([
    ("path", pa.string()), ("frame_id", pa.int64()), ("kind", pa.string()), ("idx", pa.int32()), ("id", pa.int64()),
    ("values", pa.list_(pa.float64())),
])


def read_tlv(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_id, kind, idx, id, values) of every point and target; a frame without any has kind ``empty``."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, points, targets in tlv_frames(data.as_buffer().to_pybytes()):
                    out = [(name, number, "point", i, None, list(p)) for i, p in enumerate(points)]
                    out += [(name, number, "target", i, t[0], list(t[1:])) for i, t in enumerate(targets)]
                    out = out or [(name, number, "empty", 0, None, [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, frame_id bigint, kind string, idx int, id bigint, values array<double>")


def tlv_points(rows: DataFrame) -> DataFrame:
    """Points in Cartesian coordinates, as the measurement tracker takes them; empty frames keep a row with a null point."""
    v = lambda i: F.get("values", F.lit(i))
    point = F.col("kind") == "point"
    per_frame = rows.withColumn("__p", F.max(point.cast("int")).over(Window.partitionBy("path", "frame_id")))
    kept = per_frame.filter(point | (F.col("__p") == 0)).dropDuplicates(["path", "frame_id", "kind", "idx"])
    return kept.select(
        F.col("path").alias("capture_id"), "frame_id", F.when(point, F.col("idx")).alias("point_idx"),
        F.when(point, v(0) * F.sin(v(1))).alias("x"), F.when(point, v(0) * F.cos(v(1))).alias("y"), F.when(point, F.lit(0.0)).alias("z"),
        F.when(point, v(2)).alias("velocity"), F.when(point, v(3)).alias("snr"),
    )


def tlv_truth(rows: DataFrame) -> DataFrame:
    v = lambda i: F.get("values", F.lit(i))
    return rows.filter("kind = 'target'").select(F.col("path").alias("capture_id"), "frame_id", F.col("id").alias("truth_id"), v(0).alias("x"), v(1).alias("y"), F.lit(0.0).alias("z"))


# --- JSON records

RECORD = "version int, frame_id bigint, tracks array<struct<track_id:bigint,position:array<double>,velocity:array<double>,pos_cov:array<array<double>>,ext_cov:array<array<double>>,status:string,age:int,missed:int>>"


def track_records(tracks: DataFrame, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(keys..., frame_id, record): one JSON object a frame, tracks by id; numbers must be finite."""
    numbers = ["px", "py", "pz", "vx", "vy", "vz"]
    finite = None
    for c in numbers:
        ok = ~F.isnan(c) & (F.abs(c) < math.inf)
        finite = ok if finite is None else finite & ok
    checked = tracks.withColumn("px", F.when(finite, F.col("px")).otherwise(F.raise_error(F.lit("a number is not finite")).cast("double")))
    one = F.struct("track_id", F.array("px", "py", "pz").alias("position"), F.array("vx", "vy", "vz").alias("velocity"), "pos_cov", "ext_cov", "status", "age", "missed")
    frames = checked.groupBy(*keys, "frame_id").agg(F.array_sort(F.collect_list(one)).alias("tracks"))
    return frames.select(*keys, "frame_id", F.to_json(F.struct(F.lit(1).alias("version"), "frame_id", "tracks")).alias("record"))


def tracks_from_records(records: DataFrame, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """The tracks of records; a damaged record is an error."""
    parsed = records.select(*keys, F.from_json("record", RECORD, {"mode": "FAILFAST"}).alias("r")).filter(
        F.when(F.col("r.version") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("unknown record version")).cast("boolean"))
    )
    rows = parsed.select(*keys, "r.frame_id", F.explode("r.tracks").alias("t"))
    p, v = F.col("t.position"), F.col("t.velocity")
    return rows.select(
        *keys, "frame_id", "t.track_id", p[0].alias("px"), p[1].alias("py"), p[2].alias("pz"), v[0].alias("vx"), v[1].alias("vy"), v[2].alias("vz"),
        "t.pos_cov", "t.ext_cov", "t.status", "t.age", "t.missed",
    )
