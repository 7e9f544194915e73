"""Lossless codecs for chunks of int16 frames, on the driver, in Arrow stages, and partly as expressions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CODECS = ("raw", "zlib", "shuffle-zlib", "frame-delta-shuffle-zlib", "adaptive-shuffle-zlib")
#: First byte of an adaptive chunk.
PLAIN, DELTA = 0, 1


def shuffle(data: bytes) -> bytes:
    """All low bytes, then all high bytes."""
    if len(data) % 2:
        raise ValueError("an odd number of bytes")
    return data[0::2] + data[1::2]


def unshuffle(data: bytes) -> bytes:
    if len(data) % 2:
        raise ValueError("an odd number of bytes")
    out = np.empty(len(data), np.uint8)
    half = len(data) // 2
    out[0::2], out[1::2] = np.frombuffer(data, np.uint8, half), np.frombuffer(data, np.uint8, half, half)
    return out.tobytes()


def _frames(data: bytes, frame_bytes: int) -> np.ndarray:
    if frame_bytes <= 0 or frame_bytes % 2 or not data or len(data) % frame_bytes:
        raise ValueError("not whole frames")
    return np.frombuffer(data, "<u2").reshape(-1, frame_bytes // 2)


def delta(data: bytes, frame_bytes: int) -> bytes:
    """Each frame less the one before it, modulo 2^16; the first as it is."""
    x = _frames(data, frame_bytes)
    return np.concatenate([x[:1], x[1:] - x[:-1]]).astype("<u2").tobytes()


def undelta(data: bytes, frame_bytes: int) -> bytes:
    return np.cumsum(_frames(data, frame_bytes), axis=0, dtype=np.uint16).astype("<u2").tobytes()


def inflate(data: bytes, size: int | None = None) -> bytes:
    """One whole stream of exactly ``size`` bytes, nothing after it."""
    z = zlib.decompressobj()
    out = z.decompress(data)
    if not z.eof or z.unused_data:
        raise ValueError("cut off, or data after the stream")
    if size is not None and len(out) != size:
        raise ValueError("another length than declared")
    return out


def encode(data: bytes, codec: str, frame_bytes: int, level: int = 1) -> bytes:
    if codec == "raw":
        return data
    if codec == "zlib":
        return zlib.compress(data, level)
    plain = zlib.compress(shuffle(data), level) if codec != "frame-delta-shuffle-zlib" else b""
    if codec == "shuffle-zlib":
        return plain
    if codec == "adaptive-shuffle-zlib" and len(data) == frame_bytes:
        return bytes([PLAIN]) + plain
    changed = zlib.compress(shuffle(delta(data, frame_bytes)), level)
    if codec == "frame-delta-shuffle-zlib":
        return changed
    if codec != "adaptive-shuffle-zlib":
        raise ValueError(f"unknown codec {codec}")
    return bytes([DELTA]) + changed if len(changed) < len(plain) else bytes([PLAIN]) + plain


def decode(data: bytes, codec: str, frame_bytes: int) -> bytes:
    if codec == "raw":
        return data
    if codec == "zlib":
        return inflate(data)
    if codec == "shuffle-zlib":
        return unshuffle(inflate(data))
    if codec == "frame-delta-shuffle-zlib":
        return undelta(unshuffle(inflate(data)), frame_bytes)
    if codec != "adaptive-shuffle-zlib":
        raise ValueError(f"unknown codec {codec}")
    if not data or data[0] not in (PLAIN, DELTA):
        raise ValueError("an adaptive chunk without its tag")
    words = unshuffle(inflate(data[1:]))
    return words if data[0] == PLAIN else undelta(words, frame_bytes)


def transform_column(df: DataFrame, column: str, kind: str, codec: str, frame_bytes: int, level: int = 1) -> DataFrame:
    """``df`` with a binary column encoded or decoded (``kind``) batch by batch."""
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            cells = [c.as_buffer().to_pybytes() for c in batch.column(at)]
            made = [encode(c, codec, frame_bytes, level) if kind == "encode" else decode(c, codec, frame_bytes) for c in cells]
            columns = list(batch.columns)
            columns[at] = pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def shuffle_expr(data: Column) -> Column:
    """``shuffle`` as an expression over the bytes in hexadecimal."""
    h = F.hex(data)
    at = F.sequence(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int") - 1)
    low = F.transform(at, lambda i: F.substring(h, i * 4 + 1, F.lit(2)))
    high = F.transform(at, lambda i: F.substring(h, i * 4 + 3, F.lit(2)))
    return F.when(F.octet_length(data) == 0, data).otherwise(F.unhex(F.array_join(F.concat(low, high), "")))


def frame_delta(words: DataFrame, chunk: list[str], frame: str, index: str, word: str, out: str = "delta") -> DataFrame:
    """``delta`` on one row per word: a lag over the frames of a chunk, modulo 2^16."""
    before = F.lag(word).over(Window.partitionBy(*chunk, index).orderBy(frame))
    return words.withColumn(out, F.pmod(F.col(word) - F.coalesce(before, F.lit(0)), F.lit(65536)))


# --- chunked storage and its measurement


def write_chunks(frames: DataFrame, path: str, codec: str, frame_bytes: int, chunk_frames: int = 4, level: int = 1) -> None:
    """Frames (capture_id, frame_id, data) in chunks of consecutive frames, encoded, as a table sorted by frame."""
    chunk = F.floor(F.col("frame_id") / chunk_frames).alias("chunk")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "data"))), lambda x: x["data"])
    chunks = frames.groupBy("capture_id", chunk).agg(F.count(F.lit(1)).alias("n_frames"), F.unhex(F.array_join(F.transform(ordered, F.hex), "")).alias("data"))
    transform_column(chunks, "data", "encode", codec, frame_bytes, level).sortWithinPartitions("capture_id", "chunk").write.parquet(path)


def read_window(spark, path: str, codec: str, frame_bytes: int, capture_id, first: int, stop: int, chunk_frames: int = 4) -> DataFrame:
    """(frame_id, data) of a window of frames; only its chunks are read and decoded."""
    rows = spark.read.parquet(path).filter((F.col("capture_id") == capture_id) & F.col("chunk").between(first // chunk_frames, (stop - 1) // chunk_frames))
    plain = transform_column(rows.select("chunk", "n_frames", "data"), "data", "decode", codec, frame_bytes)
    parts = plain.select("chunk", "data", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("i"))
    out = parts.select((F.col("chunk") * chunk_frames + F.col("i")).alias("frame_id"), F.substring("data", F.col("i").cast("int") * frame_bytes + 1, F.lit(frame_bytes)).alias("data"))
    return out.filter(F.col("frame_id").between(first, stop - 1))


def window_starts(seed: int, windows: int, frames: int, length: int) -> list[int]:
    """Reproducible random window starts."""
    return np.random.default_rng(seed).integers(0, frames - length + 1, windows).tolist()


def latency_report(times: DataFrame, by: tuple[str, ...] = ("codec",)) -> DataFrame:
    """Median and 95th percentile of (by..., seconds)."""
    return times.groupBy(*by).agg(F.percentile("seconds", F.lit(0.5)).alias("p50"), F.percentile("seconds", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))
