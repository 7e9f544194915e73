"""ADC words to complex cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.contracts import AdcFrame
from .cube import Cube, partitioned


def word_positions(spec: AdcFrame, cell: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(chirp, rx, sample, position of I, position of Q) of a frame's cell number, by arithmetic alone."""
    c, r, s = spec.chirps, spec.rx, spec.samples
    whole = lambda x, n: F.floor(x / n).cast("int")
    if spec.layout == "group4_i_then_q":
        # 8-word groups of 4 I and 4 Q; within a chirp, sample by sample and receiver by receiver
        chirp, within = whole(cell, r * s), cell % (r * s)
        i = whole(cell, 4) * 8 + cell % 4
        return chirp, within % r, whole(within, r), i, i + 4
    chirp, rx, sample = whole(cell, r * s), whole(cell, s) % r, cell % s
    if spec.layout == "iq_interleaved":
        return chirp, rx, sample, cell * 2, cell * 2 + 1
    if spec.layout == "sample_i_then_q":
        base = (chirp * s + sample) * 2 * r
        return chirp, rx, sample, base + rx, base + r + rx
    # group2: I0 I1 Q0 Q1 for each pair of samples
    i = (chirp * r + rx) * 2 * s + whole(sample, 2) * 4 + sample % 2
    return chirp, rx, sample, i, i + 2


def organize_adc_samples(raw: DataFrame, spec: AdcFrame, drop_incomplete: bool = False) -> Cube:
    """Cells of all complete frames in rows of (capture_id, samples array).

    A row holds one or more frames; words beyond the last complete frame are an error unless dropped, and so is a
    row without a complete frame. No shuffle by cells: each frame is expanded where it lies.
    """
    n = spec.words
    size = F.size("samples")
    ok = (size >= n) if drop_incomplete else (size >= n) & (size % n == 0)
    checked = partitioned(raw.select("capture_id", "samples"), ("capture_id",)).withColumn(
        "__frames", F.when(ok, F.floor(size / n)).otherwise(F.raise_error(F.lit("incomplete ADC frame"))).cast("int")
    )
    frames = checked.select("capture_id", "samples", F.explode(F.sequence(F.lit(0), F.col("__frames") - 1)).alias("frame"))
    cells = frames.select("capture_id", "frame", "samples", F.explode(F.sequence(F.lit(0), F.lit(n // 2 - 1))).alias("cell"))
    chirp, rx, sample, i, q = word_positions(spec, F.col("cell"))
    base = F.col("frame") * n
    df = cells.select(
        "capture_id",
        "frame",
        chirp.alias("chirp"),
        rx.cast("int").alias("rx"),
        sample.cast("int").alias("sample"),
        F.get("samples", (base + i).cast("int")).cast("double").alias("re"),
        F.get("samples", (base + q).cast("int")).cast("double").alias("im"),
    )
    return Cube(df, {"chirp": spec.chirps, "rx": spec.rx, "sample": spec.samples})


def frames_from_words(words: DataFrame) -> DataFrame:
    """(capture_id, samples) from one row per word (capture_id, word_index, word)."""
    pairs = F.array_sort(F.collect_list(F.struct("word_index", "word")))
    return words.groupBy("capture_id").agg(pairs.alias("w")).select("capture_id", F.transform("w", lambda x: x["word"]).alias("samples"))


def words_from_bytes(data: Column) -> Column:
    """Little-endian int16 words of a binary column."""
    hexed = F.hex(data)
    at = F.sequence(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int") - 1)
    word = F.transform(at, lambda i: F.conv(F.concat(F.substring(hexed, i * 4 + 3, F.lit(2)), F.substring(hexed, i * 4 + 1, F.lit(2))), 16, 10).cast("int"))
    return F.when(
        F.octet_length(data) % 2 == 0,
        F.when(F.octet_length(data) > 0, F.transform(word, lambda w: (w - F.when(w >= 32768, 65536).otherwise(0)).cast("smallint"))).otherwise(F.array().cast("array<smallint>")),
    ).otherwise(F.raise_error(F.lit("odd number of bytes")))
