"""Capture datagrams: parsing, reordering, loss statistics, and exact frame assembly.

A datagram holds a 10-byte header (u32 packet number, u48 byte count, little-endian) and int16 samples. Packet
numbers wrap at 2^32, byte counts at 2^48.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.contracts import require
from .adc import words_from_bytes

NUMBER_WRAP, COUNT_WRAP = 1 << 32, 1 << 48
#: Samples of a full datagram: 1456 bytes.
PAYLOAD_WORDS = 728


def unsigned_le(data: Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer of ``size`` bytes (at most 7) at offset ``at``."""
    hexed = F.hex(F.substring(data, at + 1, size))
    swapped = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("bigint")


def parse_packets(raw: DataFrame, data: str = "data") -> DataFrame:
    """Adds packet_number, byte_count and payload (array of words); a short or odd datagram is an error."""
    d = F.col(data)
    whole = F.octet_length(d) >= 10
    rows = raw.withColumn("__d", F.when(whole, d).otherwise(F.raise_error(F.lit("datagram without a header")).cast("binary")))
    body = F.substring("__d", 11, 1 << 30)
    return rows.withColumns({
        "packet_number": unsigned_le(F.col("__d"), 0, 4),
        "byte_count": unsigned_le(F.col("__d"), 4, 6),
        "payload": words_from_bytes(body),
    }).drop("__d")


def classify_packets(packets: DataFrame, start: int, n: int, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Adds slot (number relative to the start, modulo 2^32) and fate: kept, duplicate or out_of_frame.

    The first arrival of a number is kept.
    """
    require(n > 0, "a frame needs packets")
    slot = F.pmod(F.col("packet_number") - start, F.lit(NUMBER_WRAP))
    first = F.row_number().over(Window.partitionBy(*keys, "packet_number").orderBy("arrival"))
    rows = packets.withColumn("slot", slot).withColumn("__first", first)
    fate = F.when(F.col("slot") >= n, "out_of_frame").when(F.col("__first") > 1, "duplicate").otherwise("kept")
    return rows.withColumn("fate", fate).drop("__first")


def packet_slots(packets: DataFrame, n: int, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Every slot of every capture: (keys..., slot)."""
    return packets.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("slot"))


def missing_packets(packets: DataFrame, start: int, n: int, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(keys..., packet_number) of slots without a packet."""
    kept = classify_packets(packets, start, n, keys).filter(F.col("fate") == "kept").select(*keys, "slot")
    gaps = packet_slots(packets, n, keys).join(kept, [*keys, "slot"], "left_anti")
    return gaps.select(*keys, F.pmod(F.col("slot") + start, F.lit(NUMBER_WRAP)).alias("packet_number"))


def packet_loss(packets: DataFrame, start: int, n: int, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Counts and sorted lists of missing, duplicate and out-of-frame packets of each capture."""
    rows = classify_packets(packets, start, n, keys)

    def listed(fate: str) -> Column:
        hits = F.collect_list(F.when(F.col("fate") == fate, F.struct("arrival", "packet_number")))
        return F.transform(F.array_sort(hits), lambda x: x["packet_number"]).alias(fate)

    counted = rows.groupBy(*keys).agg(F.count_if(F.col("fate") == "kept").alias("received"), listed("duplicate"), listed("out_of_frame"))
    gaps = missing_packets(packets, start, n, keys).withColumn("slot", F.pmod(F.col("packet_number") - start, F.lit(NUMBER_WRAP)))
    lost = gaps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "packet_number"))), lambda x: x["packet_number"]).alias("missing"))
    empty = F.array().cast("array<bigint>")
    return counted.join(lost, list(keys), "left").select(*keys, F.lit(n).alias("expected"), "received", F.coalesce("missing", empty).alias("missing"), "duplicate", "out_of_frame")


def reorder_packets(packets: DataFrame, start: int, n: int, fill: int = 0, width: int | None = None, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(keys..., samples): payloads in order of packet number, missing ones filled.

    The width is given or the longest payload of all the capture's packets; shorter payloads are filled up,
    longer ones cut.
    """
    rows = classify_packets(packets, start, n, keys)
    longest = rows.groupBy(*keys).agg((F.lit(width) if width else F.max(F.size("payload"))).alias("__width"))
    kept = rows.filter(F.col("fate") == "kept").select(*keys, "slot", "payload")
    slots = packet_slots(packets, n, keys).join(kept, [*keys, "slot"], "left").join(longest, list(keys))
    filler = F.array_repeat(F.lit(fill).cast("smallint"), F.col("__width"))
    full = F.slice(F.concat(F.coalesce("payload", F.array().cast("array<smallint>")), filler), F.lit(1), F.col("__width"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", full.alias("p"))))
    return slots.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x["p"])).alias("samples"))


def assemble_frames(packets: DataFrame, origin: int, n: int, words: int = PAYLOAD_WORDS, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(keys..., samples) of captures of exactly ``n`` contiguous packets; any contradiction is an error.

    Byte counts must be origin + i * bytes for i = 0..n-1 (modulo 2^48), payloads of ``words`` words, and packet
    numbers contiguous (modulo 2^32) in that order.
    """
    size = words * 2
    relative = F.pmod(F.col("byte_count") - origin, F.lit(COUNT_WRAP))
    w = Window.partitionBy(*keys).orderBy("__rel", "arrival")
    rows = packets.withColumn("__rel", relative).withColumns({
        "__i": F.row_number().over(w) - 1,
        "__gap": F.pmod(F.col("packet_number") - F.lag("packet_number").over(w), F.lit(NUMBER_WRAP)),
    })
    ok = (F.col("__rel") == F.col("__i") * size) & (F.size("payload") == words) & (F.col("__gap").isNull() | (F.col("__gap") == 1))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "payload")))
    frames = rows.groupBy(*keys).agg(ordered.alias("__p"), F.count(F.lit(1)).alias("__n"), F.min(ok.cast("int")).alias("__ok"))
    exact = (F.col("__n") == n) & (F.col("__ok") == 1)
    samples = F.when(exact, F.flatten(F.transform("__p", lambda x: x["payload"]))).otherwise(F.raise_error(F.lit("packets do not form one contiguous frame")).cast("array<smallint>"))
    return frames.select(*keys, samples.alias("samples"))


def take_frame(packets: DataFrame, n: int, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """The first ``n`` packets of each capture in order of arrival; fewer are an error."""
    w = Window.partitionBy(*keys)
    rows = packets.withColumns({"__i": F.row_number().over(w.orderBy("arrival")), "__n": F.count(F.lit(1)).over(w)})
    checked = rows.withColumn("__i", F.when(F.col("__n") >= n, F.col("__i")).otherwise(F.raise_error(F.lit("the source ended within a frame")).cast("int")))
    return checked.filter(F.col("__i") <= n).drop("__i", "__n")
